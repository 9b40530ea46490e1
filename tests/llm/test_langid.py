from tidemark.llm import langid
from tidemark.llm.queries import op3_language_id


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    got = op3_language_id(spark, path).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_training_and_scores_against_a_plain_form(spark, monkeypatch):
    """Counts, priors and posterior of a naive Bayes written out n-gram by n-gram, on texts longer
    than a piece."""
    import numpy as np

    monkeypatch.setattr(langid, "PIECE", 64)
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("aábc dE." if i % 3 else "xyz d-é"), int(rng.integers(1, 400)))), ["one", "two", "two"][i % 3]) for i in range(30)]
    bits, smooth = 10, 0.5
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=bits, smoothing=smooth)

    def grams(text):
        p = langid._points(f"  {text}  ").astype(np.uint32)
        for n in range(1, 4):
            for i in range(len(p) - n + 1):
                if (p[i : i + n] != 32).any():
                    own = np.concatenate([p[i : i + n], np.full(2, 32, np.uint32)])
                    yield int({k: b for k, b, _ in langid._buckets(own, bits)}[n][0])

    counts = {k: np.full(1 << bits, smooth) for k in ("one", "two")}
    for _, t, lang in rows:
        for g in grams(t):
            counts[lang][g] += 1
    table = np.stack([np.log(counts[k] / counts[k].sum()) for k in ("one", "two")], axis=1)
    prior = np.log(np.array([11, 21]) / 32)
    assert model.langs == ("one", "two") and np.allclose(model.table, table, atol=1e-5) and np.allclose(model.prior, prior)
    for t, lang, score in zip([r[1] for r in rows], *model.predict([r[1] for r in rows]), strict=True):
        s = prior + sum(model.table[g].astype(float) for g in grams(t)) if langid._points(t).max() > 32 else prior
        assert lang == ("one", "two")[int(s.argmax())] and np.isclose(score, 1 / np.exp(s - s.max()).sum(), atol=1e-6)


def test_pieces_score_like_whole_texts():
    import numpy as np

    rng = np.random.default_rng(1)
    model = langid.Model(("a", "b"), np.log([0.5, 0.5]), rng.normal(size=(1 << 16, 2)).astype("float32") / 50, 16)
    texts = ["".join(rng.choice(list("abc d"), n)) for n in (1, 2, 3, 50, 400)]
    want = []
    for t in texts:
        p, s = langid._points(t + "  "), np.zeros(2)  # two spaces divide pieces
        for _, b, has in langid._buckets(p, 16):
            s += model.table[b[has]].sum(axis=0)
        want.append("ab"[int(s.argmax())] if (p != 32).any() else "und")
    assert model.predict(texts)[0] == want


def test_scores_do_not_depend_on_neighbours(monkeypatch):
    import numpy as np

    monkeypatch.setattr(langid, "PIECE", 16)
    rng = np.random.default_rng(2)
    model = langid.Model(("a", "b"), np.log([0.5, 0.5]), rng.normal(size=(1 << 16, 2)).astype("float32") / 50, 16, leads=True)
    texts = ["".join(rng.choice(list("abc d"), n)) for n in (1, 2, 3, 14, 15, 16, 17, 50, 400, 1, 2)]
    want = []
    for t in texts:
        p, s = langid._points(f"  {t}  ").astype(np.uint32), np.zeros(2)
        for n in range(1, 4):
            for i in range(len(p) - n + 1):
                if (p[i : i + n] != 32).any():
                    own = np.concatenate([p[i : i + n], np.full(2, 32, np.uint32)])
                    s += model.table[dict((k, b[0]) for k, b, _ in langid._buckets(own, 16))[n]]
        want.append(1 / np.exp(s - s.max()).sum() if (p != 32).any() else 0.0)
    assert np.allclose(model.predict(texts)[1], want, rtol=0, atol=1e-9)
    assert np.allclose(model.predict(texts[::-1])[1], want[::-1], rtol=0, atol=1e-9)


def test_odd_rows(spark):
    rows = [(1, "the house and the garden", "en"), (2, "der garten und das haus", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "xx"), (6, "x" * 1_300_000, None), (None, "und das", "de"), (1, "the house and the garden", "en")]
    df = spark.createDataFrame([(*r, "p", 0.1) for r in rows], "doc_id long, text string, lang string, _pred string, Score double")
    out = langid.identify(df, langid.train(df))
    assert out.columns == ["doc_id", "text", "lang", "_pred", "lang_pred", "score"]
    had = {r.doc_id: r.lang_pred for r in out.collect()}
    assert (had[1], had[2], had[None], had[3], had[4], had[5]) == ("en", "de", "de", "und", "und", "und") and had[6] in ("en", "de")
    assert langid.identify(df.limit(0), langid.train(df.limit(0))).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}
