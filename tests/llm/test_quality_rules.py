import re
from collections import Counter

from tidemark.llm import quality_rules as q
from tidemark.llm.queries import op1_quality_rules

SCHEMA = "doc_id long, text string, n_words string, _words int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = op1_quality_rules(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, sym, dup, rep = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep), r.doc_id
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert r.kept == (not r.base_failed and r.rule is None)


def test_odd_rows(spark):
    long = "x y z   " * 40_000
    period = " ".join("a b c d e f g h i".split() * 3)
    rows = [(1, None, "q", 1), (2, "", None, None), (3, long, "", 2), (3, long, "", 2), (None, "one\n\none\x0b\n", "c", 3), (5, period, "", 1), (6, "😀 é\tß" * 9, "", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = q.apply_rules(df, q.DecisionList(())).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "_words", *q.STATISTICS, "base_failed", "rule", "kept"}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    assert q.apply_rules(df.limit(0), q.DecisionList(())).count() == 0


def test_learns_conjunction_and_keeps_good():
    rows = [({"a": float(i % 10), "b": float(i % 7)}, i % 10 >= 8 and i % 7 >= 4) for i in range(2000)]
    rules = q.learn(rows)
    assert rules.rules
    for r, low in rows:
        assert any(all(c.holds(r) for c in rule) for rule in rules.rules) == low
    assert q.learn([]).rules == () and q.learn([({"a": 1.0}, True)]).rules == ()


def test_rules_agree_with_labels(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = op1_quality_rules(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("not kept").count() >= 0.8 * bad.count()
