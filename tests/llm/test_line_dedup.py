import hashlib
from collections import defaultdict

from tidemark.llm.line_dedup import drop_repeated_lines

WS = "\x20\x09\x0a\x0b\x0c\x0d"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=5):
    seen = defaultdict(list)
    keys = [[x.strip(WS).translate(AZ) for x in (t or "").split("\n")] for _, t in rows]
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in set(ks):
            seen[k].append(i)
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        gone = [len(k) >= 40 and len(seen[k]) >= least and i != max((x for x in seen[k] if x is not None), default=None) for k in ks]
        left = [x for x, g in zip(lines, gone, strict=True) if not g]
        out.append((i, len(lines), sum(gone), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark):
    boiler = "This boiler plate line has é over forty code points."
    rows = [(i, f"own {i}\n \t{boiler.upper() if i % 2 else boiler}\x0b\ntail\n{boiler}") for i in range(8)]
    rows += [(7, rows[7][1]), (None, boiler), (None, None), (20, ""), (21, "\n\n"), (22, "É" * 39 + "\n" + "a" * 200_000)]
    rows += [(30 + i, "x" * 39) for i in range(6)]
    df = spark.createDataFrame([(i, t, "extra", 5, 6) for i, t in rows], "doc_id long, text string, _row1 string, n_lines int, H1 int")
    got = drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "_row1", "H1", "n_lines", "n_dropped"]
    had = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in got.collect()), key=str)
    assert had == brute(rows)
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_text_that_loses_most_of_its_lines(spark):
    shared = [f"line {i} of a passage that many documents hold in full" for i in range(3_000)]
    rows = [(i, "\n".join(x for k, x in enumerate(shared) for x in ([x] if i < 5 else [x, f"own {k}"]))) for i in range(6)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    had = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=str)
    assert had == brute(rows) and {r.doc_id: r.n_dropped for r in got} == {**dict.fromkeys(range(5), 3_000), 5: 0}


def test_repeated_rows_are_one_document(spark):
    few, many = "A line that two documents hold, over forty code points.", "A line that five documents hold, over forty code points."
    rows = [(7, f"{few}\n{many}")] * 4 + [(3, f"{few}\n{many}"), (4, many), (5, many), (6, many), (None, few)]
    got = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), distinct_ids=True).collect()
    had = sorted(((r.doc_id, r.n_dropped, r.text) for r in got), key=str)
    assert had == sorted([(7, 0, rows[0][1])] * 4 + [(3, 1, few), (4, 1, ""), (5, 1, ""), (6, 1, ""), (None, 0, few)], key=str)
