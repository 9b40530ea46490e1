import random
import re
from collections import defaultdict

from tidemark.llm import jaccard_join as j

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(AZ))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(sets):
        for k in {k for x in s for k in at[x] if k > i}:
            both = len(s & sets[k])
            if 100 * both >= 80 * len(s | sets[k]):
                up[root(k)] = root(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted((str(d), len(s), d if not s else min(least[root(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "g") for i, t in rows], "doc_id long, text string, r1 int, node string")
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in j.components(df).collect())


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    boiler = " ".join(f"b{i}" for i in range(30))
    rows = [(1000 + i, edited(rng, base, rng.choice([1, 2, 4, 6, 9, 12]))) for i in range(60)]
    rows += [(2000 + i, boiler + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 8, 60])))) for i in range(60)]
    for n in range(1, 24):  # small sets of every size, with one edit at the end, and extended
        w = [f"s{n}x{i}" for i in range(n)]
        rows += [(3000 + 10 * n, " ".join(w)), (3001 + 10 * n, " ".join([*w, "more"])), (3002 + 10 * n, " ".join([*w[:-1], "Other"])), (3003 + 10 * n, " ".join(w).upper())]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "é\x1c"), (5, "z " * 30_000), (5, "z " * 30_000), (None, "z z z z z"), (None, None), (6, rows[0][1]), (7, "other words are here now")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    kept = j.keep_one(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _row1 int"))
    assert kept.columns == ["doc_id", "text", "_row1"]
    want = {c for _, n, c in brute(rows) if n}
    got = [r.doc_id for r in kept.collect() if (r.text or "").strip()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_boundary_follows_cost():
    assert j.boundary({5: 10}, 1.0, 80) < j.boundary({5: 10, 10: 10}, 50.0, 80)
    assert j.subset_cost(10, 80) == 67 and j.prefix_size(10, 80) == 3
