"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Equal sets are one node. Nodes with few shingles are light: each enumerates its subsets of
the sizes that a link needs, and nodes that share one are candidates. Heavy nodes scan
inverted lists over the prefix of their set in an order that puts rare shingles first. The
boundary between light and heavy comes from the cost of both. Every candidate is held
against the full sets.

A list links its members to a leader first, the most central member. Only lists that are
still in several components afterwards compare members of different components with one
another, so a group of copies costs a number of comparisons in proportion to its size.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, fresh, hash_pair, materialise

#: Shingles that are told apart when the order is made: their number bounds what is broadcast.
MOST_FREQUENT = 500_000
#: Bits of the filter of shingles that come twice: it bounds what is broadcast.
MOST_BITS = 1 << 28
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``k`` words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(w))
    if not width:
        return w
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mix(h + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of linked sets of n and m shingles."""
    return -(-percent * (n + m) // (100 + percent))


def _partners(n: int, percent: int) -> range:
    return range(-(-n * percent // 100), n * 100 // percent + 1)


@cache
def subset_cost(n: int, percent: int) -> int:
    """How many subsets a light set of n shingles enumerates."""
    return sum(math.comb(n, overlap(n, m, percent)) for m in _partners(n, percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], mean_list: float, percent: int, most: int = 16) -> int:
    """The largest size at which enumerating costs no more than scanning, over all sets up
    to it; ``sizes`` counts sets by size, ``mean_list`` is the mean length of a list."""
    best = enumerated = scanned = 0
    for n in range(1, most + 1):
        enumerated += sizes.get(n, 0) * subset_cost(n, percent)
        scanned += sizes.get(n, 0) * prefix_size(n, percent) * max(mean_list, 1.0)
        if enumerated <= scanned:
            best = n
    return best


@cache
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(n), c)), np.int64)


def subset_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """A key for each subset of a light set that a link to some size of partner needs."""
    n, out = len(s), []
    for m in _partners(n, percent):
        picked = s[_choices(n, overlap(n, m, percent))]
        h = np.full(len(picked), min(n, m) * 1_000_003 + max(n, m), np.uint64)
        for i in range(picked.shape[1]):
            h = _mix(h + picked[:, i])
        out.append(h)
    return np.concatenate(out)


def _pack(v: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences of three bytes, or whole where one is too large."""
    d = np.diff(v, prepend=np.uint64(0))
    if len(d) and d.max() >= 1 << 24:
        return b"\4" + v.astype("<u4").tobytes()
    return b"\3" + np.ascontiguousarray(d.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if b[:1] == b"\4":
        return np.frombuffer(b, "<u4", offset=1).astype(np.uint64)
    d = np.frombuffer(b, np.uint8, offset=1).reshape(-1, 3).astype(np.uint64)
    return np.cumsum(d[:, 0] | d[:, 1] << np.uint64(8) | d[:, 2] << np.uint64(16), dtype=np.uint64)


def group_bits(documents: int) -> int:
    """So many groups of prints that each is that of some thousand documents, from 256 to 2^18:
    a group is merged in one task."""
    return min(18, max(8, (documents >> 12).bit_length()))


def shingle_counts(docs: DataFrame, k: int, groups_bits: int) -> DataFrame:
    """(g, repeated, counts, sums): for each group of shingle prints (32 bits and those of the group), the prints met
    in two sets or more, in how many, and sums over all. All documents are counted."""

    def prints(batches):
        held, size, seen = [], 0, set()

        def rows():
            v = np.sort(np.concatenate(held))
            at = np.searchsorted(v >> np.uint64(32), np.arange((1 << groups_bits) + 1, dtype=np.uint64))
            own = [(g, _pack(v[a:b] & np.uint64(0xFFFFFFFF))) for g, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_pydict({"g": pa.array([x[0] for x in own], pa.int32()), "blob": pa.array([x[1] for x in own], pa.binary())})

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), k)
                if len(s) and (node := _node(s)) not in seen:  # copies count once a task
                    seen.add(node)
                    held.append(s >> np.uint64(32 - groups_bits))
                    size += len(s)
            if size > 4_000_000:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    def merge(table: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([_unpack(b.as_py()) for b in table.column("blob")]))
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        n = np.diff(np.append(first, len(v)))
        more = n > 1
        rare = n[n <= 64]
        return pa.table({"g": pa.array([table.column("g")[0].as_py()], pa.int32()), "prints": pa.array([v[first][more].astype("<u4").tobytes()], pa.binary()), "counts": pa.array([n[more].astype("<u4").tobytes()], pa.binary()), "repeated": pa.array([int(more.sum())]), "n": pa.array([float(rare.sum())]), "n2": pa.array([float((rare.astype(float) ** 2).sum())])})

    got = docs.mapInArrow(prints, "g int, blob binary").groupBy("g").applyInArrow(merge, "g int, prints binary, counts binary, repeated long, n double, n2 double")
    return materialise(got, "prints")


def _filters(counts: DataFrame, groups_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """A bit filter of repeated prints, the most frequent prints with their counts, and the
    mean length of a list. Each group has a stretch of the filter to itself, so what reaches the driver is
    the filter, ``MOST_BITS`` at most, and the frequent prints, ``MOST_FREQUENT`` at most."""
    total = counts.agg(F.sum("repeated").alias("r"), F.sum("n").alias("n"), F.sum("n2").alias("n2")).first()
    repeated = total.r or 0
    bits = min(MOST_BITS, max(1 << max(16, groups_bits + 3), 1 << int(8 * repeated).bit_length()))
    own = bits >> groups_bits  # bits of a group's stretch, eight or more

    def powers(batches):
        out = np.zeros(64, np.int64)
        for b in batches:
            for c in b.column(0):
                out += np.bincount(np.frexp(np.frombuffer(c.as_py(), "<u4").astype(float))[1], minlength=64)[:64]
        yield pa.RecordBatch.from_pydict({"p": pa.array(range(64), pa.int32()), "c": out})

    table = {r.p: r.c for r in counts.select("counts").mapInArrow(powers, "p int, c long").groupBy("p").agg(F.sum("c").alias("c")).collect()}
    least, have = 64, 0
    while least > 3 and have + table.get(least - 1, 0) <= MOST_FREQUENT:
        least -= 1
        have += table.get(least, 0)

    def stretch(batches):
        for b in batches:
            for g, v, c in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                v, c = (np.uint64(g) << np.uint64(32)) | np.frombuffer(v, "<u4").astype(np.uint64), np.frombuffer(c, "<u4")
                set_ = np.zeros(own, np.uint8)
                set_[(_place(v, bits, groups_bits) & np.uint64(own - 1)).astype(np.int64)] = 1
                top = np.frexp(c.astype(float))[1] >= least
                yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int32()), "bits": pa.array([np.packbits(set_, bitorder="little").tobytes()], pa.binary()), "prints": pa.array([v[top].tobytes()], pa.binary()), "counts": pa.array([c[top].tobytes()], pa.binary())})

    filter_, top, of = np.zeros(bits >> 3, np.uint8), [], []
    for r in counts.select("g", "prints", "counts").mapInArrow(stretch, "g int, bits binary, prints binary, counts binary").toLocalIterator():
        filter_[r.g * (own >> 3) : (r.g + 1) * (own >> 3)] = np.frombuffer(r.bits, np.uint8)
        top.append(np.frombuffer(r.prints, "<u8"))
        of.append(np.frombuffer(r.counts, "<u4"))
    top, of = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((top, np.uint64), (of, np.uint32)))
    order = np.argsort(top)
    return filter_, top[order], of[order], (total.n2 or 0) / max(total.n or 0, 1)


def _place(prints: np.ndarray, bits: int, groups_bits: int) -> np.ndarray:
    """The bit of each print: its group's stretch, and a place in it."""
    own = np.uint64(bits >> groups_bits)
    return (prints >> np.uint64(32)) * own + (_mix(prints) & (own - np.uint64(1)))


def _sets(docs: DataFrame, k: int, percent: int, shared, groups_bits: int) -> DataFrame:
    """Per row: n, node and, for the first of equal sets in a task and if enough of its
    shingles come twice to have a link, the set and its centrality."""

    def run(batches):
        filter_, top, of = shared.value
        bits, seen = len(filter_) << 3, set()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                node = _node(s) if len(s) else None
                row = (len(s), node, None, None)
                if node and node not in seen:
                    seen.add(node)
                    v = s >> np.uint64(32 - groups_bits)
                    p = _place(v, bits, groups_bits)
                    twice = (filter_[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
                    if 100 * int(twice.sum()) >= percent * len(s):
                        at = np.minimum(np.searchsorted(top, v), max(len(top) - 1, 0))
                        df = np.where(top[at] == v, of[at], 1) if len(top) else np.ones(len(s))
                        row = (len(s), node, s.tobytes(), float(np.log2(df).mean()))
                out.append(row)
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["d", "r1", "r2", "n", "node", "shingles", "central"])

    schema = T.StructType([docs.schema["d"], *T.StructType.fromDDL("r1 long, r2 long, n long, node binary, shingles binary, central double").fields])
    return materialise(docs.mapInArrow(run, schema), "sets")


def _keys(sets: DataFrame, shared, light: int, percent: int, groups_bits: int) -> DataFrame:
    """(h, pos, node, n, central): subsets of light sets, and prefix shingles of the others with
    their place in the order. Light sets that may link with a heavy one are in both."""

    def run(batches):
        _, top, of = shared.value
        for batch in batches:
            nodes, keys, places, sizes, cent = [], [], [], [], []
            for node, b, c in zip(*[batch.column(x).to_pylist() for x in ("node", "shingles", "central")], strict=True):
                s = np.frombuffer(b, "<u8")
                n, own, pos = len(s), [], []
                if n <= light:
                    own.append(subset_keys(s, percent))
                    pos.append(np.zeros(len(own[-1]), np.int64))
                if 100 * n >= percent * (light + 1):
                    v = s >> np.uint64(32 - groups_bits)
                    at = np.minimum(np.searchsorted(top, v), max(len(top) - 1, 0))
                    df = np.where(top[at] == v, of[at], 0) if len(top) else np.zeros(n)
                    own.append(s[np.lexsort((s, df))[: prefix_size(n, percent)]])
                    pos.append(np.arange(len(own[-1])))
                keys += own
                places += pos
                k = sum(map(len, own))
                nodes += [node] * k
                sizes += [n] * k
                cent += [c] * k
            h = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            at = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"h": h, "pos": pa.array(at, pa.int64()), "node": pa.array(nodes, pa.binary()), "n": pa.array(sizes, pa.int64()), "central": pa.array(cent, pa.float64())})

    return sets.mapInArrow(run, "h long, pos long, node binary, n long, central double")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, both): sizes and intersection of the full sets of each pair."""

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                out.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            cols = list(zip(*out, strict=True)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(c, pa.int64()) for c in cols]], names=["a", "b", "na", "nb", "both"])

    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary, na long, nb long, both long")


def _links(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _in_reach(n: str, pos: str, m: str, at: str, percent: int):
    """Whether sets of n and m shingles whose first common one is at these places can link.

    What stands before the first common shingle isn't shared, so it must leave the
    least intersection. A pair that links is in the list of its first common shingle.
    """
    need = percent * (F.col(n) + F.col(m))
    return ((100 + percent) * (F.col(n) - F.col(pos)) >= need) & ((100 + percent) * (F.col(m) - F.col(at)) >= need)


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: (d, r1, r2, n, node, component): the id, a 128-bit key of id and
    text, the number of shingles, the class of equal sets, and the least id that links
    reach (null ids are left out of it; null if there is no other).

    A text without words has no node and is linked with nothing: its component is its id.
    With fewer than ``k`` words, the whole sequence is one shingle. Whole texts are read.
    """
    spark = docs.sparkSession
    groups_bits = group_bits(docs.count())
    text = F.col(f"`{text_col}`")
    r1, r2 = hash_pair(F.col(f"`{id_col}`"), text)
    base = docs.select(F.col(f"`{id_col}`").alias("d"), r1.alias("r1"), r2.alias("r2"), text.alias("text"))
    filter_, top, of, mean_list = _filters(shingle_counts(base.select("text"), k, groups_bits), groups_bits)
    shared = spark.sparkContext.broadcast((filter_, top, of))
    rows = _sets(base, k, percent, shared, groups_bits)
    heads = rows.where("shingles is not null").select("node", "n", "shingles", "central")
    sets = materialise(heads.groupBy("node").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.first("central").alias("central")), "nodes")
    sizes = {r.n: r["count"] for r in sets.where(F.col("n") <= 16).groupBy("n").count().collect()}
    light = boundary(sizes, mean_list, percent)
    posts = materialise(_keys(sets, shared, light, percent, groups_bits), "postings")

    lists = posts.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("central", "node", "n", "pos")).alias("lead")).where("m > 1")
    lists = materialise(lists.select("h", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos")), "lists")
    members = materialise(posts.join(lists, "h").select("h", "pos", "node", "n", "lead", "lead_n", "lead_pos"), "members")
    pairs = members.where(_in_reach("n", "pos", "lead_n", "lead_pos", percent)).select(F.col("lead").alias("a"), F.col("node").alias("b")).where("a != b").distinct()
    star = materialise(_measured(materialise(pairs, "pairs"), sets), "star")
    edges = materialise(_links(star, percent), "edges")
    comps = materialise(connected_components(edges, "a", "b", "near"), "near-comps")

    # Lists in several components: members of different ones are compared with each other,
    # unless their distances from the list's leader, which are known, exclude a link: the
    # Jaccard distance is a metric, so two members are at least as far apart as these differ.
    placed = members.join(comps, "node", "left").select("h", "pos", "node", "n", "lead", "lead_n", F.coalesce("component", "node").alias("c"))
    placed = materialise(placed, "placed")
    torn = materialise(placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("h"), "torn")
    left = placed.join(torn, "h")
    main = materialise(left.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("x")).select("h", F.col("x.c").alias("main")), "main")
    left = left.join(main, "h").withColumn("odd", F.col("c") != F.col("main"))
    known = star.select(F.col("a").alias("lead"), F.col("b").alias("node"), "both")
    apart = 1 - F.col("both") / (F.col("n") + F.col("lead_n") - F.col("both"))
    own = F.col("node") == F.col("lead")
    left = left.join(known, ["lead", "node"], "left").select(
        "h", "pos", "node", "n", "c", "odd",
        F.when(own, 0.0).otherwise(F.coalesce(apart, 1 - F.least("n", "lead_n") / F.greatest("n", "lead_n"))).alias("least"),
        F.when(own, 0.0).otherwise(F.coalesce(apart, F.lit(1.0))).alias("most"),
    )
    left = materialise(left, "left")
    a = left.where("odd").select("h", *[F.col(c).alias(f"{c}_a") for c in ("node", "pos", "n", "c", "least", "most")])
    b = left.select("h", "odd", *[F.col(c).alias(f"{c}_b") for c in ("node", "pos", "n", "c", "least", "most")])
    far = 1 - percent / 100 + 1e-9
    near = (F.col("least_a") - F.col("most_b") <= far) & (F.col("least_b") - F.col("most_a") <= far)
    once = ~F.col("odd") | (F.col("node_a") < F.col("node_b"))
    both = a.join(b, "h").where((F.col("c_a") != F.col("c_b")) & once & near & _in_reach("n_a", "pos_a", "n_b", "pos_b", percent))
    more = materialise(both.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct(), "cross-pairs")
    found = materialise(_links(_measured(more, sets), percent), "cross-edges")
    if not found.isEmpty():
        comps = materialise(connected_components(edges.unionByName(found), "a", "b", "near"), "near-comps")

    joined = rows.drop("shingles", "central").join(comps, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    joined = materialise(joined, "rooted")
    least = materialise(joined.where("root is not null").groupBy("root").agg(F.min("d").alias("component")), "least")
    out = joined.join(least, "root", "left")
    return out.select("d", "r1", "r2", "n", "node", "root", F.when(F.col("root").isNull(), F.col("d")).otherwise(F.col("component")).alias("component"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``) for each row, as ``link`` defines them. Null or
    empty text: no shingles, its own component. Rows with one id and unlike texts are each
    a document. An empty table gives an empty table."""
    got = link(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    return got.select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: that of the least id (null ids last), and of
    texts under that id the one of least key. Texts without words all stay. Rows equal in id and text are one
    document, and one of them stays."""
    got = link(docs, id_col=id_col, text_col=text_col, k=k, percent=percent)
    first = got.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("d").isNull(), "d", "r1", "r2")).alias("x"))
    stay = first.select("x.r1", "x.r2").unionByName(got.where("root is null").select("r1", "r2").distinct())
    k1, k2 = fresh("_row1", docs), fresh("_row2", docs)
    r1, r2 = hash_pair(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    stay = materialise(stay.toDF(k1, k2), "stay")
    return docs.withColumns({k1: r1, k2: r2}).join(stay, [k1, k2], "left_semi").dropDuplicates([k1, k2]).drop(k1, k2)
