"""Pieces that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import new_path, released, shared_dir
from ..storage import stage as materialise

__all__ = ["connected_components", "fresh", "hash_pair", "lower_ascii", "materialise", "new_path", "released", "settle", "shared_dir", "split_words"]

#: White space of the contracts: a space and the code points 9 to 13.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores appended until no column of ``frames`` is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settle(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with the columns ``cols``, each computed once a row.

    Catalyst copies an expression below every filter and into every projection that names
    it. It leaves what a generator gives alone, so here one generator gives all.
    """
    at = fresh("_settled", df)
    base = df.drop(*cols)
    out = df.select(*[F.col(f"`{c}`") for c in base.columns], F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias(at))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], *[F.col(at)[k].alias(k) for k in cols])


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased; every other code point stays."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Maximal runs of what isn't white space; an empty array for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values under unlike seeds: 128 bits together."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7919), *cols)


def connected_components(edges: DataFrame, a: str, b: str, tag: str = "cc") -> DataFrame:
    """Connected components of an undirected graph by alternating large and small stars.

    Every round replaces each node's links by links to the least node around it, until
    the edges are stars. The minimum is aggregated before the shuffle and the join that
    follows reads written tables, so adaptive execution splits the partitions of a hub.
    Rounds grow with the logarithm of the longest path; edges never multiply.
    Self-loops and edges with a null end are left out. Returns one row per node
    that has an edge: (node, component), component being the least node reached.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = materialise(e.where("u > v").distinct(), tag)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialise(large, tag)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, tag)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
