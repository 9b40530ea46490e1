"""Line deduplication over a whole corpus, with DataFrame operations only.

Lines are normalised, exploded and hashed; the documents per hash are counted; lines over
the threshold are dropped; each text is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, hash_pair, lower_ascii, materialise


def line_keys(text: Column) -> Column:
    """The keys of the lines of a text: stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, distinct_ids: bool = False
) -> DataFrame:
    """Drop lines whose key of at least ``min_chars`` code points is in at least
    ``min_docs`` documents, except in the document with the largest id that holds it.

    Returns the columns of ``docs``, the text with the other lines joined by newlines,
    and ``n_lines`` (before dropping) and ``n_dropped`` (both long); columns of these two
    names in the input are replaced. Whole texts are read.

    Null or empty text counts as one empty line and comes back as it was. Each row is one
    document; rows with the same id each count, and if theirs is the largest id, all of
    them keep the line. With ``distinct_ids`` rows with the same id are one document and count
    once, and rows without id don't count. A null id is less than any other, so a line is dropped from rows
    without id whenever a row with an id holds it; where only such rows hold it, it stays. An
    empty table gives an empty table. A line's hash has 128 bits.

    Shuffles: one pre-aggregated row for each key and task (with ``distinct_ids`` one for each key, id and task before); one row of 28 bytes for each
    long line; the text once, where documents lose lines and the set of those isn't small.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    long_keys = F.array_distinct(F.filter(line_keys(text), lambda k: F.char_length(k) >= min_chars))
    key = docs.select(F.col(f"`{id_col}`").alias("d"), F.explode(long_keys).alias("k"))
    h1, h2 = hash_pair(F.col("k"))
    counts = key.select("d", h1.alias("h1"), h2.alias("h2")).groupBy("h1", "h2").agg((F.count_distinct("d") if distinct_ids else F.count(F.lit(1))).alias("n"), F.max("d").alias("keep"))
    frequent = materialise(counts.where(F.col("n") >= min_docs).select("h1", "h2", "keep"), "lines")

    r1, r2 = hash_pair(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    lines = docs.select(F.col(f"`{id_col}`").alias("d"), r1.alias("r1"), r2.alias("r2"), F.posexplode(line_keys(text)).alias("p", "k")).where(
        F.char_length("k") >= min_chars
    )
    lines = lines.select("d", "r1", "r2", "p", h1.alias("h1"), h2.alias("h2"))
    lost = lines.join(frequent, ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("keep")))
    lost = materialise(lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("p")).alias("lost")), "lost")

    k1, k2, gone = (fresh(c, docs) for c in ("_row1", "_row2", "_lost"))
    lost = lost.select(F.col("r1").alias(k1), F.col("r2").alias(k2), F.col("lost").alias(gone))
    out = docs.withColumns({k1: r1, k2: r2}).join(lost.hint("shuffle_hash"), [k1, k2], "left")
    parts = F.split(text, "\n")
    # One pass over the positions, however many are lost: a set difference, not a search for each line.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return out.select(
        *[
            F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
