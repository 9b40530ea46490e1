"""Exact deduplication as a stateful stream, with DataFrame operations only.

A streaming aggregation without watermark keeps one row of state for each text digest, on
disk in RocksDB and never expired: the stable identifier that stays, the place of its
content, and the number of rows. Files that arrive later are added under the same state
path. Digest hits are held against the full bytes.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, materialise, new_path, settle

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition takes megabytes ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text that is compared: A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def update_state(spark: SparkSession, path: str, state_path: str, *, id_col: str = "doc_id", text_col: str = "text", digest=sha256, bytes_per_trigger: int = 256 << 30) -> None:
    """Take the files under ``path`` that the state hasn't seen into it, and stop.

    A batch takes ``bytes_per_trigger`` of files at most. After a failure the next call
    goes on from the last batch that was committed. Files of any age are taken: by default the
    file source skips those that are seven days older than the newest one it has seen.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    # As a pattern that only this path fits, since a stream takes no single file by name.
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).option("maxFileAge", "36500d").parquet(f"{path[:-1]}[{path[-1]}]")
    place = F.struct(F.col(f"`{id_col}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    keyed = rows.select(digest(normalised(F.col(f"`{text_col}`"))).alias("digest"), place.alias("place"))
    state = keyed.groupBy("digest").agg(F.max("place").alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, _STATE):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path).trigger(availableNow=True).start()
        query.awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """(digest, keep, n): the keyed state after the last committed batch."""
    with _settings(spark, _STATE):
        got = spark.read.format("statestore").load(state_path)
        return materialise(got.select(F.col("key.*"), F.col("value.*")).toDF("digest", "keep", "n"), "state")


def deduplicate(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", state_path: str | None = None, digest=sha256) -> DataFrame:
    """All rows of the Parquet table at ``path``, with ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256`` and the place of the content that stays (``keep_file``,
    ``keep_row``). Columns of these names in the table are replaced.

    Of equal texts the row with the largest id stays; of rows with that id, the one that
    is last by file and place in it. A null id is less than any other. Null text counts as
    empty. Whole texts are hashed and compared; an empty table gives an empty table.

    The state must belong to this table alone: a state that doesn't count as many rows as the
    table has raises. Without ``state_path`` a new one is made in
    the shared folder.

    The least and the greatest text under each digest are found with pre-aggregation, so
    a group of any size sends one row a task; where they differ, digests clashed and the
    rows under these are grouped anew by digest and text.
    """
    state_path = state_path or new_path(spark, "dedup-state")
    update_state(spark, path, state_path, id_col=id_col, text_col=text_col, digest=digest)
    state = read_state(spark, state_path)
    docs = spark.read.parquet(path)
    counted, there = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], docs.count()
    if counted != there:
        raise RuntimeError(f"{state_path} counts {counted} rows; {path} has {there}")
    names = ("keep_id", "group_size", "kept", "text_sha256", "keep_file", "keep_row")
    own = [c for c in docs.columns if c.lower() not in names]
    base = docs.select(*[F.col(f"`{c}`") for c in own])
    d, at, n, keep, whole = (fresh(c, base) for c in ("_digest", "_place", "_n", "_keep", "_whole"))
    text = normalised(F.col(f"`{text_col}`"))
    place = F.struct(F.col(f"`{id_col}`").alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = docs.select(*[F.col(f"`{c}`") for c in own], place.alias(at))
    keyed = settle(placed, **{d: digest(text), "text_sha256": F.sha2(text, 256)})
    state = state.select(F.col("digest").alias(d), F.col("keep").alias(keep), F.col("n").alias(n))

    under = docs.select(text.alias("t")).groupBy(digest(F.col("t")).alias(d))
    clash = materialise(under.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select(d), "clash")
    if clash.isEmpty():
        joined = keyed.join(state, d, "left")
    else:
        sure = keyed.join(clash, d, "left_anti").join(state, d, "left")
        torn = keyed.withColumn(whole, text).join(clash, d, "left_semi")
        groups = torn.groupBy(d, whole).agg(F.max(at).alias(keep), F.count(F.lit(1)).alias(n))
        joined = sure.unionByName(torn.join(groups, [d, whole]).drop(whole))
    same = (F.col(f"{keep}.file") == F.col(f"{at}.file")) & (F.col(f"{keep}.row") == F.col(f"{at}.row"))
    return joined.select(
        *[F.col(f"`{c}`") for c in own],
        F.col(f"{keep}.id").alias("keep_id"),
        F.col(n).alias("group_size"),
        same.alias("kept"),
        "text_sha256",
        F.col(f"{keep}.file").alias("keep_file"),
        F.col(f"{keep}.row").alias("keep_row"),
    )
