"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidConfig

#: Rows of a driver-made table that is broadcast at most.
SMALL = 100_000
#: Paths that this process has given out and not deleted.
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a temporary one is
    made and set, on a local master only: elsewhere executors wouldn't see it, and that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise InvalidConfig("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def stage(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet and read back: what follows, however often it reads
    it, starts there, and a lost executor costs only the tasks it ran. ``released`` leaves it if ``keep``."""
    path = new_path(df.sparkSession, tag)
    if keep:
        _PATHS.remove(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written to new paths inside it. The caller has by then written
    or collected what it needs of results that read these tables."""
    before = len(_PATHS)
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while len(_PATHS) > before:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
            path.getFileSystem(conf).delete(path, True)


def driver_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table made on the driver; up to ``SMALL`` rows it is broadcast to whatever it joins."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= SMALL else df
