"""Snapshots: bars that are validated, written once, hashed and sealed.

A snapshot is a folder under a store: bars and instruments as Parquet, partition-free
and immutable, and one manifest row that says CREATED, SEALED or FAILED. Every state is a
folder of its own that is written once, so a reader never sees a half-written manifest and the
second of two writers of one state fails.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidBars, SnapshotError
from ..schema import BARS, INSTRUMENTS, canonical_json, validate_schema

_PRICES = ("open", "high", "low", "close")


def clean(bars: DataFrame) -> DataFrame:
    """Bars under the fixed schema, prices to 8 places. Texts of timestamps are parsed."""
    x = validate_schema(bars, BARS)
    return x.select("instrument_id", "ts_utc", *[F.round(c, 8).alias(c) for c in _PRICES], "volume")


def violations(bars: DataFrame) -> dict[str, int]:
    """Counts of what sealing refuses, in one pass and one duplicate check."""
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    finite = F.lit(True)
    for c in _PRICES:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    bounds = (F.col("high") >= F.greatest("open", "low", "close")) & (F.col("low") <= F.least("open", "high", "close"))
    r = bars.agg(
        F.count(F.lit(1)).alias("n"), bad(F.col("instrument_id").isNull() | F.col("ts_utc").isNull()).alias("missing_key"), bad(~finite).alias("not_finite"), bad(finite & ~bounds).alias("ohlc"),
        bad(F.date_trunc("second", "ts_utc").cast("timestamp_ntz") != F.col("ts_utc")).alias("sub_second"),
    ).first()
    out = {k: int(v) for k, v in r.asDict().items() if k != "n" and v}
    if not r.n:
        out["empty"] = 1
    twice = bars.groupBy("instrument_id", "ts_utc").count().where("count > 1").count()
    return {**out, "duplicate": twice} if twice else out


def default_instruments(bars: DataFrame) -> DataFrame:
    ids = bars.select("instrument_id").distinct()
    return ids.select("instrument_id", F.col("instrument_id").alias("symbol"), F.lit("USD").alias("currency"), F.lit("EQUITY").alias("asset_class"), F.lit(1.0).alias("multiplier"), F.lit(0.01).alias("tick_size"), F.lit(None).cast("string").alias("meta_json"))


def _folded(rows: DataFrame, keys: list[str], at: str, value: str, between: str, block: int) -> DataFrame:
    """(keys, ``at`` // block, h): each block's values in order, joined and hashed."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda r: r[value]), between)
    return rows.groupBy(*keys, F.floor(F.col(at) / block).alias("b")).agg(F.sha2(joined, 256).alias("h"))


def _number(c: str, places: int) -> Column:
    return F.coalesce(F.regexp_replace(F.format_number(c, places), ",", ""), F.lit("NA"))


def content_hash(bars: DataFrame, places: int = 8, block: int = 10_000, instruments: DataFrame | None = None) -> DataFrame:
    """One row: a SHA-256 in levels, at each of which at most ``block`` digests are together.

    Lines of bars are numbered within an instrument, so all instruments are hashed side by side: blocks of
    lines, blocks of their digests, and one digest for the instrument (``block`` cubed lines at
    most), then blocks of instruments in order. Lines of ``instruments`` stand before.
    """
    w = Window.partitionBy("instrument_id").orderBy("ts_utc")
    line = F.concat_ws("|", "instrument_id", F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), *[_number(c, places) for c in (*_PRICES, "volume")])
    x = bars.select("instrument_id", line.alias("line"), (F.row_number().over(w) - 1).alias("rn"))
    h = _folded(x, ["instrument_id"], "rn", "line", "\n", block)
    for _ in range(2):
        h = _folded(h, ["instrument_id"], "b", "h", "", block)
    rows = h.select(F.lit(1).alias("part"), "instrument_id", "h")
    if instruments is not None:
        text = [F.coalesce(c, F.lit("NA")) for c in ("instrument_id", "symbol", "currency", "asset_class")]
        said = F.concat_ws("|", *text, _number("multiplier", places), _number("tick_size", places), F.coalesce("meta_json", F.lit("NA")))
        rows = rows.unionByName(instruments.select(F.lit(0).alias("part"), "instrument_id", F.sha2(said, 256).alias("h")))
    # One row for each instrument is numbered here.
    rows = rows.select("h", (F.row_number().over(Window.orderBy("part", "instrument_id", "h")) - 1).alias("rn"))
    h = _folded(rows, [], "rn", "h", "", block)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda r: r["h"]), "")
    return h.agg(F.sha2(whole, 256).alias("snapshot_hash"))


def fetch(bars: DataFrame, universe: list[str], start, end) -> DataFrame:
    """Bars of a universe between two times, both included; the filters reach the scan."""
    return bars.where(F.col("instrument_id").isin(*universe) & F.col("ts_utc").between(F.lit(str(start)).cast("timestamp_ntz"), F.lit(str(end)).cast("timestamp_ntz")))


def latest(bars: DataFrame, n: int, asof=None) -> DataFrame:
    x = bars if asof is None else bars.where(F.col("ts_utc") <= F.lit(str(asof)).cast("timestamp_ntz"))
    w = Window.partitionBy("instrument_id").orderBy(F.desc("ts_utc"))
    return x.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def yahoo_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Bars of several symbols, each from its own table or all from one with a column for each."""
    if not tables:
        raise InvalidBars("no symbols")
    out = None
    for symbol, wide in tables.items():
        got = yahoo_bars(wide, symbol)
        out = got if out is None else out.unionByName(got)
    return out


def yahoo_bars(wide: DataFrame, symbol: str) -> DataFrame:
    """Bars from columns such as ``SYM.Open``, or plain ``Open``, next to ``Date``."""
    find = {c.split(".")[-1].lower(): c for c in wide.columns if c.startswith(f"{symbol}.") or "." not in c}
    missing = [c for c in ("date", *_PRICES, "volume") if c not in find]
    if missing:
        raise InvalidBars(f"{symbol} lacks {', '.join(missing)}")
    col = lambda c: F.col(f"`{find[c]}`")
    return wide.select(F.lit(symbol).alias("instrument_id"), col("date").cast("timestamp_ntz").alias("ts_utc"), *[col(c).cast("double").alias(c) for c in (*_PRICES, "volume")])


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV: ISO times that end in Z only; a byte order mark is dropped."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnsRenamed({c: re.sub("^\ufeff", "", c).strip() for c in raw.columns})
    missing = [c for c in ("instrument_id", "ts_utc", *_PRICES) if c not in raw.columns]
    if missing:
        raise InvalidBars(f"missing columns: {', '.join(missing)}")
    bad = raw.where(~F.col("ts_utc").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") | F.col("ts_utc").isNull())
    if not bad.isEmpty():
        raise InvalidBars("ts_utc must be ISO with Z")
    volume = F.col("volume") if "volume" in raw.columns else F.lit(None)
    ts = F.to_timestamp_ntz(F.regexp_replace("ts_utc", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return raw.select("instrument_id", ts.alias("ts_utc"), *[F.col(c).cast("double").alias(c) for c in _PRICES], volume.cast("double").alias("volume"))


def read_instruments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Instruments from CSV: ids must be there and differ; other columns may be left out, and
    take the defaults of ``default_instruments``."""
    raw = spark.read.csv(path, header=True)
    raw = raw.withColumnsRenamed({c: re.sub("^\ufeff", "", c).strip() for c in raw.columns})
    if "instrument_id" not in raw.columns:
        raise InvalidBars("missing columns: instrument_id")
    plain = default_instruments(raw)
    given = [c for c in plain.columns[1:] if c in raw.columns]
    kinds = {f.name: f.dataType for f in INSTRUMENTS}
    out = raw.select("instrument_id", *[F.col(c).cast(kinds[c]).alias(f"_{c}") for c in given])
    if not out.where("instrument_id is null or instrument_id = ''").isEmpty():
        raise InvalidBars("an instrument without an id")
    if not out.groupBy("instrument_id").count().where("count > 1").isEmpty():
        raise InvalidBars("an instrument stands twice")
    for c in (c for c in given if isinstance(kinds[c], T.DoubleType)):
        if not raw.where(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).isEmpty():
            raise InvalidBars(f"{c} isn't a number")
    both = plain.join(out, "instrument_id")
    return both.select("instrument_id", *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in plain.columns[1:]])


def new_id() -> str:
    return f"snapshot_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:4]}"


@dataclass(frozen=True)
class Snapshot:
    store: "SnapshotStore"
    snapshot_id: str

    @property
    def path(self) -> str:
        return f"{self.store.root}/snapshots/{self.snapshot_id}"

    def bars(self) -> DataFrame:
        return self.store.spark.read.schema(BARS).parquet(f"{self.path}/bars")

    def instruments(self) -> DataFrame:
        return self.store.spark.read.schema(INSTRUMENTS).parquet(f"{self.path}/instruments")

    def info(self) -> dict:
        return next((r.asDict() for r in self.store.manifest().where(F.col("snapshot_id") == self.snapshot_id).collect()), {})

    def summary(self) -> DataFrame:
        """Each instrument with its bars: count, first and last time; 0 and nulls without bars."""
        b = self.bars().groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))
        x = self.instruments().join(b, "instrument_id", "left")
        return x.select("instrument_id", "symbol", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), "first_ts", "last_ts")

    def attach(self, universe: list[str] | None = None, start=None, end=None, prefix: str = "snapshot") -> tuple[str, str]:
        """Temporary views of the bars and instruments of a universe and a time; the filters reach
        the scan. Returns their names, which ``close`` drops."""
        bars, ins = self.bars(), self.instruments()
        if universe is not None:
            bars, ins = (x.where(F.col("instrument_id").isin(*universe)) for x in (bars, ins))
        if start is not None:
            bars = bars.where(F.col("ts_utc") >= F.lit(str(start)).cast("timestamp_ntz"))
        if end is not None:
            bars = bars.where(F.col("ts_utc") <= F.lit(str(end)).cast("timestamp_ntz"))
        names = f"{prefix}_bars", f"{prefix}_instruments"
        bars.createOrReplaceTempView(names[0])
        ins.createOrReplaceTempView(names[1])
        return names

    def close(self, prefix: str = "snapshot") -> None:
        for name in ("bars", "instruments"):
            self.store.spark.catalog.dropTempView(f"{prefix}_{name}")


_MANIFEST = "snapshot_id string, status string, created_at string, sealed_at string, snapshot_hash string, n_bars long, n_instruments long, meta_json string, version long"


class SnapshotStore:
    """Snapshots under one root. The manifest is append-only; the last version of an id holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, *row) -> None:
        at = f"{self.root}/manifest/{row[0]}/{row[-1]}"
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").parquet(at)

    def manifest(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/*/*")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], _MANIFEST)
        w = Window.partitionBy("snapshot_id").orderBy(F.desc("version"))
        return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    def list(self, status: str | None = None) -> DataFrame:
        m = self.manifest().drop("version")
        return (m if status is None else m.where(F.col("status") == status)).orderBy("created_at", "snapshot_id")

    def create(self, snapshot_id: str | None = None, meta: dict | None = None) -> Snapshot:
        s = Snapshot(self, snapshot_id or new_id())
        if s.info():
            raise SnapshotError(f"{s.snapshot_id} exists")
        self._append(s.snapshot_id, "CREATED", datetime.now(timezone.utc).isoformat(), None, None, 0, 0, canonical_json(meta or {}), 1)
        return s

    def _created(self, s: Snapshot) -> dict:
        info = s.info()
        if info.get("status") != "CREATED":
            raise SnapshotError(f"{s.snapshot_id} is {info.get('status')}, not CREATED")
        return info

    def _instruments(self, s: Snapshot) -> DataFrame:
        try:
            return s.instruments()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], INSTRUMENTS)

    def import_instruments(self, s: Snapshot, instruments: DataFrame) -> None:
        """Adds instruments; one that is there already raises."""
        self._created(s)
        ins = validate_schema(instruments, INSTRUMENTS)
        again = ins.join(self._instruments(s), "instrument_id", "left_semi").select("instrument_id").limit(3).collect()
        if again:
            raise InvalidBars(f"instruments are there already: {', '.join(r.instrument_id for r in again)}")
        ins.write.mode("append").parquet(f"{s.path}/instruments")

    def import_instruments_csv(self, s: Snapshot, path: str) -> None:
        self.import_instruments(s, read_instruments_csv(self.spark, path))

    def import_bars(self, s: Snapshot, bars: DataFrame, instruments: DataFrame | None = None, validate: str = "fail_fast") -> None:
        """Adds bars. ``instruments`` are added before; without any in the snapshot each instrument
        of the bars gets the defaults. Under ``fail_fast`` bars of other instruments, and bars
        that sealing would refuse, raise here; under ``none`` only sealing looks."""
        if validate not in ("fail_fast", "none"):
            raise SnapshotError("validate is fail_fast or none")
        self._created(s)
        if instruments is not None:
            self.import_instruments(s, instruments)
        known, x = self._instruments(s), clean(bars)
        if known.isEmpty():
            default_instruments(x).write.mode("append").parquet(f"{s.path}/instruments")
            known = s.instruments()
        if validate == "fail_fast":
            bad = violations(x)
            orphans = x.join(known, "instrument_id", "left_anti").select("instrument_id").distinct().count()
            if orphans:
                bad["orphan_instrument"] = orphans
            if bad:
                self._fail(s, bad)
        x.write.mode("append").parquet(f"{s.path}/bars")

    def _fail(self, s: Snapshot, bad: dict) -> None:
        self._append(s.snapshot_id, "FAILED", s.info()["created_at"], None, None, 0, 0, canonical_json({"violations": bad}), 2)
        raise InvalidBars(f"{s.snapshot_id}: {bad}")

    def seal(self, s: Snapshot) -> str:
        """Validate, hash and seal; a sealed snapshot gives its hash again."""
        info = s.info()
        if info.get("status") == "SEALED":
            return info["snapshot_hash"]
        self._created(s)
        try:
            bars = s.bars()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            self._fail(s, {"empty": 1})
        bad = violations(bars)
        orphans = bars.join(s.instruments(), "instrument_id", "left_anti").select("instrument_id").distinct().count()
        if orphans:
            bad["orphan_instrument"] = orphans
        if bad:
            self._fail(s, bad)
        h, n = content_hash(bars, instruments=s.instruments()).first().snapshot_hash, bars.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("i")).first()
        self._append(s.snapshot_id, "SEALED", info["created_at"], datetime.now(timezone.utc).isoformat(), h, n.n, n.i, info["meta_json"], 2)
        return h

    def open(self, snapshot_id: str, verify: bool = False) -> Snapshot:
        s = Snapshot(self, snapshot_id)
        info = s.info()
        if info.get("status") != "SEALED":
            raise SnapshotError(f"{snapshot_id} is {info.get('status', 'unknown')}, not SEALED")
        if verify and content_hash(s.bars(), instruments=s.instruments()).first().snapshot_hash != info["snapshot_hash"]:
            raise SnapshotError(f"{snapshot_id} was changed after sealing")
        return s

    def from_df(self, bars: DataFrame, instruments: DataFrame | None = None, snapshot_id: str | None = None) -> Snapshot:
        s = self.create(snapshot_id)
        self.import_bars(s, bars, instruments)
        self.seal(s)
        return s

    def from_csv(self, path: str, snapshot_id: str | None = None) -> Snapshot:
        return self.from_df(read_bars_csv(self.spark, path), snapshot_id=snapshot_id)
