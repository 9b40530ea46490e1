"""From targets to ledger events, by windows.

Right when targets don't read positions, cash, equity or earlier state: then the position is
the last target that a next open could fill. ``by`` names a run (none, or candidate columns); all
windows are partitioned by it and the instrument, and events are numbered pulse by pulse.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..schema import utc
from ..storage import driver_table
from .cost import Cost

#: Fixed value: the square root of the double precision epsilon; smaller changes aren't traded.
MIN_DELTA = 1.4901161193847656e-08


@dataclass(frozen=True)
class Opening:
    """Cash, positions and their cost basis before the first pulse; ``date`` stands on the
    opening rows of the ledger in place of the first pulse."""

    cash: float = 100_000.0
    positions: dict[str, float] = field(default_factory=dict)
    cost_basis: dict[str, float] = field(default_factory=dict)
    date: str | None = None

    def __post_init__(self):
        if self.date is not None:
            utc(self.date)
        if not 0 <= self.cash < float("inf"):
            raise InvalidConfig("opening cash must be a finite number of at least 0")
        for k, q in self.positions.items():
            if not 0 <= q < float("inf"):
                raise InvalidConfig(f"opening position of {k} must be a finite number of at least 0")
            if q and not 0 <= self.cost_basis.get(k, float("nan")) < float("inf"):
                raise InvalidConfig(f"opening position of {k} needs a cost basis")

    def held(self) -> dict[str, float]:
        return {k: float(q) for k, q in sorted(self.positions.items()) if q}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, q, float(self.cost_basis[k])) for k, q in self.held().items()]
        return driver_table(spark, rows, "instrument_id string, _open_qty double, _open_basis double")


def checked(target: Column) -> Column:
    """``target``; a null, NaN or infinite one fails the query, as it does in the fold."""
    good = target.isNotNull() & ~F.isnan(target) & (F.abs(target) < float("inf"))
    return F.when(good, target).otherwise(F.raise_error(F.lit("INVALID_TARGET: targets must be finite")).cast("double"))


def fills(targets: DataFrame, cost: Cost, opening: Opening = Opening(), by: tuple[str, ...] = ()) -> DataFrame:
    """Fills of a panel with a ``target`` column at the next bar's open.

    Returns ``by``, decision_ts, ts_utc (of the fill), instrument_id, side, qty, price, fee,
    cash_delta, position_delta. A change on the last bar has no next open and isn't filled:
    see ``unfilled``. An open that isn't over 0 can't fill either: the position stays, and
    the change is tried again at the next pulse. Targets that aren't finite fail the query.
    """
    d = _deltas(targets, opening, by).where("_fills")
    d = d.withColumn("side", F.when(F.col("_delta") > 0, "BUY").otherwise("SELL")).withColumn("qty", F.abs("_delta"))
    price, fee = cost.price_and_fee(F.col("side"), F.col("qty"), F.col("_open"))
    d = d.withColumn("price", price).withColumn("fee", fee)
    gross = F.col("qty") * F.col("price")
    cash = F.when(F.col("side") == "BUY", -(gross + F.col("fee"))).otherwise(gross - F.col("fee"))
    return d.select(*by, F.col("ts_utc").alias("decision_ts"), F.col("_ts").alias("ts_utc"), "instrument_id", "side", "qty", "price", "fee", cash.alias("cash_delta"), F.col("_delta").alias("position_delta"))


def _deltas(targets: DataFrame, opening: Opening, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by, "instrument_id").orderBy("ts_utc")
    held = opening.held()
    first = F.lit(0.0)
    for k, q in held.items():
        first = F.when(F.col("instrument_id") == k, F.lit(q)).otherwise(first)
    d = targets.withColumns({"target": checked(F.col("target").cast("double")), "_open": F.lead("open").over(w), "_ts": F.lead("ts_utc").over(w)})
    d = d.withColumn("_fills", F.coalesce(F.col("_open") > 0, F.lit(False)))
    was = F.last(F.when(F.col("_fills"), F.col("target")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("_delta", F.col("target") - F.coalesce(was, first)).where(F.abs("_delta") > MIN_DELTA)


def unfilled(targets: DataFrame, opening: Opening = Opening(), by: tuple[str, ...] = ()) -> DataFrame:
    """Changes on the last bar, which no later open can fill."""
    return _deltas(targets, opening, by).where(F.col("_ts").isNull()).select(*by, "ts_utc", "instrument_id", F.lit("LAST_BAR_NO_FILL").alias("warning"), F.col("_delta").alias("delta"))


def events(fills_: DataFrame, start, opening: Opening = Opening(), by: tuple[str, ...] = (), runs: DataFrame | None = None) -> DataFrame:
    """The append-only ledger: opening rows, then fills, with a dense ``event_seq``.

    Order is that of decisions, then instruments. Events are numbered within their pulse;
    a running total of the counts of a run's pulses, one row for each, says where a pulse starts.
    Opening rows stand before the first pulse of every run: those of ``runs`` (one row of
    ``by`` each, with a column ``start`` where runs start at unlike times), else those that have fills.
    """
    spark = fills_.sparkSession
    kinds = "event_type", "instrument_id", "side", "qty", "price", "fee", "cash_delta", "position_delta"
    rows = fills_.withColumn("event_type", F.lit("FILL")).select(*by, "decision_ts", "ts_utc", *kinds)
    held = opening.table(spark)
    if opening.held():
        if runs is None and by:
            runs = fills_.select(*by).distinct()
        at = F.lit(str(utc(opening.date))) if opening.date is not None else F.col("start") if runs is not None and "start" in runs.columns else F.lit(start)
        first = (held if runs is None else runs.crossJoin(held)).select(
            *by, F.lit(None).cast("timestamp_ntz").alias("decision_ts"), at.cast("timestamp_ntz").alias("ts_utc"), F.lit("CASHFLOW").alias("event_type"), "instrument_id",
            F.lit("BUY").alias("side"), F.col("_open_qty").alias("qty"), F.col("_open_basis").alias("price"), F.lit(0.0).alias("fee"), F.lit(0.0).alias("cash_delta"), F.col("_open_qty").alias("position_delta"),
        )
        rows = rows.unionByName(first)
    # Opening rows have no decision; as keys of a join nulls wouldn't meet.
    rows = rows.withColumn("decision_ts", F.coalesce("decision_ts", F.lit("0001-01-01").cast("timestamp_ntz")))
    pulse = (*by, "decision_ts")
    at = F.sum("_n").over(Window.partitionBy(*by).orderBy("decision_ts")) - F.col("_n")
    starts = rows.groupBy(*pulse).agg(F.count(F.lit(1)).alias("_n")).select(*pulse, at.alias("_at"))
    within = F.row_number().over(Window.partitionBy(*pulse).orderBy("instrument_id"))
    numbered = rows.withColumn("_k", within).join(starts, list(pulse))
    return numbered.withColumn("event_seq", (F.col("_at") + F.col("_k")).cast("long")).drop("decision_ts", "_k", "_at")
