"""Bars from rows with a time, a price and a volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CoverageError


def bars(rows: DataFrame, instrument: Column, pulse: Column, at: Column, price: Column, volume: Column) -> DataFrame:
    """OHLCV bars: one pre-aggregated row for each instrument and pulse leaves a task.

    Open and close are the prices of least and greatest (time, price), so ties can't make
    them depend on the order of rows. Prices are rounded to 8 places.
    """
    x = rows.select(instrument.alias("instrument_id"), pulse.alias("ts_utc"), at.alias("at"), price.alias("price"), volume.cast("double").alias("v"))
    r = lambda c: F.round(c, 8)
    first, last = F.min(F.struct("at", "price")), F.max(F.struct("at", "price"))
    return x.groupBy("instrument_id", "ts_utc").agg(
        r(first["price"]).alias("open"), r(F.max("price")).alias("high"), r(F.min("price")).alias("low"), r(last["price"]).alias("close"), F.sum("v").alias("volume")
    )


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trunc(unit: str, c: str) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def ptype_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").where("l_shipdate >= '1995-03-01' and l_shipdate < '2001-08-01'")
    rows = rows.join(_t(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return bars(rows, F.col("p_type"), _trunc("month", "l_shipdate"), F.col("l_shipdate"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"))


def event_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(_t(spark, sf_dir, "events"), F.col("event_type"), _trunc("day", "ts"), F.col("ts"), F.col("value"), F.lit(1))


def segment_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").where("o_orderdate < '2001-07-01'").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return bars(rows, F.col("c_mktsegment"), _trunc("quarter", "o_orderdate"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1))


def region_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").where("o_orderdate < '2001-07-01'").join(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    places = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    rows = rows.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return bars(rows, F.col("r_name"), _trunc("quarter", "o_orderdate"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1))


def priority_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with orders of each priority; on small data it has gaps."""
    return bars(_t(spark, sf_dir, "orders"), F.col("o_orderpriority"), _trunc("month", "o_orderdate"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1))


def ohlc_violations(panel: DataFrame) -> DataFrame:
    """Bars out of the OHLC bounds or off the whole second."""
    bad = (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))
    return panel.where(bad | (F.date_trunc("second", "ts_utc").cast("timestamp_ntz") != F.col("ts_utc")))


def coverage_gaps(panel: DataFrame) -> DataFrame:
    """(instrument, pulse) pairs without a bar. The cross join is of the instruments and the
    pulse calendar, which is what a complete panel holds anyway."""
    have = panel.select("instrument_id", "ts_utc")
    grid = have.select("instrument_id").distinct().crossJoin(have.select("ts_utc").distinct())
    return grid.join(have, ["instrument_id", "ts_utc"], "left_anti")


def missing_universe(panel: DataFrame, universe: list[str]) -> DataFrame:
    """Ids of the universe that the panel doesn't have."""
    ids = panel.sparkSession.createDataFrame([(u,) for u in universe], "instrument_id string")
    return ids.join(panel.select("instrument_id").distinct(), "instrument_id", "left_anti")


def require_complete(panel: DataFrame) -> DataFrame:
    """``panel``, or an error if some instrument lacks a pulse."""
    n = panel.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("i"), F.count_distinct("ts_utc").alias("t")).first()
    if n.n != n.i * n.t:
        raise CoverageError(f"{n.i * n.t - n.n} of {n.i * n.t} bars are missing")
    return panel
