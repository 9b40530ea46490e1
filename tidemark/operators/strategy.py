"""Column strategies: targets as expressions, for what doesn't read portfolio state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig


def sma_crossover(fast: Column, slow: Column, qty: float | Column = 1.0, threshold: float = 0.0) -> Column:
    """``qty`` while fast / slow - 1 is over the threshold, else 0; 0 in warm-up."""
    q = F.lit(float(qty)) if isinstance(qty, (int, float)) else qty
    return F.when(fast / F.nullif(slow, F.lit(0.0)) - 1 > threshold, q).otherwise(0.0)


def signal_map(signal: Column, long_qty: float = 1.0, flat_qty: float = 0.0, short_qty: float = -1.0) -> Column:
    """LONG, FLAT or SHORT to a quantity; anything else is null, which the fold refuses."""
    return F.when(signal == "LONG", float(long_qty)).when(signal == "FLAT", float(flat_qty)).when(signal == "SHORT", float(short_qty))


def hold_zero() -> Column:
    return F.lit(0.0)


def ts_rule(cut: str, before: float, after: float) -> Column:
    return F.when(F.col("ts_utc") < F.lit(cut).cast("timestamp_ntz"), float(before)).otherwise(float(after))


def select_top_n(df: DataFrame, signal: str, n: int, out: str = "selected", by: tuple[str, ...] = ()) -> DataFrame:
    """The n largest signals of each pulse, ties by instrument; null signals aren't selected."""
    w = Window.partitionBy(*by, "ts_utc").orderBy(F.col(signal).desc_nulls_last(), "instrument_id")
    return df.withColumn(out, F.col(signal).isNotNull() & (F.row_number().over(w) <= n))


def weight_equal(df: DataFrame, selected: str = "selected", out: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """An equal share for each selected instrument of a pulse; the others 0."""
    n = F.sum(F.col(selected).cast("int")).over(Window.partitionBy(*by, "ts_utc"))
    return df.withColumn(out, F.when(F.col(selected), 1.0 / F.nullif(n, F.lit(0))).otherwise(0.0))


def passed_warmup(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def pulse_wide(panel: DataFrame, features: list[str], instruments: list[str], ohlcv: tuple[str, ...] = ("close",)) -> DataFrame:
    """One row for each pulse: ``{instrument}__ohlcv_{field}`` and ``{instrument}__feature_{id}``.

    The instruments are given, so no extra pass looks for them. ``__`` divides the parts of a name and is
    reserved: an instrument or feature with it raises."""
    for name in (*instruments, *features):
        if "__" in name:
            raise InvalidConfig(f"{name}: __ is reserved")
    aggs = [F.first(c).alias(f"ohlcv_{c}") for c in ohlcv] + [F.first(f).alias(f"feature_{f}") for f in features]
    wide = panel.groupBy("ts_utc").pivot("instrument_id", instruments).agg(*aggs)
    single = len(aggs) == 1
    names = {}
    for i in instruments:
        for kind, c in [("ohlcv", c) for c in ohlcv] + [("feature", f) for f in features]:
            names[i if single else f"{i}_{kind}_{c}"] = f"{i}__{kind}_{c}"
    return wide.withColumnsRenamed(names)


def features_long(panel: DataFrame, features: list[str]) -> DataFrame:
    """(instrument_id, ts_utc, feature_name, feature_value)."""
    return panel.unpivot(["instrument_id", "ts_utc"], list(features), "feature_name", "feature_value")


def features_wide(long: DataFrame, features: list[str]) -> DataFrame:
    return long.groupBy("instrument_id", "ts_utc").pivot("feature_name", list(features)).agg(F.first("feature_value"))
