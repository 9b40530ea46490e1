"""Performance metrics of equity curves and trades: one grouped pass for any number of runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, ValidationError
from ..schema import canonical_json, sha256
from .accounting import drawdown, period_returns

STANDARD = ("total_return", "annualized_return", "volatility", "sharpe", "max_drawdown", "time_in_market", "n_trades", "win_rate", "avg_trade")
#: Deviations up to the double precision epsilon count as none; cadence table (seconds, bars a year).
SD_EPSILON = 2.220446049250313e-16
CADENCES = ((60, 525600), (300, 105120), (900, 35040), (3600, 8760), (86400, 252), (604800, 52))


@dataclass(frozen=True)
class MetricContext:
    """How a run is annualised: trading days, bars a day and the annual risk-free rate."""

    trading_days: float = 252
    bars_per_day: float = 1
    risk_free: float = 0.0
    label: str = "us_equity"

    def __post_init__(self):
        if not self.trading_days > 0 or not self.bars_per_day > 0:
            raise InvalidConfig("a calendar needs days and bars")
        if not self.risk_free > -1:
            raise InvalidConfig("the risk-free rate must be over -1")

    @property
    def bars_per_year(self) -> float:
        return self.trading_days * self.bars_per_day

    @property
    def rf_per_period(self) -> float:
        return (1 + self.risk_free) ** (1 / self.bars_per_year) - 1

    def hash(self) -> str:
        return sha256(canonical_json(self.__dict__))


def us_equity(risk_free: float = 0.0, bars_per_day: float = 1) -> MetricContext:
    return MetricContext(252, bars_per_day, risk_free)


def crypto(risk_free: float = 0.0, bars_per_day: float = 1) -> MetricContext:
    return MetricContext(365, bars_per_day, risk_free, "crypto")


def cadence(pulses: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, median gap in seconds, and bars a year: the nearest table cadence within a fifth, else 252."""
    w = Window.partitionBy(*by).orderBy("ts_utc")
    gap = pulses.select(*by, "ts_utc").distinct().withColumn("_gap", F.unix_timestamp(F.col("ts_utc").cast("timestamp")) - F.unix_timestamp(F.lag("ts_utc").over(w).cast("timestamp")))
    x = gap.groupBy(*by).agg(F.median("_gap").alias("median_gap"))
    out = F.lit(252)
    for s, n in reversed(CADENCES):
        out = F.when(F.abs(F.col("median_gap") / s - 1) <= 0.2, n).otherwise(out)
    return x.withColumn("bars_per_year", out)


def _trade_columns() -> list[Column]:
    n = F.count("realized_pnl")
    return [n.alias("n_trades"), F.when(n > 0, F.avg(F.when(F.col("realized_pnl") > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.when(n > 0, F.avg("realized_pnl")).alias("avg_trade")]


def metrics(equity: DataFrame, trades: DataFrame, context: MetricContext = MetricContext(), by: tuple[str, ...] = ()) -> DataFrame:
    """The nine standard metrics, one row for each run.

    Null where a metric isn't defined: fewer than two pulses, a gap in the returns, no
    deviation (Sharpe), no trade (win rate, average trade).
    """
    bpy, rf = context.bars_per_year, context.rf_per_period
    e = drawdown(period_returns(equity, by), by)
    ex = F.col("period_return") - rf
    n, gaps = F.count(F.lit(1)), F.count(F.lit(1)) - F.count("period_return")
    x = e.groupBy(*by).agg(
        n.alias("_n"), gaps.alias("_gaps"), F.min_by("equity", "ts_utc").alias("_first"), F.max_by("equity", "ts_utc").alias("_last"), F.stddev_samp("period_return").alias("_sd"),
        F.avg(ex).alias("_mean"), F.stddev_samp(ex).alias("_xsd"), F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.abs("positions_value") > 1e-6, 1.0).otherwise(0.0)).alias("time_in_market"),
    )
    total = F.when(F.col("_first") != 0, F.col("_last") / F.nullif(F.col("_first"), F.lit(0.0)) - 1)
    whole = F.col("_gaps") == 1
    x = x.withColumn("total_return", total)
    years = (F.col("_n") - 1) / F.lit(float(bpy))
    x = x.withColumn("annualized_return", F.when((F.col("_n") >= 2) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 1 / F.nullif(years, F.lit(0.0))) - 1))
    x = x.withColumn("volatility", F.when(whole & (F.col("_n") >= 3), F.col("_sd") * (bpy**0.5)))
    x = x.withColumn("sharpe", F.when(whole & (F.col("_n") >= 3) & (F.col("_xsd") > SD_EPSILON), F.col("_mean") / F.nullif(F.col("_xsd"), F.lit(0.0)) * (bpy**0.5)))
    t = trades.groupBy(*by).agg(*_trade_columns())
    out = x.join(t, list(by), "left") if by else x.crossJoin(t)
    return out.select(*by, *[F.coalesce("n_trades", F.lit(0)).cast("long").alias("n_trades") if c == "n_trades" else F.col(c) for c in STANDARD])


def compare_runs(metrics_: DataFrame, cadences: DataFrame | None = None, rank_by: str = "sharpe", descending: bool = True) -> DataFrame:
    """Runs side by side, ranked; runs of unlike cadence can't be compared."""
    if cadences is not None and cadences.select("bars_per_year").distinct().limit(2).count() > 1:
        raise ValidationError("runs of unlike cadence")
    key = F.col(rank_by).desc_nulls_last() if descending else F.col(rank_by).asc_nulls_last()
    return metrics_.withColumn("rank", F.row_number().over(Window.orderBy(key, *[c for c in metrics_.columns if c not in STANDARD])))
