"""Sweeps: all candidates of a column strategy as one plan, with a candidate column.

The panel with its features is written once, then the ledger's legs; equity, trades and
metrics of all candidates read these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..functions import indicators as ind
from ..operators import accounting, ledger, metrics
from ..operators.cost import Cost
from ..operators.ledger import Opening
from ..sources import panels
from ..storage import stage

BY = ("candidate_id",)


@dataclass(frozen=True)
class Sweep:
    panel: DataFrame  # with candidate_id and target
    legs: DataFrame  # events by leg, with what each close realised
    cash: float

    @property
    def events(self) -> DataFrame:
        return self.legs.where("first_leg").drop("first_leg", "action", "leg_qty", "book", "hi", "lo", "realized", "cost")

    @property
    def trades(self) -> DataFrame:
        return accounting.trades(self.legs, BY)

    @cached_property
    def equity(self) -> DataFrame:
        return stage(accounting.equity(self.panel, self.legs, self.cash, BY), "sweep-equity")

    def metrics(self, context: metrics.MetricContext = metrics.MetricContext()) -> DataFrame:
        return metrics.metrics(self.equity, self.trades, context, BY)

    def returns(self) -> DataFrame:
        """(candidate_id, ts_utc, equity, period_return), the first return null."""
        return accounting.period_returns(self.equity, BY).select("candidate_id", "ts_utc", "equity", "period_return")


def with_features(panel: DataFrame, features: dict[str, Callable[[DataFrame, str], DataFrame]]) -> DataFrame:
    """Each feature of any candidate once, as a column of the panel."""
    for name, build in features.items():
        panel = build(panel, name)
    return panel


def run(panel: DataFrame, candidates: DataFrame, target: Column, cost: Cost, opening: Opening = Opening()) -> Sweep:
    """``panel`` has the union of features; ``target`` reads them and the candidate's parameters.

    A grid's table is made on the driver and broadcast up to a fixed number of rows.
    Windows are partitioned by candidate and instrument. A panel with gaps raises.
    """
    panel = panels.require_complete(stage(panel, "sweep-panel"))
    x = panel.join(candidates, how="cross").withColumn("target", target)
    x = x.select(*BY, "instrument_id", "ts_utc", "open", "close", "target")
    fills = stage(ledger.fills(x, cost, opening, BY), "sweep-fills")
    start = None
    if opening.held():
        start = panel.agg(F.min("ts_utc").alias("t")).first().t
    ev = ledger.events(fills, start, opening, BY, candidates.select(*BY))
    return Sweep(x, stage(accounting.matched_legs(ev, BY), "sweep-legs"), opening.cash)


def crossover(panel: DataFrame, candidates: DataFrame, fast: list[int], slow: list[int], cost: Cost, qty: float = 1.0, opening: Opening = Opening()) -> Sweep:
    """SMA crossover over a grid with columns ``fast`` and ``slow``: every mean is computed once."""
    from ..operators.strategy import sma_crossover

    lengths = sorted({*fast, *slow})
    x = with_features(panel, {f"sma_{n}": (lambda d, o, n=n: ind.sma(d, n, o)) for n in lengths})

    def pick(param: str) -> Column:
        out = F.lit(None).cast("double")
        for n in lengths:
            out = F.when(F.col(param) == n, F.col(f"sma_{n}")).otherwise(out)
        return out

    return run(x, candidates, sma_crossover(pick("fast"), pick("slow"), qty), cost, opening)


def review(results: DataFrame, rank_by: str, n: int = 5, descending: bool = True) -> DataFrame:
    """The n best candidates; nulls last, ties in the order of the grid."""
    key = F.col(rank_by).desc_nulls_last() if descending else F.col(rank_by).asc_nulls_last()
    return results.withColumn("rank", F.row_number().over(Window.orderBy(key, "candidate_row"))).where(F.col("rank") <= n)


def issues(results: DataFrame) -> DataFrame:
    """Candidates that failed or lack a finite value of some metric, in the order of the grid."""
    bad = F.lit(False) if "status" not in results.columns else F.col("status") != "DONE"
    for c in ("total_return", "sharpe"):
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return results.where(bad).orderBy("candidate_row") if "candidate_row" in results.columns else results.where(bad)


def counted(sweeps: DataFrame, candidates: DataFrame) -> DataFrame:
    """``sweeps`` with n_candidates, n_done and n_failed, 0 without candidates."""
    n = candidates.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(F.when(F.col("status") == "DONE", 1).otherwise(0)).alias("n_done"), F.sum(F.when(F.col("status") == "FAILED", 1).otherwise(0)).alias("n_failed"))
    return sweeps.join(n, "sweep_id", "left").na.fill(0, ["n_candidates", "n_done", "n_failed"])


def returns_frame(returns: DataFrame, candidates: list[str], value: str = "period_return"):
    """A pandas frame, time by candidate: one row for each pulse comes to the driver."""
    return returns_wide(returns, candidates, value).orderBy("ts_utc").toPandas().set_index("ts_utc")


def returns_panel(returns: DataFrame) -> DataFrame:
    """The retained panel without the first pulse, which has no return; complete or an error."""
    if not incomplete(returns).isEmpty():
        raise ValidationError("candidates with unlike timestamps")
    return returns.where("period_return is not null")


def incomplete(returns: DataFrame) -> DataFrame:
    """Candidates whose timestamps aren't those of the whole panel."""
    total = returns.agg(F.count_distinct("ts_utc").alias("total"))
    have = returns.groupBy("candidate_id").agg(F.count_distinct("ts_utc").alias("have"))
    return have.crossJoin(total).where("have != total")


def returns_wide(returns: DataFrame, candidates: list[str], value: str = "period_return") -> DataFrame:
    return returns.groupBy("ts_utc").pivot("candidate_id", candidates).agg(F.first(value))


def returns_matrix(returns: DataFrame, candidates: list[str], value: str = "period_return"):
    """A numpy matrix of time by candidate, for a panel that is complete."""
    if not incomplete(returns).isEmpty():
        raise ValidationError("candidates with unlike timestamps")
    return returns_frame(returns, candidates, value).to_numpy()
