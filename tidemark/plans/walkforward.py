"""Walk-forward evaluation: folds, selection, scores, degradation and stored sessions."""

from __future__ import annotations

import math
from calendar import monthrange
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, ValidationError
from ..operators import accounting, ledger, metrics
from ..operators.cost import Cost
from ..operators.ledger import Opening
from ..schema import canonical_json, derive_seed, sha256, utc
from ..sources import panels
from ..storage import driver_table, stage
from .grids import Candidate, Grid

#: What a metric measures. Only the classes of ``SELECTABLE`` compare windows of unlike length.
METRIC_CLASS = {
    "annualized_return": "annualized", "volatility": "annualized", "sharpe": "ratio", "win_rate": "rate", "avg_trade": "length_invariant",
    "total_return": "cumulative", "final_equity": "level", "max_drawdown": "path_dependent", "n_trades": "count",
}
SELECTABLE = ("rate", "annualized", "ratio", "length_invariant")
_UNITS = {"sec": 1, "min": 60, "hour": 3600, "day": 86400, "week": 604800}
POLICIES = ("carry_test_state", "flat_test_state")


@dataclass(frozen=True)
class Fold:
    fold_seq: int
    scheme: str
    train_start: datetime
    train_end: datetime
    test_start: datetime
    test_end: datetime

    def __post_init__(self):
        if not self.train_start <= self.train_end < self.test_start <= self.test_end:
            raise InvalidConfig("fold boundaries out of order")

    @property
    def fold_id(self) -> str:
        return sha256([self.fold_seq, self.scheme, self.train_start, self.train_end, self.test_start, self.test_end])


def fold(seq: int, train_start, train_end, test_start, test_end) -> Fold:
    """An explicit fold; both windows include both their ends."""
    return Fold(seq, "explicit", utc(train_start), utc(train_end), utc(test_start), utc(test_end))


def fold_list(*folds: Fold) -> list[Fold]:
    """Folds in order: numbers from 1 on, test windows that follow each other."""
    if not folds or [f.fold_seq for f in folds] != list(range(1, len(folds) + 1)):
        raise InvalidConfig("folds must be numbered from 1 on")
    if any(b.test_start <= a.test_end for a, b in zip(folds, folds[1:], strict=False)):
        raise InvalidConfig("test windows must follow each other")
    return list(folds)


def shift(at: datetime, period: str) -> datetime:
    """``at`` plus a period such as "3 months"; days past a month's end roll on."""
    n, unit = period.split()
    k, unit = int(n), unit.rstrip("s")
    if k <= 0:
        raise InvalidConfig("a period must be positive")
    if unit in _UNITS:
        return at + timedelta(seconds=k * _UNITS[unit])
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        raise InvalidConfig(f"unknown period {period!r}")
    m = at.month - 1 + k * months
    year, month = at.year + m // 12, m % 12 + 1
    days = monthrange(year, month)[1]
    return at.replace(year=year, month=month, day=min(at.day, days)) + timedelta(days=max(0, at.day - days))


def _folds(start, end, window: str, test: str, step: str | None, anchored: bool) -> list[Fold]:
    begin, last, out, step = utc(start), utc(end), [], step or test
    train_start, cut = begin, shift(begin, window)
    second = timedelta(seconds=1)
    while shift(cut, test) - second <= last:
        out.append(Fold(len(out) + 1, "anchored" if anchored else "rolling", begin if anchored else train_start, cut - second, cut, shift(cut, test) - second))
        train_start = shift(train_start, step)
        cut = shift(cut, step) if anchored else shift(train_start, window)
    if not out:
        raise InvalidConfig("no fold fits between start and end")
    return out


def folds_rolling(start, end, train_window: str, test_window: str, step: str | None = None) -> list[Fold]:
    return _folds(start, end, train_window, test_window, step, False)


def folds_anchored(start, end, train_window: str, test_window: str, step: str | None = None) -> list[Fold]:
    return _folds(start, end, train_window, test_window, step, True)


def table(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    rows = [(f.fold_seq, f.scheme, f.train_start, f.train_end, f.test_start, f.test_end) for f in folds]
    return driver_table(spark, rows, "fold_seq int, scheme string, train_start timestamp_ntz, train_end timestamp_ntz, test_start timestamp_ntz, test_end timestamp_ntz")


def windows(spark: SparkSession, folds: list[Fold], which: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """(fold_seq, window, lo, hi), both ends inclusive."""
    rows = [(f.fold_seq, w, a, b) for f in folds for w, a, b in (("train", f.train_start, f.train_end), ("test", f.test_start, f.test_end)) if w in which]
    return driver_table(spark, rows, "fold_seq int, window string, lo timestamp_ntz, hi timestamp_ntz")


_BY = ("fold_seq", "window", "candidate_id")


def _evaluate(panel: DataFrame, wins: DataFrame, candidates: DataFrame | None, target: Column, cost: Cost, opening: Opening) -> tuple[DataFrame, DataFrame]:
    """Panel rows and legs of all windows and candidates; without a table of candidates each
    window names its own, with its parameters."""
    x = panel.join(wins, (F.col("ts_utc") >= F.col("lo")) & (F.col("ts_utc") <= F.col("hi")))
    x = (x if candidates is None else x.join(candidates, how="cross")).withColumn("target", target)
    x = stage(x.select(*_BY, "instrument_id", "ts_utc", "open", "close", "target"), "windows")
    runs = x.groupBy(*_BY).agg(F.min("ts_utc").alias("start")) if opening.held() else None
    ev = ledger.events(ledger.fills(x, cost, opening, _BY), None, opening, _BY, runs)
    return x, stage(accounting.matched_legs(ev, _BY), "window-legs")


def _scores(x: DataFrame, legs: DataFrame, opening: Opening, context: metrics.MetricContext) -> DataFrame:
    return metrics.metrics(accounting.equity(x, legs, opening.cash, _BY), accounting.trades(legs, _BY), context, _BY)


def scores(panel: DataFrame, candidates: DataFrame, target: Column, cost: Cost, folds: list[Fold], context: metrics.MetricContext, opening: Opening = Opening(), which: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """The nine metrics of every candidate in every window of ``which``: one plan.

    Features come from all earlier bars, while trading and scoring stay within a window,
    which starts from ``opening``. Windows and candidates are broadcast tables of a few rows; from
    there everything is partitioned by fold, window and candidate.
    """
    panel = panels.require_complete(stage(panel, "wf-panel"))
    return _scores(*_evaluate(panel, windows(panel.sparkSession, folds, which), candidates, target, cost, opening), opening, context)


def select(scores_: DataFrame, metric: str, largest: bool = True) -> DataFrame:
    """(fold_seq, candidate_id) that training selects: finite values only, ties to the least id."""
    kind = METRIC_CLASS.get(metric)
    if kind not in SELECTABLE:
        raise InvalidConfig(f"{metric} is {kind or 'not classed'}: windows can't be compared by it")
    x = scores_.where((F.col("window") == "train") & F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf")))
    key = F.desc(metric) if largest else F.asc(metric)
    return x.withColumn("_k", F.row_number().over(Window.partitionBy("fold_seq").orderBy(key, "candidate_id"))).where("_k = 1").select("fold_seq", "candidate_id")


def long_scores(scores_: DataFrame) -> DataFrame:
    x = scores_.withColumns({m: F.col(m).cast("double") for m in metrics.STANDARD})
    return x.unpivot(["fold_seq", "window", "candidate_id"], list(metrics.STANDARD), "metric", "value")


def degradation(scores_: DataFrame, selected: DataFrame, folds: list[Fold], metric: str, short_days: int = 90, cold_start: bool = False) -> DataFrame:
    """Train against test of the selected candidate of each fold. ``cold_start_distorted``
    says that test windows didn't carry the state of the one before."""
    x = scores_.join(selected, ["fold_seq", "candidate_id"]).select("fold_seq", "candidate_id", "window", F.col(metric).alias("v"))
    x = x.groupBy("fold_seq", "candidate_id").agg(F.max(F.when(F.col("window") == "train", F.col("v"))).alias("train"), F.max(F.when(F.col("window") == "test", F.col("v"))).alias("test"))
    f = table(scores_.sparkSession, folds).select("fold_seq", (F.datediff("test_end", "test_start") < short_days).alias("short_test_window"), F.lit(cold_start).alias("cold_start_distorted"))
    diff = F.col("test") - F.col("train")
    pct = F.when(F.abs("train") > metrics.SD_EPSILON, diff / F.nullif(F.abs("train"), F.lit(0.0)))
    return x.join(f, "fold_seq").withColumn("diff_abs", diff).withColumn("diff_pct", pct)


def opening_from(legs: DataFrame, cash: float, opening: Opening) -> Opening:
    """Cash, long positions and their average basis after a run: where the next one starts.
    At most one row for each instrument comes to the driver."""
    if legs.isEmpty():
        return opening
    sign = F.when(F.col("book") == "L", 1).otherwise(-1)
    basis = sign * F.when(F.col("action") == "OPEN", F.col("leg_qty") * F.col("price")).otherwise(-F.col("cost"))
    once = lambda c: F.sum(F.when(F.col("first_leg"), F.col(c)).otherwise(0.0))
    rows = legs.groupBy("instrument_id").agg(once("position_delta").alias("q"), F.sum(basis).alias("b"), once("cash_delta").alias("c")).collect()
    held = {r.instrument_id: r.q for r in rows if abs(r.q) > 1e-12}
    if any(q < 0 for q in held.values()):
        raise ValidationError("a short position can't be carried into the next window")
    return Opening(cash + math.fsum(r.c for r in rows), held, {r.instrument_id: r.b / r.q for r in rows if r.instrument_id in held})


@dataclass(frozen=True)
class Session:
    """One walk-forward evaluation: its identity, scores of all training candidates and of the
    selected one's test window, and what was selected."""

    session_id: str
    identity: dict[str, Any]
    folds: list[Fold]
    scores: DataFrame
    selected: DataFrame

    def degradation(self) -> DataFrame:
        return degradation(self.scores, self.selected, self.folds, self.identity["metric"], cold_start=self.identity["policy"] == "flat_test_state")

    def save(self, root: str) -> None:
        """Written once under ``root``; an id that is there raises."""
        at = f"{root.rstrip('/')}/sessions/{self.session_id}"
        self.scores.write.mode("error").parquet(f"{at}/scores")
        self.selected.write.mode("error").parquet(f"{at}/selected")
        table(self.scores.sparkSession, self.folds).write.mode("error").parquet(f"{at}/folds")
        rows = [(self.session_id, canonical_json(self.identity))]
        self.scores.sparkSession.createDataFrame(rows, "session_id string, identity_json string").coalesce(1).write.mode("error").parquet(f"{at}/session")

    def candidate(self, grid: Grid, fold_seq: int | str, rationale: str | None = None) -> tuple[Candidate, dict[str, Any]]:
        """The candidate a fold selected, and where it comes from: for promotion. "latest" is
        the last fold, and needs a rationale, as it is the one fold nothing later has tested."""
        rows = {r.fold_seq: r.candidate_id for r in self.selected.collect()}
        said = (rationale or "").strip() or None
        if fold_seq == "latest":
            if said is None:
                raise InvalidConfig("the latest fold needs a selection rationale")
            fold_seq = max(rows, default=0)
        if fold_seq not in rows:
            raise ValidationError(f"fold {fold_seq} selected no candidate")
        got = next(c for c in grid if c.label == rows[fold_seq])
        metric = self.identity["metric"]
        values = {r.window: r[metric] for r in self.scores.where((F.col("fold_seq") == fold_seq) & (F.col("candidate_id") == got.label)).collect()}
        return got, {"session_id": self.session_id, "fold_seq": fold_seq, "fold_id": self.folds[fold_seq - 1].fold_id, "metric": metric, "train": values.get("train"), "test": values.get("test"), "rationale": said, "key": got.key(), "identity": self.identity}


def open_session(spark: SparkSession, root: str, session_id: str) -> Session:
    """A saved session; its folds and identity must agree with its id."""
    import json

    at = f"{root.rstrip('/')}/sessions/{session_id}"
    identity = json.loads(spark.read.parquet(f"{at}/session").first().identity_json)
    rows = spark.read.parquet(f"{at}/folds").orderBy("fold_seq").collect()
    folds = [Fold(r.fold_seq, r.scheme, r.train_start, r.train_end, r.test_start, r.test_end) for r in rows]
    if _session_id(identity) != session_id or [f.fold_id for f in folds] != identity["folds"]:
        raise ValidationError(f"session {session_id} was changed")
    return Session(session_id, identity, folds, spark.read.parquet(f"{at}/scores"), spark.read.parquet(f"{at}/selected"))


def _session_id(identity: dict[str, Any]) -> str:
    return "session_" + sha256(identity)[:16]


def walk_forward(panel: DataFrame, grid: Grid, types: dict[str, str], target: Column, cost: Cost, folds: list[Fold], metric: str, context: metrics.MetricContext, opening: Opening = Opening(), *, largest: bool = True, policy: str = "carry_test_state", seed: int = 1, snapshot_hash: str = "") -> Session:
    """Train every candidate in each training window, and test the selected one only.

    All training windows are one plan. Under ``carry_test_state`` a test window starts from
    the cash, long positions and average basis the one before ended with, so test windows run in
    order; under ``flat_test_state`` each starts from ``opening`` and they are one plan too.
    """
    if policy not in POLICIES:
        raise InvalidConfig(f"policy must be one of {', '.join(POLICIES)}")
    spark = panel.sparkSession
    panel = panels.require_complete(stage(panel, "wf-panel"))
    candidates = grid.table(spark, types)
    trained = stage(scores(panel, candidates, target, cost, folds, context, opening, ("train",)), "wf-train")
    selected = stage(select(trained, metric, largest), "wf-selected")
    chosen = {r.fold_seq: r.candidate_id for r in selected.collect()}
    if len(chosen) < len(folds):
        raise ValidationError(f"no finite {metric} in the training window of fold {min(f.fold_seq for f in folds if f.fold_seq not in chosen)}")
    # One row for each fold.
    tasks = F.broadcast(stage(windows(spark, folds, ("test",)).join(selected, "fold_seq").join(candidates, "candidate_id"), "wf-tests"))
    if policy == "flat_test_state":
        tested = _scores(*_evaluate(panel, tasks, None, target, cost, opening), opening, context)
    else:
        tested, now = None, opening
        for f in folds:
            x, legs = _evaluate(panel, tasks.where(F.col("fold_seq") == f.fold_seq), None, target, cost, now)
            got = _scores(x, legs, now, context)
            tested = got if tested is None else tested.unionByName(got)
            now = opening_from(legs, now.cash, now)
    identity = {
        "snapshot_hash": snapshot_hash, "grid": [c.key() for c in grid], "folds": [f.fold_id for f in folds], "metric": metric, "largest": largest, "seed": seed, "policy": policy, "cost": cost.hash(),
        "context": context.hash(), "opening": asdict(opening), "strategy": str(target), "test_seeds": {str(f.fold_seq): derive_seed(seed, {"fold_seq": f.fold_seq, "window": "test", "candidate": chosen[f.fold_seq]}) for f in folds},
    }
    return Session(_session_id(identity), identity, list(folds), stage(trained.unionByName(tested), "wf-scores"), selected)


__all__ = ["METRIC_CLASS", "POLICIES", "SELECTABLE", "Fold", "Session", "degradation", "fold", "fold_list", "folds_anchored", "folds_rolling", "long_scores", "open_session", "opening_from", "scores", "select", "shift", "table", "walk_forward", "windows"]
