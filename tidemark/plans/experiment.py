"""Experiments and durable runs: one strategy over one panel, its ledger and what follows from it."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, PreflightError, SnapshotError, TidemarkError
from ..operators import accounting, ledger, metrics
from ..operators.cost import Cost
from ..operators.ledger import Opening
from ..operators.risk import Risk
from ..schema import LEDGER, canonical_json, sha256
from ..sources import panels
from ..storage import stage
from . import fold, preflight, sweep


@dataclass(frozen=True)
class Experiment:
    """A complete panel with its features, a strategy and its models. The cost model has no
    default. A strategy is a Column of targets, or a function of (ctx, params) or (ctx)."""

    panel: DataFrame
    strategy: Column | Callable
    cost: Cost
    risk: Risk = Risk()
    opening: Opening = Opening()
    features: tuple[str, ...] = ()
    context: metrics.MetricContext = metrics.MetricContext()
    snapshot_id: str = ""
    aliases: dict[str, str] = field(default_factory=dict)

    def config(self, params: dict[str, Any]) -> dict[str, Any]:
        source = str(self.strategy) if isinstance(self.strategy, Column) else preflight.fingerprint(self.strategy)
        out = {"cost": self.cost.plan_json(), "risk": self.risk.plan_json(), "opening": asdict(self.opening), "features": list(self.features), "strategy": source, "snapshot_id": self.snapshot_id, "params": params, "metrics": asdict(self.context)}
        return {**out, "aliases": self.aliases} if self.aliases else out

    def run_id(self, params: dict[str, Any]) -> str:
        return "run_" + sha256(self.config(params))[:16]


@dataclass(frozen=True)
class Run:
    run_id: str
    ledger: DataFrame
    panel: DataFrame
    cash: float
    context: metrics.MetricContext = field(default_factory=metrics.MetricContext)
    stored_equity: DataFrame | None = None

    def results(self, what: str) -> DataFrame:
        """``equity``, ``returns``, ``fills``, ``trades`` or ``ledger``."""
        if what == "ledger":
            return self.ledger
        if what in ("fills", "trades"):
            return getattr(accounting, "fill_rows" if what == "fills" else "trades")(self.ledger)
        if what in ("equity", "returns"):
            eq = accounting.equity(self.panel, self.ledger, self.cash) if self.stored_equity is None else self.stored_equity
            return eq if what == "equity" else accounting.period_returns(eq)
        raise InvalidConfig(f"no result {what!r}")

    def cursor(self, what: str = "fills", rows: int = 10_000) -> Iterator[list]:
        """Rows of a result in lists of ``rows``, of which the driver holds one at a time."""
        held = []
        for r in self.results(what).toLocalIterator():
            held.append(r)
            if len(held) == rows:
                yield held
                held = []
        if held:
            yield held

    def metrics(self) -> DataFrame:
        return metrics.metrics(self.results("equity"), self.results("trades"), self.context)

    def cadence(self) -> DataFrame:
        return metrics.cadence(self.panel.select("ts_utc")).withColumn("run_id", F.lit(self.run_id))

    def summary(self) -> str:
        """The run in a few lines: pulses, equity, and each metric, shares as percents."""
        m, e = self.metrics().first(), self.results("equity").agg(F.count(F.lit(1)).alias("n"), F.min_by("equity", "ts_utc").alias("a"), F.max_by("equity", "ts_utc").alias("b")).first()
        lines = [f"run {self.run_id}: {e.n} pulses, equity {e.a:,.2f} to {e.b:,.2f}"]
        for c in metrics.STANDARD:
            v = m[c]
            lines.append(f"  {c:<18} " + ("-" if v is None else str(v) if c == "n_trades" else f"{v:.4f}" if c in ("sharpe", "avg_trade") else percent(v)))
        return "\n".join(lines)


def percent(v: float | None, places: int = 2) -> str:
    return "-" if v is None or v != v else f"{100 * v:.{places}f}%"


def curated(df: DataFrame, columns: tuple[str, ...], n: int = 20) -> str:
    """The first rows of some columns as text; the rest is said, not shown."""
    rows = df.select(*columns).limit(n + 1).collect()
    body = [[("-" if v is None else str(v)) for v in r] for r in rows[:n]]
    wide = [max(len(x) for x in col) for col in zip(columns, *body, strict=True)]
    out = ["  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in [list(columns), *body]]
    more = [f"and more, with {len(df.columns) - len(columns)} other columns"] if len(rows) > n else []
    return "\n".join(out + more)


def parts_of(exp: Experiment, params: dict[str, Any], seed: int = 1) -> dict[str, DataFrame]:
    """Ledger rows (``event``) and, for a function, ``equity``, ``state`` and ``warning`` rows.

    A Column goes by windows. A function goes by the sequential fold, in one grouped call on an
    executor whose rows are written once.
    """
    panel = panels.require_complete(exp.panel)
    if isinstance(exp.strategy, Column):
        start = panel.agg(F.min("ts_utc").alias("t")).first().t if exp.opening.held() else None
        x = panel.withColumn("target", exp.risk.column(exp.strategy))
        return {"event": ledger.events(stage(ledger.fills(x, exp.cost, exp.opening), "run-fills"), start, exp.opening)}
    preflight.require(exp.strategy)
    rows = stage(fold.walk(panel, exp.strategy, params, exp.cost, exp.risk, exp.opening, exp.features, seed, exp.run_id(params), exp.aliases), "run-walk")
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select(*cols)
    return {
        "event": of("event", "ts_utc", "event_type", "instrument_id", "side", "qty", "price", "fee", "cash_delta", "position_delta", "event_seq"),
        "equity": of("equity", "ts_utc", "cash", "positions_value", "equity", "realized_pnl", "unrealized_pnl"),
        "state": of("state", "ts_utc", F.col("text").alias("state_json")),
        "warning": of("warning", F.col("text").alias("warning")),
    }


def events_of(exp: Experiment, params: dict[str, Any], seed: int = 1) -> DataFrame:
    return parts_of(exp, params, seed)["event"]


_RUNS = "run_id string, snapshot_id string, status string, created_at string, label string, archived boolean, tags array<string>, config_json string, promoted_from string, strategy_source string, source_hash string, seconds double, n_pulses long, n_events long, final_equity double, max_drawdown double, n_trades long, bars_per_year int, error string, version long"
_SWEEPS = "sweep_id string, created_at string, meta_json string"


def reproduction_key(exp: Experiment, candidate, seed: int, snapshot_hash: str = "") -> str:
    """The same for a candidate run again on the same bars under the same models."""
    return sha256({"config": exp.config({**candidate.feature_params, **candidate.params}), "candidate": candidate.key(), "seed": seed, "snapshot_hash": snapshot_hash})


class RunStore:
    """Durable runs under one root: tables for each run, and a row for each state of a run, of
    which the last version holds. Writing a run again with the same configuration opens it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{path}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _rows(self) -> DataFrame:
        w = Window.partitionBy("run_id").orderBy(F.desc("version"))
        return self._read("runs/*/*", _RUNS).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    def list(self, include_archived: bool = False) -> DataFrame:
        """Runs with their statistics, telemetry, and tags as one text; by time, then id."""
        rows = self._rows().drop("version", "strategy_source", "config_json")
        rows = rows.withColumn("tags_text", F.array_join(F.sort_array("tags"), ", "))
        return (rows if include_archived else rows.where("not archived")).orderBy("created_at", "run_id")

    def info(self, run_id: str) -> dict[str, Any]:
        got = self._rows().where(F.col("run_id") == run_id).collect()
        if not got:
            raise SnapshotError(f"no run {run_id}")
        return got[0].asDict()

    def print(self, include_archived: bool = False) -> str:
        x = self.list(include_archived).withColumn("max_drawdown", F.concat(F.round(100 * F.col("max_drawdown"), 2).cast("string"), F.lit("%")))
        return curated(x, ("run_id", "label", "status", "final_equity", "max_drawdown", "n_trades", "tags_text"))

    def _put(self, row: dict[str, Any]) -> None:
        values = tuple(row[c.split()[0]] for c in _RUNS.split(", "))
        self.spark.createDataFrame([values], _RUNS).coalesce(1).write.mode("error").parquet(f"{self.root}/runs/{row['run_id']}/{row['version']}")

    def _change(self, run_id: str, **values: Any) -> None:
        row = self.info(run_id)
        self._put({**row, **values, "version": row["version"] + 1})

    def run(self, exp: Experiment, params: dict[str, Any] | None = None, run_id: str | None = None, seed: int = 1, promoted_from: str | None = None, sinks: tuple[str, ...] = ("equity", "state")) -> Run:
        """Run and store: the ledger always, and the ``sinks`` among equity, state and features.

        A run that was left RUNNING or FAILED is walked again from the start under the same seed and its
        tables are replaced: pulses give the same result again, so nothing of a broken
        attempt is needed.
        """
        if set(sinks) - {"equity", "state", "features"}:
            raise InvalidConfig("sinks are equity, state and features")
        params = params or {}
        config = canonical_json({**exp.config(params), "seed": seed})
        run_id = run_id or exp.run_id(params)
        known = self._rows().where(F.col("run_id") == run_id).collect()
        if known and known[0].config_json != config:
            raise TidemarkError(f"{run_id} exists with another configuration")
        if not known or known[0].status != "DONE":
            source = None if isinstance(exp.strategy, Column) else preflight.source_of(exp.strategy)
            row = {
                "run_id": run_id, "snapshot_id": exp.snapshot_id, "status": "RUNNING", "created_at": datetime.now(timezone.utc).isoformat(), "label": None, "archived": False, "tags": [], "config_json": config, "promoted_from": promoted_from,
                "strategy_source": source, "source_hash": None if source is None else preflight.fingerprint(exp.strategy), "seconds": None, "n_pulses": None, "n_events": None, "final_equity": None, "max_drawdown": None, "n_trades": None, "bars_per_year": None, "error": None, "version": 1 + (known[0].version if known else 0),
            }
            self._put(row)
            began = time.time()
            try:
                row |= self._write(exp, params, run_id, seed, sinks)
            except Exception as e:
                self._put({**row, "status": "FAILED", "error": f"{type(e).__name__}: {str(e)[:500]}", "seconds": time.time() - began, "version": row["version"] + 1})
                raise
            self._put({**row, "status": "DONE", "seconds": time.time() - began, "version": row["version"] + 1})
        return self.open(exp, run_id)

    def _at(self, table: str, run_id: str) -> str:
        return f"{self.root}/{table}/run_id={run_id}"

    def _write(self, exp: Experiment, params: dict[str, Any], run_id: str, seed: int, sinks: tuple[str, ...]) -> dict[str, Any]:
        parts = parts_of(exp, params, seed)
        e = parts["event"].withColumns({"run_id": F.lit(run_id), "event_id": F.concat(F.lit(f"{run_id}_"), F.lpad(F.col("event_seq").cast("string"), 8, "0")), "meta_json": F.to_json(F.struct("cash_delta", "position_delta"))})
        e.select(*LEDGER.fieldNames()).write.mode("overwrite").parquet(self._at("ledger", run_id))
        events = self.spark.read.schema(LEDGER).parquet(self._at("ledger", run_id))
        legs = stage(accounting.matched_legs(events), "run-legs")
        equity = stage(accounting.equity(exp.panel, legs, exp.opening.cash), "run-equity")
        if "equity" in sinks:
            equity.write.mode("overwrite").parquet(self._at("equity", run_id))
        if "state" in sinks and "state" in parts:
            parts["state"].write.mode("overwrite").parquet(self._at("state", run_id))
        if "features" in sinks and exp.features:
            exp.panel.unpivot(["instrument_id", "ts_utc"], list(exp.features), "feature_name", "feature_value").write.mode("overwrite").parquet(self._at("features", run_id))
        stats = accounting.drawdown(equity).agg(F.count(F.lit(1)).alias("n"), F.max_by("equity", "ts_utc").alias("last"), F.min("drawdown").alias("dd")).first()
        counts = legs.agg(F.count_if(F.col("first_leg")).alias("events"), F.count_if((F.col("action") == "CLOSE") & (F.col("event_type") == "FILL")).alias("trades")).first()
        return {"n_pulses": stats.n, "n_events": counts.events, "final_equity": stats.last, "max_drawdown": stats.dd, "n_trades": counts.trades, "bars_per_year": metrics.cadence(exp.panel.select("ts_utc")).first().bars_per_year}

    def resume(self, exp: Experiment, run_id: str, params: dict[str, Any] | None = None, seed: int = 1) -> Run:
        """A run that didn't end, to its end; one that did raises."""
        if self.info(run_id)["status"] == "DONE":
            raise SnapshotError(f"{run_id} is done")
        return self.run(exp, params, run_id, seed)

    def open(self, exp: Experiment, run_id: str) -> Run:
        info = self.info(run_id)
        if info["status"] != "DONE":
            raise SnapshotError(f"{run_id} is {info['status']}")
        rows = self.spark.read.schema(LEDGER).parquet(self._at("ledger", run_id))
        stored = self._read(f"equity/run_id={run_id}", "ts_utc timestamp_ntz, cash double, positions_value double, equity double, realized_pnl double, unrealized_pnl double")
        return Run(run_id, rows, exp.panel, exp.opening.cash, exp.context, None if stored.isEmpty() else stored)

    def states(self, run_id: str) -> DataFrame:
        return self._read(f"state/run_id={run_id}", "ts_utc timestamp_ntz, state_json string")

    def features(self, run_id: str) -> DataFrame:
        return self._read(f"features/run_id={run_id}", "instrument_id string, ts_utc timestamp_ntz, feature_name string, feature_value double")

    def telemetry(self) -> DataFrame:
        """Median and 99th percentile of seconds and of microseconds a pulse, over runs that ended."""
        x = self._rows().where("status = 'DONE'").withColumn("us_a_pulse", F.col("seconds") * 1e6 / F.nullif(F.col("n_pulses"), F.lit(0)))
        return x.agg(F.count(F.lit(1)).alias("runs"), *[F.percentile(c, p).alias(f"{c}_{n}") for c in ("seconds", "us_a_pulse") for p, n in ((0.5, "median"), (0.99, "p99"))])

    def strategy(self, run_id: str, trust: bool = False) -> Callable | str:
        """The source a run was made by, if its hash agrees. Only on trust is it executed, and the
        function it defines returned."""
        info = self.info(run_id)
        text = info["strategy_source"]
        if text is None:
            raise SnapshotError(f"{run_id} has no source")
        if preflight.hash_of(text) != info["source_hash"]:
            raise PreflightError(f"the source of {run_id} was changed")
        if not trust:
            return text
        space: dict[str, Any] = {}
        exec(compile(text, run_id, "exec"), space)  # noqa: S102
        made = [v for k, v in space.items() if callable(v) and k != "__builtins__"]
        if len(made) != 1:
            raise PreflightError("the source doesn't define one function")
        return made[0]

    def label(self, run_id: str, label: str | None) -> None:
        self._change(run_id, label=label)

    def archive(self, run_id: str) -> None:
        self._change(run_id, archived=True)

    def tag(self, run_id: str, *tags: str) -> None:
        self._change(run_id, tags=sorted({*self.info(run_id)["tags"], *tags}))

    def untag(self, run_id: str, *tags: str) -> None:
        gone = set(tags) or set(self.info(run_id)["tags"])
        self._change(run_id, tags=[t for t in self.info(run_id)["tags"] if t not in gone])

    def tags(self) -> DataFrame:
        return self._rows().select("run_id", F.explode("tags").alias("tag"))

    def tagged(self, *tags: str) -> DataFrame:
        """Runs with any of ``tags``, a row for each: (tag, and the columns of ``list``)."""
        picked = self.tags().where(F.col("tag").isin(*tags))
        return picked.join(self.list(True), "run_id").orderBy("tag", "created_at", "run_id")

    def compare(self, runs: list[Run], rank_by: str = "sharpe") -> DataFrame:
        """Runs side by side; runs of unlike cadence raise."""
        if not runs:
            raise InvalidConfig("nothing to compare")
        out = cadences = None
        for r in runs:
            row = r.metrics().withColumn("run_id", F.lit(r.run_id))
            out = row if out is None else out.unionByName(row)
            cadences = r.cadence() if cadences is None else cadences.unionByName(r.cadence())
        return metrics.compare_runs(out, cadences, rank_by=rank_by)

    def promote(self, exp: Experiment, candidate, source: str, run_id: str | None = None, seed: int = 1, note: str | None = None) -> Run:
        """Run one candidate of a sweep durably, and keep where it came from."""
        context = {"sweep": source, "candidate": candidate.label, "key": candidate.key(), "seed": seed, "note": note, "reproduction_key": reproduction_key(exp, candidate, seed)}
        return self.run(exp, {**candidate.feature_params, **candidate.params}, run_id, seed, promoted_from=canonical_json(context))

    def promotion(self, run_id: str) -> dict[str, Any]:
        """Where a promoted run came from; empty for a run that wasn't promoted."""
        return json.loads(self.info(run_id)["promoted_from"] or "{}")

    def save_sweep(self, s: sweep.Sweep, sweep_id: str, context: metrics.MetricContext = metrics.MetricContext(), failed: DataFrame | None = None, meta: dict[str, Any] | None = None) -> None:
        """Candidates with status and metrics, and their retained returns; an id is written once.
        ``failed``: (candidate_id, error) of candidates that gave none."""
        done = s.metrics(context).withColumns({"status": F.lit("DONE"), "error": F.lit(None).cast("string")})
        if failed is not None:
            done = done.unionByName(failed.select("candidate_id", F.lit("FAILED").alias("status"), "error"), allowMissingColumns=True)
        done.write.mode("error").parquet(f"{self.root}/sweeps/{sweep_id}/candidates")
        s.returns().write.mode("error").parquet(f"{self.root}/sweeps/{sweep_id}/returns")
        row = [(sweep_id, datetime.now(timezone.utc).isoformat(), canonical_json(meta or {}))]
        self.spark.createDataFrame(row, _SWEEPS).coalesce(1).write.mode("error").parquet(f"{self.root}/sweeps/{sweep_id}/sweep")

    def open_sweep(self, sweep_id: str) -> tuple[DataFrame, DataFrame]:
        at = f"{self.root}/sweeps/{sweep_id}"
        return self.spark.read.parquet(f"{at}/candidates"), self.spark.read.parquet(f"{at}/returns")

    def sweeps(self) -> DataFrame:
        """Saved sweeps with how many candidates they have, ended and failed."""
        heads = self._read("sweeps/*/sweep", _SWEEPS)
        rows = self._read("sweeps/*/candidates", "candidate_id string, status string").withColumn("sweep_id", F.element_at(F.split(F.input_file_name(), "/"), -3))
        return sweep.counted(heads, rows).orderBy("created_at", "sweep_id")

    def sweep_info(self, sweep_id: str) -> dict[str, Any]:
        got = self.sweeps().where(F.col("sweep_id") == sweep_id).collect()
        if not got:
            raise SnapshotError(f"no sweep {sweep_id}")
        return got[0].asDict()
