"""The sequential fold, for strategies that read portfolio state.

One candidate is one group: its bars are turned to numpy once and walked pulse by pulse.
It is also the independent form against which the window plan is tested.
"""

from __future__ import annotations

import inspect
import json
import math
import traceback
import warnings
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CoverageError, InvalidTarget, UnknownFeature
from ..operators.cost import Cost
from ..operators.ledger import MIN_DELTA, Opening
from ..operators.risk import Risk
from ..operators.types import Selection, Signal, Target, Weights, unwrap
from ..schema import alias_names, canonical_json, derive_seed
from ..storage import driver_table


#: Rows of a panel that is broadcast at most.
SHARED = 2_000_000


@dataclass
class Context:
    """What a strategy sees at one pulse. Nothing later than the pulse is reachable."""

    ts_utc: Any
    universe: list[str]
    bars: dict[str, dict[str, float]]
    features: dict[str, dict[str, float | None]]
    positions: dict[str, float]
    cash: float
    equity: float
    seed: int
    state_prev: Any = None
    aliases: dict[str, str] = field(default_factory=dict)

    def _known(self, instrument: str) -> str:
        if instrument not in self.bars:
            raise InvalidTarget(f"{instrument} isn't in the universe: {', '.join(self.universe)}")
        return instrument

    def bar(self, instrument: str) -> dict[str, float]:
        return self.bars[self._known(instrument)]

    def open(self, instrument: str) -> float:
        return self.bar(instrument)["open"]

    def high(self, instrument: str) -> float:
        return self.bar(instrument)["high"]

    def low(self, instrument: str) -> float:
        return self.bar(instrument)["low"]

    def close(self, instrument: str) -> float:
        return self.bar(instrument)["close"]

    def volume(self, instrument: str) -> float:
        return self.bar(instrument)["volume"]

    def position(self, instrument: str) -> float:
        return self.positions[self._known(instrument)]

    def idx(self, instrument: str, missing: str = "error") -> int | None:
        """The place of an instrument in the universe, from 0; None where it isn't in it, if asked."""
        return None if missing == "none" and instrument not in self.bars else self.universe.index(self._known(instrument))

    def flat(self, default: float = 0.0) -> dict[str, float]:
        return dict.fromkeys(self.universe, float(default))

    def hold(self) -> dict[str, float]:
        return dict(self.positions)

    def targets(self, *_: Any) -> None:
        raise InvalidTarget("ctx.targets is gone: start from ctx.flat()")

    def current_targets(self, *_: Any) -> None:
        raise InvalidTarget("ctx.current_targets is gone: start from ctx.hold()")

    def feature(self, instrument: str, name: str, default: float | None = None) -> float | None:
        known = self.features[self._known(instrument)]
        name = self.aliases.get(name, name)
        if name not in known:
            raise UnknownFeature(f"{name}; known: {', '.join(known)}")
        v = known[name]
        return default if v is None else v

    def features_of(self, instrument: str, names: dict[str, str] | None = None) -> dict[str, float | None]:
        """All features of an instrument by alias: those of ``names`` (alias -> feature id), else
        the run's own aliases, else feature ids."""
        names = names or self.aliases or {k: k for k in self.features[self._known(instrument)]}
        return {alias: self.feature(instrument, fid) for alias, fid in names.items()}

    def vec(self, name: str) -> np.ndarray:
        """A field or feature over the universe, in its order."""
        return np.array([self.bars[i][name] if name in self.bars[i] else np.nan if (v := self.feature(i, name)) is None else v for i in self.universe], float)


def signal_return(ctx: Context, feature: str) -> Signal:
    return Signal({i: ctx.feature(i, feature) for i in ctx.universe}, ctx.universe, "signal_return")


def passed_warmup(values: dict[str, float | None]) -> bool:
    """Does every value of ``ctx.features_of`` exist?"""
    return all(v is not None and v == v for v in values.values())


def select_top_n(signal: dict[str, float | None], n: int) -> Selection:
    """The n largest of what is known, ties by instrument; with fewer, a warning and those."""
    known = sorted(((i, v) for i, v in signal.items() if v is not None and v == v), key=lambda x: (-x[1], x[0]))
    if 0 < len(known) < n:
        warnings.warn(f"only {len(known)} of {n} instruments have a signal", stacklevel=2)
    best = {i for i, _ in known[:n]}
    return Selection({i: i in best for i in signal}, origin="select_top_n")


def weight_equal(selected: Selection | list[str]) -> Weights:
    names = selected.chosen() if isinstance(selected, Selection) else list(selected)
    return Weights({i: 1 / len(names) for i in names}, origin="weight_equal")


def target_rebalance(weights: dict[str, float], ctx: Context, equity_fraction: float = 1.0) -> Target:
    """Whole quantities for weights of at least 0 that sum to 1 at most; 0, and a warning, without
    a good price."""
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise InvalidTarget("weights must be at least 0 and sum to 1 at most")
    if not 0 < equity_fraction <= 1:
        raise InvalidTarget("equity_fraction must be over 0 and 1 at most")
    out = ctx.flat()
    for i, w in weights.items():
        p = ctx.close(i)
        if p > 0 and math.isfinite(p):
            out[i] = float(math.floor(w * equity_fraction * ctx.equity / p))
        else:
            warnings.warn(f"no positive price for {i}", stacklevel=2)
    return Target(out, ctx.universe, "target_rebalance")


def echo(targets: dict[str, float]) -> Callable:
    """A strategy that always wants ``targets``, and nothing of what they don't name."""
    return lambda ctx, params: {**ctx.flat(), **targets}


def call_strategy(strategy: Callable, ctx: Context, params: dict[str, Any]) -> Any:
    """(ctx, params) or (ctx), by what the function takes."""
    return strategy(ctx, params) if len(inspect.signature(strategy).parameters) > 1 else strategy(ctx)


def validate_targets(targets: Any, universe: list[str]) -> dict[str, float]:
    targets = unwrap(targets)
    if not isinstance(targets, dict) or set(targets) != set(universe):
        raise InvalidTarget("targets must name exactly the universe")
    out = {i: float(targets[i]) for i in universe}
    if not all(math.isfinite(v) for v in out.values()):
        raise InvalidTarget("targets must be finite")
    return out


class Lots:
    """FIFO lots of one instrument; realized gains exclude fees."""

    def __init__(self):
        self.lots: deque[list[float]] = deque()  # signed quantity, price

    def fill(self, delta: float, price: float) -> float:
        realized = 0.0
        while abs(delta) > 1e-9 and self.lots and self.lots[0][0] * delta < 0:
            q, p = self.lots[0]
            m = min(abs(q), abs(delta))
            sign = 1 if q > 0 else -1
            realized += m * (price - p) * sign
            self.lots[0][0] -= sign * m
            delta += sign * m
            if abs(self.lots[0][0]) <= 1e-9:
                self.lots.popleft()
        if abs(delta) > 1e-9:
            self.lots.append([delta, price])
        return realized

    def basis(self) -> float:
        return sum(q * p for q, p in self.lots)


@dataclass
class FoldResult:
    events: list[dict]
    equity: list[dict]
    states: list[dict]
    warnings: list[str]


def run_fold(bars: pd.DataFrame, strategy: Callable, params: dict[str, Any], cost: Cost, risk: Risk = Risk(), opening: Opening = Opening(), features: tuple[str, ...] = (), seed: int = 1, run_id: str = "run", aliases: dict[str, str] | None = None, resume: FoldResult | None = None) -> FoldResult:
    """Walk the pulses: value, decide, validate, limit, then fill at the next open.

    With ``resume`` (what an earlier, shorter walk over the same bars gave) the walk goes on after
    its last pulse: lots, cash and positions come from its events, the state from its states.
    """
    universe = sorted(bars["instrument_id"].unique())
    pulses = sorted(bars["ts_utc"].unique())
    if len(bars) != len(universe) * len(pulses):
        raise CoverageError("the panel isn't complete")
    x = bars.sort_values(["ts_utc", "instrument_id"])
    grid = {c: x[c].to_numpy(dtype=float).reshape(len(pulses), len(universe)) for c in ("open", "high", "low", "close", "volume", *features)}
    aliases = alias_names(aliases or {})
    pos = dict.fromkeys(universe, 0.0) | {k: q for k, q in opening.held().items()}
    lots = {i: Lots() for i in universe}
    cash, realized, state = float(opening.cash), 0.0, None
    out = FoldResult([], [], [], [])
    begin = 0
    if resume is not None and resume.equity:
        done = pd.Timestamp(resume.equity[-1]["ts_utc"])
        begin = sum(pd.Timestamp(t) <= done for t in pulses)
        # Decisions of the last bar there was weren't filled; they are taken again from there.
        pending = [w for w in resume.warnings if w.startswith("LAST_BAR_NO_FILL")]
        begin -= bool(pending) and begin < len(pulses)
        out = FoldResult(list(resume.events), resume.equity[:begin], [s for s in resume.states if begin == len(pulses) or pd.Timestamp(s["ts_utc"]) < pulses[begin]], [w for w in resume.warnings if w not in pending])
        state = json.loads(out.states[-1]["state_json"]) if out.states else None
        pos = dict.fromkeys(universe, 0.0)
        for e in out.events:
            pos[e["instrument_id"]] += e["position_delta"]
            cash += e["cash_delta"]
            realized += lots[e["instrument_id"]].fill(e["position_delta"], e["price"]) - e["fee"]
    for k, q in opening.held().items() if resume is None or not resume.equity else ():
        lots[k].fill(q, opening.cost_basis[k])
        out.events.append({"ts_utc": pulses[0], "event_type": "CASHFLOW", "instrument_id": k, "side": "BUY", "qty": q, "price": opening.cost_basis[k], "fee": 0.0, "cash_delta": 0.0, "position_delta": q})
    for t, ts in list(enumerate(pulses))[begin:]:
        close = dict(zip(universe, grid["close"][t].tolist(), strict=True))
        value = sum(pos[i] * close[i] for i in universe)
        out.equity.append({"ts_utc": ts, "cash": cash, "positions_value": value, "equity": cash + value, "realized_pnl": realized, "unrealized_pnl": value - sum(lots[i].basis() for i in universe)})
        ctx = Context(
            ts, universe, {i: {c: float(grid[c][t, j]) for c in ("open", "high", "low", "close", "volume")} for j, i in enumerate(universe)},
            {i: {f: None if math.isnan(v := float(grid[f][t, j])) else v for f in features} for j, i in enumerate(universe)},
            dict(pos), cash, cash + value, derive_seed(seed, {"run_id": run_id, "pulse": t}), state, aliases,
        )
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            got = call_strategy(strategy, ctx, params)
        out.warnings += sorted({str(w.message) for w in said} - set(out.warnings))
        if isinstance(got, dict) and set(got) == {"targets", "state_update"}:
            got, state = got["targets"], got["state_update"]
            out.states.append({"ts_utc": ts, "state_json": canonical_json(state)})
        targets = validate_targets(got, universe)
        targets = validate_targets(risk.apply(targets, close, cash + value, params), universe)
        for j, i in enumerate(universe):
            delta = targets[i] - pos[i]
            if abs(delta) <= MIN_DELTA:
                continue
            if t + 1 == len(pulses):
                out.warnings.append(f"LAST_BAR_NO_FILL {i}")
                continue
            raw = float(grid["open"][t + 1, j])
            if not raw > 0:
                continue
            side, qty = ("BUY" if delta > 0 else "SELL"), abs(delta)
            price, fee = cost.apply(side, qty, raw)
            change = -(qty * price + fee) if delta > 0 else qty * price - fee
            realized += lots[i].fill(delta, price) - fee
            cash += change
            pos[i] += delta
            out.events.append({"ts_utc": pulses[t + 1], "event_type": "FILL", "instrument_id": i, "side": side, "qty": qty, "price": price, "fee": fee, "cash_delta": change, "position_delta": delta})
    for n, e in enumerate(out.events, 1):
        e["event_seq"] = n
    return out


_SCHEMA = "candidate_id string, status string, error string, n_events long, warnings string, ts_utc timestamp_ntz, cash double, positions_value double, equity double, realized_pnl double, unrealized_pnl double"


def fold_sweep(panel: DataFrame, candidates: list, strategy: Callable, cost: Cost, risk: Risk = Risk(), opening: Opening = Opening(), features: tuple[str, ...] = (), seed: int = 1, stop_on_error: bool = False, aliases: dict[str, str] | None = None) -> DataFrame:
    """A stateful strategy over candidates, each one grouped call, run side by side.

    Returns equity rows for candidates that ended, and one row with status FAILED and the
    error for the others. A walk needs the whole panel, so a worker holds it in any case:
    up to ``SHARED`` rows it is broadcast and only the candidates are dealt out; beyond that each
    candidate's panel is shuffled to it.
    """
    spark = panel.sparkSession
    params = {c.label: {**c.feature_params, **c.params} for c in candidates}
    ids = driver_table(spark, [(c.label,) for c in candidates], "candidate_id string")
    cols = ["candidate_id", "instrument_id", "ts_utc", "open", "high", "low", "close", "volume", *features]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        label = key[0]
        try:
            r = run_fold(pdf, strategy, params[label], cost, risk, opening, features, derive_seed(seed, {"run_id": label, "params": params[label]}), label, aliases)
        except Exception as e:  # noqa: BLE001
            if stop_on_error:
                raise
            return pd.DataFrame([{"candidate_id": label, "status": "FAILED", "error": f"{type(e).__name__}: {e} {traceback.format_exc()[-200:]}", "n_events": 0, "warnings": None, "ts_utc": None, "cash": None, "positions_value": None, "equity": None, "realized_pnl": None, "unrealized_pnl": None}])
        out = pd.DataFrame(r.equity)
        out.insert(0, "warnings", "; ".join(r.warnings))
        out.insert(0, "n_events", len(r.events))
        out.insert(0, "error", None)
        out.insert(0, "status", "DONE")
        out.insert(0, "candidate_id", label)
        return out

    table = panel.select(*cols[1:]).limit(SHARED + 1).toArrow()
    if table.num_rows > SHARED:
        return panel.crossJoin(ids).select(*cols).groupBy("candidate_id").applyInPandas(run, _SCHEMA)
    shared = spark.sparkContext.broadcast(table)

    def each(batches):
        for names in batches:
            for label in names["candidate_id"]:
                yield run((label,), shared.value.to_pandas())

    return ids.repartition(max(1, min(len(candidates), 10_000)), "candidate_id").mapInPandas(each, _SCHEMA)


_EVENT = ("ts_utc", "event_type", "instrument_id", "side", "qty", "price", "fee", "cash_delta", "position_delta", "event_seq")
_WALK = "kind string, ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long, cash double, positions_value double, equity double, realized_pnl double, unrealized_pnl double, text string"


def walk(panel: DataFrame, strategy: Callable, params: dict[str, Any], cost: Cost, risk: Risk = Risk(), opening: Opening = Opening(), features: tuple[str, ...] = (), seed: int = 1, run_id: str = "run", aliases: dict[str, str] | None = None) -> DataFrame:
    """One run in one grouped call on an executor: rows of kind event, equity, state (its JSON in
    ``text``) and warning, which the caller writes once and then splits."""
    cols = ["instrument_id", "ts_utc", "open", "high", "low", "close", "volume", *features]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = run_fold(pdf.drop(columns="_run"), strategy, params, cost, risk, opening, features, seed, run_id, aliases)
        rows = [{"kind": "event", **{c: e[c] for c in _EVENT}} for e in r.events] + [{"kind": "equity", **e} for e in r.equity]
        rows += [{"kind": "state", "ts_utc": s["ts_utc"], "text": s["state_json"]} for s in r.states] + [{"kind": "warning", "text": w} for w in r.warnings]
        names = [f.split()[0] for f in _WALK.split(", ")]
        out = pd.DataFrame(rows, columns=names)
        out["event_seq"] = out["event_seq"].astype("Int64")
        for c in ("event_type", "instrument_id", "side", "text"):
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        out["ts_utc"] = pd.to_datetime(out["ts_utc"])
        return out

    return panel.select(*cols).withColumn("_run", F.lit(0)).groupBy("_run").applyInPandas(run, _WALK)


__all__ = ["Context", "FoldResult", "Lots", "call_strategy", "echo", "fold_sweep", "passed_warmup", "run_fold", "select_top_n", "signal_return", "target_rebalance", "validate_targets", "walk", "weight_equal"]
