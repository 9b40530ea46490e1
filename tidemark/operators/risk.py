"""Risk chains on target quantities. ``long_only`` is a Column; ``max_weight`` reads equity and
so runs in the fold."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig, InvalidTarget
from ..schema import canonical_json, sha256


@dataclass(frozen=True)
class Param:
    """A value that each candidate gives by name."""

    name: str


def resolve(value: Any, params: dict[str, Any]) -> Any:
    if isinstance(value, Param):
        if value.name not in params:
            raise InvalidConfig(f"parameter {value.name} has no value")
        return params[value.name]
    return value


@dataclass(frozen=True)
class Risk:
    steps: tuple[tuple[str, Any], ...] = ()

    @property
    def stateless(self) -> bool:
        return all(k == "long_only" for k, _ in self.steps)

    def column(self, target: Column) -> Column:
        if not self.stateless:
            raise InvalidConfig("max_weight reads equity: run it in the fold")
        for _ in self.steps:
            target = F.greatest(target, F.lit(0.0))
        return target

    def apply(self, targets: dict[str, float], close: dict[str, float], equity: float, params: dict[str, Any] | None = None) -> dict[str, float]:
        for kind, value in self.steps:
            if kind == "long_only":
                targets = {k: max(t, 0.0) for k, t in targets.items()}
                continue
            w = resolve(value, params or {})
            if not 0 <= w < float("inf"):
                raise InvalidConfig("max_weight must be a finite number of at least 0")
            if equity < 0:
                raise InvalidTarget("max_weight isn't defined for negative equity")
            out = {}
            for k, t in targets.items():
                if t and not (close[k] > 0):
                    raise InvalidTarget(f"no positive price for {k}")
                most = w * equity / close[k] if close[k] > 0 else 0.0
                out[k] = min(abs(t), most) * (1 if t > 0 else -1 if t < 0 else 0)
            targets = out
        return targets

    def plan_json(self) -> str:
        return canonical_json({"version": 1, "steps": [{"kind": k, "arg": {"param": v.name} if isinstance(v, Param) else v} for k, v in self.steps]})

    def hash(self) -> str:
        return sha256(self.plan_json())


def none() -> Risk:
    return Risk()


def long_only() -> Risk:
    return Risk((("long_only", None),))


def max_weight(weight: float | Param) -> Risk:
    return Risk((("max_weight", weight),))


def chain(*risks: Risk) -> Risk:
    return Risk(tuple(s for r in risks for s in r.steps))


def from_plan_json(text: str) -> Risk:
    return Risk(tuple((s["kind"], Param(s["arg"]["param"]) if isinstance(s["arg"], dict) else s["arg"]) for s in json.loads(text)["steps"]))
