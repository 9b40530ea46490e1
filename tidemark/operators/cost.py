"""Transaction costs as chains of steps: each is one Column expression, and its Python twin."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..schema import canonical_json, sha256

KINDS = ("spread_bps", "fixed_fee", "notional_bps_fee")


@dataclass(frozen=True)
class Cost:
    """Steps in order: (kind, amount). Price steps come before fees."""

    steps: tuple[tuple[str, float], ...] = ()

    def __post_init__(self):
        fees = False
        for kind, amount in self.steps:
            if kind not in KINDS:
                raise InvalidConfig(f"unknown cost step {kind}")
            if not (isinstance(amount, (int, float)) and 0 <= amount < float("inf")):
                raise InvalidConfig(f"{kind} must be a finite number of at least 0")
            if kind == "spread_bps" and fees:
                raise InvalidConfig("price steps must come before fees")
            fees |= kind != "spread_bps"

    def price_and_fee(self, side: Column, qty: Column, price: Column) -> tuple[Column, Column]:
        """The fill price, to 8 places, and the fee; a spread is paid by half on each side."""
        sign, fee = F.when(side == "BUY", 1.0).otherwise(-1.0), F.lit(0.0)
        for kind, x in self.steps:
            if kind == "spread_bps":
                price = price * (1 + sign * x / 20000)
            elif kind == "fixed_fee":
                fee = fee + x
            else:
                fee = fee + qty * price * (x / 10000)
        return F.round(price, 8), fee

    def apply(self, side: str, qty: float, price: float) -> tuple[float, float]:
        fee = 0.0
        for kind, x in self.steps:
            if kind == "spread_bps":
                price *= 1 + (1 if side == "BUY" else -1) * x / 20000
            elif kind == "fixed_fee":
                fee += x
            else:
                fee += qty * price * x / 10000
        return round(price, 8), fee

    def describe(self) -> list[dict]:
        return [{"step": i + 1, "kind": k, "amount": v, "stage": "price" if k == "spread_bps" else "fee"} for i, (k, v) in enumerate(self.steps)]

    def plan_json(self) -> str:
        return canonical_json({"version": 1, "steps": [{"kind": k, "amount": float(v)} for k, v in self.steps]})

    def hash(self) -> str:
        return sha256(self.plan_json())


def zero() -> Cost:
    return Cost()


def spread_bps(bps: float) -> Cost:
    return Cost((("spread_bps", bps),))


def fixed_fee(amount: float) -> Cost:
    return Cost((("fixed_fee", amount),))


def notional_bps_fee(bps: float) -> Cost:
    return Cost((("notional_bps_fee", bps),))


def chain(*costs: Cost) -> Cost:
    if not costs:
        raise InvalidConfig("a chain needs a cost")
    return Cost(tuple(s for c in costs for s in c.steps))


def from_plan_json(text: str) -> Cost:
    import json

    return Cost(tuple((s["kind"], s["amount"]) for s in json.loads(text)["steps"]))
