"""What a strategy's steps pass on: signals, selections, weights, and the targets it returns.

Each is a dictionary over instruments that is checked when made. Only a ``Target``, or a
plain dictionary over the whole universe, is a strategy's result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from ..errors import InvalidTarget


class Typed(dict):
    """A checked dictionary, with the step it came from."""

    whole = False

    def __init__(self, values: dict | None = None, universe: Iterable[str] | None = None, origin: str | None = None):
        super().__init__(values or {})
        self.origin = origin
        if any(not isinstance(k, str) or not k for k in self):
            raise InvalidTarget(f"names of a {type(self).__name__.lower()} must be instruments")
        if universe is not None:
            names = set(universe)
            if set(self) - names or (self.whole and set(self) != names):
                raise InvalidTarget(f"a {type(self).__name__.lower()} must name {'exactly' if self.whole else 'only'} instruments of the universe")
        for k, v in self.items():
            self[k] = self.check(v)

    def check(self, v):
        return v


class Signal(Typed):
    """Numbers to rank by; unknown ones are None, infinite ones are refused, and it isn't empty."""

    def __init__(self, values: dict | None = None, universe: Iterable[str] | None = None, origin: str | None = None):
        super().__init__(values, universe, origin)
        if not self:
            raise InvalidTarget("a signal needs an instrument")

    def check(self, v):
        if v is None or v != v:
            return None
        if math.isinf(v):
            raise InvalidTarget("signals can't be infinite")
        return float(v)


class Selection(Typed):
    """True for what is selected; may be empty."""

    def check(self, v):
        if not isinstance(v, bool):
            raise InvalidTarget("a selection is true or false")
        return v

    def chosen(self) -> list[str]:
        return [k for k, v in self.items() if v]


class Weights(Typed):
    """Finite shares; may be empty."""

    def check(self, v):
        if v is None or not math.isfinite(v):
            raise InvalidTarget("weights must be finite")
        return float(v)


class Target(Typed):
    """Finite quantities for exactly the universe."""

    whole = True

    def check(self, v):
        if v is None or not math.isfinite(v):
            raise InvalidTarget("targets must be finite")
        return float(v)


def unwrap(result):
    """A strategy's result; what is only a step on the way is refused."""
    if isinstance(result, (Signal, Selection, Weights)):
        raise InvalidTarget(f"a strategy can't return a {type(result).__name__.lower()}: end in targets")
    return result
