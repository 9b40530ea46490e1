"""Checks before a run: can this strategy run again with the same result?"""

from __future__ import annotations

import ast
import builtins
import hashlib
import inspect
import textwrap
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import PreflightError

#: Fixed value: calls whose result depends on more than their arguments.
FORBIDDEN = {"time", "now", "today", "utcnow", "random", "randint", "shuffle", "choice", "urandom", "uuid4", "getenv", "input", "open", "exec", "eval", "perf_counter"}


@dataclass(frozen=True)
class Preflight:
    """Tier 1: self-contained. Tier 2: leans on outside names. Tier 3: can't be run again."""

    tier: int
    reasons: tuple[str, ...]
    source_hash: str | None

    @property
    def allowed(self) -> bool:
        return self.tier < 3


def source_of(fn: Callable) -> str | None:
    try:
        return textwrap.dedent(inspect.getsource(fn))
    except (OSError, TypeError):
        return None


def hash_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(fn: Callable) -> str | None:
    text = source_of(fn)
    return None if text is None else hash_of(text)


def _tree(text: str) -> ast.AST:
    """The syntax tree of a function's source; of a lambda, whose line needn't parse by
    itself, from ``lambda`` on as far as it does."""
    try:
        return ast.parse(text)
    except SyntaxError:
        start = text.find("lambda")
        for end in range(len(text), start, -1):
            try:
                return ast.parse(text[start:end], mode="eval")
            except SyntaxError:
                continue
    return ast.parse("pass")


def _calls(tree: ast.AST) -> list[str]:
    bad = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            name = node.func.attr if isinstance(node.func, ast.Attribute) else getattr(node.func, "id", "")
            if name in FORBIDDEN:
                bad.append(f"calls {name}")
        if isinstance(node, (ast.Global, ast.Nonlocal)):
            bad.append("assigns outer names")
    return bad


def forbidden(fn: Callable) -> list[str]:
    """What a function does that makes its result depend on more than its arguments."""
    text = source_of(fn)
    return [] if text is None else _calls(_tree(text))


def preflight(fn: Callable) -> Preflight:
    text = source_of(fn)
    if text is None:
        return Preflight(2, ("the source can't be read",), None)
    tree = _tree(text)
    bad = _calls(tree)
    outside = ["imports" for node in ast.walk(tree) if isinstance(node, (ast.Import, ast.ImportFrom))]
    if (len(inspect.signature(fn).parameters)) not in (1, 2):
        bad.append("takes neither (ctx) nor (ctx, params)")
    seen = inspect.getclosurevars(fn)
    for k, v in {**seen.nonlocals, **seen.globals}.items():
        if isinstance(v, (list, dict, set)):
            bad.append(f"reads the mutable {k}")
        elif not hasattr(builtins, k):
            outside.append(f"uses {k}")
    tier = 3 if bad else 2 if outside else 1
    return Preflight(tier, tuple(bad + outside), hashlib.sha256(text.encode()).hexdigest())


def require(fn: Callable) -> Preflight:
    p = preflight(fn)
    if not p.allowed:
        raise PreflightError("; ".join(p.reasons))
    return p
