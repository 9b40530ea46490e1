"""Parameter grids: labelled candidates as a small table."""

from __future__ import annotations

import ast
import itertools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidConfig
from ..schema import canonical_json, derive_seed, sha256
from ..storage import driver_table

#: Fixed value: what a grid filter may call.
ALLOWED = {"abs", "min", "max", "pmin", "pmax", "round", "exp", "log", "log10", "sqrt", "floor", "ceil", "is_na", "is_finite"}
_NODES = (ast.Expression, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.Compare, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.Eq, ast.NotEq, ast.In, ast.NotIn, ast.Name, ast.Load, ast.Constant, ast.List, ast.Tuple, ast.Call)


@dataclass(frozen=True)
class Candidate:
    label: str
    params: dict[str, Any]
    feature_params: dict[str, Any]

    def key(self) -> str:
        return sha256({"params": self.params, "feature_params": self.feature_params})


class Grid(list):
    """Candidates in order, with unlike labels."""

    def __init__(self, candidates):
        super().__init__(candidates)
        labels = [c.label for c in self]
        if len(set(labels)) != len(labels):
            raise InvalidConfig("labels of a grid must differ")

    def table(self, spark: SparkSession, types: dict[str, str]) -> DataFrame:
        """One row for each candidate: candidate_id, candidate_row and the named parameters.
        Joins broadcast it, up to the bound of ``driver_table``."""
        rows = [(c.label, i + 1, *[{**c.feature_params, **c.params}.get(k) for k in types]) for i, c in enumerate(self)]
        return driver_table(spark, rows, ", ".join(["candidate_id string", "candidate_row int", *[f"{k} {t}" for k, t in types.items()]]))


class _WholeColumn(ast.NodeTransformer):
    """min and max of one name are over the whole grid: a name of their own."""

    def visit_Call(self, node: ast.Call) -> ast.AST:
        self.generic_visit(node)
        if node.func.id in ("min", "max") and len(node.args) == 1 and isinstance(node.args[0], ast.Name):
            return ast.copy_location(ast.Name(f"{node.func.id} of {node.args[0].id}", ast.Load()), node)
        return node


def _check(expr: str) -> Any:
    import math

    tree = ast.parse(expr, mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, _NODES) or (isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in ALLOWED)):
            raise InvalidConfig(f"a grid filter can't use {ast.dump(node)[:60]}")
    code = compile(_WholeColumn().visit(tree), "filter", "eval")
    na = lambda v: v is None or v != v
    own = {"abs": abs, "min": min, "max": max, "pmin": min, "pmax": max, "round": round, "is_na": na, "is_finite": lambda v: not na(v) and math.isfinite(v)}
    known = {k: own.get(k) or getattr(math, k) for k in ALLOWED}

    def kept(rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        whole = {f"{f.__name__} of {k}": f(r[k] for r in rows) for f in (min, max) for k in (rows[0] if rows else ()) if all(isinstance(r[k], (int, float)) for r in rows)}
        return [r for r in rows if eval(code, {"__builtins__": {}}, {**known, **whole, **r})]  # noqa: S307

    return kept


def _cross(values: dict[str, list], where: str | None) -> list[dict[str, Any]]:
    """The cross product, the first name varying fastest."""
    if any(not isinstance(v, (list, tuple)) or not v for v in values.values()):
        raise InvalidConfig("each parameter needs a list of values")
    names = list(values)
    rows = [dict(zip(names, reversed(x), strict=True)) for x in itertools.product(*[values[k] for k in reversed(names)])]
    return rows if where is None else _check(where)(rows)


def _label(params: dict, feature_params: dict) -> str:
    return "grid_" + sha256({"p": params, "f": feature_params})[:12]


def param_grid(where: str | None = None, **values: list) -> Grid:
    return Grid(Candidate(_label(r, {}), r, {}) for r in _cross(values, where))


strategy_grid = param_grid


def feature_grid(where: str | None = None, **values: list) -> Grid:
    return Grid(Candidate(_label({}, r), {}, r) for r in _cross(values, where))


def grid_cross(features: Grid, strategy: Grid) -> Grid:
    return Grid(Candidate(_label(s.params, f.feature_params), s.params, f.feature_params) for s in strategy for f in features)


def grid_named(**candidates: dict) -> Grid:
    return Grid(Candidate(k, dict(v), {}) for k, v in candidates.items())


def add_baseline(grid: Grid, label: str = "baseline", **params: Any) -> Grid:
    return Grid([Candidate(label, params, {}), *grid])


def candidate_seed(master: int, run_id: str, c: Candidate) -> int:
    return derive_seed(master, {"run_id": run_id, "params": canonical_json(c.params)})
