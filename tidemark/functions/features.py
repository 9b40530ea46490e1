"""Indicator definitions: built-in, by a user's function or from a CSV, and what is known about them.

An indicator says how many bars it needs and from which bar on its values hold. Built-in ones
are window columns; functions run in one grouped pandas call for each series, all of a
run's together. A feature map gives indicators the names a strategy uses.
"""

from __future__ import annotations

import hashlib
import inspect
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CoverageError, InvalidConfig, InvalidFeature, UnknownFeature
from ..operators.risk import Param, resolve
from ..schema import canonical_json, sha256
from ..storage import driver_table, stage
from . import indicators as ind

#: Goes into every cache key: a change of any formula changes it.
ENGINE_VERSION = "2"
SOURCES = ("builtin", "ttr", "custom", "csv")


@dataclass(frozen=True)
class Indicator:
    """One named series of values. Exactly one of ``build`` (panel, column -> panel), ``fn``
    (window of ``stable_after`` bars -> number) and ``series_fn`` (bars, params -> values) makes it;
    ``series_fn`` wins over ``fn``."""

    id: str
    requires_bars: int
    stable_after: int = 0
    params: dict[str, Any] = field(default_factory=dict)
    source: str = "custom"
    build: Callable[[DataFrame, str], DataFrame] | None = None
    fn: Callable | None = None
    series_fn: Callable | None = None
    recursive: tuple | None = None

    def __post_init__(self):
        if not self.id or "__" in self.id:
            raise InvalidConfig("an indicator needs an id, without __")
        if self.requires_bars < 1 or int(self.requires_bars) != self.requires_bars:
            raise InvalidConfig("requires_bars must be a whole number of at least 1")
        if not self.stable_after:
            object.__setattr__(self, "stable_after", self.requires_bars)
        if self.stable_after < self.requires_bars:
            raise InvalidConfig("stable_after must be at least requires_bars")
        if self.source not in SOURCES:
            raise InvalidConfig(f"source must be one of {', '.join(SOURCES)}")
        if not any((self.build, self.fn, self.series_fn, self.recursive)):
            raise InvalidConfig("an indicator needs a function")
        for f in (self.fn, self.series_fn):
            if f is not None:
                require_pure(f)

    @property
    def fingerprint(self) -> str:
        said = [_source(f) for f in (self.fn, self.series_fn) if f is not None]
        return sha256({"id": self.id, "requires_bars": self.requires_bars, "stable_after": self.stable_after, "params": self.params, "source": self.source, "functions": said, "recursive": self.recursive})


def _source(fn: Callable) -> str:
    try:
        text = inspect.getsource(fn)
    except (OSError, TypeError):
        text = getattr(fn, "__qualname__", repr(type(fn)))
    return hashlib.sha256(text.encode()).hexdigest()


def require_pure(fn: Callable) -> None:
    """Refuses functions that assign outer names or call what depends on more than its arguments."""
    from ..plans.preflight import forbidden

    bad = forbidden(fn)
    if bad:
        raise InvalidConfig(f"indicator function {'; '.join(bad)}")


def token(text: str) -> str:
    """Lower case, and one underscore for each stretch of other characters."""
    return re.sub(r"[^a-z0-9]+", "_", str(text).lower()).strip("_")


# Constructors ---------------------------------------------------------------------------------


def _built(name: str, fn: Callable, warm: int, source: str, **params: Any) -> Indicator:
    return Indicator(name, warm, params=params, source=source, build=fn)


def sma(n: int) -> Indicator:
    return _built(f"sma_{n}", lambda d, o: ind.sma(d, n, o), n, "builtin", n=n)


def ema(n: int) -> Indicator:
    """The bounded mean: a window of n + 1 bars, unlike ``ttr("EMA")``."""
    return _built(f"ema_{n}", lambda d, o: ind.ema_bounded(d, n, o), n + 1, "builtin", n=n)


def rsi(n: int) -> Indicator:
    return _built(f"rsi_{n}", lambda d, o: ind.rsi_simple(d, n, o), n + 1, "builtin", n=n)


def returns(n: int) -> Indicator:
    return _built(f"return_{n}", lambda d, o: ind.returns(d, n, o), n + 1, "builtin", n=n)


def _multi(build: Callable, prefix: str, part: str) -> Callable[[DataFrame, str], DataFrame]:
    """One output of a function that makes several columns with a prefix."""

    def run(d: DataFrame, out: str) -> DataFrame:
        made = build(d, "_all")
        return made.withColumn(out, F.col(f"_all_{part}")).drop(*[c for c in made.columns if c.startswith("_all_")])

    return run


#: Functions with one output: (arguments, builder or kind of recursion, bars before the first value).
_SINGLE: dict[str, tuple] = {
    "SMA": (ind.sma, 0), "runMean": (ind.sma, 0), "WMA": (ind.wma, 0), "ROC": (ind.roc, 1), "momentum": (ind.momentum, 1), "CCI": (ind.cci, 0), "MFI": (ind.mfi, 1), "CMF": (ind.cmf, 0),
    "runSD": (ind.run_sd, 0), "runVar": (ind.run_var, 0), "runMAD": (ind.run_mad, 0), "EMA": ("ema", 0), "RSI": ("rsi", 1),
}
#: Outputs of functions with several, and our column for each.
OUTPUTS = {
    "ATR": {"tr": "tr", "atr": "atr", "trueHigh": "high", "trueLow": "low"},
    "BBands": {"dn": "dn", "mavg": "mavg", "up": "up", "pctB": "pct_b"},
    "MACD": {"macd": "macd", "signal": "macd_signal", "histogram": "macd_histogram"},
    "aroon": {"aroonUp": "up", "aroonDn": "dn", "oscillator": "osc"},
    "DonchianChannel": {"high": "high", "low": "low", "mid": "mid"},
}


def ttr(name: str, output: str | None = None, *, id: str | None = None, **args: Any) -> Indicator:
    """An indicator of the technical family by name, such as ``ttr("RSI", n=14)`` or
    ``ttr("BBands", "up", n=20)``; for a function that isn't in it give ``function``."""
    said = "_".join(token(x) for x in ("ttr", name, *[v for v in args.values() if not isinstance(v, bool)], *([output] if output else [])))
    made = id or said
    params = {"function": name, "output": output, **args}
    if name in _SINGLE:
        build, more = _SINGLE[name]
        n = args["n"]
        if isinstance(build, str):
            return Indicator(made, n + more, params=params, source="ttr", recursive=(build, n))
        return Indicator(made, n + more, params=params, source="ttr", build=lambda d, o: build(d, n, o))
    if name not in OUTPUTS:
        raise UnknownFeature(f"{name} isn't built in: give its function with from_function")
    if output not in OUTPUTS[name]:
        raise UnknownFeature(f"{name} gives {', '.join(OUTPUTS[name])}")
    part = OUTPUTS[name][output]
    if name == "MACD":
        fast, slow, sig = args["nFast"], args["nSlow"], args["nSig"]
        return Indicator(made, slow + sig - 1, params=params, source="ttr", recursive=(part, fast, slow, sig, args.get("percent", True)))
    n = args["n"]
    if name == "ATR":
        if output == "atr":
            return Indicator(made, n + 1, params=params, source="ttr", recursive=("atr", n))
        return Indicator(made, n + 1, params=params, source="ttr", build=_multi(ind.true_range, made, part))
    build = {"BBands": ind.bbands, "aroon": ind.aroon, "DonchianChannel": ind.donchian}[name]
    return Indicator(made, n, params=params, source="ttr", build=_multi(lambda d, p: build(d, n, p), made, part))


def ttr_outputs(name: str, outputs: Iterable[str] | None = None, **args: Any) -> list[Indicator]:
    """The bundle of a function's outputs."""
    return bundle(*[ttr(name, o, **args) for o in (outputs or OUTPUTS[name])])


def from_function(id: str, fn: Callable, requires_bars: int, **args: Any) -> Indicator:
    """A function of the closing prices seen so far (a numpy array) whose last value counts."""

    def last(window: pd.DataFrame) -> float:
        got = fn(window["close"].to_numpy(), **args)
        return float(got[-1] if hasattr(got, "__len__") else got)

    require_pure(fn)
    return Indicator(id, requires_bars, params={"adapter": "function", "hash": _source(fn), **args}, fn=last)


def from_csv(spark: SparkSession, path: str, value_col: str, id: str, date_col: str = "ts_utc", instrument_col: str = "instrument_id") -> Indicator:
    """Values by time and instrument from a CSV; a bar without a value gets null. Duplicate
    keys, missing columns and empty instruments raise."""
    raw = spark.read.csv(path, header=True)
    missing = [c for c in (date_col, instrument_col, value_col) if c not in raw.columns]
    if missing:
        raise InvalidConfig(f"{path} lacks {', '.join(missing)}")
    at = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(F.col(date_col), "Z$", ""), " ", "T"), F.lit("yyyy-MM-dd['T'HH:mm:ss]"))
    rows = stage(raw.select(F.col(instrument_col).alias("instrument_id"), at.alias("ts_utc"), F.col(value_col).cast("double").alias("_value")), "csv-indicator")
    if not rows.where("instrument_id is null or instrument_id = '' or ts_utc is null").isEmpty():
        raise InvalidConfig(f"{path} has a row without an instrument or a time")
    if not rows.groupBy("instrument_id", "ts_utc").count().where("count > 1").isEmpty():
        raise InvalidConfig(f"{path} has two values for one bar")
    digest = rows.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("instrument_id", "ts_utc", "_value")).alias("x")).first()
    return Indicator(id, 1, params={"adapter": "csv", "path": path, "value_col": value_col, "date_col": date_col, "instrument_col": instrument_col, "rows": digest.n, "hash": digest.x}, source="csv", build=lambda d, o: d.join(rows.withColumnRenamed("_value", o), ["instrument_id", "ts_utc"], "left"))


def bundle(*indicators: Indicator) -> list[Indicator]:
    """Indicators that belong together; ids must differ."""
    if not indicators:
        raise InvalidConfig("a bundle needs an indicator")
    ids = [i.id for i in indicators]
    if len(set(ids)) != len(ids):
        raise InvalidConfig("ids in a bundle must differ")
    return list(indicators)


# Registry, maps and parameters ----------------------------------------------------------------


class Registry(dict):
    """Indicators of a session by name."""

    def register(self, indicator: Indicator, name: str | None = None, overwrite: bool = False) -> None:
        name = name or indicator.id
        if name in self and not overwrite:
            raise InvalidConfig(f"{name} is registered")
        self[name] = indicator

    def get_indicator(self, name: str) -> Indicator:
        if name not in self:
            raise UnknownFeature(f"{name}; known: {', '.join(sorted(self)) or 'none'}")
        return self[name]

    def list(self, pattern: str | None = None) -> list[str]:
        return sorted(k for k in self if pattern is None or re.search(pattern, k))

    def remove(self, name: str) -> None:
        self.get_indicator(name)
        del self[name]


REGISTRY = Registry()
CONSTRUCTORS: dict[str, Callable] = {"sma": sma, "ema": ema, "rsi": rsi, "returns": returns, "ttr": ttr, "ttr_outputs": ttr_outputs}


@dataclass(frozen=True)
class Declared:
    """An indicator, or a bundle, whose arguments each candidate gives: ``declare("sma", n=Param("n"))``."""

    constructor: str
    args: dict[str, Any]
    positional: tuple = ()

    def resolve(self, params: dict[str, Any]) -> Indicator | list[Indicator]:
        return CONSTRUCTORS[self.constructor](*[resolve(v, params) for v in self.positional], **{k: resolve(v, params) for k, v in self.args.items()})


def declare(constructor: str, *positional: Any, **args: Any) -> Declared:
    if constructor not in CONSTRUCTORS:
        raise InvalidConfig(f"unknown constructor {constructor}")
    return Declared(constructor, args, positional)


Features = dict[str, Any] | list


def feature_map(**features: Any) -> dict[str, Any]:
    """Aliases of indicators, bundles and declarations, in order."""
    if not features:
        raise InvalidConfig("a feature map needs a feature")
    if any("__" in k for k in features):
        raise InvalidConfig("__ is reserved in names")
    return dict(features)


def materialise(features: Features, params: dict[str, Any] | None = None) -> dict[str, Indicator]:
    """Alias -> indicator with all parameters resolved. Bundles take their ids as aliases; a bundle
    from a declaration keeps the aliases of its outputs' ids without parameters."""
    items = features.items() if isinstance(features, dict) else [(None, f) for f in features]
    out: dict[str, Indicator] = {}
    for alias, f in items:
        declared = isinstance(f, Declared)
        f = f.resolve(params or {}) if declared else f
        for one in f if isinstance(f, list) else [f]:
            if not isinstance(one, Indicator):
                raise InvalidConfig(f"{alias or one!r} isn't an indicator")
            name = one.id if isinstance(f, list) or alias is None else alias
            if isinstance(f, list) and declared:
                name = "_".join(x for x in (alias, token(one.params.get("output") or one.id)) if x)
            if name in out:
                raise InvalidConfig(f"alias {name} is used twice")
            out[name] = one
    return out


def alias_map(features: Features, params: dict[str, Any] | None = None) -> dict[str, str]:
    return {a: i.id for a, i in materialise(features, params).items()}


def parameters(features: Features) -> list[dict[str, str]]:
    """Where features take a value from a candidate: (param_name, alias, argument, constructor)."""
    items = features.items() if isinstance(features, dict) else [(None, f) for f in features]
    out = []
    for alias, f in items:
        if isinstance(f, Declared):
            args = {**{str(i): v for i, v in enumerate(f.positional)}, **f.args}
            out += [{"param_name": v.name, "alias": alias, "argument": k, "constructor": f.constructor} for k, v in args.items() if isinstance(v, Param)]
    return out


def unique(indicators: Iterable[Indicator]) -> list[Indicator]:
    """One of each fingerprint; one id for two unlike indicators raises."""
    out: dict[str, Indicator] = {}
    for i in indicators:
        if out.setdefault(i.id, i).fingerprint != i.fingerprint:
            raise InvalidConfig(f"two indicators are called {i.id}")
    return list(out.values())


# Values ---------------------------------------------------------------------------------------


def normalised(value: Column, stable_after: int, name: str, by=ind.SERIES) -> Column:
    """Null in warm-up; from then on a null, NaN or infinite value fails the query."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    row = F.row_number().over(ind.series(by))
    return F.when(row >= stable_after, F.when(good, value).otherwise(F.raise_error(F.lit(f"INVALID_FEATURE: {name} isn't finite after warm-up")).cast("double")))


def _values(i: Indicator, bars: pd.DataFrame) -> list[float | None]:
    """Values of a function for one series, checked and masked."""
    n = len(bars)
    if i.series_fn is not None:
        got = list(i.series_fn(bars, i.params) if len(inspect.signature(i.series_fn).parameters) > 1 else i.series_fn(bars))
        if len(got) != n:
            raise InvalidFeature(f"{i.id} gave {len(got)} values for {n} bars")
    else:
        two = len(inspect.signature(i.fn).parameters) > 1
        got = [None] * n
        for k in range(i.stable_after - 1, n):
            window = bars.iloc[k + 1 - i.stable_after : k + 1]
            got[k] = i.fn(window, i.params) if two else i.fn(window)
    out: list[float | None] = [None] * min(i.stable_after - 1, n)
    for k in range(len(out), n):
        v = got[k]
        if v is None or not isinstance(v, (int, float)) and not hasattr(v, "__float__") or not math.isfinite(float(v)):
            raise InvalidFeature(f"{i.id} isn't finite after warm-up")
        out.append(float(v))
    return out


def compute(panel: DataFrame, features: Features, params: dict[str, Any] | None = None, *, strict: bool = True, by=ind.SERIES) -> DataFrame:
    """``panel`` with one column for each indicator id.

    Window columns come first; recursive ones and users' functions share one grouped call, in which
    a task holds the bars of one series. Values that aren't finite after warm-up fail the query, for
    window columns only if ``strict``; those of a CSV may be null.
    """
    todo = unique(materialise(features, params).values())
    taken = [i.id for i in todo if i.id in panel.columns]
    if taken:
        raise InvalidConfig(f"the panel has a column {taken[0]}")
    out = panel
    for i in todo:
        if i.build is not None:
            out = i.build(out, i.id)
            if strict and i.source != "csv":
                out = out.withColumn(i.id, normalised(F.col(i.id), i.stable_after, i.id, by))
    grouped = [i for i in todo if i.build is None]
    if not grouped:
        return out
    schema = T.StructType([*out.schema.fields, *[T.StructField(i.id, T.DoubleType()) for i in grouped]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_utc").reset_index(drop=True)
        for i in grouped:
            pdf[i.id] = ind.KINDS[i.recursive[0]](pdf, *i.recursive[1:]) if i.recursive else _values(i, pdf)
        return pdf

    return out.groupBy(*by).applyInPandas(run, schema)


def check_no_lookahead(panel: DataFrame, features: Features, at, horizons: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Rows (instrument_id, ts_utc, feature_id, horizon) whose value up to ``at`` changes when
    as many later pulses are seen too. An honest indicator gives none."""
    ids = [i.id for i in unique(materialise(features).values())]
    cut = F.lit(str(at)).cast("timestamp_ntz")
    panel = stage(panel, "lookahead")
    later = panel.where(F.col("ts_utc") > cut).select("ts_utc").distinct().orderBy("ts_utc").limit(max(horizons)).collect()
    seen = compute(panel.where(F.col("ts_utc") <= cut), features, strict=False).unpivot(["instrument_id", "ts_utc"], ids, "feature_id", "_v")
    out = None
    for h in horizons:
        if len(later) < h:
            continue
        more = compute(panel.where(F.col("ts_utc") <= F.lit(str(later[h - 1].ts_utc)).cast("timestamp_ntz")), features, strict=False).where(F.col("ts_utc") <= cut)
        both = seen.join(more.unpivot(["instrument_id", "ts_utc"], ids, "feature_id", "_w"), ["instrument_id", "ts_utc", "feature_id"])
        bad = both.where(~F.col("_v").eqNullSafe(F.col("_w"))).select("instrument_id", "ts_utc", "feature_id", F.lit(h).alias("horizon"))
        out = bad if out is None else out.unionByName(bad)
    if out is None:
        raise InvalidConfig("no pulse after the cut")
    return out


# Inspection -----------------------------------------------------------------------------------


def contracts(spark: SparkSession, features: Features, params: dict[str, Any] | None = None) -> DataFrame:
    """(alias, feature_id, source, requires_bars, stable_after) of each feature."""
    named = isinstance(features, dict)
    rows = [(a if named else None, i.id, i.source, int(i.requires_bars), int(i.stable_after)) for a, i in materialise(features, params).items()]
    return driver_table(spark, rows, "alias string, feature_id string, source string, requires_bars int, stable_after int")


def bar_counts(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """(instrument_id, available_bars) of every instrument, 0 for those without bars."""
    have = bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("_n"))
    return instruments.select("instrument_id").distinct().join(have, "instrument_id", "left").select("instrument_id", F.coalesce("_n", F.lit(0)).alias("available_bars"))


def contract_check(instruments: DataFrame, bars: DataFrame, features: Features, params: dict[str, Any] | None = None) -> DataFrame:
    """Every instrument with every contract: are there bars enough to leave warm-up?"""
    x = bar_counts(instruments, bars).crossJoin(contracts(bars.sparkSession, features, params))
    ok = (F.col("available_bars") >= F.col("stable_after")).alias("warmup_achievable")
    return x.select("alias", "instrument_id", "feature_id", "source", "requires_bars", "stable_after", "available_bars", ok)


def warmup_diagnostics(instruments: DataFrame, bars: DataFrame, features: Features, params: dict[str, Any] | None = None) -> DataFrame:
    """The pairs that never leave warm-up."""
    return contract_check(instruments, bars, features, params).where("not warmup_achievable")


def pulse_snapshot(panel: DataFrame, at, universe: list[str] | None = None) -> DataFrame:
    """The rows of one pulse; an instrument of the universe without one raises."""
    x = panel.where(F.col("ts_utc") == F.lit(str(at)).cast("timestamp_ntz"))
    if universe is not None:
        x = x.where(F.col("instrument_id").isin(*universe))
        have = {r.instrument_id for r in x.select("instrument_id").collect()}
        if have != set(universe):
            raise CoverageError(f"no bar at {at} for {', '.join(sorted(set(universe) - have))}")
    return x


def feature_rows(panel: DataFrame, feature_ids: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """(ts_utc, instrument_id, feature_id, feature_value, alias): all features without aliases, or
    those the map names, once for each alias."""
    missing = [f for f in (aliases or {}).values() if f not in feature_ids]
    if missing:
        raise UnknownFeature(f"{missing[0]}; known: {', '.join(feature_ids) or 'none'}")
    long = panel.unpivot(["ts_utc", "instrument_id"], list(feature_ids), "feature_id", "feature_value")
    if aliases is None:
        return long.withColumn("alias", F.lit(None).cast("string"))
    return long.join(driver_table(panel.sparkSession, [(f, a) for a, f in aliases.items()], "feature_id string, alias string"), "feature_id").select("ts_utc", "instrument_id", "feature_id", "feature_value", "alias")


# Precomputing and caching ---------------------------------------------------------------------


@dataclass(frozen=True)
class Precomputed:
    """The union of all candidates' features over one panel, computed once."""

    panel: DataFrame
    indicators: list[Indicator]
    aliases: dict[str, dict[str, str]]  # candidate label -> alias -> feature id
    snapshot_hash: str
    engine_version: str = ENGINE_VERSION

    def require(self, snapshot_hash: str) -> "Precomputed":
        """This, or an error if it belongs to other bars or another engine."""
        if (snapshot_hash, ENGINE_VERSION) != (self.snapshot_hash, self.engine_version):
            raise InvalidConfig("features were computed on other bars or by another engine")
        return self

    def pick(self, alias: str) -> Column:
        """The feature that each candidate calls ``alias``, beside ``candidate_id``."""
        of: dict[str, list[str]] = {}
        for label, names in self.aliases.items():
            if alias in names:
                of.setdefault(names[alias], []).append(label)
        if not of:
            raise UnknownFeature(alias)
        out = F.lit(None).cast("double")
        for fid, labels in of.items():
            out = F.when(F.col("candidate_id").isin(*labels), F.col(f"`{fid}`")).otherwise(out)
        return out

    def warmup(self, scoring_start) -> DataFrame:
        """(candidate_id, instrument_id, feature_id, stable_after, available_bars, warmup_achievable)
        by the bars up to the start of scoring."""
        spark, by_id = self.panel.sparkSession, {i.id: i for i in self.indicators}
        rows = [(c, f, int(by_id[f].stable_after)) for c, names in self.aliases.items() for f in sorted(set(names.values()))]
        seen = self.panel.groupBy("instrument_id").agg(F.count_if(F.col("ts_utc") <= F.lit(str(scoring_start)).cast("timestamp_ntz")).alias("available_bars"))
        x = seen.crossJoin(driver_table(spark, rows, "candidate_id string, feature_id string, stable_after int"))
        return x.select("candidate_id", "instrument_id", "feature_id", "stable_after", "available_bars", (F.col("available_bars") >= F.col("stable_after")).alias("warmup_achievable"))


class FeatureCache(dict):
    """Stored panels of a session by what they were computed from."""

    def key(self, snapshot_hash: str, indicators: Iterable[Indicator], start=None, end=None) -> str:
        return sha256(canonical_json([snapshot_hash, ENGINE_VERSION, str(start), str(end), sorted(i.fingerprint for i in indicators)]))


CACHE = FeatureCache()


def precompute(panel: DataFrame, candidates: list, features: Features, snapshot_hash: str = "", cache: FeatureCache | None = CACHE, start=None, end=None) -> Precomputed:
    """Features of all candidates of a grid: each distinct one once, written once. A cache entry holds
    for a sealed panel only, so without a ``snapshot_hash`` nothing is cached."""
    aliases = {c.label: {a: i.id for a, i in materialise(features, {**c.params, **c.feature_params}).items()} for c in candidates}
    todo = unique(i for c in candidates for i in materialise(features, {**c.params, **c.feature_params}).values())
    key = None if cache is None or not snapshot_hash else cache.key(snapshot_hash, todo, start, end)
    if key is None or key not in cache:
        got = stage(compute(panel, todo, strict=False), "features")
        if key is None:
            return Precomputed(got, todo, aliases, snapshot_hash)
        cache[key] = got
    return Precomputed(cache[key], todo, aliases, snapshot_hash)


def latest_values(panel: DataFrame, feature_ids: list[str]) -> DataFrame:
    """The last row of each series with its features."""
    w = Window.partitionBy("instrument_id").orderBy(F.desc("ts_utc"))
    return panel.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("instrument_id", "ts_utc", *[F.col(f"`{f}`") for f in feature_ids])


def renamed(indicator: Indicator, id: str) -> Indicator:
    return replace(indicator, id=id)
