"""Schemas, canonical JSON, hashes, timestamps and derived seeds."""

from __future__ import annotations

import hashlib
import json
import math
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidBars, InvalidConfig

_TYPES = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "timestamp_ntz": T.TimestampNTZType()}


def struct(text: str) -> T.StructType:
    """A schema from "name type, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


BARS = struct("instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double")
INSTRUMENTS = struct("instrument_id string, symbol string, currency string, asset_class string, multiplier double, tick_size double, meta_json string")
LEDGER = struct(
    "event_id string, run_id string, ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long, meta_json string"
)
EQUITY = struct("run_id string, ts_utc timestamp_ntz, cash double, positions_value double, equity double, realized_pnl double, unrealized_pnl double")


def validate_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    """``df`` cast and ordered as ``want``; missing columns raise."""
    missing = [f.name for f in want if f.name not in df.columns]
    if missing:
        raise InvalidBars(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want])


def canonical_json(value: Any) -> str:
    """JSON with sorted keys, full digits, and null for what isn't a finite number."""

    def plain(v: Any) -> Any:
        if isinstance(v, float):
            return v if math.isfinite(v) else None
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, (datetime, date)):
            return iso_utc(v)
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256(value: Any) -> str:
    """The hash of a value's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def utc(value: str | date | datetime) -> datetime:
    """A whole-second naive UTC timestamp of an ISO text, date or datetime."""
    if isinstance(value, str):
        text = value.strip().replace("Z", "+00:00")
        try:
            value = datetime.fromisoformat(text)
        except ValueError as e:
            raise InvalidConfig(f"not an ISO timestamp: {value!r}") from e
    elif isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    if value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    if value.microsecond:
        raise InvalidBars(f"{value} isn't a whole second")
    return value


def iso_utc(value: str | date | datetime) -> str:
    return utc(value).strftime("%Y-%m-%dT%H:%M:%SZ")


def utc_column(text: Column) -> Column:
    """Whole-second timestamps of ISO texts (a date, or date and time with ``T`` or a space, and ``Z``
    or an offset or nothing after it, which is UTC); null for null, and for any other text."""
    t = F.trim(text)
    shaped = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})?)?$")
    day = F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))
    clock = F.try_to_timestamp(F.concat(F.substring(t, 1, 10), F.lit(" "), F.substring(t, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    offset = F.regexp_extract(t, r"([+-]\d{2}):?(\d{2})$", 0)
    minutes = F.when(F.length(t) <= 19, 0).otherwise(F.coalesce(F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int") * (F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, -2, 2).try_cast("int")), F.lit(0)))
    at = F.when(F.length(t) == 10, day).otherwise(clock) - F.make_dt_interval(mins=minutes)
    return F.when(shaped, at).cast("timestamp_ntz")


def read_json(text: str | None) -> Any:
    """A value of JSON; nothing for null or empty text, and an error for what isn't JSON."""
    if text is None or not text.strip():
        return None
    try:
        return json.loads(text)
    except ValueError as e:
        raise InvalidConfig(f"not JSON: {text[:60]!r}") from e


def named_numbers(values: dict[str, Any], defaults: dict[str, float]) -> dict[str, float]:
    """``defaults`` with ``values`` over them: known names only, finite numbers only."""
    unknown = sorted(set(values) - set(defaults))
    if unknown:
        raise InvalidConfig(f"unknown {unknown[0]}; known: {', '.join(defaults)}")
    bad = [k for k, v in values.items() if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v)]
    if bad:
        raise InvalidConfig(f"{bad[0]} must be a finite number")
    return {k: float(values.get(k, v)) for k, v in defaults.items()}


def alias_names(aliases: dict[str, str]) -> dict[str, str]:
    """Alias -> feature id, in order; empty names and the reserved ``__`` raise."""
    for alias, fid in aliases.items():
        if not isinstance(alias, str) or not isinstance(fid, str) or not alias.strip() or not fid.strip() or "__" in alias:
            raise InvalidConfig(f"{alias!r} can't name {fid!r}")
    return dict(aliases)


#: Starts and weights of the six digest chunks that make a seed, and the modulus.
SEED_STARTS, SEED_WEIGHTS, SEED_MODULUS = (1, 7, 13, 19, 25, 31), (1, 17, 257, 4099, 65537, 104729), 2147483647


def derive_seed(master: int, salt: dict[str, Any]) -> int:
    """A seed from a master seed and what the work is for: the same in any process."""
    if isinstance(master, bool) or not isinstance(master, int) or not 0 <= master <= SEED_MODULUS:
        raise InvalidConfig(f"a seed is a whole number from 0 to {SEED_MODULUS}")
    digest = sha256({"master_seed": master, "salt": salt})
    return seed_of_digest(digest)


def seed_of_digest(digest: str) -> int:
    total = sum(int(digest[s - 1 : s + 5], 16) * w for s, w in zip(SEED_STARTS, SEED_WEIGHTS, strict=True))
    return total % SEED_MODULUS + 1


def seed_column(text: Column) -> Column:
    """The seed of a text's SHA-256, as a column."""
    digest = F.sha2(text, 256)
    total = F.lit(0).cast("long")
    for s, w in zip(SEED_STARTS, SEED_WEIGHTS, strict=True):
        total = total + F.conv(F.substring(digest, s, 6), 16, 10).cast("long") * w
    return total % SEED_MODULUS + 1
