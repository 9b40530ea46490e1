"""Simulated daily bars: geometric steps with a common market factor, reproducible by seed."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidConfig


def business_days(start: date, n: int) -> list[date]:
    out, at = [], start
    while len(out) < n:
        if at.weekday() < 5:
            out.append(at)
        at += timedelta(days=1)
    return out


def sim_bars(spark: SparkSession, n_instruments: int = 10, n_days: int = 1260, seed: int = 1, start: str = "2018-01-01", prefix: str = "DEMO_") -> DataFrame:
    """Instruments are made side by side: each has a counter-based stream of its own."""
    if n_instruments < 1 or n_days < 1:
        raise InvalidConfig("simulation needs an instrument and a day")
    days = business_days(date.fromisoformat(start), n_days)
    market = np.random.Generator(np.random.Philox(key=seed)).normal(0.0002, 0.008, n_days)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["id"].iloc[0])
        r = np.random.Generator(np.random.Philox(key=seed + (k + 1) * 1_000_003))
        close = np.round(50 * (1 + k % 7) * np.exp(np.cumsum((0.6 + 0.1 * (k % 8)) * market + r.normal(0, 0.012, n_days))), 8)
        open_ = np.round(np.append(close[0], close[:-1]) * np.exp(r.normal(0, 0.003, n_days)), 8)
        wide = np.abs(r.normal(0, 0.004, (2, n_days)))
        return pd.DataFrame({"instrument_id": f"{prefix}{k + 1:03d}", "ts_utc": pd.to_datetime(days), "open": open_, "high": np.round(np.maximum(open_, close) * (1 + wide[0]), 8), "low": np.round(np.minimum(open_, close) * (1 - wide[1]), 8), "close": close, "volume": np.round(r.lognormal(11, 0.4, n_days))})

    schema = "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double"
    return spark.range(n_instruments).withColumn("g", F.col("id")).groupBy("g").applyInPandas(make, schema)
