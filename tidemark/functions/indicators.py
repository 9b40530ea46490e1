"""Indicators as window columns: warm-up is null and no value looks ahead.

Each function takes bars and returns them with new columns; ``by`` names what a series is
(instrument, or candidate and instrument). All of one ``by`` share a sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("instrument_id",)


def series(by=SERIES):
    return Window.partitionBy(*by).orderBy("ts_utc")


def _last(n: int, by=SERIES):
    return series(by).rowsBetween(-(n - 1), 0)


def _after(n: int, value: Column, by=SERIES) -> Column:
    """Null before the n-th bar of a series."""
    return F.when(F.row_number().over(series(by)) >= n, value)


def _lag(c: str, k: int, by=SERIES) -> Column:
    return F.col(c) if k == 0 else F.lag(c, k).over(series(by))


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def sma(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, _after(n, F.avg(c).over(_last(n, by)), by))


def ema_bounded(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    """Exponential weights over a window of n + 1 bars, seeded with the oldest."""
    a = 2 / (n + 1)
    terms = [_lag(c, k, by) * (a * (1 - a) ** k) for k in range(n)] + [_lag(c, n, by) * (1 - a) ** n]
    return df.withColumn(out, _after(n + 1, _total(terms), by))


def rsi_simple(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    """Relative strength over simple means of gains and losses; 100 without a loss."""
    steps = df.withColumn("_step", F.col(c) - F.lag(c).over(series(by)))
    gain, loss = (F.avg(F.greatest(s * F.col("_step"), F.lit(0.0))).over(_last(n, by)) for s in (F.lit(1), F.lit(-1)))
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return steps.withColumn(out, _after(n + 1, value, by)).drop("_step")


def returns(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    past = F.lag(c, n).over(series(by))
    return df.withColumn(out, (F.col(c) - past) / F.nullif(past, F.lit(0.0)))


def wma(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, _after(n, _total([_lag(c, k, by) * (n - k) for k in range(n)]) / (n * (n + 1) / 2), by))


def roc(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, F.ln(F.col(c) / F.nullif(F.lag(c, n).over(series(by)), F.lit(0.0))))


def momentum(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, F.col(c) - F.lag(c, n).over(series(by)))


def cci(df: DataFrame, n: int, out: str, by=SERIES) -> DataFrame:
    """Commodity channel index with the usual constant 0.015."""
    x = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    x = x.withColumn("_all", F.collect_list("_tp").over(_last(n, by))).withColumn("_mean", F.avg("_tp").over(_last(n, by)))
    dev = F.aggregate("_all", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_mean"))) / n
    return x.withColumn(out, _after(n, (F.col("_tp") - F.col("_mean")) / F.nullif(0.015 * dev, F.lit(0.0)), by)).drop("_tp", "_all", "_mean")


def bbands(df: DataFrame, n: int, prefix: str, c: str = "close", by=SERIES, width: float = 2.0) -> DataFrame:
    """Bands of ``width`` population deviations around the mean: dn, mavg, up, pct_b."""
    m, s = F.avg(c).over(_last(n, by)), F.stddev_pop(c).over(_last(n, by))
    x = df.withColumn(f"{prefix}_dn", _after(n, m - width * s, by)).withColumn(f"{prefix}_mavg", _after(n, m, by)).withColumn(f"{prefix}_up", _after(n, m + width * s, by))
    dn, up = F.col(f"{prefix}_dn"), F.col(f"{prefix}_up")
    return x.withColumn(f"{prefix}_pct_b", (F.col(c) - dn) / F.nullif(up - dn, F.lit(0.0)))


def donchian(df: DataFrame, n: int, prefix: str, by=SERIES) -> DataFrame:
    hi, lo = F.max("high").over(_last(n, by)), F.min("low").over(_last(n, by))
    return df.withColumns({f"{prefix}_high": _after(n, hi, by), f"{prefix}_mid": _after(n, (hi + lo) / 2, by), f"{prefix}_low": _after(n, lo, by)})


def aroon(df: DataFrame, n: int, prefix: str, by=SERIES) -> DataFrame:
    """Bars since the extremes of the last n bars, the latest of ties: up, dn, oscillator."""
    x = df.withColumn("_rn", F.row_number().over(series(by)))
    top = F.max(F.struct("high", "_rn")).over(_last(n, by))["_rn"]
    low = F.max(F.struct((-F.col("low")).alias("v"), F.col("_rn"))).over(_last(n, by))["_rn"]
    up, dn = 100 * (n - (F.col("_rn") - top)) / n, 100 * (n - (F.col("_rn") - low)) / n
    return x.withColumns({f"{prefix}_up": _after(n, up, by), f"{prefix}_dn": _after(n, dn, by), f"{prefix}_osc": _after(n, up - dn, by)}).drop("_rn")


def true_range(df: DataFrame, prefix: str, by=SERIES) -> DataFrame:
    """The range with the close before in it: tr, high, low; null on a series' first bar."""
    was = F.lag("close").over(series(by))
    hi, lo = F.when(was.isNotNull(), F.greatest("high", was)), F.when(was.isNotNull(), F.least("low", was))
    return df.withColumns({f"{prefix}_tr": hi - lo, f"{prefix}_high": hi, f"{prefix}_low": lo})


def mfi(df: DataFrame, n: int, out: str, by=SERIES) -> DataFrame:
    """Money flow index: flows that rose against flows that fell."""
    x = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    x = x.withColumn("_was", F.lag("_tp").over(series(by)))
    flow = F.col("_tp") * F.col("volume")
    pos = F.sum(F.when(F.col("_tp") > F.col("_was"), flow).otherwise(0.0)).over(_last(n, by))
    neg = F.sum(F.when(F.col("_tp") < F.col("_was"), flow).otherwise(0.0)).over(_last(n, by))
    return x.withColumn(out, _after(n + 1, F.when(neg == 0, 100.0).otherwise(100 - 100 / (1 + pos / F.nullif(neg, F.lit(0.0)))), by)).drop("_tp", "_was")


def cmf(df: DataFrame, n: int, out: str, by=SERIES) -> DataFrame:
    """Chaikin money flow; a bar without range counts as zero."""
    span = F.col("high") - F.col("low")
    clv = F.when(span == 0, 0.0).otherwise(((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / F.nullif(span, F.lit(0.0)))
    return df.withColumn(out, _after(n, F.sum(clv * F.col("volume")).over(_last(n, by)) / F.nullif(F.sum("volume").over(_last(n, by)), F.lit(0.0)), by))


def run_sd(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, _after(n, F.stddev_samp(c).over(_last(n, by)), by))


def run_var(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    return df.withColumn(out, _after(n, F.var_samp(c).over(_last(n, by)), by))


def _median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def run_mad(df: DataFrame, n: int, out: str, c: str = "close", by=SERIES) -> DataFrame:
    """Median absolute deviation times 1.4826."""
    x = df.withColumn("_all", F.collect_list(c).over(_last(n, by))).withColumn("_mid", _median(F.col("_all")))
    return x.withColumn(out, _after(n, 1.4826 * _median(F.transform("_all", lambda v: F.abs(v - F.col("_mid")))), by)).drop("_all", "_mid")


def recursive(df: DataFrame, columns: dict[str, tuple], by=SERIES) -> DataFrame:
    """Recursive indicators, each series in one grouped pandas call, which no window can express.

    ``columns`` maps an output to ("ema", n), ("rsi", n), ("atr", n), ("macd", fast, slow, signal),
    ("macd_signal", ...) or ("macd_histogram", ...); a False after the periods of the last three gives
    differences of prices instead of percents. A series is the bars of one instrument, and only it must
    fit a worker.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_utc").reset_index(drop=True)
        for name, (kind, *args) in columns.items():
            pdf[name] = KINDS[kind](pdf, *args)
        return pdf

    return df.groupBy(*by).applyInPandas(run, schema)


def smooth(x: list[float | None], n: int, ratio: float) -> list[float | None]:
    """Recursive smoothing of what follows leading nulls, seeded with the mean of the first n."""
    start = next((i for i, v in enumerate(x) if v is not None), len(x))
    out: list[float | None] = [None] * len(x)
    if start + n > len(x):
        return out
    now = sum(x[start : start + n]) / n
    out[start + n - 1] = now
    for i in range(start + n, len(x)):
        now = x[i] * ratio + now * (1 - ratio)
        out[i] = now
    return out


def _ema(pdf: pd.DataFrame, n: int) -> list:
    return smooth(pdf["close"].tolist(), n, 2 / (n + 1))


def _rsi(pdf: pd.DataFrame, n: int) -> list:
    c = pdf["close"].tolist()
    steps = [None] + [b - a for a, b in zip(c, c[1:], strict=False)]
    up = smooth([None if s is None else max(s, 0.0) for s in steps], n, 1 / n)
    dn = smooth([None if s is None else max(-s, 0.0) for s in steps], n, 1 / n)
    return [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, dn, strict=True)]


def _atr(pdf: pd.DataFrame, n: int) -> list:
    h, lo, c = (pdf[k].tolist() for k in ("high", "low", "close"))
    tr = [None] + [max(h[i], c[i - 1]) - min(lo[i], c[i - 1]) for i in range(1, len(c))]
    return smooth(tr, n, 1 / n)


def _macd(pdf: pd.DataFrame, fast: int, slow: int, signal: int, percent: bool = True) -> list:
    f, s = _ema(pdf, fast), _ema(pdf, slow)
    return [None if a is None or b is None else 100 * (a / b - 1) if percent else a - b for a, b in zip(f, s, strict=True)]


def _macd_signal(pdf: pd.DataFrame, fast: int, slow: int, signal: int, percent: bool = True) -> list:
    return smooth(_macd(pdf, fast, slow, signal, percent), signal, 2 / (signal + 1))


def _macd_histogram(pdf: pd.DataFrame, *args: int) -> list:
    return [None if b is None else a - b for a, b in zip(_macd(pdf, *args), _macd_signal(pdf, *args), strict=True)]


KINDS = {"ema": _ema, "rsi": _rsi, "atr": _atr, "macd": _macd, "macd_signal": _macd_signal, "macd_histogram": _macd_histogram}
#: Bars before the first value, by function and period (macd: slow and signal).
WARM_UP = {
    "sma": lambda n: n, "ema_bounded": lambda n: n + 1, "rsi_simple": lambda n: n + 1, "returns": lambda n: n + 1, "wma": lambda n: n, "roc": lambda n: n + 1,
    "momentum": lambda n: n + 1, "cci": lambda n: n, "bbands": lambda n: n, "donchian": lambda n: n, "aroon": lambda n: n, "mfi": lambda n: n + 1, "cmf": lambda n: n,
    "run_sd": lambda n: n, "run_var": lambda n: n, "run_mad": lambda n: n, "ema": lambda n: n, "rsi": lambda n: n + 1, "atr": lambda n: n + 1, "macd": lambda slow, signal: slow + signal - 1,
}
