"""Selection-integrity statistics over retained returns (candidate_id, ts_utc, period_return)."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..storage import driver_table, stage

EULER = 0.5772156649


def _numbered(returns: DataFrame) -> DataFrame:
    w = Window.partitionBy("candidate_id").orderBy("ts_utc")
    return returns.where("period_return is not null").withColumn("rn", F.row_number().over(w))


def splits(s: int) -> list[tuple[int, int, bool]]:
    """(case, block, in sample) of all choices of half of ``s`` blocks."""
    if s < 2 or s % 2:
        raise ValidationError("S must be even and at least 2")
    out = []
    for case, chosen in enumerate(combinations(range(1, s + 1), s // 2), 1):
        out += [(case, b, b in chosen) for b in range(1, s + 1)]
    return out


def pbo_cases(returns: DataFrame, s: int = 4, metric: Callable | None = None) -> DataFrame:
    """One row for each split: the in-sample winner, its average out-of-sample rank, omega and
    lambda (null where infinite, when the winner is best out of sample).

    The splits are a table of binomial size in ``s``; block sums are aggregated first, so
    the join is of candidates times blocks, whatever the length of the history. Returns are
    computed once, numbered and written, and one row says whether their lengths agree.

    ``metric`` (a matrix of time by candidate -> one score for each column) takes the place of the mean:
    each split is one grouped call over the returns, as such a score doesn't add up from blocks.
    """
    spark = returns.sparkSession
    x = stage(_numbered(returns.select("candidate_id", "ts_utc", "period_return")), "pbo-returns")
    t = x.groupBy("candidate_id").agg(F.max("rn").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if t.k < 2 or t.lo != t.hi:
        raise ValidationError("PBO needs two candidates or more with as many returns each")
    if t.lo < 4 or t.lo % s:
        raise ValidationError(f"S must divide the {t.lo} returns")
    size = t.lo // s
    blocks = x.groupBy("candidate_id", (F.floor((F.col("rn") - 1) / size) + 1).alias("block")).agg(F.sum("period_return").alias("r"))
    cases = driver_table(spark, splits(s), "case_id int, block int, is_in boolean")
    m = _scored(x, cases, size, metric) if metric else blocks.join(cases, "block").groupBy("case_id", "candidate_id").agg(
        F.round(F.sum(F.when(F.col("is_in"), F.col("r"))) / (size * s // 2), 12).alias("ins"), F.round(F.sum(F.when(~F.col("is_in"), F.col("r"))) / (size * s // 2), 12).alias("oos")
    )
    win = Window.partitionBy("case_id").orderBy(F.desc("ins"), "candidate_id")
    tie = F.count(F.lit(1)).over(Window.partitionBy("case_id", "oos"))
    m = m.withColumns({"w": F.row_number().over(win), "rank_": F.rank().over(Window.partitionBy("case_id").orderBy("oos")) + (tie - 1) / 2, "n": F.count(F.lit(1)).over(Window.partitionBy("case_id"))})
    m = m.where("w = 1").withColumn("omega", F.col("rank_") / F.col("n"))
    lam = F.when(F.col("omega") < 1, F.ln(F.col("omega") / F.nullif(1 - F.col("omega"), F.lit(0.0))))
    return m.select("case_id", F.col("candidate_id").alias("winner"), F.col("rank_").cast("double").alias("oos_rank"), "omega", lam.alias("logit"))


def _scored(x: DataFrame, cases: DataFrame, size: int, metric: Callable) -> DataFrame:
    """(case_id, candidate_id, ins, oos) by a function of the returns of each half."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for inside, half in pdf.groupby("is_in"):
            wide = half.pivot(index="rn", columns="candidate_id", values="period_return").sort_index()
            got = np.asarray(metric(wide.to_numpy()), float)
            if got.shape != (wide.shape[1],) or not np.isfinite(got).all():
                raise ValidationError("a metric gives one finite score for each candidate")
            out["ins" if inside else "oos"] = np.round(got, 12)
        names = sorted(pdf["candidate_id"].unique())
        return pd.DataFrame({"case_id": pdf["case_id"].iloc[0], "candidate_id": names, **out})

    rows = x.withColumn("block", (F.floor((F.col("rn") - 1) / size) + 1).cast("int")).join(cases, "block")
    return rows.groupBy("case_id").applyInPandas(run, "case_id int, candidate_id string, ins double, oos double")


def pbo(returns: DataFrame, s: int = 4, threshold: float = 0.0, metric: Callable | None = None) -> DataFrame:
    """The probability of back-test overfitting: the share of splits with lambda up to ``threshold``."""
    c = pbo_cases(returns, s, metric)
    return c.agg(F.avg(F.when(F.col("logit") <= threshold, 1.0).otherwise(0.0)).alias("pbo"), F.count(F.lit(1)).alias("n_cases"))


def moments(returns: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """(candidate_id, n, sharpe, skew, kurtosis): per period; kurtosis isn't excess."""
    x = returns.where("period_return is not null").withColumn("e", F.col("period_return") - risk_free)
    sd = F.stddev_samp("e")
    return x.groupBy("candidate_id").agg(F.count("e").alias("n"), F.when(sd > 0, F.avg("e") / F.nullif(sd, F.lit(0.0))).alias("sharpe"), F.skewness("e").alias("skew"), (F.kurtosis("e") + 3).alias("kurtosis"))


def min_track_record(returns: DataFrame, reference_sharpe: float = 0.0, confidence: float = 0.95, risk_free: float = 0.0) -> DataFrame:
    """The track record that a Sharpe ratio needs; null (infinite) up to the reference."""
    z = NormalDist().inv_cdf(confidence)
    m = moments(returns, risk_free)
    sr = F.col("sharpe")
    over = F.nullif(sr - reference_sharpe, F.lit(0.0))
    need = 1 + (1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr) * F.pow(z / over, F.lit(2.0))
    m = m.withColumn("min_trl", F.when(sr > reference_sharpe, need))
    return m.withColumn("significant", F.coalesce(F.col("n") > F.col("min_trl"), F.lit(False))).withColumn("extra", F.ceil(F.greatest(F.col("min_trl") - F.col("n"), F.lit(0.0))).cast("long"))


def correlations(returns: DataFrame) -> DataFrame:
    """(a, b, r) for each pair of candidates, in one aggregation over shared timestamps."""
    x = returns.where("period_return is not null").select("candidate_id", "ts_utc", "period_return")
    a = x.select(F.col("candidate_id").alias("a"), "ts_utc", F.col("period_return").alias("x"))
    b = x.select(F.col("candidate_id").alias("b"), "ts_utc", F.col("period_return").alias("y"))
    return a.join(b, "ts_utc").where("a < b").groupBy("a", "b").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr("x", "y"))).alias("r"))


def complete_linkage(names: list[str], distance: dict[tuple[str, str], float], cut: float) -> dict[str, int]:
    """Clusters of complete linkage cut at ``cut``, numbered by first appearance in ``names``."""
    groups = [[n] for n in names]
    far = lambda g, h: max(distance[(min(a, b), max(a, b))] for a in g for b in h)
    while len(groups) > 1:
        d, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > cut:
            break
        groups[i] += groups.pop(j)
    of = {n: k for k, g in enumerate(groups) for n in g}
    seen: dict[int, int] = {}
    return {n: seen.setdefault(of[n], len(seen) + 1) for n in names}


def clusters(returns: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(candidate_id, cluster): effective trials. Correlations are one Spark job; only the
    matrix of the grid's candidates comes to the driver."""
    got = correlations(returns).collect()
    if any(r.r is None for r in got):
        raise ValidationError("a candidate's returns don't vary")
    names = sorted({x for r in got for x in (r.a, r.b)}) or [r.candidate_id for r in returns.select("candidate_id").distinct().collect()]
    at = complete_linkage(names, {(r.a, r.b): 1 - r.r for r in got}, threshold)
    return returns.sparkSession.createDataFrame(sorted(at.items()), "candidate_id string, cluster int")


def deflated_sharpe(returns: DataFrame, effective_trials: float, confidence: float = 0.95, risk_free: float = 0.0) -> DataFrame:
    """(…, dsr_z, dsr, significant): the Sharpe ratio held against the best of so many trials.

    The normal distribution isn't a Spark function: its quantiles are literals here, and its
    cumulative value is a series.
    """
    m = moments(returns, risk_free)
    raw = m.count()
    if not 2 <= effective_trials <= max(raw, 2):
        raise ValidationError("effective trials must be from 2 to the number of candidates")
    n, nd = float(effective_trials), NormalDist()
    best = (1 - EULER) * nd.inv_cdf(1 - 1 / n) + EULER * nd.inv_cdf(1 - 1 / (n * math.e))
    sr0 = m.agg((F.stddev_samp("sharpe") * best).alias("sr0"))
    sr = F.col("sharpe")
    spread = F.sqrt(1 - F.col("skew") * sr + (F.col("kurtosis") - 1) / 4 * sr * sr)
    out = m.crossJoin(sr0).withColumn("dsr_z", (sr - F.col("sr0")) * F.sqrt(F.col("n") - 1) / F.nullif(spread, F.lit(0.0)))
    return out.withColumn("dsr", normal_cdf(F.col("dsr_z"))).withColumn("significant", F.col("dsr_z") >= nd.inv_cdf(confidence))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function, by its series: 0.5 + density * (z + z^3/3 + z^5/(3*5) + ...)."""
    start = F.struct(z.cast("double").alias("term"), z.cast("double").alias("sum"))
    step = lambda a, k: F.struct((a["term"] * z * z / (2 * k + 3)).alias("term"), (a["sum"] + a["term"] * z * z / (2 * k + 3)).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(150)), start, step, lambda a: a["sum"])
    inside = 0.5 + F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total
    return F.when(z > 8, 1.0).when(z < -8, 0.0).otherwise(inside)
