"""Golden cases, parity of the window plan with the sequential fold, and refusals."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import indicators as ind
from tidemark.operators import accounting, cost, ledger, metrics, risk, strategy
from tidemark.plans import fold, grids, preflight, sweep, validation, walkforward
from tidemark.schema import canonical_json, derive_seed, iso_utc, seed_of_digest, utc
from tidemark.sources import panels, simulate, snapshots

DAY = dt.datetime(2020, 1, 1)


def events(spark, rows):
    out = []
    for n, (i, side, q, p) in enumerate(rows, 1):
        s = 1 if side == "BUY" else -1
        out.append((DAY + dt.timedelta(days=n), "FILL", i, side, float(q), float(p), 0.0, -s * q * p * 1.0, s * q * 1.0, n))
    return spark.createDataFrame(out, "ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long")


def legs(spark, rows):
    got = accounting.fill_rows(events(spark, rows)).collect()
    return sorted((r.event_seq, r.action, r.qty, r.realized_pnl) for r in got)


def test_fifo_flip(spark):
    got = legs(spark, [("A", "BUY", 100, 10), ("A", "SELL", 250, 12), ("A", "BUY", 150, 11)])
    assert got == [(1, "OPEN", 100, 0), (2, "CLOSE", 100, 200), (2, "OPEN", 150, 0), (3, "CLOSE", 150, 150)]


def test_fifo_lots_and_isolation(spark):
    got = legs(spark, [("A", "BUY", 10, 10), ("A", "BUY", 10, 11), ("A", "BUY", 10, 12), ("A", "SELL", 25, 13)])
    assert got[-1] == (4, "CLOSE", 25, 55)
    got = legs(spark, [("BTC", "BUY", 1, 100), ("ETH", "BUY", 2, 50), ("BTC", "SELL", 1, 110)])
    assert sum(x[3] for x in got) == 10


def test_fifo_random_against_lots(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ABC"), rng.choice(["BUY", "SELL"]), rng.randint(1, 30), rng.randint(5, 50)) for _ in range(300)]
    lots = {k: fold.Lots() for k in "ABC"}
    want = {n: lots[i].fill(q if s == "BUY" else -q, float(p)) for n, (i, s, q, p) in enumerate(rows, 1)}
    got = {}
    for n, action, _, r in legs(spark, rows):
        got[n] = got.get(n, 0) + r
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


@pytest.mark.parametrize("panel", [panels.ptype_month, panels.event_day])
def test_windows_match_fold(spark, sf_dir, panel):
    x = ind.sma(ind.sma(panel(spark, sf_dir), 3, "fast"), 6, "slow")
    flips = F.when(F.col("fast") > F.col("slow"), 4.0).when(F.col("fast") < F.col("slow"), -3.0).otherwise(0.0)
    x = x.withColumn("target", flips)
    names = [r.instrument_id for r in x.select("instrument_id").distinct().orderBy("instrument_id").collect()]
    opening = ledger.Opening(1e5, {names[0]: 5.0}, {names[0]: 90.0})
    start = x.agg(F.min("ts_utc")).first()[0]
    c = cost.chain(cost.spread_bps(10), cost.fixed_fee(1), cost.notional_bps_fee(3))
    ev = ledger.events(ledger.fills(x, c, opening), start, opening)
    eq = [tuple(r)[1:] for r in accounting.equity(x, ev, 1e5).orderBy("ts_utc").collect()]

    def strategy_fn(ctx, params):
        out = {}
        for i in ctx.universe:
            f, s = ctx.feature(i, "fast"), ctx.feature(i, "slow")
            out[i] = 0.0 if s is None else 4.0 if f > s else -3.0 if f < s else 0.0
        return out

    r = fold.run_fold(x.toPandas(), strategy_fn, {}, c, opening=opening, features=("fast", "slow"))
    got = [(e.event_seq, e.instrument_id, e.side, e.qty) for e in ev.orderBy("event_seq").collect()]
    assert got == [(e["event_seq"], e["instrument_id"], e["side"], e["qty"]) for e in r.events]
    want = [tuple(e[k] for k in ("cash", "positions_value", "equity", "realized_pnl", "unrealized_pnl")) for e in r.equity]
    assert np.allclose(np.array(eq), np.array(want), rtol=1e-10, atol=1e-6)


def test_no_lookahead_and_order_of_rows(spark):
    bars = simulate.sim_bars(spark, 2, 40, 3).persist()
    build = [
        lambda d: ind.sma(d, 4, "v"), lambda d: ind.ema_bounded(d, 4, "v"), lambda d: ind.rsi_simple(d, 4, "v"), lambda d: ind.returns(d, 2, "v"), lambda d: ind.cci(d, 4, "v"),
        lambda d: ind.mfi(d, 4, "v"), lambda d: ind.run_mad(d, 4, "v"), lambda d: ind.recursive(d, {"v": ("rsi", 4)}), lambda d: ind.recursive(d, {"v": ("macd_signal", 3, 5, 2)}),
    ]
    cut = bars.select("ts_utc").distinct().orderBy("ts_utc").collect()[29].ts_utc
    for f in build:
        key = lambda d: {(r.instrument_id, r.ts_utc): r.v for r in d.collect()}
        whole, part = key(f(bars)), key(f(bars.where(F.col("ts_utc") <= F.lit(cut)).repartition(3, "close")))
        assert all(whole[k] == v or abs(whole[k] - v) < 1e-9 for k, v in part.items())
    bars.unpersist()


def test_costs_and_risks(spark):
    c = cost.chain(cost.spread_bps(20), cost.fixed_fee(2), cost.notional_bps_fee(10))
    assert c.apply("BUY", 10, 100) == (100.1, pytest.approx(3.001)) and cost.from_plan_json(c.plan_json()) == c and len(c.hash()) == 64
    with pytest.raises(errors.InvalidConfig):
        cost.chain(cost.fixed_fee(1), cost.spread_bps(1))
    r = risk.chain(risk.long_only(), risk.max_weight(risk.Param("w")))
    assert r.apply({"A": 9.0, "B": -4.0}, {"A": 50.0, "B": 1.0}, 1000.0, {"w": 0.1}) == {"A": 2.0, "B": 0.0}
    assert risk.from_plan_json(r.plan_json()) == r
    with pytest.raises(errors.InvalidTarget):
        r.apply({"A": 1.0}, {"A": 1.0}, -1.0, {"w": 0.1})
    with pytest.raises(errors.InvalidConfig):
        r.column(F.col("x"))


def test_zero_trades_and_constant_equity(spark):
    rows = [(DAY + dt.timedelta(days=k), 100.0, 0.0, 100.0) for k in range(5)]
    eq = spark.createDataFrame(rows, "ts_utc timestamp_ntz, cash double, positions_value double, equity double")
    none = accounting.trades(events(spark, [("A", "BUY", 1, 1)]))
    r = metrics.metrics(eq, none).first()
    assert (r.n_trades, r.win_rate, r.avg_trade, r.sharpe, r.total_return, r.max_drawdown) == (0, None, None, None, 0.0, 0.0)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    e = 100 * np.cumprod(1 + rng.normal(0.001, 0.01, 80))
    eq = spark.createDataFrame([(DAY + dt.timedelta(days=k), 0.0, 1.0, float(v)) for k, v in enumerate(e)], "ts_utc timestamp_ntz, cash double, positions_value double, equity double")
    r = metrics.metrics(eq, accounting.trades(events(spark, [("A", "BUY", 1, 1), ("A", "SELL", 1, 3)])), metrics.us_equity(0.03)).first()
    p, rf = e[1:] / e[:-1] - 1, 1.03 ** (1 / 252) - 1
    assert np.isclose(r.volatility, p.std(ddof=1) * 252**0.5, rtol=1e-10) and np.isclose(r.sharpe, (p - rf).mean() / p.std(ddof=1) * 252**0.5, rtol=1e-10)
    assert np.isclose(r.max_drawdown, (e / np.maximum.accumulate(e) - 1).min()) and np.isclose(r.annualized_return, (e[-1] / e[0]) ** (252 / 79) - 1)
    assert (r.n_trades, r.win_rate, r.avg_trade) == (1, 1.0, 2.0)


def test_grids():
    g = grids.param_grid("fast < slow and max(fast, 2) > 1", fast=[2, 3], slow=[3, 4])
    assert [c.params for c in g] == [{"fast": 2, "slow": 3}, {"fast": 2, "slow": 4}, {"fast": 3, "slow": 4}]
    assert len(grids.grid_cross(grids.feature_grid(n=[1, 2]), g)) == 6 and grids.add_baseline(g, x=1)[0].label == "baseline"
    for bad in ("__import__('os')", "fast.real > 0", "[x for x in (1,)]"):
        with pytest.raises(errors.InvalidConfig):
            grids.param_grid(bad, fast=[1])


def test_folds():
    f = walkforward.folds_rolling("2020-01-01", "2020-12-31", "3 months", "2 months")
    assert [(x.train_start.month, x.test_start.month, iso_utc(x.test_end)) for x in f[:2]] == [(1, 4, "2020-05-31T23:59:59Z"), (3, 6, "2020-07-31T23:59:59Z")]
    a = walkforward.folds_anchored("2020-01-01", "2020-12-31", "3 months", "2 months")
    assert all(x.train_start == DAY for x in a) and a[1].test_start.month == 6 and len({x.fold_id for x in a}) == len(a)
    assert walkforward.shift(dt.datetime(2021, 1, 31), "1 month") == dt.datetime(2021, 3, 3)
    with pytest.raises(errors.InvalidConfig):
        walkforward.folds_rolling("2020-01-01", "2020-02-01", "3 months", "2 months")


def test_statistics(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.01, 0.02, (12, 3))
    rows = [(f"c{k}", DAY + dt.timedelta(days=t), float(x[t, k])) for k in range(3) for t in range(12)]
    df = spark.createDataFrame(rows, "candidate_id string, ts_utc timestamp_ntz, period_return double")
    m = {r.candidate_id: r for r in validation.moments(df).collect()}
    for k in range(3):
        v = x[:, k]
        d = v - v.mean()
        assert np.isclose(m[f"c{k}"].skew, (d**3).mean() / (d**2).mean() ** 1.5) and np.isclose(m[f"c{k}"].kurtosis, (d**4).mean() / (d**2).mean() ** 2)
    c = {(r.a, r.b): r.r for r in validation.correlations(df).collect()}
    assert np.isclose(c["c0", "c2"], np.corrcoef(x[:, 0], x[:, 2])[0, 1])
    z = spark.createDataFrame([(v,) for v in (-2.0, 0.0, 0.5, 3.0)], "z double").select(validation.normal_cdf(F.col("z")).alias("p")).collect()
    assert np.allclose([r.p for r in z], [validation.NormalDist().cdf(v) for v in (-2, 0, 0.5, 3)], atol=2e-7)
    assert validation.complete_linkage(["a", "b", "c"], {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "c"): 0.8}, 0.5) == {"a": 1, "b": 2, "c": 1}
    with pytest.raises(errors.ValidationError):
        validation.pbo_cases(df, 5)
    with pytest.raises(errors.ValidationError):
        validation.pbo_cases(df.where("candidate_id = 'c0'"), 4)


def test_snapshots(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    bars = simulate.sim_bars(spark, 3, 12, 5)
    s = store.from_df(bars, snapshot_id="one")
    h = s.info()["snapshot_hash"]
    assert store.from_df(bars.repartition(5, "close"), snapshot_id="two").info()["snapshot_hash"] == h
    assert store.open("one", verify=True).bars().count() == 36 and store.list("SEALED").count() == 2
    with pytest.raises(errors.SnapshotError):
        store.create("one")
    bad = bars.limit(1).unionAll(bars.limit(1))
    for name, frame in {"dup": bad, "ohlc": bars.withColumn("high", F.col("low") - 1), "sec": bars.withColumn("ts_utc", F.col("ts_utc") + F.expr("interval 1 millisecond")), "empty": bars.limit(0)}.items():
        with pytest.raises(errors.InvalidBars):
            store.from_df(frame, snapshot_id=name)
        with pytest.raises(errors.SnapshotError):
            store.open(name)
    path = tmp_path / "b.csv"
    path.write_bytes("﻿instrument_id,ts_utc,open,high,low,close,volume\nA,2020-01-01T00:00:00Z,1,2,1,2,5\nA,2020-01-02T00:00:00Z,1,2,1,2,\n".encode())
    assert store.from_csv(str(path), "csv").bars().count() == 2
    path.write_text("instrument_id,ts_utc,open,high,low,close\nA,2020-01-01,1,2,1,2\n")
    with pytest.raises(errors.InvalidBars):
        snapshots.read_bars_csv(spark, str(path))
    wide = spark.createDataFrame([("2020-01-01", 1.0, 2.0, 0.5, 1.5, 9.0)], ["Date", "X.Open", "X.High", "X.Low", "X.Close", "X.Volume"])
    assert snapshots.yahoo_bars(wide, "X").first().close == 1.5


def test_ragged_panel(spark):
    bars = simulate.sim_bars(spark, 2, 5, 1)
    assert panels.require_complete(bars) is bars
    gone = bars.orderBy("ts_utc").limit(9)
    with pytest.raises(errors.CoverageError):
        panels.require_complete(gone)


def test_preflight():
    import time

    assert preflight.preflight(lambda ctx, params: ctx.flat()).allowed

    def clock(ctx):
        return {i: time.time() for i in ctx.universe}

    p = preflight.preflight(clock)
    assert p.tier == 3 and len(p.source_hash) == 64
    with pytest.raises(errors.PreflightError):
        preflight.require(clock)


def test_schema_helpers():
    assert canonical_json({"b": float("nan"), "a": [1.5, DAY]}) == '{"a":[1.5,"2020-01-01T00:00:00Z"],"b":null}'
    assert utc("2020-01-01T01:00:00+01:00") == DAY and derive_seed(1, {"x": 1}) != derive_seed(2, {"x": 1})
    assert seed_of_digest("000001" * 11) == sum((1, 17, 257, 4099, 65537, 104729)) + 1
    with pytest.raises(errors.InvalidBars):
        utc(dt.datetime(2020, 1, 1, 0, 0, 0, 5))


def test_fold_refusals():
    bars = pd.DataFrame([{"instrument_id": i, "ts_utc": DAY + dt.timedelta(days=k), **dict.fromkeys(("open", "high", "low", "close", "volume"), 10.0)} for i in "AB" for k in range(3)])
    for bad in (lambda c, p: {"A": 1.0}, lambda c, p: {"A": float("inf"), "B": 0.0}, lambda c, p: [1, 2]):
        with pytest.raises(errors.InvalidTarget):
            fold.run_fold(bars, bad, {}, cost.zero())
    with pytest.raises(errors.UnknownFeature):
        fold.run_fold(bars, lambda c, p: {i: c.feature(i, "nope") for i in c.universe}, {}, cost.zero())
    r = fold.run_fold(bars, lambda c, p: {"A": float(len(c.universe)) if c.ts_utc > DAY + dt.timedelta(days=1) else 0.0, "B": 0.0}, {}, cost.zero())
    assert r.warnings == ["LAST_BAR_NO_FILL A"] and not r.events


def test_sweep_is_one_plan_per_candidate_column(spark, sf_dir):
    x = ind.sma(panels.event_day(spark, sf_dir), 3, "sma_3")
    cands = grids.grid_named(a={"q": 1.0}, b={"q": 2.0}).table(spark, {"q": "double"})
    s = sweep.run(x, cands, strategy.sma_crossover(F.col("close"), F.col("sma_3"), F.col("q")), cost.zero(), ledger.Opening(1000.0))
    got = {r.candidate_id: r.p for r in s.events.groupBy("candidate_id").agg(F.sum("position_delta").alias("p")).collect()}
    assert set(got) == {"a", "b"} and abs(got["b"] - 2 * got["a"]) < 1e-9


def test_stream_bars_match_batch(spark, sf_dir, tmp_path):
    from tidemark.streaming.bars import stream_bars

    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    src.write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = stream_bars(ticks).writeStream.outputMode("complete").format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.instrument_id, r.ts_utc): (r.open, r.close, r.volume) for r in spark.table("bars").collect()}
    want = {(r.instrument_id, r.ts_utc): (r.open, r.close, r.volume) for r in panels.event_day(spark, sf_dir).collect()}
    assert got == want
