"""Targets and opens that can't be filled, lots at size, strategy forms, resumed walks, store states."""

import datetime as dt
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import indicators as ind
from tidemark.operators import accounting, cost, ledger, strategy, types
from tidemark.plans import experiment, fold, grids, preflight, sweep, validation
from tidemark.sources import simulate, snapshots

DAY = dt.datetime(2020, 1, 1)
BARS = "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double, target double"


def panel(spark, opens, targets):
    rows = [("A", DAY + dt.timedelta(days=k), o, 9.0, 1.0, 5.0, 1.0, t) for k, (o, t) in enumerate(zip(opens, targets, strict=True))]
    return spark.createDataFrame(rows, BARS)


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_targets_that_are_not_finite_fail(spark, bad):
    with pytest.raises(PySparkException, match="INVALID_TARGET"):
        ledger.fills(panel(spark, [5.0] * 4, [3.0, bad, 3.0, 3.0]), cost.zero()).collect()


def test_orders_wait_for_an_open_that_fills(spark):
    rng = random.Random(1)
    for _ in range(4):
        opens = [rng.choice([0.0, 5.0, 6.0]) for _ in range(25)]
        targets = [float(rng.choice([0, 0, 3, -2])) for _ in range(25)]
        x = panel(spark, opens, targets)
        opening = ledger.Opening(1e3, {"A": 1.0}, {"A": 4.0})
        got = ledger.events(ledger.fills(x, cost.fixed_fee(1), opening), DAY, opening).orderBy("event_seq").collect()
        at = dict(zip([DAY + dt.timedelta(days=k) for k in range(25)], targets, strict=True))
        r = fold.run_fold(x.toPandas(), lambda ctx: {"A": at[pd.Timestamp(ctx.ts_utc).to_pydatetime()]}, {}, cost.fixed_fee(1), opening=opening)  # noqa: B023
        assert [(e.event_seq, e.side, e.qty, e.price) for e in got] == [(e["event_seq"], e["side"], e["qty"], e["price"]) for e in r.events]
        assert ledger.unfilled(x, opening).count() == sum(w.startswith("LAST_BAR") for w in r.warnings)
        accounting.require_order(ledger.events(ledger.fills(x, cost.zero()), DAY))


def test_many_fills_of_one_instrument(spark):
    n = 100_000
    rng = np.random.default_rng(5)
    delta = rng.choice([-3.0, -1.0, 1.0, 2.0, 5.0, -4.0], n)
    price = np.round(50 + np.cumsum(rng.normal(0, 0.1, n)), 2)
    pdf = pd.DataFrame({"ts_utc": [DAY] * n, "event_type": "FILL", "instrument_id": "A", "side": np.where(delta > 0, "BUY", "SELL"), "qty": np.abs(delta), "price": price, "fee": 0.0, "cash_delta": -delta * price, "position_delta": delta, "event_seq": np.arange(1, n + 1)})
    ev = spark.createDataFrame(pdf, "ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long")
    lots = fold.Lots()
    want = sum(lots.fill(float(d), float(p)) for d, p in zip(delta, price, strict=True))
    got = accounting.trades(ev).agg(F.sum("realized_pnl").alias("r")).first().r
    assert abs(got - want) < 1e-5 * max(1.0, abs(want))
    assert abs(accounting.matches(ev).agg(F.sum("realized").alias("r")).first().r - want) < 1e-5 * max(1.0, abs(want))


def test_ragged_panels_do_not_run(spark, tmp_path):
    x = simulate.sim_bars(spark, 2, 10, 1).orderBy("ts_utc").limit(19)
    store = experiment.RunStore(spark, str(tmp_path))
    for s in (strategy.hold_zero(), lambda ctx: ctx.flat()):
        with pytest.raises((errors.CoverageError, PySparkException), match="missing|complete"):
            store.run(experiment.Experiment(x, s, cost.zero()), run_id=f"r{isinstance(s, type(F.lit(1)))}")
    with pytest.raises(errors.CoverageError):
        sweep.run(x, grids.grid_named(a={"q": 1.0}).table(spark, {"q": "double"}), F.col("q"), cost.zero())
    assert {r.status for r in store.list().collect()} == {"FAILED"}


def bars_pdf(n=12):
    return pd.DataFrame([{"instrument_id": i, "ts_utc": DAY + dt.timedelta(days=k), **dict.fromkeys(("open", "high", "low", "close", "volume"), 10.0 + k + j), "f": float(k)} for j, i in enumerate("AB") for k in range(n)])


def test_context_and_types():
    seen = {}

    def look(ctx):
        seen.update(idx=ctx.idx("B"), none=ctx.idx("Z", "none"), high=ctx.high("A"), low=ctx.low("B"), all=ctx.features_of("A"), some=ctx.features_of("B", {"x": "f"}), warm=fold.passed_warmup(ctx.features_of("A")))
        for bad in (ctx.targets, ctx.current_targets, lambda: ctx.close("Z"), lambda: ctx.position("Z"), lambda: ctx.idx("Z")):
            with pytest.raises(errors.InvalidTarget):
                bad()
        return ctx.flat(1)

    r = fold.run_fold(bars_pdf(3), look, {}, cost.zero(), features=("f",), aliases={"g": "f"})
    assert seen == {"idx": 1, "none": None, "high": 12.0, "low": 13.0, "all": {"g": 2.0}, "some": {"x": 2.0}, "warm": True} and len(r.events) == 2
    for step in (types.Signal({"A": 1.0, "B": 2.0}), types.Selection({"A": True}), types.Weights({"A": 0.5})):
        with pytest.raises(errors.InvalidTarget, match="end in targets"):
            fold.run_fold(bars_pdf(3), lambda ctx: step, {}, cost.zero())  # noqa: B023
    for bad in (lambda: types.Signal({}), lambda: types.Signal({"A": float("inf")}), lambda: types.Selection({"A": 1}), lambda: types.Weights({"A": float("nan")}), lambda: types.Target({"A": 1.0}, ["A", "B"]), lambda: types.Weights({"Z": 1.0}, ["A"])):
        with pytest.raises(errors.InvalidTarget):
            bad()
    few = fold.run_fold(bars_pdf(3), lambda ctx: fold.target_rebalance(fold.weight_equal(fold.select_top_n(fold.signal_return(ctx, "f"), 5)), ctx), {}, cost.zero(), features=("f",))
    assert any("only 2 of 5" in w for w in few.warnings) and fold.run_fold(bars_pdf(3), fold.echo({"A": 2.0}), {}, cost.zero()).events[0]["qty"] == 2.0


def test_a_walk_goes_on_where_it_ended():
    def moody(ctx, params):
        k = (ctx.state_prev or 0) + 1
        return {"targets": {"A": float(k % 3), "B": float(k % 2) * 2}, "state_update": k}

    whole = fold.run_fold(bars_pdf(), moody, {}, cost.fixed_fee(1), opening=ledger.Opening(1e3, {"A": 1.0}, {"A": 9.0}))
    for n in (1, 5, 11):
        cut = fold.run_fold(bars_pdf()[lambda x: x.ts_utc < DAY + dt.timedelta(days=n)], moody, {}, cost.fixed_fee(1), opening=ledger.Opening(1e3, {"A": 1.0}, {"A": 9.0}))  # noqa: B023
        more = fold.run_fold(bars_pdf(), moody, {}, cost.fixed_fee(1), opening=ledger.Opening(1e3, {"A": 1.0}, {"A": 9.0}), resume=cut)
        assert more.equity == whole.equity and more.events == whole.events and more.states == whole.states and more.warnings == whole.warnings


def test_store_states_sources_and_comparison(spark, tmp_path):
    bars = simulate.sim_bars(spark, 2, 30, 9)
    bars.write.parquet(str(tmp_path / "bars"))
    x = ind.sma(spark.read.parquet(str(tmp_path / "bars")), 3, "m")
    store = experiment.RunStore(spark, str(tmp_path / "store"))

    def broken(ctx, params):
        return {"A": 1.0}

    with pytest.raises(PySparkException):
        store.run(experiment.Experiment(x, broken, cost.zero()), run_id="b")
    assert store.info("b")["status"] == "FAILED" and "PythonException" in store.info("b")["error"]
    with pytest.raises(errors.SnapshotError):
        store.open(experiment.Experiment(x, broken, cost.zero()), "b")

    def qty_three(ctx, params):
        return {i: 3.0 for i in ctx.universe}

    exp = experiment.Experiment(x, qty_three, cost.fixed_fee(1), features=("m",))
    run = store.run(exp, run_id="three", sinks=("equity", "state", "features"))
    with pytest.raises(errors.SnapshotError):
        store.resume(exp, "three")
    info = store.info("three")
    assert (info["n_pulses"], info["n_events"], info["n_trades"], info["bars_per_year"]) == (30, 2, 0, 252) and info["seconds"] > 0
    assert store.features("three").count() == 60 and store.states("three").count() == 0 and run.results("equity").count() == 30
    assert "def qty_three" in store.strategy("three") and store.strategy("three", trust=True).__name__ == "qty_three"
    assert preflight.hash_of(store.strategy("three")) == info["source_hash"]
    assert [len(x) for x in run.cursor("equity", 20)] == [20, 10] and [len(x) for x in run.cursor()] == [2]
    assert "30 pulses" in run.summary() and "three" in store.print() and store.telemetry().first().runs == 1
    store.tag("three", "x", "y")
    assert [(r.tag, r.run_id) for r in store.tagged("y", "z").collect()] == [("y", "three")]
    c = grids.grid_named(a={"q": 1.0})[0]
    made = store.promote(exp, c, "sw", "promoted", note="why")
    said = store.promotion(made.run_id)
    assert said["note"] == "why" and said["reproduction_key"] == experiment.reproduction_key(exp, c, 1) != experiment.reproduction_key(exp, c, 2) and store.promotion("three") == {}
    weekly = x.withColumn("ts_utc", F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.datediff("ts_utc", F.lit("2018-01-01")).cast("int") * 7))
    other = store.run(experiment.Experiment(weekly, strategy.hold_zero(), cost.zero(), snapshot_id="w"), run_id="w")
    with pytest.raises(errors.ValidationError):
        store.compare([run, other])
    with pytest.raises(errors.InvalidConfig):
        store.run(exp, run_id="z", sinks=("telemetry",))


def test_sweep_store_and_views(spark, tmp_path):
    x = ind.sma(simulate.sim_bars(spark, 2, 20, 3), 3, "m")
    s = sweep.run(x, grids.grid_named(a={"q": 1.0}, b={"q": 0.0}).table(spark, {"q": "double"}), strategy.sma_crossover(F.col("close"), F.col("m"), F.col("q")), cost.zero())
    store = experiment.RunStore(spark, str(tmp_path))
    store.save_sweep(s, "one", failed=spark.createDataFrame([("c", "boom")], "candidate_id string, error string"), meta={"k": 1})
    assert {k: store.sweep_info("one")[k] for k in ("n_candidates", "n_done", "n_failed")} == {"n_candidates": 3, "n_done": 2, "n_failed": 1}
    with pytest.raises(errors.SnapshotError):
        store.sweep_info("two")
    assert {r.candidate_id for r in sweep.issues(store.open_sweep("one")[0]).collect()} == {"b", "c"}
    assert sweep.returns_panel(s.returns()).count() == 38 and sweep.returns_frame(s.returns(), ["a", "b"]).shape == (20, 2)
    with pytest.raises(errors.ValidationError):
        sweep.returns_panel(s.returns().where("not (candidate_id = 'a' and equity > 0 and ts_utc > '2018-01-10')"))


def test_snapshot_instruments(spark, tmp_path):
    store = snapshots.SnapshotStore(spark, str(tmp_path / "store"))
    bars = simulate.sim_bars(spark, 2, 6, 5)
    path = tmp_path / "i.csv"
    path.write_text("instrument_id,symbol,multiplier\nDEMO_001,X,2.5\nDEMO_002,,\nDEMO_009,Z,1\n")
    s = store.create("one")
    store.import_instruments_csv(s, str(path))
    store.import_bars(s, bars.where("instrument_id = 'DEMO_001'"))
    store.import_bars(s, bars.where("instrument_id = 'DEMO_002'"))
    h = store.seal(s)
    assert {r.instrument_id: (r.symbol, r.n_bars) for r in s.summary().collect()} == {"DEMO_001": ("X", 6), "DEMO_002": ("DEMO_002", 6), "DEMO_009": ("Z", 0)}
    assert s.instruments().where("instrument_id = 'DEMO_001'").first().multiplier == 2.5 and s.bars().count() == 12
    plain = store.from_df(bars, snapshot_id="two")
    assert plain.info()["snapshot_hash"] != h
    spark.createDataFrame([("DEMO_001", "X", "USD", "EQUITY", 3.5, 0.01, None), ("DEMO_002", "Y", "USD", "EQUITY", 1.0, 0.01, None)], s.instruments().schema).write.mode("overwrite").parquet(f"{s.path}/instruments")
    with pytest.raises(errors.SnapshotError):
        store.open("one", verify=True)
    t = store.create("three")
    store.import_instruments(t, plain.instruments().where("instrument_id = 'DEMO_001'"))
    with pytest.raises(errors.InvalidBars, match="there already"):
        store.import_instruments(t, plain.instruments())
    store.import_bars(t, bars, validate="none")
    with pytest.raises(errors.InvalidBars, match="orphan"):
        store.seal(t)
    u = store.create("four")
    store.import_instruments(u, plain.instruments().where("instrument_id = 'DEMO_001'"))
    with pytest.raises(errors.InvalidBars, match="orphan"):
        store.import_bars(u, bars)
    with pytest.raises(errors.InvalidBars, match="empty"):
        store.seal(store.create("five"))
    for k, text in enumerate(("symbol\nX\n", "instrument_id\nA\nA\n", "instrument_id,symbol\n,X\n", "instrument_id,multiplier\nA,two\n")):
        bad = tmp_path / f"bad{k}.csv"
        bad.write_text(text)
        with pytest.raises(errors.InvalidBars):
            snapshots.read_instruments_csv(spark, str(bad))
    views = plain.attach(["DEMO_002"], "2018-01-02", "2018-01-04")
    assert spark.table(views[0]).count() == 3 and spark.table(views[1]).count() == 1
    plain.close()
    assert not spark.catalog.tableExists(views[0])
    wide = spark.createDataFrame([("2020-01-01", *[1.0, 2.0, 0.5, 1.5, 9.0] * 2)], ["Date", *[f"{s}.{c}" for s in "XY" for c in ("Open", "High", "Low", "Close", "Volume")]])
    assert sorted(r.instrument_id for r in snapshots.yahoo_union({"X": wide, "Y": wide}).collect()) == ["X", "Y"]


def test_grid_filters():
    g = grids.param_grid("a == max(a) or (pmin(a, b) == 1 and is_finite(b))", a=[1, 2, 3], b=[1, 5])
    assert [(c.params["a"], c.params["b"]) for c in g] == [(1, 1), (2, 1), (3, 1), (1, 5), (3, 5)]
    assert not grids.param_grid("is_na(a)", a=[1, 2])
    with pytest.raises(errors.InvalidConfig):
        grids.param_grid("a.b", a=[1])


def test_pbo_by_another_measure(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.01, 0.02, (12, 4))
    rows = [(f"c{k}", DAY + dt.timedelta(days=t), float(x[t, k])) for k in range(4) for t in range(12)]
    df = spark.createDataFrame(rows, "candidate_id string, ts_utc timestamp_ntz, period_return double")
    mean = {r.case_id: r for r in validation.pbo_cases(df, 4).collect()}
    own = {r.case_id: r for r in validation.pbo_cases(df, 4, metric=lambda m: m.mean(axis=0)).collect()}
    assert {k: (r.winner, r.oos_rank) for k, r in own.items()} == {k: (r.winner, r.oos_rank) for k, r in mean.items()}
    sharpe = {r.case_id: r for r in validation.pbo_cases(df, 4, metric=lambda m: m.mean(axis=0) / m.std(axis=0, ddof=1)).collect()}
    for case, chosen in enumerate(combinations(range(4), 2), 1):
        inside = np.concatenate([np.arange(3 * b, 3 * b + 3) for b in chosen])
        s = x[inside].mean(axis=0) / x[inside].std(axis=0, ddof=1)
        assert sharpe[case].winner == f"c{int(s.argmax())}"
    with pytest.raises(PySparkException, match="ValidationError"):
        validation.pbo_cases(df, 4, metric=lambda m: m.mean(axis=0)[:2]).collect()


def test_ledgers_from_outside(spark):
    said = [("BUY", 5.0, 10.0), ("BUY_TO_COVER", 2.0, 11.0), ("SELL_SHORT", 7.0, 12.0), ("SELL_SHORT", 1.0, 9.0), ("BUY_TO_COVER", 1.0, 8.0), ("HOLD", 1.0, 8.0), ("BUY", -1.0, 8.0), ("BUY", 1.0, None), ("COVER", 3.0, 7.0), ("SELL", 2.0, 6.0)]
    rows = [(DAY, "FILL", "A", s, q, p, 0.5, 0.0, 0.0, n) for n, (s, q, p) in enumerate(said, 1)]
    ev = spark.createDataFrame(rows, "ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long")
    x = accounting.screen(ev)
    assert [r.status for r in x.orderBy("event_seq").collect()] == [None, "REJECTED", None, "REJECTED", None, "INVALID", "INVALID", "INVALID", None, None]
    assert [r.position_delta for r in x.orderBy("event_seq").collect()] == [5, 0, -7, 0, 1, 0, 0, 0, 3, -2]
    got = [(r.event_seq, r.action, r.qty, r.realized_pnl) for r in accounting.screened_fills(x).collect()]
    assert sorted(got, key=str) == sorted([(1, "OPEN", 5, 0), (2, "REJECTED", 2, None), (3, "CLOSE", 5, 10), (3, "OPEN", 2, 0), (4, "REJECTED", 1, None), (5, "CLOSE", 1, 4), (6, None, 1, None), (7, None, -1, None), (8, None, 1, None), (9, "CLOSE", 1, 5), (9, "OPEN", 2, 0), (10, "CLOSE", 2, -2)], key=str)


def test_schema_values():
    from tidemark import schema

    assert schema.read_json(None) is None and schema.read_json(' {"a": [1]} ') == {"a": [1]}
    assert schema.named_numbers({"a": 2}, {"a": 1.0, "b": 3.0}) == {"a": 2.0, "b": 3.0} and schema.alias_names({"x": "sma_3"}) == {"x": "sma_3"}
    for bad in (lambda: schema.read_json("{"), lambda: schema.named_numbers({"c": 1}, {"a": 1.0}), lambda: schema.named_numbers({"a": "1"}, {"a": 1.0}), lambda: schema.alias_names({"a__b": "c"}), lambda: schema.derive_seed(-1, {}), lambda: schema.derive_seed(1.5, {})):
        with pytest.raises(errors.InvalidConfig):
            bad()


def test_reserved_names_and_pulse_seeds(spark):
    from tidemark.schema import derive_seed

    with pytest.raises(errors.InvalidConfig):
        strategy.pulse_wide(simulate.sim_bars(spark, 1, 3, 1), [], ["A__B"])
    seeds = []
    fold.run_fold(bars_pdf(3), lambda ctx: seeds.append(ctx.seed) or ctx.flat(), {}, cost.zero(), seed=9, run_id="r")
    assert seeds == [derive_seed(9, {"run_id": "r", "pulse": t}) for t in range(3)]
    with pytest.raises(errors.InvalidBars):
        ledger.Opening(1.0, date="2020-01-01T00:00:00.5Z")
