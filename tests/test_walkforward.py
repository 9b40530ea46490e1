"""Walk-forward sessions: carried state against the sequential fold, stores, candidates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import indicators as ind
from tidemark.operators import accounting, cost, ledger, metrics
from tidemark.plans import fold, grids, walkforward as wf
from tidemark.sources import simulate

GRID = grids.grid_named(one={"q": 1.0}, three={"q": 3.0}, none={"q": 0.0})
COST = cost.chain(cost.spread_bps(10), cost.fixed_fee(1))
CONTEXT = metrics.us_equity()


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wf") / "b")
    ind.sma(simulate.sim_bars(spark, 2, 90, 11), 4, "m").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def folds():
    return wf.folds_rolling("2018-01-01", "2018-05-07", "6 weeks", "3 weeks")


def target():
    return F.when(F.col("m").isNotNull() & (F.col("close") > F.col("m")), F.col("q")).otherwise(0.0)


def run(panel, folds, policy):
    return wf.walk_forward(panel, GRID, {"q": "double"}, target(), COST, folds, "sharpe", CONTEXT, ledger.Opening(10_000.0), policy=policy, snapshot_hash="h")


def test_carried_state_matches_the_fold(spark, panel, folds):
    got = run(panel, folds, "carry_test_state")
    chosen = {r.fold_seq: r.candidate_id for r in got.selected.collect()}
    assert set(chosen) == {f.fold_seq for f in folds} and len(folds) == 4
    rows = {r.fold_seq: r for r in got.scores.where("window = 'test'").collect()}
    assert got.scores.where("window = 'train'").count() == 3 * len(folds) and len(rows) == len(folds)
    opening = ledger.Opening(10_000.0)
    for f in folds:
        q = {c.label: c.params["q"] for c in GRID}[chosen[f.fold_seq]]
        bars = panel.where(F.col("ts_utc").between(F.lit(f.test_start), F.lit(f.test_end))).toPandas()

        def walk(ctx, params):
            out = {}
            for i in ctx.universe:
                m = ctx.feature(i, "m")
                out[i] = params["q"] if m is not None and ctx.close(i) > m else 0.0
            return out

        r = fold.run_fold(bars, walk, {"q": q}, COST, opening=opening, features=("m",))
        first, last = r.equity[0], r.equity[-1]
        assert abs(rows[f.fold_seq].total_return - (last["equity"] / first["equity"] - 1)) < 1e-9
        held, lots = {}, {}
        for e in r.events:
            lots.setdefault(e["instrument_id"], fold.Lots()).fill(e["position_delta"], e["price"])
            held[e["instrument_id"]] = held.get(e["instrument_id"], 0.0) + e["position_delta"]
        held = {k: v for k, v in held.items() if abs(v) > 1e-12}
        opening = ledger.Opening(last["cash"], held, {k: lots[k].basis() / v for k, v in held.items()})


def test_sessions_are_stored_and_opened(spark, panel, folds, tmp_path):
    got = run(panel, folds, "flat_test_state")
    got.save(str(tmp_path))
    back = wf.open_session(spark, str(tmp_path), got.session_id)
    assert back.folds == got.folds and back.identity == got.identity
    d = {r.fold_seq: r for r in back.degradation().collect()}
    assert all(r.cold_start_distorted and r.short_test_window for r in d.values()) and len(d) == len(folds)
    c, said = back.candidate(GRID, 2)
    assert c.label == {r.fold_seq: r.candidate_id for r in got.selected.collect()}[2] and said["fold_id"] == folds[1].fold_id and abs(said["test"] - said["train"] - d[2].diff_abs) < 1e-9
    with pytest.raises(errors.InvalidConfig):
        back.candidate(GRID, "latest")
    assert back.candidate(GRID, "latest", "the only one with trades")[1]["fold_seq"] == len(folds)
    with pytest.raises(errors.ValidationError):
        back.candidate(GRID, 99)
    with pytest.raises(Exception, match="already exists"):
        got.save(str(tmp_path))


def test_what_can_select():
    assert [k for k, v in wf.METRIC_CLASS.items() if v in wf.SELECTABLE] == ["annualized_return", "volatility", "sharpe", "win_rate", "avg_trade"]


def test_selection_takes_finite_values_only(spark):
    rows = [(1, "train", "a", float("inf"), 1.0), (1, "train", "b", 2.0, 1.0), (1, "train", "c", 2.0, 1.0), (1, "train", "d", float("nan"), 1.0), (1, "test", "e", 9.0, 1.0), (2, "train", "a", float("inf"), 1.0)]
    s = spark.createDataFrame(rows, "fold_seq int, window string, candidate_id string, sharpe double, max_drawdown double")
    assert [tuple(r) for r in wf.select(s, "sharpe").collect()] == [(1, "b")]
    for bad in ("max_drawdown", "time_in_market", "total_return", "n_trades"):
        with pytest.raises(errors.InvalidConfig):
            wf.select(s, bad)


def test_explicit_folds():
    a = wf.fold(1, "2020-01-01", "2020-01-31", "2020-02-01", "2020-02-10")
    b = wf.fold(2, "2020-01-11", "2020-02-10", "2020-02-11", "2020-02-20")
    assert wf.fold_list(a, b) == [a, b] and a.scheme == "explicit"
    for bad in ((b,), (a, wf.fold(2, "2020-01-11", "2020-02-05", "2020-02-06", "2020-02-20")), ()):
        with pytest.raises(errors.InvalidConfig):
            wf.fold_list(*bad)
    with pytest.raises(errors.InvalidConfig):
        wf.fold(1, "2020-01-01", "2020-02-05", "2020-02-01", "2020-02-10")


def test_shorts_are_not_carried(spark):
    day = dt.datetime(2020, 1, 2)
    ev = spark.createDataFrame([(day, "FILL", "A", "SELL", 2.0, 5.0, 0.0, 10.0, -2.0, 1)], "ts_utc timestamp_ntz, event_type string, instrument_id string, side string, qty double, price double, fee double, cash_delta double, position_delta double, event_seq long")
    with pytest.raises(errors.ValidationError):
        wf.opening_from(accounting.matched_legs(ev), 100.0, ledger.Opening(100.0))
    assert wf.opening_from(accounting.matched_legs(ev.limit(0)), 100.0, ledger.Opening(7.0)).cash == 7.0


def test_windows_start_from_the_opening(spark, panel, folds):
    opening = ledger.Opening(1_000.0, {"DEMO_001": 4.0}, {"DEMO_001": 50.0})
    got = wf.scores(panel, GRID.table(spark, {"q": "double"}), target(), COST, folds[:1], CONTEXT, opening, ("train",)).where("candidate_id = 'none'").first()
    bars = panel.where(F.col("ts_utc").between(F.lit(folds[0].train_start), F.lit(folds[0].train_end))).toPandas()
    r = fold.run_fold(bars, lambda ctx: ctx.flat(), {}, COST, opening=opening)
    assert abs(got.total_return - (r.equity[-1]["equity"] / r.equity[0]["equity"] - 1)) < 1e-9 and got.n_trades == 1
