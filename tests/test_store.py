import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import indicators as ind
from tidemark.operators import cost, ledger, strategy
from tidemark.plans import grids, sweep
from tidemark.plans.experiment import Experiment, RunStore
from tidemark.sources import simulate


def test_runs_and_sweeps(spark, tmp_path):
    bars = simulate.sim_bars(spark, 2, 30, 9)
    bars.write.parquet(str(tmp_path / "bars"))
    x = ind.sma(spark.read.parquet(str(tmp_path / "bars")), 3, "sma_3")
    opening = ledger.Opening(1e4, {"DEMO_001": 2.0}, {"DEMO_001": 50.0})
    exp = Experiment(x, strategy.sma_crossover(F.col("close"), F.col("sma_3"), 5.0), cost.fixed_fee(1), opening=opening, features=("sma_3",), snapshot_id="s")
    store = RunStore(spark, str(tmp_path / "store"))
    run = store.run(exp, run_id="windows")

    def same(ctx, params):
        out = {}
        for i in ctx.universe:
            m = ctx.feature(i, "sma_3")
            out[i] = params["qty"] if m is not None and ctx.close(i) / m - 1 > 0 else 0.0
        return out

    walked = store.run(Experiment(x, same, cost.fixed_fee(1), opening=opening, features=("sma_3",), snapshot_id="s"), {"qty": 5.0}, "fold")
    key = lambda r: [(e.event_seq, e.instrument_id, e.side, e.qty, round(e.price, 6), round(e.cash_delta, 6)) for e in r.results("ledger").orderBy("event_seq").collect()]
    assert key(run) == key(walked) and run.ledger.first().event_id.startswith("windows_0000")
    assert store.run(exp, run_id="windows").results("equity").count() == 30
    with pytest.raises(errors.TidemarkError):
        store.run(Experiment(x, strategy.hold_zero(), cost.zero()), run_id="windows")
    with pytest.raises(errors.InvalidConfig):
        run.results("features")
    store.tag("fold", "b", "a")
    store.untag("fold", "b")
    store.label("fold", "walk")
    assert [tuple(r) for r in store.tags().collect()] == [("fold", "a")] and store.info("fold")["label"] == "walk"
    ranked = store.compare([run, walked]).orderBy("rank").collect()
    assert abs(ranked[0].total_return - ranked[1].total_return) < 1e-9
    store.archive("fold")
    assert store.list().count() == 1 and store.list(True).count() == 2
    cands = grids.grid_named(a={"q": 1.0}, b={"q": 2.0})
    s = sweep.run(x, cands.table(spark, {"q": "double"}), strategy.sma_crossover(F.col("close"), F.col("sma_3"), F.col("q")), cost.zero())
    store.save_sweep(s, "sw")
    got, returns = store.open_sweep("sw")
    assert got.count() == 2 and returns.count() == 60
    assert "sw" in store.info(store.promote(exp, cands[0], "sw", "promoted").run_id)["promoted_from"]
