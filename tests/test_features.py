"""User indicators, registry, maps, parameters, contracts, precomputing and lookahead."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import features as ft
from tidemark.functions import indicators as ind
from tidemark.operators.risk import Param
from tidemark.plans import grids
from tidemark.sources import simulate


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "b")
    simulate.sim_bars(spark, 3, 40, 7).write.parquet(path)
    return spark.read.parquet(path)


def values(df, c):
    return {(r.instrument_id, r.ts_utc): r[c] for r in df.collect()}


def test_functions_give_what_columns_give(bars):
    fn = ft.Indicator("mine", 4, fn=lambda window: window["close"].mean())
    series = ft.Indicator("whole", 4, params={"n": 4}, series_fn=lambda bars, params: bars["close"].rolling(params["n"]).mean())
    last = ft.from_function("last", lambda close: close[-2:].sum(), 2)
    got = ft.compute(bars, [fn, series, last, ft.sma(4), ft.ttr("EMA", n=3), ft.ttr("BBands", "up", n=4), ft.ttr("MACD", "signal", nFast=3, nSlow=5, nSig=2)])
    assert set(got.columns) >= {"mine", "whole", "last", "ttr_ema_3", "ttr_bbands_4_up", "ttr_macd_3_5_2_signal"}
    rows = got.orderBy("instrument_id", "ts_utc").collect()
    assert sum(r.mine is None for r in rows) == 9 and all(abs(r.mine - r.sma_4) < 1e-9 and abs(r.whole - r.sma_4) < 1e-9 for r in rows if r.mine is not None)
    one = [r for r in rows if r.instrument_id == "DEMO_001"]
    assert one[0].last is None and all(abs(b.last - a.close - b.close) < 1e-9 for a, b in zip(one, one[1:], strict=False))
    want = values(ind.bbands(bars, 4, "bb"), "bb_up")
    assert all(v is None or abs(v - want[k]) < 1e-9 for k, v in values(got, "ttr_bbands_4_up").items())


def test_values_must_be_finite_after_warm_up(spark, bars):
    short = ft.Indicator("short", 1, series_fn=lambda bars, params: [1.0])
    nan = ft.Indicator("nan", 2, fn=lambda window: float("nan"))
    for bad in (short, nan):
        with pytest.raises(PySparkException, match="InvalidFeature"):
            ft.compute(bars, [bad]).collect()
    flat = spark.createDataFrame([("A", dt.datetime(2020, 1, d), 0.0, 0.0, 0.0, 0.0, 1.0) for d in range(1, 6)], "instrument_id string, ts_utc timestamp_ntz, open double, high double, low double, close double, volume double")
    with pytest.raises(PySparkException, match="INVALID_FEATURE"):
        ft.compute(flat, [ft.returns(1)]).collect()
    assert ft.compute(flat, [ft.returns(1)], strict=False).where("return_1 is not null").count() == 0


def test_definitions_are_checked():
    for bad in (dict(id="", requires_bars=1), dict(id="a__b", requires_bars=1), dict(id="a", requires_bars=0), dict(id="a", requires_bars=3, stable_after=2), dict(id="a", requires_bars=1, source="x")):
        with pytest.raises(errors.InvalidConfig):
            ft.Indicator(**bad, fn=len)
    with pytest.raises(errors.InvalidConfig):
        ft.Indicator("a", 1)

    def clock(window):
        import time

        return time.time()

    with pytest.raises(errors.InvalidConfig, match="calls time"):
        ft.Indicator("clock", 1, fn=clock)
    with pytest.raises(errors.UnknownFeature):
        ft.ttr("ZLEMA", n=3)
    with pytest.raises(errors.UnknownFeature):
        ft.ttr("ATR", "middle", n=3)
    assert ft.sma(3).fingerprint == ft.sma(3).fingerprint != ft.sma(4).fingerprint
    assert [i.id for i in ft.ttr_outputs("ATR", n=5)] == ["ttr_atr_5_tr", "ttr_atr_5_atr", "ttr_atr_5_truehigh", "ttr_atr_5_truelow"]
    with pytest.raises(errors.InvalidConfig):
        ft.bundle(ft.sma(3), ft.sma(3))
    with pytest.raises(errors.InvalidConfig):
        ft.unique([ft.sma(3), ft.renamed(ft.sma(4), "sma_3")])


def test_registry_and_maps():
    reg = ft.Registry()
    reg.register(ft.sma(3))
    reg.register(ft.sma(5), "slow")
    with pytest.raises(errors.InvalidConfig):
        reg.register(ft.sma(9), "slow")
    reg.register(ft.sma(9), "slow", overwrite=True)
    assert reg.list() == ["slow", "sma_3"] and reg.list("^sl") == ["slow"] and reg.get_indicator("slow").id == "sma_9"
    reg.remove("slow")
    with pytest.raises(errors.UnknownFeature):
        reg.get_indicator("slow")
    m = ft.feature_map(fast=ft.declare("sma", Param("n")), bands=ft.declare("ttr_outputs", "BBands", n=Param("w")), change=ft.returns(1))
    assert ft.parameters(m) == [{"param_name": "n", "alias": "fast", "argument": "0", "constructor": "sma"}, {"param_name": "w", "alias": "bands", "argument": "n", "constructor": "ttr_outputs"}]
    assert ft.alias_map(m, {"n": 4, "w": 6}) == {"fast": "sma_4", "bands_dn": "ttr_bbands_6_dn", "bands_mavg": "ttr_bbands_6_mavg", "bands_up": "ttr_bbands_6_up", "bands_pctb": "ttr_bbands_6_pctb", "change": "return_1"}
    with pytest.raises(errors.InvalidConfig):
        ft.materialise(m, {"n": 4})
    with pytest.raises(errors.InvalidConfig):
        ft.feature_map(a__b=ft.sma(2))


def test_csv_indicator_refuses(spark, bars, tmp_path):
    def write(name, *rows):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        return str(tmp_path / name)

    first = bars.orderBy("instrument_id", "ts_utc").first()
    good = write("g.csv", "ts_utc,instrument_id,v", f"{first.ts_utc:%Y-%m-%dT%H:%M:%SZ},DEMO_001,2.5", f"{first.ts_utc:%Y-%m-%d},DEMO_002,3")
    got = values(ft.compute(bars, [ft.from_csv(spark, good, "v", "v")]), "v")
    assert len(got) == 120 and {k: v for k, v in got.items() if v is not None} == {("DEMO_001", first.ts_utc): 2.5, ("DEMO_002", first.ts_utc): 3.0}
    for bad in (write("a.csv", "ts_utc,v", "2020-01-01,1"), write("b.csv", "ts_utc,instrument_id,v", "2020-01-01,A,1", "2020-01-01,A,2"), write("c.csv", "ts_utc,instrument_id,v", "2020-01-01,,1")):
        with pytest.raises(errors.InvalidConfig):
            ft.from_csv(spark, bad, "v", "v")


def test_lookahead_is_found(bars):
    cut = bars.select("ts_utc").distinct().orderBy("ts_utc").collect()[20].ts_utc
    peeks = ft.Indicator("peeks", 1, series_fn=lambda bars, params: bars["close"].shift(-1).fillna(0.0))
    honest = [ft.sma(3), ft.rsi(3), ft.ema(3), ft.ttr("RSI", n=3), ft.ttr("CCI", n=4), ft.ttr("aroon", "aroonUp", n=4), ft.ttr("DonchianChannel", "mid", n=4), ft.ttr("MFI", n=3), ft.ttr("CMF", n=3), ft.ttr("WMA", n=3), ft.ttr("runMAD", n=3), ft.ttr("ATR", "atr", n=3)]
    bad = ft.check_no_lookahead(bars, [peeks, *honest], cut)
    assert {r.feature_id for r in bad.collect()} == {"peeks"} and bad.where(F.col("ts_utc") == F.lit(cut)).count() == 6


def test_precomputed_features(spark, bars):
    grid = grids.grid_named(a={"n": 3}, b={"n": 5}, c={"n": 3})
    m = ft.feature_map(mean=ft.declare("sma", Param("n")), change=ft.returns(1))
    cache = ft.FeatureCache()
    pre = ft.precompute(bars, grid, m, "hash", cache)
    again = ft.precompute(bars, grid, m, "hash", cache)
    assert [i.id for i in pre.indicators] == ["sma_3", "return_1", "sma_5"] and again.panel is pre.panel and len(cache) == 1
    assert ft.precompute(bars, grid, m, "other", cache).panel is not pre.panel
    x = pre.panel.join(grid.table(spark, {"n": "int"}), how="cross").select("candidate_id", "sma_3", "sma_5", pre.pick("mean").alias("v"))
    assert x.where("not v <=> if(candidate_id = 'b', sma_5, sma_3)").count() == 0
    with pytest.raises(errors.InvalidConfig):
        pre.require("x")
    with pytest.raises(errors.UnknownFeature):
        pre.pick("nothing")
    start = bars.select("ts_utc").distinct().orderBy("ts_utc").collect()[3].ts_utc
    warm = {(r.candidate_id, r.feature_id): r.warmup_achievable for r in pre.warmup(start).where("instrument_id = 'DEMO_001'").collect()}
    assert warm == {("a", "sma_3"): True, ("a", "return_1"): True, ("b", "sma_5"): False, ("b", "return_1"): True, ("c", "sma_3"): True, ("c", "return_1"): True}


def test_inspection(spark, bars):
    x = ft.compute(bars, [ft.sma(3), ft.returns(1)])
    at = bars.select("ts_utc").distinct().orderBy("ts_utc").collect()[9].ts_utc
    pulse = ft.pulse_snapshot(x, at, ["DEMO_001", "DEMO_003"])
    assert pulse.count() == 2 and ft.feature_rows(pulse, ["sma_3", "return_1"]).count() == 4
    with pytest.raises(errors.CoverageError):
        ft.pulse_snapshot(x, at, ["DEMO_001", "NONE"])
    with pytest.raises(errors.UnknownFeature):
        ft.feature_rows(pulse, ["sma_3"], {"a": "sma_9"})
    assert ft.latest_values(x, ["sma_3"]).count() == 3
    ids = bars.select("instrument_id").distinct()
    assert ft.warmup_diagnostics(ids, bars, [ft.sma(3), ft.sma(41)]).count() == 3
