"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("s01_bars_ptype_month", "w01_sma", "t_bbands", "b14_fills_fifo", "b16_equity", "a12_metrics", "g03_sweep_metrics", "v01_pbo_summary", "v06_walk_forward_scores", "fold_rebalance")


def record_run(spark, instruments: int, days: int, fast: int = 5, slow: int = 10) -> float:
    """Seconds of a durable run of a crossover over simulated bars: ledger and equity are written,
    metrics collected. Writing the bars isn't counted."""
    from pyspark.sql import functions as F

    from tidemark.functions import indicators as ind
    from tidemark.operators import accounting, cost, ledger, metrics, strategy
    from tidemark.sources import simulate
    from tidemark.storage import stage

    bars = stage(simulate.sim_bars(spark, instruments, days, 42), "bench-bars")
    began = time.time()
    x = ind.sma(ind.sma(bars, fast, "fast"), slow, "slow").withColumn("target", strategy.sma_crossover(F.col("fast"), F.col("slow"), 10.0))
    x = stage(x.select("instrument_id", "ts_utc", "open", "close", "target"), "bench-targets")
    ev = stage(ledger.events(ledger.fills(x, cost.zero(), ledger.Opening(1e7)), None, ledger.Opening(1e7)), "bench-ledger")
    legs = stage(accounting.matched_legs(ev), "bench-legs")
    equity = stage(accounting.equity(x, legs, 1e7), "bench-equity")
    metrics.metrics(equity, accounting.trades(legs)).collect()
    return round(time.time() - began, 3)


def record_sweep(spark, instruments: int, days: int) -> float:
    """Seconds of a sweep of one candidate over simulated bars, metrics collected."""
    from tidemark.operators import cost, ledger
    from tidemark.plans import grids, sweep
    from tidemark.sources import simulate
    from tidemark.storage import stage

    bars = stage(simulate.sim_bars(spark, instruments, days, 42), "bench-bars")
    began = time.time()
    one = grids.grid_named(one={"fast": 5, "slow": 10}).table(spark, {"fast": "int", "slow": "int"})
    sweep.crossover(bars, one, [5], [10], cost.zero(), 10.0, ledger.Opening(1e7)).metrics().collect()
    return round(time.time() - began, 3)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark import catalogue

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["s01_bars_event_day"](spark, SF_DIR).collect()  # starts the session
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    took["record_run_630k_bars"] = record_run(spark, 500, 1260)
    total = round(sum(took.values()), 3)
    # Other recorded shapes, beside the total: durable runs at high and low density, a sweep of one candidate.
    took |= {f"record_run_{i}x{d}_high": record_run(spark, i, d) for i, d in ((50, 252), (100, 1260))}
    took |= {"record_run_500x1260_low": record_run(spark, 500, 1260, 20, 50), "record_sweep_one_500x1260_high": record_sweep(spark, 500, 1260)}
    print(json.dumps({"metric": "headline queries and the recorded 630,000-bar run, total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()
