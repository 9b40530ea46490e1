"""FIFO lots, fills, trades and equity from the ledger, as relations.

A close takes the oldest open quantity. In each book (long or short) opens and closes are
intervals of cumulative quantity. Their ends, in one sorted series, cut the book into parts
that belong to one open and one close each: matching is one sort of a book, not a join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TidemarkError

#: Overlaps up to this are dust of double arithmetic.
DUST = 1e-9


#: Sides of ledgers from outside, and the direction of each.
SIDES = {"BUY": 1, "BUY_TO_COVER": 1, "COVER": 1, "SELL": -1, "SELL_SHORT": -1, "SHORT": -1}


def screen(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A ledger from outside with ``status``: null where a fill counts, REJECTED for a
    BUY_TO_COVER without a short position or a SELL_SHORT without a long one, INVALID for an unknown side, or a quantity or
    price that isn't a positive number. Sides become BUY and SELL and deltas follow them; what doesn't count moves nothing.

    Whether a fill counts depends on those before it, so an instrument's events are one grouped
    call. The engine's own ledgers have BUY and SELL only and don't need it.
    """
    schema = T.StructType([*events.schema.fields, T.StructField("status", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_seq").reset_index(drop=True)
        net, status, moved = 0.0, [], []
        for side, q, p in zip(pdf["side"], pdf["qty"], pdf["price"], strict=True):
            way, bad = SIDES.get(side or ""), None
            if way is None or not (q is not None and q > 0 and math.isfinite(q)) or not (p is not None and p > 0 and math.isfinite(p)):
                bad = "INVALID"
            elif (side == "BUY_TO_COVER" and net >= 0) or (side == "SELL_SHORT" and net <= 0):
                bad = "REJECTED"
            status.append(bad)
            moved.append(0.0 if bad else way * q)
            net += moved[-1]
        ok = pd.Series(status).isna()
        pdf["side"] = [side if bad else "BUY" if m > 0 else "SELL" for side, m, bad in zip(pdf["side"], moved, status, strict=True)]
        pdf["position_delta"] = moved
        pdf["cash_delta"] = (-pdf["position_delta"] * pdf["price"] - pdf["fee"].fillna(0.0)).where(ok & (pdf["event_type"] == "FILL"), 0.0)
        pdf["status"] = pd.Series(status, dtype=object)
        return pdf

    return events.groupBy(*by, "instrument_id").applyInPandas(run, schema)


def screened_fills(screened: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``fill_rows`` of what counts, and one row for each other fill: action REJECTED, or null if INVALID."""
    good = fill_rows(screened.where("status is null").drop("status"), by)
    bad = screened.where("status is not null and event_type = 'FILL'")
    action = F.when(F.col("status") == "REJECTED", F.lit("REJECTED")).alias("action")
    return good.unionByName(bad.select(*by, "event_seq", "ts_utc", "instrument_id", "side", "qty", "price", "fee", action, F.lit(None).cast("double").alias("realized_pnl")))


def legs(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Closing and opening leg of each event, with its book and interval. ``first_leg`` marks
    one leg of each event, for what counts once an event. Legs given are returned as they are."""
    if "leg_qty" in events.columns:
        return events
    key = (*by, "instrument_id")
    w = Window.partitionBy(*key).orderBy("event_seq")
    before = F.coalesce(F.sum("position_delta").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    e = events.withColumn("_before", before)
    against = F.col("_before") * F.col("position_delta") < -DUST * DUST
    e = e.withColumn("_close", F.when(against, F.least("qty", F.abs("_before"))).otherwise(0.0)).withColumn("_open", F.col("qty") - F.col("_close"))
    buy = F.col("side") == "BUY"
    leg = lambda kind, q, book: F.struct(F.lit(kind).alias("action"), F.col(q).alias("leg_qty"), book.alias("book"))
    both = F.array(leg("CLOSE", "_close", F.when(buy, "S").otherwise("L")), leg("OPEN", "_open", F.when(buy, "L").otherwise("S")))
    e = e.select("*", F.posexplode(F.filter(both, lambda x: x["leg_qty"] > DUST)).alias("_at", "_leg"))
    e = e.select(*events.columns, (F.col("_at") == 0).alias("first_leg"), "_leg.*")
    u = Window.partitionBy(*key, "book", "action").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("hi", F.sum("leg_qty").over(u)).withColumn("lo", F.col("hi") - F.col("leg_qty"))


def _parts(legs_: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Legs with the part of their book that ends where they end: ``matched`` (null where no
    close takes it), and its open and close. From the far end of a book on, the open or close of a
    part is the last one met."""
    down = Window.partitionBy(*by, "instrument_id", "book").orderBy(F.desc("hi"))
    so_far = down.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, c: F.last(F.when(F.col("action") == kind, F.col(c)), ignorenulls=True).over(so_far)
    x = legs_.withColumns({"_o_seq": last("OPEN", "event_seq"), "_o_price": last("OPEN", "price"), "_c_seq": last("CLOSE", "event_seq"), "_c_price": last("CLOSE", "price")})
    x = x.withColumns({"_c_ts": last("CLOSE", "ts_utc"), "_size": F.col("hi") - F.coalesce(F.lead("hi").over(down), F.lit(0.0))})
    return x.withColumn("matched", F.when(F.col("_c_seq").isNotNull() & F.col("_o_seq").isNotNull() & (F.col("_size") > DUST), F.col("_size")))


def _gain() -> Column:
    gain = F.col("_c_price") - F.col("_o_price")
    return F.col("matched") * F.when(F.col("book") == "L", gain).otherwise(-gain)


def matches(legs_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Parts of lots that closes take: event_seq and time of the close, quantity, prices, realized."""
    x = _parts(legs(legs_, by), by).where("matched is not null")
    return x.select(*by, "instrument_id", "book", F.col("_c_seq").alias("event_seq"), F.col("_c_ts").alias("ts_utc"), F.col("_c_price").alias("close_price"), F.col("_o_seq").alias("open_seq"), F.col("_o_price").alias("open_price"), "matched", _gain().alias("realized"))


def matched_legs(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Legs with ``realized`` and ``cost`` (of the opens taken) on each closing one, from one
    pass over the ledger; fills, trades and equity all start here, and take it instead of events."""
    if "realized" in events.columns:
        return events
    out = legs(events, by)
    x = _parts(out, by)
    taken = Window.partitionBy(*by, "instrument_id", "book", "_c_seq")
    closes = F.col("action") == "CLOSE"
    of = lambda c: F.when(closes, F.coalesce(F.sum(c).over(taken), F.lit(0.0))).otherwise(0.0)
    return x.withColumns({"realized": of(_gain()), "cost": of(F.col("matched") * F.col("_o_price"))}).select(*out.columns, "realized", "cost")


def fill_rows(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each leg, the CLOSE of a flip before its OPEN. ``realized_pnl`` is gross of
    fees; the whole fee stands on each leg of a flip, so take fee totals from the ledger."""
    out = matched_legs(events, by).where("event_type = 'FILL'")
    return out.select(*by, "event_seq", "ts_utc", "instrument_id", "side", F.col("leg_qty").alias("qty"), "price", "fee", "action", F.col("realized").alias("realized_pnl"))


def trades(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return fill_rows(events, by).where("action = 'CLOSE'")


def equity(panel: DataFrame, events: DataFrame, cash: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Per pulse: cash, positions_value, equity, realized_pnl (net of fees), unrealized_pnl.

    Deltas are summed by instrument and pulse before anything is windowed; events happen
    at pulses, so running sums over the complete panel are exact.
    """
    key = (*by, "instrument_id")
    x = matched_legs(events, by)
    sign = F.when(F.col("book") == "L", 1).otherwise(-1)
    basis = sign * F.when(F.col("action") == "OPEN", F.col("leg_qty") * F.col("price")).otherwise(-F.col("cost"))
    once = lambda c: F.sum(F.when(F.col("first_leg"), F.col(c)).otherwise(0.0))
    parts = x.groupBy(*key, "ts_utc").agg(once("cash_delta").alias("_c"), once("position_delta").alias("_p"), once("fee").alias("_f"), F.sum(basis).alias("_b"), F.sum("realized").alias("_r"))
    p = panel.select(*key, "ts_utc", "close").join(parts, [*key, "ts_utc"], "left")
    w = Window.partitionBy(*key).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_c", "_p", "_f", "_b", "_r")})
    p = p.withColumns({"_pos": F.sum("_p").over(w), "_basis": F.sum("_b").over(w)})
    t = p.groupBy(*by, "ts_utc").agg(
        F.sum("_c").alias("_c"), F.sum("_basis").alias("_basis"), F.sum(F.col("_r") - F.col("_f")).alias("_r"),
        F.sum(F.when(F.abs("_pos") > DUST, F.col("_pos") * F.col("close")).otherwise(0.0)).alias("positions_value"),
    )
    v = Window.partitionBy(*by).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cash", F.lit(float(cash)) + F.sum("_c").over(v)).withColumn("realized_pnl", F.sum("_r").over(v))
    return t.select(*by, "ts_utc", "cash", "positions_value", (F.col("cash") + F.col("positions_value")).alias("equity"), "realized_pnl", (F.col("positions_value") - F.col("_basis")).alias("unrealized_pnl"))


def period_returns(equity_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Equity with ``period_return``, null on the first pulse and after zero equity."""
    was = F.lag("equity").over(Window.partitionBy(*by).orderBy("ts_utc"))
    return equity_.withColumn("period_return", F.when(was != 0, F.col("equity") / F.nullif(was, F.lit(0.0)) - 1))


def drawdown(equity_: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("ts_utc").rowsBetween(Window.unboundedPreceding, 0)
    x = equity_.withColumn("running_max", F.max("equity").over(w))
    return x.withColumn("drawdown", F.when(F.col("running_max") != 0, F.col("equity") / F.nullif(F.col("running_max"), F.lit(0.0)) - 1))


def require_order(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``events``, or an error where event_seq isn't dense from 1 in a run or times go back."""
    w = Window.partitionBy(*by, "instrument_id").orderBy("event_seq")
    back = events.withColumn("_was", F.lag("ts_utc").over(w)).where("ts_utc < _was")
    runs = events.groupBy(*by).agg(F.min("event_seq").alias("lo"), F.max("event_seq").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_seq").alias("k"))
    if not runs.where("n > 0 and (lo != 1 or hi != n or k != n)").isEmpty() or not back.isEmpty():
        raise TidemarkError("events out of order")
    return events


def final_state(events: DataFrame, cash: float, by: tuple[str, ...] = (), asof=None) -> tuple[DataFrame, DataFrame]:
    """Positions and cash after all events, or after those up to ``asof``."""
    e = events if asof is None else events.where(F.col("ts_utc") <= F.lit(asof).cast("timestamp_ntz"))
    return e.groupBy(*by, "instrument_id").agg(F.sum("position_delta").alias("position")), e.groupBy(*by).agg((F.lit(cash) + F.sum("cash_delta")).alias("cash"))
