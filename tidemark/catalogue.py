"""Named queries over the test tables, one or more for each operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import features
from .functions import indicators as ind
from .operators import accounting, cost, ledger, metrics, risk, strategy
from .plans import experiment, fold, grids, sweep, validation, walkforward
from .schema import seed_column, utc_column
from .sources import panels, snapshots
from .storage import driver_table, shared_dir, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CASH, COST = 1_000_000.0, cost.chain(cost.spread_bps(5), cost.fixed_fee(1))
MONTHLY = metrics.MetricContext(12, 1, 0.02, "monthly")
DAILY = metrics.us_equity(0.02)
OPEN = ledger.Opening(CASH, {"ECONOMY": 7.0, "PROMO": 5.0}, {"ECONOMY": 1000.0, "PROMO": 1100.5})
FAST, SLOW = [2, 3, 4], [6, 8, 10]
GRID = grids.grid_named(**{f"f{f}_s{s}": {"fast": f, "slow": s} for f in FAST for s in SLOW})
FOLDS = walkforward.folds_rolling("1995-03-01", "2001-07-31", "24 months", "12 months")
FOLDS_ANCHORED = walkforward.folds_anchored("1995-03-01", "2001-07-31", "24 months", "12 months")


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Panels ---------------------------------------------------------------------------------------


def panel_sql(instrument: str, unit: str, at: str, price: str, volume: str, source: str) -> str:
    return f"""
src AS (SELECT {instrument} AS i, {at} AS seen_at, {price} AS price, {volume}::DOUBLE AS v FROM {source}),
bars AS (
  SELECT i AS instrument_id, date_trunc('{unit}', seen_at)::TIMESTAMP AS ts_utc, round(first(price ORDER BY seen_at, price), 8) AS open, round(max(price), 8) AS high,
         round(min(price), 8) AS low, round(last(price ORDER BY seen_at, price), 8) AS close, sum(v) AS volume
  FROM src GROUP BY 1, 2)"""


P = panel_sql("p_type", "month", "l_shipdate", "l_extendedprice / l_quantity", "l_quantity", "lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= '1995-03-01' AND l_shipdate < '2001-08-01'")
E = panel_sql("event_type", "day", "ts", "value", "1", "events")
S = panel_sql("c_mktsegment", "quarter", "o_orderdate", "o_totalprice", "1", "orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate < '2001-07-01'")
R = panel_sql("r_name", "quarter", "o_orderdate", "o_totalprice", "1", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < '2001-07-01'")
M = panel_sql("o_orderpriority", "month", "o_orderdate", "o_totalprice", "1", "orders")
PANELS = {"ptype_month": (panels.ptype_month, P), "event_day": (panels.event_day, E), "segment_quarter": (panels.segment_quarter, S), "region_quarter": (panels.region_quarter, R)}
_ROUND_BARS = "SELECT instrument_id, ts_utc, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars"

for _name, (_make, _sql) in PANELS.items():
    register(f"s01_bars_{_name}", f"WITH {_sql} {_ROUND_BARS}")(lambda spark, d, make=_make: rounded(make(spark, d), 8))


@register(
    "s07_ohlc_violations",
    f"WITH {P}, b AS (SELECT instrument_id, ts_utc, CASE WHEN month(ts_utc) = 3 THEN low - 1 ELSE high END AS high, low, open, close FROM bars) SELECT instrument_id, ts_utc FROM b WHERE high < greatest(open, low, close) OR low > least(open, high, close)",
)
def s07(spark, d):
    bad = panels.ptype_month(spark, d).withColumn("high", F.when(F.month("ts_utc") == 3, F.col("low") - 1).otherwise(F.col("high")))
    return panels.ohlc_violations(bad).select("instrument_id", "ts_utc")


@register("p03_coverage_gaps", f"WITH {M} SELECT i.instrument_id, t.ts_utc FROM (SELECT DISTINCT instrument_id FROM bars) i CROSS JOIN (SELECT DISTINCT ts_utc FROM bars) t ANTI JOIN bars USING (instrument_id, ts_utc)")
def p03(spark, d):
    return panels.coverage_gaps(panels.priority_month(spark, d))


@register("p04_missing_universe", f"WITH {P}, u(instrument_id) AS (VALUES ('ECONOMY'), ('NOWHERE'), ('SMALL'), ('ZINC')) SELECT instrument_id FROM u ANTI JOIN bars USING (instrument_id)")
def p04(spark, d):
    return panels.missing_universe(panels.ptype_month(spark, d), ["ECONOMY", "NOWHERE", "SMALL", "ZINC"])


@register(
    "s09_snapshot_summary",
    f"WITH {P} SELECT instrument_id, count(*) AS n_bars, min(ts_utc) AS first_ts, max(ts_utc) AS last_ts FROM bars GROUP BY 1",
)
def s09(spark, d):
    return panels.ptype_month(spark, d).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))


@register(
    "s08_snapshot_hash",
    f"""WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars),
l AS (SELECT instrument_id, (rn - 1) // 10000 AS block, rn, concat_ws('|', instrument_id, strftime(ts_utc, '%Y-%m-%dT%H:%M:%SZ'), format('{{:.4f}}', open), format('{{:.4f}}', high), format('{{:.4f}}', low), format('{{:.4f}}', close), format('{{:.4f}}', volume)) AS line FROM n),
h1 AS (SELECT instrument_id, block, sha256(string_agg(line, chr(10) ORDER BY rn)) AS x FROM l GROUP BY 1, 2),
h2 AS (SELECT instrument_id, block // 10000 AS block, sha256(string_agg(x, '' ORDER BY block)) AS x FROM h1 GROUP BY 1, 2),
h3 AS (SELECT instrument_id, sha256(string_agg(x, '' ORDER BY block)) AS x FROM h2 GROUP BY 1),
i AS (SELECT 0 AS part, instrument_id, sha256(concat_ws('|', instrument_id, instrument_id, 'USD', 'EQUITY', '1.0000', '0.0100', 'NA')) AS x FROM h3 UNION ALL SELECT 1, instrument_id, x FROM h3),
o AS (SELECT x, row_number() OVER (ORDER BY part, instrument_id) - 1 AS rn FROM i),
h4 AS (SELECT rn // 10000 AS block, sha256(string_agg(x, '' ORDER BY rn)) AS x FROM o GROUP BY 1)
SELECT sha256(string_agg(x, '' ORDER BY block)) AS snapshot_hash FROM h4""",
)
def s08(spark, d):
    bars = stage(panels.ptype_month(spark, d), "bars")
    return snapshots.content_hash(bars, places=4, instruments=snapshots.default_instruments(bars))


@register("s11_bars_fetch", f"WITH {P} {_ROUND_BARS} WHERE instrument_id IN ('ECONOMY', 'PROMO') AND ts_utc BETWEEN '1997-01-01' AND '1997-12-01'")
def s11(spark, d):
    return rounded(snapshots.fetch(panels.ptype_month(spark, d), ["ECONOMY", "PROMO"], "1997-01-01", "1997-12-01"), 8)


# Indicators -----------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY instrument_id ORDER BY ts_utc)"


def _over(n: int) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY ts_utc ROWS {n - 1} PRECEDING)"


def indicator(name: str, build, cols: list[str], sql: str, panel: str = "ptype_month", places: int = 6):
    make, bars = PANELS[panel]
    rounds = ", ".join(f"round({c}, {places}) AS {c}" for c in cols)
    register(name, f"WITH {bars}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), x AS ({sql}) SELECT instrument_id, ts_utc, {rounds} FROM x")(
        lambda spark, d: rounded(build(make(spark, d)).select("instrument_id", "ts_utc", *cols), places)
    )


def masked(n: int, value: str, name: str = "v") -> str:
    return f"CASE WHEN rn >= {n} THEN {value} END AS {name}"


indicator("w01_sma", lambda b: ind.sma(b, 5, "v"), ["v"], f"SELECT *, {masked(5, f'avg(close) {_over(5)}')} FROM n")
_a = 2 / 7
indicator("w02_ema_bounded", lambda b: ind.ema_bounded(b, 6, "v"), ["v"], f"SELECT *, {masked(7, ' + '.join([f'coalesce(lag(close, {k}) OVER w, 0) * {_a * (1 - _a) ** k!r}' for k in range(6)] + [f'coalesce(lag(close, 6) OVER w, 0) * {(1 - _a) ** 6!r}']))} FROM n {_W}")
indicator(
    "w03_rsi_simple", lambda b: ind.rsi_simple(b, 6, "v"), ["v"],
    f"SELECT *, {masked(7, f'CASE WHEN avg(greatest(-s, 0)) {_over(6)} = 0 THEN 100 ELSE 100 - 100 / (1 + avg(greatest(s, 0)) {_over(6)} / avg(greatest(-s, 0)) {_over(6)}) END')} FROM (SELECT *, close - lag(close) OVER w AS s FROM n {_W})",
)
indicator("w04_returns", lambda b: ind.returns(b, 3, "v"), ["v"], f"SELECT *, (close - lag(close, 3) OVER w) / lag(close, 3) OVER w AS v FROM n {_W}", "event_day")
indicator("t_wma", lambda b: ind.wma(b, 5, "v"), ["v"], f"SELECT *, {masked(5, '(' + ' + '.join(f'lag(close, {k}) OVER w * {5 - k}' for k in range(5)) + ') / 15')} FROM n {_W}")
indicator("t_roc", lambda b: ind.roc(b, 4, "v"), ["v"], f"SELECT *, ln(close / lag(close, 4) OVER w) AS v FROM n {_W}")
indicator("t_momentum", lambda b: ind.momentum(b, 4, "v"), ["v"], f"SELECT *, close - lag(close, 4) OVER w AS v FROM n {_W}")
indicator(
    "t_cci", lambda b: ind.cci(b, 6, "v"), ["v"],
    f"SELECT *, {masked(6, '(tp - m) / (0.015 * list_avg([abs(x - m) FOR x IN a]))')} FROM (SELECT *, avg(tp) {_over(6)} AS m, list(tp) {_over(6)} AS a FROM (SELECT *, (high + low + close) / 3 AS tp FROM n))",
)
indicator(
    "t_bbands", lambda b: ind.bbands(b, 6, "bb"), ["bb_dn", "bb_mavg", "bb_up", "bb_pct_b"],
    f"SELECT *, {masked(6, 'm - 2 * s', 'bb_dn')}, {masked(6, 'm', 'bb_mavg')}, {masked(6, 'm + 2 * s', 'bb_up')}, {masked(6, '(close - m + 2 * s) / (4 * s)', 'bb_pct_b')} FROM (SELECT *, avg(close) {_over(6)} AS m, stddev_pop(close) {_over(6)} AS s FROM n)",
)
indicator(
    "t_donchian", lambda b: ind.donchian(b, 6, "dc"), ["dc_high", "dc_mid", "dc_low"],
    f"SELECT *, {masked(6, 'h', 'dc_high')}, {masked(6, '(h + l) / 2', 'dc_mid')}, {masked(6, 'l', 'dc_low')} FROM (SELECT *, max(high) {_over(6)} AS h, min(low) {_over(6)} AS l FROM n)", places=9,
)
indicator(
    "t_aroon", lambda b: ind.aroon(b, 6, "ar"), ["ar_up", "ar_dn", "ar_osc"],
    f"SELECT *, {masked(6, '100.0 * (6 - (rn - u)) / 6', 'ar_up')}, {masked(6, '100.0 * (6 - (rn - l)) / 6', 'ar_dn')}, {masked(6, '100.0 * (u - l) / 6', 'ar_osc')} FROM (SELECT *, max(struct_pack(a := high, b := rn)) {_over(6)}.b AS u, max(struct_pack(a := -low, b := rn)) {_over(6)}.b AS l FROM n)".replace(
        f"max(struct_pack(a := high, b := rn)) {_over(6)}.b", f"(max(struct_pack(a := high, b := rn)) {_over(6)}).b"
    ).replace(f"max(struct_pack(a := -low, b := rn)) {_over(6)}.b", f"(max(struct_pack(a := -low, b := rn)) {_over(6)}).b"),
)
indicator(
    "t_mfi", lambda b: ind.mfi(b, 6, "v"), ["v"],
    f"SELECT *, {masked(7, f'CASE WHEN sum(ng) {_over(6)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(ps) {_over(6)} / sum(ng) {_over(6)}) END')} FROM (SELECT *, CASE WHEN tp > was THEN tp * volume ELSE 0 END AS ps, CASE WHEN tp < was THEN tp * volume ELSE 0 END AS ng FROM (SELECT *, lag(tp) OVER w AS was FROM (SELECT *, (high + low + close) / 3 AS tp FROM n) {_W}))",
)
indicator("t_cmf", lambda b: ind.cmf(b, 6, "v"), ["v"], f"SELECT *, {masked(6, f'sum(c * volume) {_over(6)} / sum(volume) {_over(6)}')} FROM (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END AS c FROM n)")
indicator("t_runsd", lambda b: ind.run_sd(b, 6, "v"), ["v"], f"SELECT *, {masked(6, f'stddev_samp(close) {_over(6)}')} FROM n")
indicator("t_runvar", lambda b: rounded(ind.run_var(b, 6, "v"), 3), ["v"], f"SELECT instrument_id, ts_utc, round(v, 3) AS v FROM (SELECT *, {masked(6, f'var_samp(close) {_over(6)}')} FROM n)")
indicator("t_runmad", lambda b: rounded(ind.run_mad(b, 6, "v"), 4), ["v"], f"SELECT instrument_id, ts_utc, round(v, 4) AS v FROM (SELECT *, {masked(6, f'1.4826 * mad(close) {_over(6)}')} FROM n)")


def _smooth_sql(name: str, source: str, n: int, ratio: str, first: int) -> str:
    """A recursive series, seeded with the mean of the n values of ``source`` that end at row ``first``."""
    return f"""{name} AS (
  SELECT instrument_id, rn, m AS v FROM (SELECT instrument_id, rn, avg(v) OVER (PARTITION BY instrument_id ORDER BY rn ROWS {n - 1} PRECEDING) AS m FROM {source}) WHERE rn = {first}
  UNION ALL SELECT s.instrument_id, s.rn, s.v * {ratio} + r.v * (1 - {ratio}) FROM {name} r JOIN {source} s ON s.instrument_id = r.instrument_id AND s.rn = r.rn + 1)"""


def recursive(name: str, columns: dict[str, tuple], ctes: str, select: str):
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    register(
        name,
        f"WITH RECURSIVE {P}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), c AS MATERIALIZED (SELECT instrument_id, rn, close AS v FROM n), {ctes} SELECT n.instrument_id, n.ts_utc, {cols} FROM ({select}) n",
    )(lambda spark, d: rounded(ind.recursive(panels.ptype_month(spark, d), columns).select("instrument_id", "ts_utc", *columns)))


recursive("t_ema", {"v": ("ema", 5)}, _smooth_sql("e", "c", 5, "(2.0 / 6)", 5), "SELECT n.*, e.v FROM n LEFT JOIN e USING (instrument_id, rn)")
recursive(
    "t_rsi", {"v": ("rsi", 5)},
    "st AS MATERIALIZED (SELECT instrument_id, rn, v - lag(v) OVER (PARTITION BY instrument_id ORDER BY rn) AS s FROM c), ups AS MATERIALIZED (SELECT instrument_id, rn, greatest(s, 0) AS v FROM st WHERE s IS NOT NULL), dns AS MATERIALIZED (SELECT instrument_id, rn, greatest(-s, 0) AS v FROM st WHERE s IS NOT NULL), "
    + _smooth_sql("u", "ups", 5, "0.2", 6) + ", " + _smooth_sql("d", "dns", 5, "0.2", 6),
    "SELECT n.*, CASE WHEN d.v = 0 THEN 100 ELSE 100 - 100 / (1 + u.v / d.v) END AS v FROM n LEFT JOIN u USING (instrument_id, rn) LEFT JOIN d USING (instrument_id, rn)",
)
recursive(
    "t_atr", {"v": ("atr", 5)},
    "tr AS MATERIALIZED (SELECT instrument_id, rn, greatest(high, p) - least(low, p) AS v FROM (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY rn) AS p FROM n) WHERE p IS NOT NULL), " + _smooth_sql("a", "tr", 5, "0.2", 6),
    "SELECT n.*, a.v FROM n LEFT JOIN a USING (instrument_id, rn)",
)
recursive(
    "t_macd", {"macd": ("macd", 3, 6, 4), "signal": ("macd_signal", 3, 6, 4), "histogram": ("macd_histogram", 3, 6, 4)},
    _smooth_sql("f", "c", 3, "0.5", 3) + ", " + _smooth_sql("s", "c", 6, "(2.0 / 7)", 6) + ", m AS MATERIALIZED (SELECT instrument_id, rn, 100 * (f.v / s.v - 1) AS v FROM f JOIN s USING (instrument_id, rn)), " + _smooth_sql("g", "m", 4, "0.4", 9),
    "SELECT n.*, m.v AS macd, g.v AS signal, m.v - g.v AS histogram FROM n LEFT JOIN m USING (instrument_id, rn) LEFT JOIN g USING (instrument_id, rn)",
)


@register("w05_latest_n", f"WITH {P} SELECT instrument_id, ts_utc, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc DESC) <= 3")
def w05(spark, d):
    return rounded(snapshots.latest(panels.ptype_month(spark, d), 3).select("instrument_id", "ts_utc", "close"))


@register("w06_cadence", f"WITH {E}, t AS (SELECT DISTINCT ts_utc FROM bars), g AS (SELECT date_diff('second', lag(ts_utc) OVER (ORDER BY ts_utc), ts_utc) AS g FROM t) SELECT median(g) AS median_gap, CASE WHEN abs(median(g) / 86400 - 1) <= 0.2 THEN 252 ELSE 0 END AS bars_per_year FROM g")
def w06(spark, d):
    return metrics.cadence(panels.event_day(spark, d))


@register("p10_pulse_wide", f"WITH {E}, x AS (SELECT ts_utc, instrument_id, close, close / lag(close) OVER (PARTITION BY instrument_id ORDER BY ts_utc) - 1 AS r FROM bars) SELECT ts_utc, " + ", ".join(f"round(max(close) FILTER (instrument_id = '{i}'), 6) AS {i}__ohlcv_close, round(max(r) FILTER (instrument_id = '{i}'), 6) AS {i}__feature_r" for i in ("click", "view")) + " FROM x GROUP BY 1")
def p10(spark, d):
    return rounded(strategy.pulse_wide(ind.returns(panels.event_day(spark, d), 1, "r"), ["r"], ["click", "view"]))


@register("p11_features_wide", f"WITH {E}, x AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars) SELECT instrument_id, ts_utc, round(CASE WHEN rn >= 3 THEN avg(close) {_over(3)} END, 6) AS sma_3, round(close - lag(close, 2) OVER (PARTITION BY instrument_id ORDER BY ts_utc), 6) AS mom_2 FROM x")
def p11(spark, d):
    x = ind.momentum(ind.sma(panels.event_day(spark, d), 3, "sma_3"), 2, "mom_2")
    return rounded(strategy.features_wide(strategy.features_long(x, ["sma_3", "mom_2"]), ["sma_3", "mom_2"]))


@register("p12_features_long", f"WITH {E}, x AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), y AS (SELECT instrument_id, ts_utc, CASE WHEN rn >= 3 THEN avg(close) {_over(3)} END AS a, close - lag(close, 2) OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS b FROM x) SELECT instrument_id, ts_utc, 'sma_3' AS feature_name, round(a, 6) AS feature_value FROM y UNION ALL SELECT instrument_id, ts_utc, 'mom_2', round(b, 6) FROM y")
def p12(spark, d):
    x = ind.momentum(ind.sma(panels.event_day(spark, d), 3, "sma_3"), 2, "mom_2")
    return rounded(strategy.features_long(x, ["sma_3", "mom_2"]))


# Runs -----------------------------------------------------------------------------------------


def crossover_panel(spark, d, panel="ptype_month", fast=3, slow=8, qty=10.0):
    x = ind.sma(ind.sma(PANELS[panel][0](spark, d), fast, "fast"), slow, "slow")
    return x.withColumn("target", strategy.sma_crossover(F.col("fast"), F.col("slow"), qty))


def crossover_sql(panel="ptype_month", fast=3, slow=8, qty=10.0) -> str:
    return f"""{PANELS[panel][1]}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars),
tg AS (SELECT *, CASE WHEN rn >= {slow} AND avg(close) {_over(fast)} / avg(close) {_over(slow)} - 1 > 0 THEN {qty} ELSE 0.0 END AS target FROM n)"""


def run_sql(by: str = "", bps: float = 5, fixed: float = 1, notional: float = 0, cash: float = CASH, opening: ledger.Opening | None = None, start: str = "") -> str:
    """CTEs from ``tg`` (by, instrument_id, ts_utc, open, close, target) to events, fills and equity."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    held = opening.held() if opening else {}
    first = "CASE instrument_id " + " ".join(f"WHEN '{k}' THEN {q}" for k, q in held.items()) + " ELSE 0 END" if held else "0"
    opens = "".join(f" UNION ALL SELECT NULL, TIMESTAMP '{start}', 'CASHFLOW', '{k}', 'BUY', {q}::DOUBLE, {opening.cost_basis[k]}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, {q}::DOUBLE" for k, q in held.items())
    key = f"{by}instrument_id"
    return f"""
nx AS (SELECT {key}, ts_utc AS decision_ts, target, lead(open) OVER w AS o, lead(ts_utc) OVER w AS ts_utc FROM tg WINDOW w AS (PARTITION BY {key} ORDER BY ts_utc)),
d AS (SELECT * EXCLUDE (target), target - coalesce(last_value(CASE WHEN o > 0 THEN target END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY decision_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {first}) AS delta FROM nx),
f AS (SELECT {by}decision_ts, ts_utc, 'FILL' AS event_type, instrument_id, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS qty, round(o * (1 + sign(delta) * {bps} / 20000.0), 8) AS price,
      {fixed}::DOUBLE + abs(delta) * o * (1 + sign(delta) * {bps} / 20000.0) * {notional} / 10000.0 AS fee, delta AS position_delta FROM d WHERE abs(delta) > 1.4901161193847656e-08 AND o > 0),
ev0 AS (SELECT {by}decision_ts, ts_utc, event_type, instrument_id, side, qty, price, fee, -sign(position_delta) * qty * price - fee AS cash_delta, position_delta FROM f{opens}),
ev AS (SELECT *, row_number() OVER ({part} ORDER BY decision_ts NULLS FIRST, instrument_id) AS event_seq FROM ev0),
b4 AS (SELECT *, coalesce(sum(position_delta) OVER (PARTITION BY {key} ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ev),
cq AS (SELECT *, CASE WHEN b * position_delta < -1e-18 THEN least(qty, abs(b)) ELSE 0 END AS cq FROM b4),
lg0 AS (SELECT *, 'CLOSE' AS action, cq AS leg_qty, CASE WHEN side = 'BUY' THEN 'S' ELSE 'L' END AS book FROM cq WHERE cq > 1e-9
        UNION ALL SELECT *, 'OPEN', qty - cq, CASE WHEN side = 'BUY' THEN 'L' ELSE 'S' END FROM cq WHERE qty - cq > 1e-9),
lg AS (SELECT *, sum(leg_qty) OVER (PARTITION BY {key}, book, action ORDER BY event_seq) AS hi FROM lg0),
mt AS (SELECT {', '.join('c.' + x.strip() for x in key.split(','))}, c.event_seq, c.ts_utc, c.book, least(c.hi, o.hi) - greatest(c.hi - c.leg_qty, o.hi - o.leg_qty) AS m, o.price AS op, c.price AS cp
       FROM lg c JOIN lg o USING ({key}, book) WHERE c.action = 'CLOSE' AND o.action = 'OPEN' AND o.hi - o.leg_qty < c.hi AND o.hi > c.hi - c.leg_qty),
mr AS (SELECT *, m * (cp - op) * CASE book WHEN 'L' THEN 1 ELSE -1 END AS r FROM mt WHERE m > 1e-9),
ra AS (SELECT {key}, event_seq, sum(r) AS r FROM mr GROUP BY ALL),
fl AS (SELECT {', '.join('lg.' + x.strip() for x in key.split(','))}, lg.event_seq, lg.ts_utc, side, leg_qty AS qty, price, fee, action, CASE WHEN action = 'CLOSE' THEN coalesce(r, 0) ELSE 0 END AS realized_pnl
       FROM lg LEFT JOIN ra USING ({key}, event_seq) WHERE event_type = 'FILL'),
mv AS (SELECT {key}, ts_utc, sum(c) AS c, sum(p) AS p, sum(f) AS f, sum(bs) AS bs, sum(r) AS r FROM (
  SELECT {key}, ts_utc, cash_delta AS c, position_delta AS p, fee AS f, 0 AS bs, 0 AS r FROM ev
  UNION ALL SELECT {key}, ts_utc, 0, 0, 0, leg_qty * price * CASE book WHEN 'L' THEN 1 ELSE -1 END, 0 FROM lg WHERE action = 'OPEN'
  UNION ALL SELECT {key}, ts_utc, 0, 0, 0, -m * op * CASE book WHEN 'L' THEN 1 ELSE -1 END, r FROM mr) GROUP BY ALL),
pp AS (SELECT {', '.join('tg.' + x.strip() for x in key.split(','))}, tg.ts_utc, close, coalesce(c, 0) AS c, coalesce(f, 0) AS f, coalesce(r, 0) AS r,
       sum(coalesce(p, 0)) OVER (PARTITION BY {', '.join('tg.' + x.strip() for x in key.split(','))} ORDER BY tg.ts_utc) AS pos, sum(coalesce(bs, 0)) OVER (PARTITION BY {', '.join('tg.' + x.strip() for x in key.split(','))} ORDER BY tg.ts_utc) AS basis
       FROM tg LEFT JOIN mv USING ({key}, ts_utc)),
pt AS (SELECT {by}ts_utc, sum(c) AS c, sum(CASE WHEN abs(pos) > 1e-9 THEN pos * close ELSE 0 END) AS positions_value, sum(basis) AS basis, sum(r - f) AS r FROM pp GROUP BY ALL),
eq AS (SELECT {by}ts_utc, {cash} + sum(c) OVER w AS cash, positions_value, {cash} + sum(c) OVER w + positions_value AS equity, sum(r) OVER w AS realized_pnl, positions_value - basis AS unrealized_pnl
       FROM pt WINDOW w AS ({part} ORDER BY ts_utc)),
rt AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS period_return, equity / max(equity) OVER w - 1 AS drawdown, max(equity) OVER w AS running_max FROM eq WINDOW w AS ({part} ORDER BY ts_utc))"""


def metrics_sql(by: str = "", context: metrics.MetricContext = MONTHLY) -> str:
    n, rf = context.bars_per_year, context.rf_per_period
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    on = f"LEFT JOIN tm USING ({by.rstrip(', ')})" if by else "CROSS JOIN tm"
    return f"""
em AS (SELECT {by}last(equity ORDER BY ts_utc) / first(equity ORDER BY ts_utc) - 1 AS tr, count(*) AS n, stddev_samp(period_return) AS sd, avg(period_return - {rf!r}) AS mx, stddev_samp(period_return - {rf!r}) AS sx, min(drawdown) AS dd, avg(CASE WHEN abs(positions_value) > 1e-6 THEN 1.0 ELSE 0 END) AS tim FROM rt {group}),
tm AS (SELECT {by}count(*) AS nt, avg(CASE WHEN realized_pnl > 0 THEN 1.0 ELSE 0 END) AS wr, avg(realized_pnl) AS av FROM fl WHERE action = 'CLOSE' {group}),
me AS (SELECT {by}round(tr, 6) AS total_return, round(pow(1 + tr, 1 / ((n - 1) / {n!r}::DOUBLE)) - 1, 6) AS annualized_return, round(sd * sqrt({n!r}), 6) AS volatility, round(CASE WHEN sx > 2.220446049250313e-16 THEN mx / sx * sqrt({n!r}) END, 6) AS sharpe,
       round(dd, 6) AS max_drawdown, round(tim, 6) AS time_in_market, coalesce(nt, 0)::BIGINT AS n_trades, round(wr, 6) AS win_rate, round(av, 4) AS avg_trade FROM em {on})"""


def finished(df: DataFrame) -> DataFrame:
    return rounded(rounded(df.withColumn("avg_trade", F.round("avg_trade", 4))), 6)


def single(spark, d, panel="ptype_month", opening=ledger.Opening(CASH), c=COST, qty=10.0, target=None):
    """The panel with targets, written once, and its ledger."""
    x = crossover_panel(spark, d, panel, qty=qty)
    x = x if target is None else x.withColumn("target", target)
    x = stage(x.select("instrument_id", "ts_utc", "open", "close", "target"), "targets")
    return x, ledger.events(ledger.fills(x, c, opening), "1995-03-01", opening)


def booked(spark, d, *args, **kwargs):
    """The panel and its matched legs, each written once: fills, trades and equity read these."""
    x, ev = single(spark, d, *args, **kwargs)
    return x, stage(accounting.matched_legs(ev), "legs")


_EV = "ts_utc, event_type, instrument_id, side, round(qty, 6) AS qty, round(price, 6) AS price, round(fee, 4) AS fee, round(cash_delta, 4) AS cash_delta, round(position_delta, 6) AS position_delta, event_seq"


def events_out(ev: DataFrame) -> DataFrame:
    four = ("fee", "cash_delta")
    return ev.select("ts_utc", "event_type", "instrument_id", "side", *[F.round(c, 4 if c in four else 6).alias(c) for c in ("qty", "price", "fee", "cash_delta", "position_delta")], "event_seq")


@register("b05_fills_next_open", f"WITH {crossover_sql()}, {run_sql(bps=0, fixed=0)} SELECT {_EV} FROM ev")
def b05(spark, d):
    return events_out(single(spark, d, c=cost.zero())[1])


@register("b05_unfillable_opens", f"WITH {crossover_sql().replace('tg AS (SELECT *,', 'tg0 AS (SELECT *,')}, tg AS (SELECT * REPLACE (CASE WHEN month(ts_utc) IN (3, 4, 9) THEN 0 ELSE open END AS open) FROM tg0), {run_sql()} SELECT {_EV} FROM ev")
def b05_unfillable(spark, d):
    """Orders wait while opens of 0 can't fill them."""
    x = crossover_panel(spark, d).withColumn("open", F.when(F.month("ts_utc").isin(3, 4, 9), 0.0).otherwise(F.col("open")))
    return events_out(ledger.events(ledger.fills(stage(x, "targets"), COST, ledger.Opening(CASH)), None))


@register("b07_cost_spread", f"WITH {crossover_sql()}, {run_sql(bps=25, fixed=0)} SELECT {_EV} FROM ev")
def b07(spark, d):
    return events_out(single(spark, d, c=cost.spread_bps(25))[1])


@register("b08_cost_fees", f"WITH {crossover_sql()}, {run_sql(bps=10, fixed=2.5, notional=7)} SELECT {_EV} FROM ev")
def b08(spark, d):
    return events_out(single(spark, d, c=cost.chain(cost.spread_bps(10), cost.fixed_fee(2.5), cost.notional_bps_fee(7)))[1])


def _flips() -> tuple:
    return F.when(F.col("close") > F.col("slow"), "LONG").when(F.col("close") < F.col("slow"), "SHORT").otherwise("FLAT")


_FLIP_SQL = f"{P}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), sl AS (SELECT *, CASE WHEN rn >= 8 THEN avg(close) {_over(8)} END AS slow FROM n), tg AS (SELECT *, CASE WHEN close > slow THEN 3.0 WHEN close < slow THEN -2.0 ELSE 0.0 END AS target FROM sl)"


@register("b28_signal_strategy", f"WITH {_FLIP_SQL}, {run_sql()} SELECT {_EV} FROM ev")
def b28(spark, d):
    return events_out(single(spark, d, target=strategy.signal_map(_flips(), 3, 0, -2))[1])


@register("b10_risk_long_only", f"WITH {_FLIP_SQL.replace('-2.0', '0.0')}, {run_sql()} SELECT {_EV} FROM ev")
def b10(spark, d):
    return events_out(single(spark, d, target=risk.long_only().column(strategy.signal_map(_flips(), 3, 0, -2)))[1])


_FL = "event_seq, ts_utc, instrument_id, side, round(qty, 6) AS qty, round(price, 6) AS price, round(fee, 4) AS fee, action, round(realized_pnl, 4) AS realized_pnl"


def fills_out(f: DataFrame) -> DataFrame:
    return f.select("event_seq", "ts_utc", "instrument_id", "side", F.round("qty", 6).alias("qty"), F.round("price", 6).alias("price"), F.round("fee", 4).alias("fee"), "action", F.round("realized_pnl", 4).alias("realized_pnl"))


@register("b14_fills_fifo", f"WITH {_FLIP_SQL}, {run_sql()} SELECT {_FL} FROM fl")
def b14(spark, d):
    return fills_out(accounting.fill_rows(single(spark, d, target=strategy.signal_map(_flips(), 3, 0, -2))[1]))


@register("b15_trades", f"WITH {_FLIP_SQL}, {run_sql()} SELECT {_FL} FROM fl WHERE action = 'CLOSE'")
def b15(spark, d):
    return fills_out(accounting.trades(single(spark, d, target=strategy.signal_map(_flips(), 3, 0, -2))[1]))


_OPEN_SQL = run_sql(opening=OPEN, start="1995-03-01")


@register("b11_ledger", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT {_EV} FROM ev")
def b11(spark, d):
    return events_out(single(spark, d, opening=OPEN)[1])


@register("b12_lots_with_openings", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT {_FL} FROM fl")
def b12(spark, d):
    return fills_out(accounting.fill_rows(single(spark, d, opening=OPEN)[1]))


_EQ = "ts_utc, round(cash, 4) AS cash, round(positions_value, 4) AS positions_value, round(equity, 4) AS equity, round(realized_pnl, 4) AS realized_pnl, round(unrealized_pnl, 4) AS unrealized_pnl"


@register("b16_equity", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT {_EQ} FROM eq")
def b16(spark, d):
    x, ev = booked(spark, d, opening=OPEN)
    return rounded(accounting.equity(x, ev, CASH), 4)


@register("b16_unrealized", f"WITH {_FLIP_SQL}, {run_sql()} SELECT {_EQ} FROM eq")
def b16_short(spark, d):
    x, ev = booked(spark, d, target=strategy.signal_map(_flips(), 3, 0, -2))
    return rounded(accounting.equity(x, ev, CASH), 4)


@register("b17_returns", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT ts_utc, round(equity, 4) AS equity, round(period_return, 8) AS period_return FROM rt")
def b17(spark, d):
    x, ev = booked(spark, d, opening=OPEN)
    return accounting.period_returns(accounting.equity(x, ev, CASH)).select("ts_utc", F.round("equity", 4).alias("equity"), F.round("period_return", 8).alias("period_return"))


@register("w07_drawdown", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT ts_utc, round(running_max, 4) AS running_max, round(drawdown, 8) AS drawdown FROM rt")
def w07(spark, d):
    x, ev = booked(spark, d, opening=OPEN)
    return accounting.drawdown(accounting.equity(x, ev, CASH)).select("ts_utc", F.round("running_max", 4).alias("running_max"), F.round("drawdown", 8).alias("drawdown"))


@register("a18_final_positions", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT instrument_id, round(sum(position_delta), 6) AS position FROM ev WHERE ts_utc <= '1999-06-01' GROUP BY 1")
def a18(spark, d):
    return rounded(accounting.final_state(single(spark, d, opening=OPEN)[1], CASH, asof="1999-06-01")[0])


@register("a18_final_cash", f"WITH {crossover_sql()}, {_OPEN_SQL} SELECT round({CASH} + sum(cash_delta), 4) AS cash FROM ev WHERE ts_utc <= '1999-06-01'")
def a18_cash(spark, d):
    return rounded(accounting.final_state(single(spark, d, opening=OPEN)[1], CASH, asof="1999-06-01")[1], 4)


@register("b05_unfilled", f"WITH {crossover_sql()}, {run_sql()} SELECT decision_ts AS ts_utc, instrument_id, 'LAST_BAR_NO_FILL' AS warning, round(delta, 6) AS delta FROM d WHERE abs(delta) > 1.4901161193847656e-08 AND ts_utc IS NULL")
def b05_unfilled(spark, d):
    return rounded(ledger.unfilled(crossover_panel(spark, d)))


@register("a12_metrics", f"WITH {crossover_sql()}, {_OPEN_SQL}, {metrics_sql()} SELECT * FROM me")
def a12(spark, d):
    x, ev = booked(spark, d, opening=OPEN)
    return finished(metrics.metrics(accounting.equity(x, ev, CASH), accounting.trades(ev), MONTHLY))


@register("a12_metrics_event_day", f"WITH {crossover_sql('event_day', qty=100.0)}, {run_sql()}, {metrics_sql(context=DAILY)} SELECT * FROM me")
def a12_day(spark, d):
    x, ev = booked(spark, d, "event_day", qty=100.0)
    return finished(metrics.metrics(accounting.equity(x, ev, CASH), accounting.trades(ev), DAILY))


@register("b26_top_n_equal_weight", f"WITH {P}, s AS (SELECT *, close / lag(close, 3) OVER (PARTITION BY instrument_id ORDER BY ts_utc) - 1 AS r FROM bars), k AS (SELECT *, r IS NOT NULL AND row_number() OVER (PARTITION BY ts_utc ORDER BY r DESC NULLS LAST, instrument_id) <= 2 AS selected FROM s) SELECT instrument_id, ts_utc, selected, round(CASE WHEN selected THEN 1.0 / sum(selected::INT) OVER (PARTITION BY ts_utc) ELSE 0 END, 6) AS weight FROM k")
def b26(spark, d):
    x = strategy.select_top_n(ind.returns(panels.ptype_month(spark, d), 3, "r"), "r", 2)
    return rounded(strategy.weight_equal(x).select("instrument_id", "ts_utc", "selected", "weight"))


@register("b19_warmup_diagnostics", f"WITH {P}, c AS (SELECT instrument_id, count(*) AS available FROM bars GROUP BY 1), f(feature_id, stable_after) AS (VALUES ('sma_5', 5), ('ema_80', 81), ('returns_100', 101)) SELECT instrument_id, feature_id, stable_after::INT AS stable_after, available FROM c CROSS JOIN f WHERE available < stable_after")
def b19(spark, d):
    bars = stage(panels.ptype_month(spark, d), "bars")
    wanted = [features.sma(5), features.ema(80), features.renamed(features.returns(100), "returns_100")]
    short = features.warmup_diagnostics(bars.select("instrument_id"), bars, wanted)
    return short.select("instrument_id", "feature_id", "stable_after", F.col("available_bars").alias("available"))


@register("a17_quantiles", f"WITH {E} SELECT instrument_id, round(quantile_cont(close, 0.5), 6) AS p50, round(quantile_cont(close, 0.99), 6) AS p99 FROM bars GROUP BY 1")
def a17(spark, d):
    return rounded(panels.event_day(spark, d).groupBy("instrument_id").agg(F.percentile("close", 0.5).alias("p50"), F.percentile("close", 0.99).alias("p99")))


@register("rng_seeds", "WITH g AS (SELECT unnest(range(1, 50)) AS n), h AS (SELECT n, sha256('run-' || n) AS x FROM g) SELECT n, (" + " + ".join(f"('0x' || substr(x, {s}, 6))::BIGINT * {w}" for s, w in zip((1, 7, 13, 19, 25, 31), (1, 17, 257, 4099, 65537, 104729), strict=True)) + ") % 2147483647 + 1 AS seed FROM h")
def rng(spark, d):
    return spark.range(1, 50).select(F.col("id").alias("n"), seed_column(F.concat(F.lit("run-"), F.col("id").cast("string"))).alias("seed"))


# Sweeps ---------------------------------------------------------------------------------------

_GRID_SQL = "g(candidate_id, candidate_row, fast, slow) AS (VALUES " + ", ".join(f"('{c.label}', {i + 1}, {c.params['fast']}, {c.params['slow']})" for i, c in enumerate(GRID)) + ")"
_PICK = lambda p, ns: f"CASE {p} " + " ".join(f"WHEN {n} THEN CASE WHEN rn >= {n} THEN sma_{n} END" for n in ns) + " END"
_SWEEP_SQL = f"""{P}, {_GRID_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn, {', '.join(f'avg(close) {_over(n)} AS sma_{n}' for n in FAST + SLOW)} FROM bars),
tg AS (SELECT candidate_id, instrument_id, ts_utc, open, close, CASE WHEN {_PICK('fast', FAST)} / {_PICK('slow', SLOW)} - 1 > 0 THEN 10.0 ELSE 0.0 END AS target FROM n CROSS JOIN g), {run_sql('candidate_id, ')}"""


def grid_table(spark) -> DataFrame:
    return GRID.table(spark, {"fast": "int", "slow": "int"})


def sweep_of(spark, d) -> sweep.Sweep:
    return sweep.crossover(panels.ptype_month(spark, d), grid_table(spark), FAST, SLOW, COST, 10.0, ledger.Opening(CASH))


@register("g01_grid", "SELECT 'f' || fast || '_s' || slow AS candidate_id, row_number() OVER (ORDER BY fast, slow)::INT AS candidate_row, fast, slow FROM unnest([2, 3, 4]) a(fast) CROSS JOIN unnest([6, 8, 10]) b(slow)")
def g01(spark, d):
    return grid_table(spark)


@register("g01_param_grid", "SELECT row_number() OVER (ORDER BY slow, fast)::INT AS candidate_row, fast, slow FROM range(2, 8) a(fast) CROSS JOIN range(4, 8) b(slow) WHERE fast < slow AND greatest(fast, 3) <= 6")
def g01_param(spark, d):
    grid = grids.param_grid("fast < slow and pmax(fast, 3) <= 6", fast=list(range(2, 8)), slow=list(range(4, 8)))
    return grid.table(spark, {"fast": "long", "slow": "long"}).drop("candidate_id")


@register("g03_sweep_metrics", f"WITH {_SWEEP_SQL}, {metrics_sql('candidate_id, ')} SELECT * FROM me")
def g03(spark, d):
    return finished(sweep_of(spark, d).metrics(MONTHLY))


@register("g07_returns_long", f"WITH {_SWEEP_SQL} SELECT candidate_id, ts_utc, round(equity, 4) AS equity, round(period_return, 8) AS period_return FROM rt")
def g07(spark, d):
    return sweep_of(spark, d).returns().select("candidate_id", "ts_utc", F.round("equity", 4).alias("equity"), F.round("period_return", 8).alias("period_return"))


@register("g07_returns_wide", f"WITH {_SWEEP_SQL} SELECT ts_utc, " + ", ".join(f"round(max(period_return) FILTER (candidate_id = '{c.label}'), 8) AS {c.label}" for c in GRID) + " FROM rt GROUP BY 1")
def g07_wide(spark, d):
    return rounded(sweep.returns_wide(sweep_of(spark, d).returns(), [c.label for c in GRID]), 8)


@register("g08_panel_completeness", f"WITH {_SWEEP_SQL}, x AS (SELECT * FROM rt WHERE NOT (candidate_id = 'f2_s6' AND year(ts_utc) = 1997)) SELECT candidate_id, count(DISTINCT ts_utc) AS have, (SELECT count(DISTINCT ts_utc) FROM x) AS total FROM x GROUP BY 1 HAVING have <> total")
def g08(spark, d):
    return sweep.incomplete(sweep_of(spark, d).returns().where("not (candidate_id = 'f2_s6' and year(ts_utc) = 1997)"))


@register("g09_review_top5", f"WITH {_SWEEP_SQL}, {metrics_sql('candidate_id, ')}, r AS (SELECT me.candidate_id, candidate_row, sharpe, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, candidate_row)::INT AS rank FROM me JOIN g USING (candidate_id)) SELECT * FROM r WHERE rank <= 5")
def g09(spark, d):
    got = finished(sweep_of(spark, d).metrics(MONTHLY)).join(grid_table(spark).select("candidate_id", "candidate_row"), "candidate_id")
    return sweep.review(got, "sharpe").select("candidate_id", "candidate_row", "sharpe", "rank")


@register("a14_run_compare", f"WITH {_SWEEP_SQL}, {metrics_sql('candidate_id, ')} SELECT candidate_id, total_return, max_drawdown, n_trades, row_number() OVER (ORDER BY total_return DESC NULLS LAST, candidate_id)::INT AS rank FROM me")
def a14(spark, d):
    return metrics.compare_runs(finished(sweep_of(spark, d).metrics(MONTHLY)), rank_by="total_return").select("candidate_id", "total_return", "max_drawdown", "n_trades", "rank")


_SPLITS = "sp(case_id, block, is_in) AS (VALUES " + ", ".join(f"({c}, {b}, {str(i).lower()})" for c, b, i in validation.splits(4)) + ")"
_PBO = f"""{_SWEEP_SQL}, {_SPLITS},
x AS (SELECT candidate_id, period_return, row_number() OVER (PARTITION BY candidate_id ORDER BY ts_utc) AS rn, count(*) OVER (PARTITION BY candidate_id) AS n FROM rt WHERE period_return IS NOT NULL),
bl AS (SELECT candidate_id, (rn - 1) // (n // 4) + 1 AS block, sum(period_return) AS r, any_value(n) AS n FROM x GROUP BY 1, 2),
cs AS (SELECT case_id, candidate_id, round(sum(r) FILTER (is_in) / (any_value(n) / 2), 12) AS ins, round(sum(r) FILTER (NOT is_in) / (any_value(n) / 2), 12) AS oos FROM bl JOIN sp USING (block) GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ins DESC, candidate_id) AS w, rank() OVER (PARTITION BY case_id ORDER BY oos) + (count(*) OVER (PARTITION BY case_id, oos) - 1) / 2 AS rank_, count(*) OVER (PARTITION BY case_id) AS n FROM cs),
pc AS (SELECT case_id, candidate_id AS winner, rank_::DOUBLE AS oos_rank, rank_ / n AS omega, CASE WHEN rank_ < n THEN ln(rank_ / n / (1 - rank_ / n)) END AS logit FROM rk WHERE w = 1)"""


@register("v01_pbo_cases", f"WITH {_PBO} SELECT case_id, winner, oos_rank, round(omega, 6) AS omega, round(logit, 6) AS logit FROM pc")
def v01(spark, d):
    return rounded(validation.pbo_cases(sweep_of(spark, d).returns()))


@register("v01_pbo_summary", f"WITH {_PBO} SELECT round(avg(CASE WHEN logit <= 0 THEN 1.0 ELSE 0 END), 6) AS pbo, count(*) AS n_cases FROM pc")
def v01_summary(spark, d):
    return rounded(validation.pbo(sweep_of(spark, d).returns()))


_MOMENTS = f"""{_SWEEP_SQL}, x AS (SELECT candidate_id, period_return AS e, avg(period_return) OVER (PARTITION BY candidate_id) AS m FROM rt WHERE period_return IS NOT NULL),
mo AS (SELECT candidate_id, count(*) AS n, avg(e) / stddev_samp(e) AS sharpe, avg(pow(e - m, 3)) / pow(var_pop(e), 1.5) AS skew, avg(pow(e - m, 4)) / pow(var_pop(e), 2) AS kurtosis FROM x GROUP BY 1)"""
_Z95 = validation.NormalDist().inv_cdf(0.95)


@register(
    "v02_moments_mintrl",
    f"WITH {_MOMENTS}, t AS (SELECT *, CASE WHEN sharpe > 0 THEN 1 + (1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) * pow({_Z95!r} / sharpe, 2) END AS min_trl FROM mo) SELECT candidate_id, n, round(sharpe, 6) AS sharpe, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(min_trl, 4) AS min_trl, coalesce(n > min_trl, false) AS significant, CASE WHEN min_trl IS NULL THEN 0 ELSE ceil(greatest(min_trl - n, 0)) END::BIGINT AS extra FROM t",
)
def v02(spark, d):
    x = validation.min_track_record(sweep_of(spark, d).returns())
    return x.select("candidate_id", "n", F.round("sharpe", 6).alias("sharpe"), F.round("skew", 6).alias("skew"), F.round("kurtosis", 6).alias("kurtosis"), F.round("min_trl", 4).alias("min_trl"), "significant", F.coalesce("extra", F.lit(0)).alias("extra"))


@register("v03_corr_pairs", f"WITH {_SWEEP_SQL} SELECT a.candidate_id AS a, b.candidate_id AS b, round(corr(a.period_return, b.period_return), 6) AS r FROM rt a JOIN rt b USING (ts_utc) WHERE a.candidate_id < b.candidate_id GROUP BY 1, 2")
def v03(spark, d):
    return rounded(validation.correlations(sweep_of(spark, d).returns()))


@register("v03_clusters")
def v03_clusters(spark, d):
    return validation.clusters(sweep_of(spark, d).returns())


_N = 4.0
_BEST = (1 - validation.EULER) * validation.NormalDist().inv_cdf(1 - 1 / _N) + validation.EULER * validation.NormalDist().inv_cdf(1 - 1 / (_N * validation.math.e))


_ODD = "[" + ", ".join(f"{float(validation.math.prod(range(1, 2 * k + 2, 2)))!r}::DOUBLE" for k in range(90)) + "]"


@register(
    "v04_dsr",
    f"""WITH {_MOMENTS}, s AS (SELECT stddev_samp(sharpe) * {_BEST!r} AS sr0 FROM mo),
z AS (SELECT candidate_id, sr0, (sharpe - sr0) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) AS z, {_ODD} AS f FROM mo CROSS JOIN s)
SELECT candidate_id, round(sr0, 6) AS sr0, round(z, 6) AS dsr_z, round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([pow(z, 2 * k + 1) / f[k + 1] for k in range(90)]), 6) AS dsr, z >= {_Z95!r} AS significant FROM z""",
)
def v04(spark, d):
    return rounded(validation.deflated_sharpe(sweep_of(spark, d).returns(), _N).select("candidate_id", "sr0", "dsr_z", "dsr", "significant"))


# Walk-forward ---------------------------------------------------------------------------------


def _folds_sql(folds) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({f.fold_seq}, '{f.scheme}', TIMESTAMP '{f.train_start}', TIMESTAMP '{f.train_end}', TIMESTAMP '{f.test_start}', TIMESTAMP '{f.test_end}')" for f in folds) + ") t(fold_seq, scheme, train_start, train_end, test_start, test_end)"


_SERIES = """WITH s AS (SELECT k, TIMESTAMP '1995-03-01' + to_months((12 * k)::INT) AS b FROM range(20) t(k)),
f AS (SELECT (k + 1)::INT AS fold_seq, '{scheme}' AS scheme, {start} AS train_start, b + INTERVAL 24 MONTH - INTERVAL 1 SECOND AS train_end, b + INTERVAL 24 MONTH AS test_start, b + INTERVAL 36 MONTH - INTERVAL 1 SECOND AS test_end FROM s)
SELECT * FROM f WHERE test_end <= TIMESTAMP '2001-07-31'"""
register("v05_folds_rolling", _SERIES.format(scheme="rolling", start="b"))(lambda spark, d: walkforward.table(spark, FOLDS))
register("v05_folds_anchored", _SERIES.format(scheme="anchored", start="TIMESTAMP '1995-03-01'"))(lambda spark, d: walkforward.table(spark, FOLDS_ANCHORED))

_WF_BY = "fold_seq, window_, candidate_id, "
_WF = f"""{P}, {_GRID_SQL}, fo AS ({_folds_sql(FOLDS)}), wi AS (SELECT fold_seq, 'train' AS window_, train_start AS lo, train_end AS hi FROM fo UNION ALL SELECT fold_seq, 'test', test_start, test_end FROM fo),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn, {', '.join(f'avg(close) {_over(n)} AS sma_{n}' for n in FAST + SLOW)} FROM bars),
tg AS (SELECT fold_seq, window_, candidate_id, instrument_id, ts_utc, open, close, CASE WHEN {_PICK('fast', FAST)} / {_PICK('slow', SLOW)} - 1 > 0 THEN 10.0 ELSE 0.0 END AS target FROM n CROSS JOIN g JOIN wi ON ts_utc BETWEEN lo AND hi), {run_sql(_WF_BY)}, {metrics_sql(_WF_BY)}"""
_SEL = "se AS (SELECT fold_seq, candidate_id FROM me WHERE window_ = 'train' AND sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fold_seq ORDER BY sharpe DESC, candidate_id) = 1)"


def wf_scores(spark, d) -> DataFrame:
    lengths = FAST + SLOW
    x = sweep.with_features(panels.ptype_month(spark, d), {f"sma_{n}": (lambda df, o, n=n: ind.sma(df, n, o)) for n in lengths})

    def pick(p, ns):
        out = F.lit(None).cast("double")
        for n in ns:
            out = F.when(F.col(p) == n, F.col(f"sma_{n}")).otherwise(out)
        return out

    return finished(walkforward.scores(x, grid_table(spark), strategy.sma_crossover(pick("fast", FAST), pick("slow", SLOW), 10.0), COST, FOLDS, MONTHLY, ledger.Opening(CASH)))


@register("v06_walk_forward_scores", f"WITH {_WF} SELECT * RENAME (window_ AS \"window\") FROM me")
def v06(spark, d):
    return wf_scores(spark, d)


@register("v06_selected", f"WITH {_WF}, {_SEL} SELECT * FROM se")
def v06_selected(spark, d):
    return walkforward.select(wf_scores(spark, d), "sharpe")


@register("v07_degradation", f"WITH {_WF}, {_SEL}, j AS (SELECT se.fold_seq, se.candidate_id, max(sharpe) FILTER (window_ = 'train') AS train, max(sharpe) FILTER (window_ = 'test') AS test FROM me JOIN se USING (fold_seq, candidate_id) GROUP BY 1, 2) SELECT j.fold_seq, candidate_id, round(train, 6) AS train, round(test, 6) AS test, date_diff('day', test_start, test_end) < 90 AS short_test_window, round(test - train, 6) AS diff_abs, round((test - train) / nullif(abs(train), 0), 4) AS diff_pct FROM j JOIN fo USING (fold_seq)")
def v07(spark, d):
    s = wf_scores(spark, d)
    x = walkforward.degradation(s, walkforward.select(s, "sharpe"), FOLDS, "sharpe")
    return x.select("fold_seq", "candidate_id", F.round("train", 6).alias("train"), F.round("test", 6).alias("test"), "short_test_window", F.round("diff_abs", 6).alias("diff_abs"), F.round("diff_pct", 4).alias("diff_pct"))


@register("v07_long_scores", f"WITH {_WF} " + " UNION ALL ".join(f"SELECT fold_seq, window_ AS \"window\", candidate_id, '{m}' AS metric, {m}::DOUBLE AS value FROM me" for m in metrics.STANDARD))
def v07_long(spark, d):
    return walkforward.long_scores(wf_scores(spark, d))


# Stateful folds -------------------------------------------------------------------------------


def _rebalance(ctx, params):
    return fold.target_rebalance(fold.weight_equal(fold.select_top_n(fold.signal_return(ctx, "r"), params["n"])), ctx, 0.9)


def _alternate(ctx, params):
    k = (ctx.state_prev or 0) + 1
    return {"targets": {i: float(params["qty"] * (k % 2)) for i in ctx.universe}, "state_update": k}


def _grow(ctx, params):
    return {i: 100.0 + 1.0 * params["step"] for i in ctx.universe}


def _fold_out(df: DataFrame) -> DataFrame:
    return df.select("candidate_id", "status", "n_events", "ts_utc", *[F.round(c, 3).alias(c) for c in ("cash", "positions_value", "equity", "realized_pnl", "unrealized_pnl")])


@register("fold_rebalance")
def fold_rebalance(spark, d):
    grid = grids.grid_named(top1={"n": 1}, top3={"n": 3})
    return _fold_out(fold.fold_sweep(ind.returns(panels.ptype_month(spark, d), 3, "r"), grid, _rebalance, COST, risk.long_only(), ledger.Opening(CASH), ("r",)))


@register("fold_max_weight")
def fold_max_weight(spark, d):
    grid = grids.grid_named(small={"step": 1, "w": 0.05}, large={"step": 50, "w": 0.2})
    return _fold_out(fold.fold_sweep(panels.ptype_month(spark, d), grid, _grow, COST, risk.max_weight(risk.Param("w")), ledger.Opening(CASH)))


_EVEN_SQL = f"{E}, tg AS (SELECT *, CASE WHEN dense_rank() OVER (ORDER BY ts_utc) % 2 = 1 THEN 3.0 ELSE 0.0 END AS target FROM bars), {run_sql()}"


@register("fold_state_prev", f"WITH {_EVEN_SQL} SELECT 'c' AS candidate_id, 'DONE' AS status, (SELECT count(*) FROM ev) AS n_events, {_EQ.replace(", 4)", ", 3)")} FROM eq")
def fold_state_prev(spark, d):
    return _fold_out(fold.fold_sweep(panels.event_day(spark, d), grids.grid_named(c={"qty": 3}), _alternate, COST, risk.none(), ledger.Opening(CASH)))


@register("fold_failed_candidate", "SELECT * FROM (VALUES ('bad', 'FAILED'), ('good', 'DONE')) t(candidate_id, status)")
def fold_failed(spark, d):
    grid = grids.grid_named(good={"qty": 1}, bad={"other": 1})
    return fold.fold_sweep(panels.event_day(spark, d), grid, _alternate, COST, opening=ledger.Opening(CASH)).select("candidate_id", "status").distinct()


# Strategies that read equity, in SQL: one recursive step for each pulse -----------------------


def _walked_sql(bars: str, grid: str, own: str, goal: str, r: str = "0") -> str:
    """CTEs to ``tg``: bars, then positions and cash pulse by pulse; ``goal`` gives a target from
    ``close``, ``equity``, ``r`` (an expression over the bars) and ``own``, the columns of grid ``g``."""
    return f"""{bars}, {grid},
nb AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY ts_utc) AS t, lead(open) OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS nxt, {r} AS r FROM bars),
wk AS (
  SELECT candidate_id, {own}, instrument_id, 0::BIGINT AS t, 0.0::DOUBLE AS pos, {CASH}::DOUBLE AS cash, 0.0::DOUBLE AS target FROM (SELECT DISTINCT instrument_id FROM nb) CROSS JOIN g
  UNION ALL
  SELECT candidate_id, {own}, instrument_id, t, pos + delta, cash + coalesce(sum(CASE WHEN delta <> 0 THEN -delta * round(nxt * (1 + sign(delta) * 5 / 20000.0), 8) - 1 ELSE 0 END) OVER (PARTITION BY candidate_id), 0), target FROM (
    SELECT *, CASE WHEN nxt > 0 AND abs(target - pos) > 1.4901161193847656e-08 THEN target - pos ELSE 0 END AS delta FROM (
      SELECT *, ({goal})::DOUBLE AS target FROM (
        SELECT candidate_id, {own}, wk.instrument_id, nb.t, wk.pos, wk.cash, nb.close, nb.nxt, nb.r, wk.cash + sum(wk.pos * nb.close) OVER (PARTITION BY candidate_id) AS equity
        FROM wk JOIN nb ON nb.instrument_id = wk.instrument_id AND nb.t = wk.t + 1)))),
tg AS (SELECT candidate_id, nb.instrument_id, nb.ts_utc, open, close, target FROM wk JOIN nb USING (instrument_id, t))"""


#: A limit of weights isn't defined for negative equity: such a candidate fails and has one row.
_BROKEN = "bk AS (SELECT candidate_id FROM eq GROUP BY 1 HAVING min(equity) < 0)"
_WALKED_OUT = f"SELECT candidate_id, 'DONE' AS status, n_events, {_EQ.replace(', 4)', ', 3)')} FROM eq JOIN (SELECT candidate_id, count(*) AS n_events FROM ev GROUP BY 1) USING (candidate_id)"
SQL["fold_max_weight"] = (
    "WITH RECURSIVE "
    + _walked_sql(P, "g(candidate_id, step, w) AS (VALUES ('small', 1, 0.05), ('large', 50, 0.2))", "step, w", "least(100.0 + step, w * equity / close)")
    + f", {run_sql('candidate_id, ')}, {_BROKEN} {_WALKED_OUT} WHERE candidate_id NOT IN (FROM bk) UNION ALL SELECT candidate_id, 'FAILED', 0, NULL, NULL, NULL, NULL, NULL, NULL FROM bk"
)
_TOP = "row_number() OVER (PARTITION BY candidate_id ORDER BY r DESC NULLS LAST, instrument_id) <= top"
SQL["fold_rebalance"] = (
    "WITH RECURSIVE "
    + _walked_sql(
        P, "g(candidate_id, top) AS (VALUES ('top1', 1), ('top3', 3))", "top",
        f"CASE WHEN r IS NOT NULL AND {_TOP} THEN greatest(0, floor(1.0 / least(top, count(r) OVER (PARTITION BY candidate_id)) * 0.9 * equity / close)) ELSE 0 END",
        "close / lag(close, 3) OVER (PARTITION BY instrument_id ORDER BY ts_utc) - 1",
    )
    + f", {run_sql('candidate_id, ')} {_WALKED_OUT}"
)


# Features -------------------------------------------------------------------------------------

_MAP = {"fast": features.sma(3), "slow": features.sma(8), "change": features.returns(2)}


@register("b25_feature_contracts", "SELECT * FROM (VALUES ('fast', 'sma_3', 'builtin', 3, 3), ('slow', 'sma_8', 'builtin', 8, 8), ('change', 'return_2', 'builtin', 3, 3)) t(alias, feature_id, source, requires_bars, stable_after)")
def b25(spark, d):
    return features.contracts(spark, _MAP)


@register(
    "b25_contract_check",
    f"WITH {M}, i AS (SELECT DISTINCT instrument_id FROM bars UNION ALL SELECT 'NONE'), c AS (SELECT i.instrument_id, count(b.ts_utc) AS available_bars FROM i LEFT JOIN bars b USING (instrument_id) GROUP BY 1), f(alias, feature_id, source, requires_bars, stable_after) AS (VALUES ('fast', 'sma_3', 'builtin', 3, 3), ('long', 'sma_90', 'builtin', 90, 90)) SELECT alias, instrument_id, feature_id, source, requires_bars, stable_after, available_bars, available_bars >= stable_after AS warmup_achievable FROM c CROSS JOIN f",
)
def b25_check(spark, d):
    bars = stage(panels.priority_month(spark, d), "bars")
    ids = bars.select("instrument_id").distinct().unionByName(driver_table(spark, [("NONE",)], "instrument_id string"))
    return features.contract_check(ids, bars, {"fast": features.sma(3), "long": features.sma(90)})


_FEATURES_SQL = f"n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), x AS (SELECT *, {masked(3, f'avg(close) {_over(3)}', 'sma_3')}, {masked(8, f'avg(close) {_over(8)}', 'sma_8')}, close / lag(close, 2) OVER w - 1 AS return_2 FROM n {_W})"


@register(
    "p13_alias_feature_rows",
    f"WITH {E}, {_FEATURES_SQL}, l AS (SELECT ts_utc, instrument_id, unnest(['sma_3', 'sma_8', 'sma_8', 'return_2']) AS feature_id, unnest(['fast', 'slow', 'again', 'change']) AS alias, unnest([sma_3, sma_8, sma_8, return_2]) AS feature_value FROM x WHERE ts_utc = (SELECT min(ts_utc) + INTERVAL 9 DAY FROM x)) SELECT ts_utc, instrument_id, feature_id, round(feature_value, 6) AS feature_value, alias FROM l",
)
def p13(spark, d):
    """Features of one pulse under the names of a map, two of them for one feature."""
    x = features.compute(panels.event_day(spark, d), _MAP)
    first = panels.event_day(spark, d).agg(F.min("ts_utc").alias("t")).first().t
    pulse = features.pulse_snapshot(x, first + walkforward.timedelta(days=9))
    return rounded(features.feature_rows(pulse, ["sma_3", "sma_8", "return_2"], {"fast": "sma_3", "slow": "sma_8", "again": "sma_8", "change": "return_2"}))


@register("s12_csv_indicator", f"WITH {E} SELECT instrument_id, ts_utc, round(CASE WHEN day(ts_utc) % 2 = 0 THEN close * 2 END, 6) AS v FROM bars")
def s12(spark, d):
    """Values of every other day from a CSV that this query writes first."""
    bars = stage(panels.event_day(spark, d), "bars")
    path = f"{shared_dir(spark)}/csv-{walkforward.sha256(d)[:12]}"
    at = F.date_format("ts_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_utc")
    bars.where("day(ts_utc) % 2 = 0").select("instrument_id", at, (F.col("close") * 2).alias("doubled")).write.mode("overwrite").csv(path, header=True)
    v = features.from_csv(spark, path, "doubled", "v")
    return rounded(features.compute(bars, [v]).select("instrument_id", "ts_utc", "v"))


@register("a21_unique_features", "SELECT * FROM (VALUES ('return_1'), ('sma_2'), ('sma_3'), ('sma_4'), ('sma_6'), ('sma_8'), ('sma_10')) t(feature_id)")
def a21(spark, d):
    """The distinct features of all candidates of a grid, by fingerprint."""
    declared = {"fast": features.declare("sma", features.Param("fast")), "slow": features.declare("sma", features.Param("slow")), "change": features.returns(1)}
    todo = features.unique(i for c in GRID for i in features.materialise(declared, c.params).values())
    return driver_table(spark, [(i.id,) for i in todo], "feature_id string")


def declared_sweep(spark, d) -> sweep.Sweep:
    """The sweep of the catalogue with features that each candidate declares, computed once."""
    declared = {"fast": features.declare("sma", features.Param("fast")), "slow": features.declare("sma", features.Param("slow"))}
    pre = features.precompute(panels.ptype_month(spark, d), GRID, declared)
    return sweep.run(pre.panel, grid_table(spark), strategy.sma_crossover(pre.pick("fast"), pre.pick("slow"), 10.0), COST, ledger.Opening(CASH))


@register("b23_precomputed_sweep", f"WITH {_SWEEP_SQL}, {metrics_sql('candidate_id, ')} SELECT * FROM me")
def b23(spark, d):
    return finished(declared_sweep(spark, d).metrics(MONTHLY))


@register(
    "b23_warmup",
    f"WITH {P}, {_GRID_SQL}, f AS (SELECT candidate_id, unnest([fast, slow]) AS n FROM g), s AS (SELECT instrument_id, count(*) FILTER (ts_utc <= '1995-09-01') AS available_bars FROM bars GROUP BY 1) SELECT candidate_id, instrument_id, 'sma_' || n AS feature_id, n AS stable_after, available_bars, available_bars >= n AS warmup_achievable FROM f CROSS JOIN s",
)
def b23_warmup(spark, d):
    declared = {"fast": features.declare("sma", features.Param("fast")), "slow": features.declare("sma", features.Param("slow"))}
    return features.precompute(panels.ptype_month(spark, d), GRID, declared).warmup("1995-09-01")


def _range_by_rows(bars, params):
    return (bars["high"] - bars["low"]).rolling(params["n"]).max()


@register("udf_series_indicator", f"WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts_utc) AS rn FROM bars), x AS (SELECT *, {masked(4, f'max(high - low) {_over(4)}', 'widest')}, {masked(3, f'max(close) {_over(3)}', 'top')} FROM n) SELECT instrument_id, ts_utc, round(widest, 6) AS widest, round(top, 6) AS top FROM x")
def udf_series(spark, d):
    """A user's indicators: one by whole series, one by windows."""
    mine = [features.Indicator("widest", 4, params={"n": 4}, series_fn=_range_by_rows), features.Indicator("top", 3, fn=lambda window: window["close"].max())]
    return rounded(features.compute(panels.ptype_month(spark, d), mine).select("instrument_id", "ts_utc", "widest", "top"))


indicator(
    "t_atr_outputs", lambda b: features.compute(b, {"a": features.ttr("ATR", "tr", n=5, id="tr"), "b": features.ttr("ATR", "trueHigh", n=5, id="hi"), "c": features.ttr("ATR", "trueLow", n=5, id="lo")}), ["tr", "hi", "lo"],
    f"SELECT *, {masked(6, 'greatest(high, p) - least(low, p)', 'tr')}, {masked(6, 'greatest(high, p)', 'hi')}, {masked(6, 'least(low, p)', 'lo')} FROM (SELECT *, lag(close) OVER w AS p FROM n {_W})", places=8,
)
recursive(
    "t_macd_points", {"macd": ("macd", 3, 6, 4, False), "signal": ("macd_signal", 3, 6, 4, False)},
    _smooth_sql("f", "c", 3, "0.5", 3) + ", " + _smooth_sql("s", "c", 6, "(2.0 / 7)", 6) + ", m AS MATERIALIZED (SELECT instrument_id, rn, f.v - s.v AS v FROM f JOIN s USING (instrument_id, rn)), " + _smooth_sql("g", "m", 4, "0.4", 9),
    "SELECT n.*, m.v AS macd, g.v AS signal FROM n LEFT JOIN m USING (instrument_id, rn) LEFT JOIN g USING (instrument_id, rn)",
)


# Cadence, seals and stores --------------------------------------------------------------------


@register(
    "w06_cadences",
    "WITH s(step) AS (VALUES (60), (330), (900), (3600), (80000), (604800), (7200)), t AS (SELECT step, TIMESTAMP '2020-01-01' + to_seconds(step * k) AS ts FROM s CROSS JOIN range(5) r(k)), g AS (SELECT step, date_diff('second', lag(ts) OVER (PARTITION BY step ORDER BY ts), ts) AS gap FROM t), m AS (SELECT step, median(gap) AS median_gap FROM g GROUP BY 1), c(s, n) AS (VALUES (60, 525600), (300, 105120), (900, 35040), (3600, 8760), (86400, 252), (604800, 52)) SELECT step, median_gap, coalesce((SELECT n FROM c WHERE abs(median_gap / s - 1) <= 0.2 ORDER BY s LIMIT 1), 252) AS bars_per_year FROM m",
)
def w06_all(spark, d):
    """Every cadence of the table, one a tenth off, one out of all of them."""
    steps = driver_table(spark, [(s,) for s in (60, 330, 900, 3600, 80000, 604800, 7200)], "step int")
    x = spark.range(5).join(steps, how="cross").select("step", (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * F.col("step"))).alias("ts_utc"))
    return metrics.cadence(x, ("step",))


@register(
    "s07_seal_violations",
    f"""WITH {P}, b AS (SELECT instrument_id, CASE WHEN month(ts_utc) = 5 THEN ts_utc + INTERVAL 1 MILLISECOND ELSE ts_utc END AS ts_utc, open, CASE WHEN month(ts_utc) = 3 THEN low - 1 ELSE high END AS high, low, CASE WHEN month(ts_utc) = 7 THEN NULL ELSE close END AS close FROM bars
UNION ALL SELECT instrument_id, ts_utc, open, high, low, close FROM bars WHERE month(ts_utc) = 9)
SELECT 'duplicate' AS kind, (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY instrument_id, ts_utc HAVING count(*) > 1)) AS n
UNION ALL SELECT 'not_finite', count(*) FROM b WHERE close IS NULL UNION ALL SELECT 'ohlc', count(*) FROM b WHERE close IS NOT NULL AND (high < greatest(open, low, close) OR low > least(open, high, close))
UNION ALL SELECT 'sub_second', count(*) FROM b WHERE date_trunc('second', ts_utc) <> ts_utc""",
)
def s07_seal(spark, d):
    """What sealing counts, on bars that break each rule."""
    b = stage(panels.ptype_month(spark, d), "bars")
    m = F.month("ts_utc")
    bad = b.withColumns({"high": F.when(m == 3, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(m != 7, F.col("close")), "ts_utc": F.when(m == 5, F.col("ts_utc") + F.expr("interval 1 millisecond")).otherwise(F.col("ts_utc"))})
    got = snapshots.violations(bad.unionByName(b.where(m == 9)))
    return spark.createDataFrame(sorted(got.items()), "kind string, n long")


def _stored(spark, d) -> experiment.RunStore:
    """Two runs of the crossover, in a store of this call."""
    store = experiment.RunStore(spark, f"{shared_dir(spark)}/runs-{walkforward.sha256([d, walkforward.datetime.now().isoformat()])[:16]}")
    x = stage(crossover_panel(spark, d), "panel")
    for qty, name in ((10.0, "ten"), (20.0, "twenty")):
        store.run(experiment.Experiment(x, strategy.sma_crossover(F.col("fast"), F.col("slow"), qty), COST, opening=ledger.Opening(CASH)), run_id=name)
    store.tag("ten", "small", "first")
    return store


_LIST_SQL = lambda q, tags: f"(WITH {crossover_sql(qty=q)}, {run_sql()} SELECT '{tags[0]}' AS run_id, 'DONE' AS status, (SELECT count(*) FROM rt) AS n_pulses, (SELECT count(*) FROM ev) AS n_events, (SELECT count(*) FROM fl WHERE action = 'CLOSE') AS n_trades, (SELECT round(last(equity ORDER BY ts_utc), 4) FROM rt) AS final_equity, (SELECT round(min(drawdown), 6) FROM rt) AS max_drawdown, '{tags[1]}' AS tags_text)"


@register("a19_run_list", "SELECT * FROM " + _LIST_SQL(10.0, ("ten", "first, small")) + " UNION ALL SELECT * FROM " + _LIST_SQL(20.0, ("twenty", "")))
def a19(spark, d):
    """The list of a run store, with statistics and tags (J5, A19, A20)."""
    x = _stored(spark, d).list()
    return x.select("run_id", "status", "n_pulses", "n_events", "n_trades", F.round("final_equity", 4).alias("final_equity"), F.round("max_drawdown", 6).alias("max_drawdown"), "tags_text")


@register("a02_sweep_list", "SELECT 'nine' AS sweep_id, (SELECT count(*) FROM range(3) CROSS JOIN range(3)) + 2 AS n_candidates, (SELECT count(*) FROM range(3) CROSS JOIN range(3)) AS n_done, 2::BIGINT AS n_failed")
def a02(spark, d):
    store = experiment.RunStore(spark, f"{shared_dir(spark)}/sweeps-{walkforward.sha256([d, walkforward.datetime.now().isoformat()])[:16]}")
    failed = spark.createDataFrame([("x", "no"), ("y", "no")], "candidate_id string, error string")
    store.save_sweep(sweep_of(spark, d), "nine", MONTHLY, failed)
    return store.sweeps().select("sweep_id", "n_candidates", "n_done", "n_failed")


@register("g07_returns_panel", f"WITH {_SWEEP_SQL} SELECT candidate_id, ts_utc, round(period_return, 8) AS period_return FROM rt WHERE period_return IS NOT NULL")
def g07_panel(spark, d):
    return sweep.returns_panel(sweep_of(spark, d).returns()).select("candidate_id", "ts_utc", F.round("period_return", 8).alias("period_return"))


# Walk-forward with one tested candidate -------------------------------------------------------


def walked(spark, d, policy: str) -> walkforward.Session:
    """The walk-forward evaluation of the catalogue's grid."""
    x = sweep.with_features(panels.ptype_month(spark, d), {f"sma_{n}": (lambda df, o, n=n: ind.sma(df, n, o)) for n in FAST + SLOW})
    pick = lambda p, ns: F.coalesce(*[F.when(F.col(p) == n, F.col(f"sma_{n}")) for n in ns])
    target = strategy.sma_crossover(pick("fast", FAST), pick("slow", SLOW), 10.0)
    return walkforward.walk_forward(x, GRID, {"fast": "int", "slow": "int"}, target, COST, FOLDS, "sharpe", MONTHLY, ledger.Opening(CASH), policy=policy)


@register("v06_flat_tests", f"WITH {_WF}, {_SEL} SELECT me.* RENAME (window_ AS \"window\") FROM me JOIN se USING (fold_seq, candidate_id) WHERE window_ = 'test'")
def v06_flat(spark, d):
    """Scores of the test windows of what training selects, each from the opening state."""
    return finished(walked(spark, d, "flat_test_state").scores.where("window = 'test'"))


@register("v06_carried")
def v06_carried(spark, d):
    """The same with state carried from test window to test window."""
    return finished(walked(spark, d, "carry_test_state").scores.where("window = 'test'"))


@register(
    "sc_utc_column",
    "WITH t AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:30' WHEN 4 THEN strftime(ts, '%d.%m.%Y') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-0100' END AS said FROM events) SELECT event_id, said, CASE event_id % 6 WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP WHEN 3 THEN date_trunc('second', ts) - INTERVAL 150 MINUTE WHEN 5 THEN date_trunc('second', ts) + INTERVAL 60 MINUTE WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS at_utc FROM t",
)
def sc_utc(spark, d):
    """Times in every form that is read, and in one that isn't."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    k, iso = F.col("event_id") % 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).when(k == 3, F.concat(iso, F.lit("+02:30"))).when(k == 4, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.concat(iso, F.lit("-0100")))
    return e.select("event_id", said.alias("said")).withColumn("at_utc", utc_column(F.col("said")))


@register(
    "g02_grid_cross",
    "SELECT 1 AS candidate_row, NULL::BIGINT AS n, NULL::BIGINT AS w, 0.0::DOUBLE AS qty UNION ALL SELECT (1 + row_number() OVER (ORDER BY qty, w, n))::INT, n, w, qty FROM unnest([2, 3]) a(n) CROSS JOIN unnest([5, 7, 9]) b(w) CROSS JOIN (SELECT unnest([1.0, 2.5])::DOUBLE AS qty) WHERE n + w <> 9",
)
def g02(spark, d):
    """Features crossed with strategies, and a baseline before them."""
    grid = grids.grid_cross(grids.feature_grid("n + w != 9", n=[2, 3], w=[5, 7, 9]), grids.strategy_grid(qty=[1.0, 2.5]))
    return grids.add_baseline(grid, qty=0.0).table(spark, {"n": "long", "w": "long", "qty": "double"}).drop("candidate_id")


@register(
    "g05_candidate_seeds",
    "WITH g AS (SELECT 'f' || fast || '_s' || slow AS candidate_id, sha256('{\"master_seed\":7,\"salt\":{\"params\":\"{\\\"fast\\\":' || fast || ',\\\"slow\\\":' || slow || '}\",\"run_id\":\"sweep\"}}') AS x FROM unnest([2, 3, 4]) a(fast) CROSS JOIN unnest([6, 8, 10]) b(slow)) SELECT candidate_id, ("
    + " + ".join(f"('0x' || substr(x, {s}, 6))::BIGINT * {w}" for s, w in zip((1, 7, 13, 19, 25, 31), (1, 17, 257, 4099, 65537, 104729), strict=True))
    + ") % 2147483647 + 1 AS seed FROM g",
)
def g05(spark, d):
    """The seed of each candidate, from a master seed and what it runs."""
    return driver_table(spark, [(c.label, grids.candidate_seed(7, "sweep", c)) for c in GRID], "candidate_id string, seed long")


@register("p06_passed_warmup", f"WITH {E}, {_FEATURES_SQL} SELECT instrument_id, ts_utc FROM x WHERE sma_3 IS NOT NULL AND sma_8 IS NOT NULL AND return_2 IS NOT NULL")
def p06(spark, d):
    x = features.compute(panels.event_day(spark, d), _MAP)
    return x.where(strategy.passed_warmup("sma_3", "sma_8", "return_2")).select("instrument_id", "ts_utc")


@register("p05_opening_date", f"WITH {crossover_sql()}, {run_sql(opening=OPEN, start='1995-02-10')} SELECT {_EV} FROM ev")
def p05(spark, d):
    """Opening rows that stand on a date of their own."""
    opening = ledger.Opening(OPEN.cash, OPEN.positions, OPEN.cost_basis, "1995-02-10")
    return events_out(single(spark, d, opening=opening)[1])
