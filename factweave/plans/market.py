"""Queries over order-book features and results of replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market as M
from . import base
from .catalog import load, query
from .scalars import ERF_SQL, books

_T = "epoch_us(ts) / 1000000.0"
TICKS_SQL = f"""SELECT event_id, user_id AS path_id, CAST(floor({_T} / 604800) AS BIGINT) AS market_id, CAST({_T} AS DOUBLE) AS ts, value + 10 AS price, 70.0 AS target, k,
 CAST({_T} - (k % 4) * 0.6 AS DOUBLE) AS observed, CAST(CASE WHEN k % 19 = 0 THEN {_T} + 5 ELSE {_T} - 100 END AS DOUBLE) AS target_observed, k % 17 = 0 AS provisional, k * 2.0 AS seconds FROM (SELECT *, {base._K} AS k FROM events)"""
base.VIEWS["ticks"] = ((), TICKS_SQL)


def ticks(spark, folder):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    e = load(spark, folder, "events").withColumn("k", F.expr(base._K)).withColumn("ts", ts)
    return e.select(
        "event_id", F.col("user_id").alias("path_id"), F.floor(F.col("ts") / 604800).alias("market_id"), "ts", (F.col("value") + 10).alias("price"), F.lit(70.0).alias("target"), "k",
        (F.col("ts") - (F.col("k") % 4) * 0.6).alias("observed"), F.when(F.col("k") % 19 == 0, F.col("ts") + 5).otherwise(F.col("ts") - 100).alias("target_observed"),
        (F.col("k") % 17 == 0).alias("provisional"), (F.col("k") * 2.0).alias("seconds"),
    )


def tick_gaps(spark, folder):
    gap = M.reference_gap(F.col("ts"), F.col("observed"), F.col("target_observed"), F.col("provisional"), F.col("price"), F.col("target"))
    return ticks(spark, folder).withColumn("gap", gap)


_GAP = "CASE WHEN NOT provisional AND k % 4 < 3 AND k % 19 <> 0 THEN price - target END"
base.VIEWS["gaps"] = (("ticks",), f"SELECT *, {_GAP} AS gap FROM ticks")


def raw_book(spark, folder):
    """Books with broken levels: as nested arrays, in any order."""
    b = books(spark, folder)
    pairs = F.transform("levels", lambda v: F.array(v["price"], v["size"]))
    return b.select("l_orderkey", F.concat(pairs, F.array(F.array(F.lit(1.5), F.lit(3.0)), F.array(F.lit(0.4), F.lit(0.0)))).alias("raw"))


@query(
    "mkt_01_book_levels",
    base.oracle("levels", "SELECT l_orderkey, count(*) AS levels, CAST(min(price) AS DOUBLE) AS best_ask, CAST(max(price) AS DOUBLE) AS best_bid, CAST(sum(size) AS DOUBLE) AS depth FROM levels GROUP BY 1"),
)
def book_levels(spark, folder):
    asks, bids = M.levels("raw"), M.levels("raw", True)
    return raw_book(spark, folder).select(
        "l_orderkey", F.size(asks).cast("long").alias("levels"), asks[0]["price"].alias("best_ask"), bids[0]["price"].alias("best_bid"), F.aggregate(asks, F.lit(0.0), lambda a, v: a + v["size"]).alias("depth")
    )


_WALK = """SELECT l_orderkey, CASE WHEN sum(take) >= {n} - 1e-9 THEN floor(sum(take * price) * 1e6 + 0.5) / 1e6 END AS gross, CASE WHEN sum(take) >= {n} - 1e-9 THEN floor((sum(0.07 * take * price * (1 - price)) + 1e-12) * 1e5 + 0.5) / 1e5 + floor((sum(take * price) * 0.01 + 1e-12) * 1e5 + 0.5) / 1e5 END AS fees
 FROM (SELECT l_orderkey, CAST(price AS DOUBLE) AS price, CAST(greatest(0, least(size, {n} - (sum(size) OVER (PARTITION BY l_orderkey ORDER BY price) - size))) AS DOUBLE) AS take FROM levels) GROUP BY 1"""


@query("mkt_02_book_walk", base.oracle("levels", _WALK.format(n=60)))
def book_walk(spark, folder):
    q = M.walk(F.col("levels"), 60.0)
    return books(spark, folder).select("l_orderkey", F.round(q["gross"], 6).alias("gross"), q["fees"].alias("fees"))


@query(
    "mkt_03_size_to_cap",
    base.oracle("levels", """WITH l AS (SELECT l_orderkey, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY price) - size AS DOUBLE) AS before FROM levels),
    n AS (SELECT l.*, u.n FROM l, (SELECT unnest(range(1, 42)) AS n) u), f AS (SELECT l_orderkey, n, sum(greatest(0, least(size, n - before))) AS filled, sum(greatest(0, least(size, n - before)) * price) AS gross, sum(0.07 * greatest(0, least(size, n - before)) * price * (1 - price)) AS protocol FROM n GROUP BY 1, 2)
    SELECT l_orderkey, CAST(COALESCE(max(n) FILTER (filled >= n - 1e-9 AND gross + floor((protocol + 1e-12) * 1e5 + 0.5) / 1e5 + floor((gross * 0.01 + 1e-12) * 1e5 + 0.5) / 1e5 <= 19.99 + 1e-9), 0) AS DOUBLE) AS shares FROM f GROUP BY 1"""),
)
def size_to_cap(spark, folder):
    return books(spark, folder).select("l_orderkey", M.size_to_cap(F.col("levels"), F.lit(25.0), F.lit(20.0), F.lit(0.0)).alias("shares"))


@query(
    "mkt_03_target_size",
    base.oracle("levels", """WITH l AS (SELECT l_orderkey, CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY price) - size AS DOUBLE) AS before FROM levels),
    n AS (SELECT l.*, u.n FROM l, (SELECT unnest(range(1, 31)) AS n) u), f AS (SELECT l_orderkey, n, sum(greatest(0, least(size, n - before))) AS filled, sum(greatest(0, least(size, n - before)) * price) AS gross, sum(0.07 * greatest(0, least(size, n - before)) * price * (1 - price)) AS protocol FROM n GROUP BY 1, 2)
    SELECT l_orderkey, CAST(CASE WHEN max(filled) < 30 - 1e-9 THEN 0 ELSE COALESCE(max(n) FILTER (gross + floor((protocol + 1e-12) * 1e5 + 0.5) / 1e5 + floor((gross * 0.01 + 1e-12) * 1e5 + 0.5) / 1e5 <= 17 + 1e-9), 0) END AS DOUBLE) AS shares FROM f GROUP BY 1"""),
)
def target_size(spark, folder):
    return books(spark, folder).select("l_orderkey", M.target_size(F.col("levels"), 30.0, F.lit(25.0), F.lit(17.0), F.lit(0.0)).alias("shares"))


@query("mkt_04_reference_gap", base.oracle("gaps", "SELECT event_id, round(gap, 6) AS gap FROM gaps"))
def reference_gap(spark, folder):
    return tick_gaps(spark, folder).select("event_id", F.round("gap", 6).alias("gap"))


@query(
    "mkt_05_quote_gates",
    base.oracle("levels", """SELECT l_orderkey, round(a - b, 6) AS spread, round((a + b) / 2, 6) AS mid, a >= 0.52 - 1e-9 AND a <= 0.55 + 1e-9 AS in_band, a - b <= 0.03 + 1e-9 AS tight, (a + b) / 2 >= 0.5 - 1e-9 AS favourite
    FROM (SELECT l_orderkey, CAST(min(price) AS DOUBLE) AS a, CAST(max(price) - 0.08 AS DOUBLE) AS b FROM levels GROUP BY 1)"""),
)
def quote_gates(spark, folder):
    bids = F.transform(F.reverse("levels"), lambda v: F.struct((v["price"] - 0.08).alias("price"), v["size"].alias("size")))
    g = M.quote_gates(F.col("levels"), bids, 0.52, 0.55)
    return books(spark, folder).select("l_orderkey", F.round(g["spread"], 6).alias("spread"), F.round(g["mid"], 6).alias("mid"), g["in_band"].alias("in_band"), g["tight"].alias("tight"), g["favourite"].alias("favourite"))


@query(
    "mkt_06_roundtrip",
    base.oracle("levels", f"""SELECT l_orderkey, COALESCE(sell.gross - sell.fees - buy.gross - buy.fees >= -2.0 - 1e-9, false) AS ok FROM ({_WALK.format(n=20)}) buy JOIN ({_WALK.format(n=20).replace('ORDER BY price', 'ORDER BY price DESC')}) sell USING (l_orderkey)"""),
)
def roundtrip(spark, folder):
    return books(spark, folder).select("l_orderkey", M.roundtrip_ok(F.col("levels"), F.reverse("levels"), F.lit(20.0), 2.0).alias("ok"))


@query(
    "mkt_07_persistence",
    base.oracle("gaps", """SELECT event_id, count(*) OVER w >= 3 AND min(CASE WHEN gap >= 0 THEN 1 ELSE -1 END) OVER w = max(CASE WHEN gap >= 0 THEN 1 ELSE -1 END) OVER w AND min(abs(gap)) OVER w >= 5 - 1e-9 AS persistent
    FROM gaps WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY path_id, market_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""),
)
def persistence(spark, folder):
    return M.persistence(tick_gaps(spark, folder), 3, 5.0).select("event_id", "persistent")


@query(
    "mkt_08_realized_vol",
    base.oracle("ticks", """WITH t AS (SELECT event_id, 0 AS path_id, ts, price FROM ticks), p AS (SELECT a.event_id, a.ts AS now, b.ts, b.price, lag(b.ts) OVER w AS t0, lag(b.price) OVER w AS p0 FROM t a JOIN t b ON b.ts BETWEEN a.ts - 3600 AND a.ts WINDOW w AS (PARTITION BY a.event_id ORDER BY b.ts))
    SELECT event_id, round(CASE WHEN count(*) >= 8 AND count(t0) > 0 THEN least(3.0, greatest(0.25, sqrt(sum(power(ln(price / p0), 2) / (ts - t0)) / count(t0)) * sqrt(31536000.0))) END, 6) AS vol FROM p GROUP BY 1"""),
)
def realized_vol(spark, folder):
    # every event on one path: the hottest key there can be
    t = ticks(spark, folder).select("event_id", F.lit(0).alias("path_id"), "ts", "price")
    return M.realized_vol(t, 3600).select("event_id", F.round("vol", 6).alias("vol"))


_EDGE_D = "(ln(price / target) - 0.5 * s * s) / s / sqrt(2.0)"


@query(
    "mkt_09_edge_side",
    base.oracle("ticks", f"""SELECT event_id, CASE WHEN CASE WHEN p >= 0.5 THEN p - 0.55 ELSE 1 - p - 0.60 END >= 0.05 * CASE WHEN k % 5 = 0 THEN 1.6 ELSE 1 END - 1e-9 THEN CASE WHEN p >= 0.5 THEN 'YES' ELSE 'NO' END END AS side FROM
    (SELECT *, CASE WHEN seconds <= 0 THEN CASE WHEN price > target THEN 1.0 ELSE 0.0 END ELSE 0.5 * (1 + ({ERF_SQL.format(x='d')})) END AS p FROM (SELECT *, CASE WHEN seconds > 0 THEN {_EDGE_D} ELSE 0 END AS d FROM (SELECT *, 0.6 * sqrt(seconds / 31536000.0) AS s, 70.0 + (k - 50) / 400.0 AS price FROM (SELECT * EXCLUDE (price) FROM ticks))))"""),
)
def edge_side(spark, folder):
    book = lambda p: F.array(F.struct(F.lit(p).alias("price"), F.lit(10.0).alias("size")))
    side = M.edge_side(70.0 + (F.col("k") - 50) / 400.0, F.col("target"), F.col("seconds"), F.lit(0.6), book(0.55), book(0.5), book(0.6), book(0.5), min_edge=0.05, defensive=F.col("k") % 5 == 0)
    return ticks(spark, folder).select("event_id", side.alias("side"))


@query(
    "mkt_10_aggression",
    base.oracle("ticks", """SELECT event_id, round(CASE WHEN e < 0.02 THEN 1.0 WHEN v / e >= 1 THEN greatest(0.7, 1.2 - 0.5 * (v / e - 1)) ELSE least(1.5, 1 + 0.8 * (1 - v / e)) END, 9) AS push FROM (SELECT event_id, least(1.0, k / 80.0) AS e, price / 200.0 AS v FROM ticks)"""),
)
def aggression(spark, folder):
    return ticks(spark, folder).select("event_id", F.round(M.aggression(F.col("k") / 80.0, F.col("price") / 200.0), 9).alias("push"))


@query(
    "mkt_11_exit_signal",
    base.oracle("ticks", """SELECT event_id, CASE WHEN k % 13 = 0 THEN NULL WHEN seconds <= 40 THEN 'forced' WHEN 10 * b - f - paid >= 0.2 - 1e-9 THEN 'profit' WHEN (k % 2 = 0 AND price - target < -1e-9) OR (k % 2 = 1 AND price - target > 1e-9) THEN 'flip' WHEN 10 * b - f - paid <= -0.8 + 1e-9 THEN 'stop' END AS reason
    FROM (SELECT *, floor((0.07 * 10 * b * (1 - b) + 1e-12) * 1e5 + 0.5) / 1e5 + floor((10 * b * 0.01 + 1e-12) * 1e5 + 0.5) / 1e5 AS f FROM (SELECT *, 0.5 + (k % 30) / 100.0 AS b, 6.0 + (k % 7) / 10.0 AS paid FROM ticks))"""),
)
def exit_signal(spark, folder):
    k = F.col("k")
    bids = F.array(F.struct((0.5 + (k % 30) / 100.0).alias("price"), F.when(k % 13 == 0, 1.0).otherwise(50.0).alias("size")))
    reason = M.exit_signal(F.when(k % 2 == 0, "YES").otherwise("NO"), F.lit(10.0), 6.0 + (k % 7) / 10.0, bids, F.col("seconds"), F.col("price") - F.col("target"))
    return ticks(spark, folder).select("event_id", reason.alias("reason"))


@query(
    "agg_22_path_summary",
    f"""SELECT CAST({base._K} % 10 AS INTEGER) AS config_id, count(*) AS n, max(value) AS max_volume, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS flat_rate, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) AS qual_rate,
    count(*) FILTER (event_type = 'view') AS quals, median(value) AS median_volume, median(value / 4) AS median_cash FROM events GROUP BY 1""",
)
def path_summary(spark, folder):
    r = load(spark, folder, "events").select(
        (F.expr(base._K) % 10).alias("config_id"), F.col("value").alias("eligible_volume_usd"), (F.col("value") / 4).alias("final_cash_usd"),
        (F.col("event_type") != "error").alias("terminal_flat"), (F.col("event_type") == "view").alias("reached_target"),
    )
    return M.path_summary(r)


@query(
    "mkt_14_drawdown",
    base.oracle("ticks", "SELECT path_id, max(peak) AS peak, round(max(peak - price), 9) AS max_drawdown FROM (SELECT path_id, price, max(price) OVER (PARTITION BY path_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM ticks) GROUP BY 1"),
)
def drawdown(spark, folder):
    out = M.drawdown(ticks(spark, folder).withColumnRenamed("price", "cash"), F.floor(F.col("ts") / 86400))
    return out.select("path_id", "peak", F.round("max_drawdown", 9).alias("max_drawdown"))


@query(
    "mkt_15_cycles",
    base.oracle("ticks", "SELECT path_id, market_id, count(*) FILTER (was AND k % 3 <> 0) AS cycles FROM (SELECT *, COALESCE(lag(k % 3 = 0) OVER (PARTITION BY path_id, market_id ORDER BY ts), false) AS was FROM ticks) GROUP BY 1, 2"),
)
def cycles(spark, folder):
    return M.cycles(ticks(spark, folder).withColumn("open", F.col("k") % 3 == 0))


@query(
    "mkt_16_position_reader",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'YES' WHEN 3 THEN 'NO' END AS side, CASE event_id % 5 WHEN 0 THEN 5.0 WHEN 1 THEN value WHEN 2 THEN 2.5 END AS shares, CASE event_id % 5 WHEN 0 THEN 3.1 WHEN 1 THEN value + 0.25 END AS paid
    FROM (SELECT event_id, value + 1 AS value FROM events)""",
)
def position_reader(spark, folder):
    v = (F.col("value") + 1).cast("string")
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, '{"outcome":"yes","shares":"5","costUsd":3.1}').when(k == 1, F.concat(F.lit('{"direction":"BUY NO","quantity":'), v, F.lit(',"buy_gross_usd":'), v, F.lit(',"fees_usd":0.25}')))
        .when(k == 2, '{"side":"token-YES-1","size":0,"qty":2.5}').when(k == 3, '{"x":"no","shares":"many"}').otherwise('{"foo":1}')
    )
    p = M.position("raw")
    return load(spark, folder, "events").select("event_id", raw.alias("raw")).select("event_id", p["side"].alias("side"), p["shares"].alias("shares"), p["paid"].alias("paid"))
