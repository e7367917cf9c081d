"""Order-book features: books, fees, gates, persistence, volatility, exits.

Books are arrays of price levels inside a tick's row and are walked there. What looks back in time is
cut into markets or time blocks first, so a busy path is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as K
from ..functions.numeric import fair_prob, half_up
from ..functions.text import as_col, let
from .blocks import running_max, with_lookback
from .percentiles import medians
from .rows import unfold

EPS = 1e-9


# ---- books -----------------------------------------------------------------------------

def levels(rows: Column | str, descending: bool = False) -> Column:
    """Valid levels of ``array<array<double>>`` as sorted ``array<struct<price, size>>``."""
    pairs = F.transform(as_col(rows), lambda r: F.struct(F.get(r, F.lit(0)).cast("double").alias("price"), F.get(r, F.lit(1)).cast("double").alias("size")))
    good = F.array_sort(F.filter(F.coalesce(pairs, F.array().cast("array<struct<price:double,size:double>>")), lambda v: (v["price"] > 0) & (v["price"] < 1) & (v["size"] > 0)))
    return F.reverse(good) if descending else good


def walk(book: Column, shares: Column | float) -> Column:
    """``struct(gross, fees)`` of filling ``shares`` level by level; NULL if the book is too thin."""
    start = F.struct(F.lit(shares).cast("double").alias("left") if not isinstance(shares, Column) else shares.cast("double").alias("left"), F.lit(0.0).alias("gross"), F.lit(0.0).alias("protocol"))

    def fill(acc: Column, level: Column) -> Column:
        take = F.when(acc["left"] > EPS, F.least(acc["left"], level["size"])).otherwise(0.0)
        return F.struct(
            (acc["left"] - take).alias("left"), (acc["gross"] + level["price"] * take).alias("gross"),
            (acc["protocol"] + K.PROTOCOL_FEE * take * level["price"] * (1 - level["price"])).alias("protocol"),
        )

    def done(acc: Column) -> Column:
        fees = half_up(acc["protocol"] + 1e-12, 5) + half_up(acc["gross"] * K.OVERLAY_FEE + 1e-12, 5)
        return F.when(acc["left"] <= EPS, F.struct(acc["gross"].alias("gross"), fees.alias("fees")))

    return F.aggregate(book, start, fill, done)


def _fits(book: Column, shares: Column, ceiling: Column) -> Column:
    return let(walk(book, shares), lambda q: F.coalesce(q["gross"] + q["fees"] <= ceiling + EPS, F.lit(False)))


def _largest_fit(book: Column, low: Column, high: Column, ceiling: Column) -> Column:
    """Largest whole n in [low, high] whose fill fits the ceiling, NULL if none does.

    Cost grows with n and an unfillable n stays so, so halving finds it in a few walks.
    """
    span = F.struct((low - 1).cast("int").alias("good"), (high + 1).cast("int").alias("bad"))
    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(high - low + 2, F.lit(2)))).cast("int"), F.lit(1)))

    def halve(acc: Column, _: Column) -> Column:
        def pick(mid: Column) -> Column:
            inside = (mid > acc["good"]) & (mid < acc["bad"])
            fits = F.when(inside, _fits(book, mid, ceiling))
            return F.struct(F.when(fits, mid).otherwise(acc["good"]).alias("good"), F.when(inside & ~fits, mid).otherwise(acc["bad"]).alias("bad"))

        return let(F.floor((acc["good"] + acc["bad"]) / 2).cast("int"), pick)

    return F.when(low <= high, F.aggregate(rounds, span, halve, lambda acc: F.when(acc["good"] >= low, acc["good"])))


def size_to_cap(book: Column, cash: Column, max_cash: Column, min_order: Column, buffer: float = 0.01) -> Column:
    """Largest whole number of shares whose cost and fees fit the cap; below the minimum order, none."""
    ceiling = F.least(cash, max_cash) - max(0.0, buffer)
    best = F.get(book, F.lit(0))["price"]
    usable = (F.size(book) > 0) & (ceiling > 0)
    found = _largest_fit(book, F.lit(1), F.when(usable, F.floor(ceiling / best).cast("int") + 1), ceiling)
    return let(found, lambda n: F.when(n.isNotNull() & ((min_order <= 0) | (n >= min_order)), n.cast("double")).otherwise(0.0))


def target_size(book: Column, target: float, cash: Column, max_cash: Column, min_order: Column) -> Column:
    """The target, or the largest whole number below it that fits; none if the book cannot fill the target."""
    ceiling = F.least(cash, max_cash)
    wanted = F.greatest(F.lit(float(target)), min_order)
    lowest = F.ceil(F.greatest(min_order, F.lit(1.0))).cast("int")
    shrunk = _largest_fit(book, lowest, F.floor(wanted).cast("int"), ceiling)
    return F.when(walk(book, wanted).isNull(), 0.0).when(_fits(book, wanted, ceiling), wanted).otherwise(F.coalesce(shrunk.cast("double"), F.lit(0.0)))


# ---- tick gates ------------------------------------------------------------------------

def reference_gap(now: Column, observed: Column, target_observed: Column, provisional: Column, price: Column, target: Column, max_age: float = 1.5) -> Column:
    """Price less target of a final, fresh and not future-stamped reference, else NULL."""
    ok = ~F.coalesce(provisional, F.lit(True)) & (now - observed <= max_age) & (target_observed <= now + EPS)
    return F.when(ok, price - target)


def quote_gates(asks: Column, bids: Column, min_price: float = 0.52, max_price: float = 0.97, max_spread: float = 0.03) -> Column:
    """Spread, mid and the three quote gates of one side's book."""
    ask, bid = F.get(asks, F.lit(0))["price"], F.get(bids, F.lit(0))["price"]
    mid = F.when(bid.isNull(), ask).otherwise((ask + bid) / 2)
    return F.struct(
        ask.alias("ask"), bid.alias("bid"), (ask - bid).alias("spread"), mid.alias("mid"),
        F.coalesce((ask >= min_price - EPS) & (ask <= max_price + EPS), F.lit(False)).alias("in_band"),
        F.coalesce(bid.isNull() | (ask - bid <= max_spread + EPS), F.lit(False)).alias("tight"),
        F.coalesce(mid >= 0.5 - EPS, F.lit(False)).alias("favourite"),
    )


def roundtrip_ok(asks: Column, bids: Column, shares: Column, max_loss: float = 0.35, need_exit: bool = True) -> Column:
    """Can the size be bought, and sold at once without losing more than ``max_loss``?"""
    both = F.struct(walk(asks, shares).alias("buy"), walk(bids, shares).alias("sell"))

    def judge(q: Column) -> Column:
        pnl = q["sell"]["gross"] - q["sell"]["fees"] - q["buy"]["gross"] - q["buy"]["fees"]
        no_exit = F.lit(not need_exit)
        return q["buy"].isNotNull() & F.when(q["sell"].isNull(), no_exit).otherwise(pnl >= -max_loss - EPS)

    return let(both, judge)


def persistence(ticks: DataFrame, n: int, min_gap: float, keys: Sequence[str] = ("path_id", "market_id")) -> DataFrame:
    """Adds ``persistent``: the last ``n`` valid gaps of the market share the sign of this one and are large enough.

    A market is short, and its history starts anew with it, so the window is over a market's ticks.
    """
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(-(n - 1), 0)
    gap = F.col("gap")
    signed = F.when(gap >= 0, gap).otherwise(-gap)
    same = (F.min(F.when(gap >= 0, 1).otherwise(-1)).over(w) == F.max(F.when(gap >= 0, 1).otherwise(-1)).over(w))
    return ticks.where(gap.isNotNull()).withColumn(
        "persistent", (F.count("*").over(w) >= n) & same & (F.min(signed).over(w) >= min_gap - EPS)
    )


def realized_vol(ticks: DataFrame, seconds: int = K.VOL_WINDOW_SECONDS, min_samples: int = K.VOL_MIN_SAMPLES, key: str = "path_id") -> DataFrame:
    """Adds ``vol``: annualised volatility of ``price`` over the trailing window, NULL with too few samples.

    Only pairs of neighbours that both lie in the window count. Paths are cut into blocks of the
    window's length, each with the block before it as context; within a block the work grows with its
    rows, however many fall into one window.
    """
    cut = with_lookback(ticks, [key], F.col("ts"), seconds)
    block = Window.partitionBy(key, "__block").orderBy("ts")
    dt = F.col("ts") - F.lag("ts").over(block)
    before = F.lag("price").over(block)
    squared = F.when((dt > 0) & (before > 0), F.pow(F.ln(F.col("price") / before), 2) / dt)
    cut = cut.withColumn("ts", F.col("ts").cast("double")).withColumns({"__r": squared, "__from": F.when(~F.lag("__home").over(block), F.lag("ts").over(block))})
    # What the window holds changes when a row enters and when a context row or a pair begun by one leaves, so running
    # sums tell it in one pass. Decimals add up exactly; a term beyond them lies far above the cap.
    huge = F.isnan("__r") | (F.abs("__r") >= 1e9)
    term = F.when(huge, 0.0).otherwise(F.coalesce("__r", F.lit(0.0))).cast("decimal(38,20)")

    def change(at: Column, leaves: int, row: int, pair: int) -> Column:
        there = F.col("__r").isNotNull()
        return F.struct(
            at.alias("at"), F.lit(leaves).alias("leaves"), F.lit(row).alias("row"), F.when(there, pair).otherwise(0).alias("pair"),
            F.when(there & huge, pair).otherwise(0).alias("huge"), (term if pair > 0 else -term if pair else F.lit(0).cast("decimal(38,20)")).alias("term"),
        )

    changes = F.array(
        change(F.col("ts"), 0, 1, 1), F.when(~F.col("__home"), change(F.col("ts") + seconds, 1, -1, 0)),
        F.when(F.col("__r").isNotNull() & F.col("__from").isNotNull(), change(F.col("__from") + seconds, 1, 0, -1)),
    )
    moves = unfold(cut, [*ticks.columns, "__block", "__home"], changes, "__c")
    so_far = Window.partitionBy(key, "__block").orderBy("__c.at", "__c.leaves").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = {f"__{name}": F.sum(f"__c.{name}").over(so_far) for name in ("row", "pair", "huge", "term")}
    # all windows run before the other rows are dropped
    out = moves.withColumns(held).where("__home AND __c.leaves = 0")
    total = F.when(F.col("__huge") > 0, float("inf")).otherwise(F.col("__term").cast("double"))
    sigma = F.sqrt(F.greatest(total, F.lit(0.0)) / F.col("__pair")) * (float(K.SECONDS_PER_YEAR) ** 0.5)
    vol = F.when((F.col("__row") >= min_samples) & (F.col("__pair") > 0), F.least(F.greatest(sigma, F.lit(K.VOL_FLOOR)), F.lit(K.VOL_CAP)))
    return out.withColumn("vol", vol).select(*ticks.columns, "vol")


def edge_side(price: Column, target: Column, seconds: Column, vol: Column, yes_asks: Column, yes_bids: Column, no_asks: Column, no_bids: Column,
              min_edge: float = 0.0, cost_aware: bool = False, margin: float = 0.0, defensive: Column | bool = False, multiplier: float = 1.6) -> Column:
    """Side whose ask lies below its fair value by the required edge, else NULL."""
    defensive = F.lit(defensive) if isinstance(defensive, bool) else defensive

    def side(p: Column) -> Column:
        yes = p >= 0.5
        asks, bids = F.when(yes, yes_asks).otherwise(no_asks), F.when(yes, yes_bids).otherwise(no_bids)
        ask = F.get(asks, F.lit(0))["price"]
        bid = F.coalesce(F.get(bids, F.lit(0))["price"], ask)
        fee = lambda q: q * (K.OVERLAY_FEE + K.PROTOCOL_FEE * (1 - q))
        required = (ask - bid) + fee(ask) + fee(bid) + margin if cost_aware else F.lit(float(min_edge))
        required = required * F.when(defensive, multiplier).otherwise(1.0)
        favoured = F.when(yes, p).otherwise(1 - p)
        return F.when(favoured - ask >= required - EPS, F.when(yes, "YES").otherwise("NO"))

    return let(fair_prob(price, target, seconds, vol), side)


def aggression(elapsed_fraction: Column, volume_fraction: Column, low: float = 0.7, high: float = 1.5) -> Column:
    """Pace multiplier: one early on, below one ahead of pace, above one behind it."""
    e = F.least(F.greatest(elapsed_fraction, F.lit(0.0)), F.lit(1.0))
    pace = volume_fraction / F.nullif(e, F.lit(0.0))
    ahead = F.greatest(F.lit(low), 1.2 - 0.5 * (pace - 1.0))
    behind = F.least(F.lit(high), 1.0 + 0.8 * (1.0 - pace))
    return F.when(e < 0.02, 1.0).when(pace >= 1.0, ahead).otherwise(behind)


def exit_signal(side: Column, shares: Column, paid: Column, bids: Column, seconds: Column, gap: Column,
                forced: float = 40.0, profit: float = 0.2, per_share: float = 0.0, stop: float = 0.08) -> Column:
    """Why an open position is sold now: forced, profit, flip or stop; NULL to hold."""

    def decide(q: Column) -> Column:
        pnl = q["gross"] - q["fees"] - paid
        goal = F.greatest(F.lit(per_share) * shares, F.lit(profit)) if profit > 0 else F.lit(per_share) * shares
        flipped = ((side == "YES") & (gap < -EPS)) | ((side == "NO") & (gap > EPS))
        return (
            F.when(q.isNull(), F.lit(None).cast("string")).when(seconds <= forced + EPS, "forced").when(pnl >= goal - EPS, "profit")
            .when(flipped, "flip").when(pnl <= -stop * shares + EPS, "stop")
        )

    return F.when(side.isNotNull() & (shares > 0), let(walk(bids, shares), decide))


# fixed values: names under which a position states its parts
SIDE_KEYS = ("outcome", "side", "direction", "result", "asset", "token", "instrument")
SHARE_KEYS = ("shares", "size", "quantity", "qty", "amount", "positionShares", "position_shares", "positionSize", "sharesHeld")
COST_KEYS = ("buy_gross_usd", "cost_usd", "costUsd", "entry_cost_usd", "entryCostUsd", "cost_basis_usd", "notional_usd")
FEE_KEYS = ("buy_fees_usd", "fees_usd", "feesUsd", "entry_fees_usd")


def position(raw: Column | str) -> Column:
    """Side, shares and paid cost of a position given as JSON under any of its known names."""
    get = lambda k: F.get_json_object(as_col(raw), f"$.{k}")

    def as_side(v: Column) -> Column:
        up = F.upper(v)
        no = (up == "NO") | up.endswith("NO") | F.array_contains(F.split(up, r"\s+"), "NO")
        return F.when(up.contains("YES"), "YES").when(no, "NO")

    scanned = F.map_values(F.from_json(as_col(raw), "MAP<STRING, STRING>"))
    exact = F.get(F.filter(F.transform(scanned, lambda v: F.upper(v)), lambda v: v.isin("YES", "NO")), F.lit(0))
    side = F.coalesce(*[as_side(get(k)) for k in SIDE_KEYS], exact)
    number = lambda k: get(k).try_cast("double")
    shares = F.coalesce(*[F.when(number(k) > 0, number(k)) for k in SHARE_KEYS])
    fee_text = F.coalesce(*[get(k) for k in FEE_KEYS])
    gross = F.coalesce(*[number(k) for k in COST_KEYS])
    paid = gross + F.coalesce(fee_text.try_cast("double"), F.lit(0.0))
    return F.struct(side.alias("side"), shares.alias("shares"), paid.alias("paid"))


# ---- equity and cycles -----------------------------------------------------------------

def drawdown(equity: DataFrame, block: Column, key: str = "path_id", order: Sequence[str] = ("ts",), value: str = "cash") -> DataFrame:
    """Peak and greatest fall below it, per path. ``block`` is a prefix of the order, such as the day."""
    peaked = running_max(equity, [key], block, order, value, "peak")
    return peaked.groupBy(key).agg(F.max("peak").alias("peak"), F.max(F.col("peak") - F.col(value)).alias("max_drawdown"))


def cycles(positions: DataFrame, keys: Sequence[str] = ("path_id", "market_id")) -> DataFrame:
    """Closed positions per market: changes from open to flat between its ticks."""
    w = Window.partitionBy(*keys).orderBy("ts")
    closed = ~F.col("open") & F.coalesce(F.lag("open").over(w), F.lit(False))
    return positions.withColumn("__closed", closed).groupBy(*keys).agg(F.count_if("__closed").alias("cycles"))


# ---- results of replays -----------------------------------------------------------------

def path_summary(results: DataFrame) -> DataFrame:
    """Per configuration over its paths: median and greatest volume, median cash, shares flat and qualifying."""
    qualifies = F.col("reached_target") & F.col("terminal_flat")
    flat = results.groupBy("config_id").agg(
        F.count("*").alias("n"), F.max("eligible_volume_usd").alias("max_volume"), F.avg(F.col("terminal_flat").cast("double")).alias("flat_rate"),
        F.avg(qualifies.cast("double")).alias("qual_rate"), F.count_if(qualifies).alias("quals"),
    )
    middle = medians(results, ["eligible_volume_usd", "final_cash_usd"], ["config_id"])
    return flat.join(middle, "config_id").withColumnsRenamed({"median_eligible_volume_usd": "median_volume", "median_final_cash_usd": "median_cash"})


def rank_configs(summary: DataFrame, k: int = 1) -> DataFrame:
    """Best configurations: qualifying paths, flat rate, median cash, median volume; earlier trials win ties."""
    order = [F.col(c).desc() for c in ("quals", "flat_rate", "median_cash", "median_volume")]
    return summary.orderBy(*order, "config_id").limit(k)
