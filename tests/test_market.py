import math
import time

import pytest
from pyspark.sql import functions as F

from factweave.operators import market as M


def test_sizing(spark):
    book = F.array(F.struct(F.lit(0.5).alias("price"), F.lit(4.0).alias("size")), F.struct(F.lit(0.6).alias("price"), F.lit(100.0).alias("size")))
    got = spark.range(1).select(
        M.size_to_cap(book, F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("cap"), M.size_to_cap(book, F.lit(10.0), F.lit(5.0), F.lit(50.0)).alias("min"),
        M.target_size(book, 5.0, F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("fits"), M.target_size(book, 20.0, F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("shrunk"),
        M.target_size(book, 200.0, F.lit(10.0), F.lit(5.0), F.lit(0.0)).alias("thin"),
    ).first()

    def cost(n):
        lv = [(0.5, min(4, n)), (0.6, max(0, n - 4))]
        return sum(p * q for p, q in lv) + round(sum(0.07 * q * p * (1 - p) for p, q in lv) + 1e-12, 5) + round(sum(p * q for p, q in lv) * 0.01 + 1e-12, 5)

    best = lambda c: max(n for n in range(1, 20) if cost(n) <= c + 1e-9)
    assert got.cap == best(4.99) and got.min == 0 and got.fits == 5 and got.shrunk == best(5.0) and got.thin == 0


def test_volatility_block_edges(spark):
    """Blocks with a look-back give what a plain scan over the window gives."""
    rows = [(0, i * 37.0, 100 + 5 * math.sin(i)) for i in range(300)]
    got = {r.ts: r.vol for r in M.realized_vol(spark.createDataFrame(rows, "path_id int, ts double, price double"), 600).collect()}
    for _, now, _ in rows:
        seen = [(t, p) for _, t, p in rows if now - 600 <= t <= now]
        rates = [math.log(b[1] / a[1]) ** 2 / (b[0] - a[0]) for a, b in zip(seen, seen[1:])]
        want = None if len(seen) < 8 else min(max(math.sqrt(sum(rates) / len(rates) * 365 * 24 * 3600), 0.25), 3.0)
        assert got[now] == (None if want is None else pytest.approx(want))


def test_volatility_of_equal_and_dense_times(spark):
    """Equal times are one step, missing or worthless prices and times give no term, and the work follows the rows."""
    rows = [(0, float(i // 3), 100.0 + i // 3 % 5, i) for i in range(90)] + [(0, 40.0, None, 90), (0, 41.0, 0.0, 91), (0, None, 1.0, 92), (0, 50.0, 1e-300, 93), (0, 51.0, 1e300, 94)]
    schema = "path_id int, ts double, price double, id int"
    got = {r.id: r.vol for r in M.realized_vol(spark.createDataFrame(rows, schema), 10).collect()}
    assert len(got) == len(rows) and got[92] is None and got[94] is None
    for i in range(90):
        now = rows[i][1]
        steps = [(t, 100.0 + t % 5) for t in range(30) if now - 10 <= t <= now]
        rates = [math.log(b[1] / a[1]) ** 2 for a, b in zip(steps, steps[1:])]
        want = None if 3 * len(steps) < 8 or not rates else min(max(math.sqrt(sum(rates) / len(rates) * 365 * 24 * 3600), 0.25), 3.0)
        assert got[i] == (None if want is None else pytest.approx(want))
    many = spark.range(200_000).select(F.lit(0).alias("path_id"), (F.col("id") % 1000 / 1000.0).alias("ts"), (F.col("id") % 1000 + 1.0).alias("price"))
    begun = time.time()
    assert M.realized_vol(many, 3600).where("vol = 3.0").count() > 190_000
    assert time.time() - begun < 60  # each row against its window would be 2e10 steps
