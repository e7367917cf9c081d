"""Numbers: rounding, ratings, fees and probabilities as Column builders."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import constants as K
from .text import as_col, let


def half_up(value: Column | str, places: int = 0) -> Column:
    """Round half up by floor, so that Spark and other engines agree at ties."""
    scale = float(10**places)
    return F.floor(as_col(value) * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty).cast("double"))


def rating5(value: Column | str, best: Column | str | None = None) -> Column:
    """Rating on a scale of five, two decimals; NULL outside (0, 5]."""
    v = as_col(value).try_cast("double")
    top = F.lit(5.0) if best is None else F.coalesce(F.nullif(as_col(best).try_cast("double"), F.lit(0.0)), F.lit(5.0))
    scaled = half_up(v * (F.lit(5.0) / top), 2)
    return F.when((scaled > 0) & (scaled <= 5), scaled)


def star_label(stars: Column | str) -> Column:
    s = as_col(stars)
    return F.when(s <= 2, "negative").when(s >= 4, "positive").when(s.isNotNull(), "neutral")


def capped(weight: float, value: Column | str) -> Column:
    """``weight`` times the value held between nothing and one, three decimals."""
    v = F.coalesce(as_col(value).cast("double"), F.lit(0.0))
    return half_up(F.lit(float(weight)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 3)


def side_fees(levels: Column) -> Column:
    """Fee of one side over ``array<struct<price,size>>``: taker fee plus overlay, five decimals each."""
    protocol = F.aggregate(
        levels, F.lit(0.0), lambda acc, f: acc + K.PROTOCOL_FEE * f["size"] * f["price"] * (1 - f["price"])
    )
    gross = F.aggregate(levels, F.lit(0.0), lambda acc, f: acc + f["price"] * f["size"])
    return half_up(protocol + 1e-12, 5) + half_up(gross * K.OVERLAY_FEE + 1e-12, 5)


# ---- fixed values: Cody's rational approximations of erf and erfc (Math. Comp. 23, 1969) ----
_ERF_SMALL = (
    (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3),
    (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3),
)
_ERFC_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
     8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
     3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_ERFC_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _fraction(x: Column, table: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    """Ratio of two polynomials, highest power first."""
    top, bottom = F.lit(table[0][0]), F.lit(table[1][0])
    for t, b in zip(table[0][1:], table[1][1:]):
        top, bottom = top * x + t, bottom * x + b
    return top / bottom


def erf(x: Column) -> Column:
    """Error function to double precision, as plain arithmetic."""

    def value(v: Column) -> Column:
        y = F.abs(v)
        inverse = 1.0 / (y * y)
        tail = (1.0 / math.sqrt(math.pi) - inverse * _fraction(inverse, _ERFC_LARGE)) / y
        outer = 1.0 - F.exp(-v * v) * F.when(y <= 4.0, _fraction(y, _ERFC_MIDDLE)).otherwise(tail)
        return F.when(y <= 0.46875, v * _fraction(v * v, _ERF_SMALL)).when(y >= 6.0, F.signum(v)).otherwise(F.signum(v) * outer)

    return let(x, value)


def fair_prob(price: Column, target: Column, seconds: Column, vol: Column) -> Column:
    """Probability that a lognormal price ends above the target."""
    years = F.greatest(seconds / float(K.SECONDS_PER_YEAR), F.lit(1e-12))
    sigma = vol * F.sqrt(years)
    step = F.when(price > target, 1.0).otherwise(0.0)
    safe = F.when(sigma > 1e-12, sigma)
    d = (F.ln(price / target) - 0.5 * safe * safe) / safe
    return F.when((seconds <= 0) | (sigma <= 1e-12), step).otherwise(0.5 * (1.0 + erf(d / math.sqrt(2.0))))


@F.pandas_udf(T.DoubleType())
def fair_prob_exact(price: pd.Series, target: pd.Series, seconds: pd.Series, vol: pd.Series) -> pd.Series:
    """The same with the C library's erf, for checks of ``fair_prob``."""
    out = []
    for p, t, s, v in zip(price, target, seconds, vol):
        sigma = v * math.sqrt(max(s / K.SECONDS_PER_YEAR, 1e-12))
        if s <= 0 or sigma <= 1e-12:
            out.append(1.0 if p > t else 0.0)
        else:
            out.append(0.5 * (1 + math.erf((math.log(p / t) - 0.5 * sigma * sigma) / sigma / math.sqrt(2))))
    return pd.Series(out, dtype="float64")
