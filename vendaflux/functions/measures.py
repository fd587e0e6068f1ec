"""Money, ratios and labels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vendaflux.functions import values as V


def ratio(num: Column, den: Column) -> Column:
    """Double division that yields NULL instead of failing on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def as_double(c: Column, scale: int | None = None) -> Column:
    """Publish an exact decimal (or a double, rounded) as DOUBLE."""
    d = c.cast("double")
    return d if scale is None else F.round(d, scale)


def half_even(c: Column, scale: int = 4) -> Column:
    """Scale, round half to even, scale back: the way numeric arrays are rounded.

    ``bround`` works on the decimal text of the double, so it differs where the
    scaled binary value is not a tie (0.04615 gives 0.0461 here, 0.0462 there).
    """
    factor = F.lit(float(10 ** scale))
    return F.rint(c * factor) / factor


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def hundredths(c: Column) -> Column:
    """A double that holds at most two decimals, as an exact integer."""
    return F.rint(c * 100).cast("bigint")


def from_units(units: Column, scale: int) -> Column:
    """Integer units of 10^-scale as ``decimal(18, scale)``.

    Much cheaper than casting a double to a decimal, which goes through text for every row.
    """
    unit = F.lit("0." + "0" * (scale - 1) + "1").cast(f"decimal({scale},{scale})")
    return (units.cast("decimal(18,0)") * unit).cast(f"decimal(18,{scale})")


def net_revenue(list_price: Column, discount: Column) -> Column:
    """Exact price x (1 - discount), for a price and a discount with at most two decimals."""
    return from_units(hundredths(list_price) * (100 - hundredths(discount)), 4)


def discount_pct(list_price: Column, billed: Column) -> Column:
    """(list - billed) / list, and 0 where there is no list price."""
    return F.when(list_price > 0, ratio(list_price - billed, list_price)).otherwise(F.lit(0.0))


def product_type(product: Column, recurring: Sequence[str] = V.RECURRING_PRODUCTS) -> Column:
    return F.when(product.isin(*recurring), V.PRODUCT_RECURRING).otherwise(V.PRODUCT_COMPLEMENTARY)


def discount_band(discount: Column) -> Column:
    """Upper bounds are inclusive; an unknown discount lands in the open last band."""
    none, low, medium, high, top = V.DISCOUNT_BANDS
    zero, five, ten, twenty = V.DISCOUNT_BAND_LIMITS
    return (
        F.when(discount <= zero, none)
        .when(discount <= five, low)
        .when(discount <= ten, medium)
        .when(discount <= twenty, high)
        .otherwise(top)
    )


def discount_coverage(list_price: Column) -> Column:
    return F.when(list_price > 0, V.DISCOUNT_COVERED).otherwise(V.DISCOUNT_UNCOVERED)


def gap_status(gap_pct: Column, tolerance: float = V.GAP_TOLERANCE) -> Column:
    """Strict on both sides: exactly +-tolerance, or an unknown gap, is on target."""
    return (
        F.when(gap_pct > tolerance, V.GAP_ABOVE)
        .when(gap_pct < -tolerance, V.GAP_BELOW)
        .otherwise(V.GAP_ON)
    )


def abc_class(cumulative: Column, a: float = V.ABC_A, b: float = V.ABC_B) -> Column:
    return F.when(cumulative <= a, "A").when(cumulative <= b, "B").otherwise("C")


def risk_level(top_share: Column) -> Column:
    critical, high, moderate = V.RISK_LABELS
    return (
        F.when(top_share > V.RISK_CRITICAL, critical)
        .when(top_share > V.RISK_HIGH, high)
        .otherwise(moderate)
    )


def correlation_label(r: Column) -> Column:
    weak, strong = V.CORRELATION_LIMITS
    strong_pos, mid_pos, flat, mid_neg, strong_neg = V.CORRELATION_LABELS
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r >= strong, strong_pos)
        .when(r >= weak, mid_pos)
        .when(r > -weak, flat)
        .when(r > -strong, mid_neg)
        .otherwise(strong_neg)
    )


def dominant_effect(volume: Column, price: Column) -> Column:
    return F.when(F.abs(volume) > F.abs(price), V.EFFECT_VOLUME).otherwise(V.EFFECT_PRICE)
