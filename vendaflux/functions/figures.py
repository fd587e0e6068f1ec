"""Figures as text: thousands, money and percentages, rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What money is written with (fixed value).
CURRENCY = "R$ "


def _signed(text: Column, c: Column, signed: bool) -> Column:
    return F.concat(F.when(c >= 0, "+").otherwise(""), text) if signed else text


def thousands(c: Column, digits: int = 0, signed: bool = False) -> Column:
    """``1,234,567``; with ``signed`` a plus before what is not negative.  NULL stays NULL."""
    return _signed(F.format_number(c.cast("double"), digits), c, signed)


def money(c: Column, signed: bool = False) -> Column:
    """``R$ 1,234`` or ``R$ +1,234``."""
    return F.concat(F.lit(CURRENCY), thousands(c, 0, signed))


def percent(c: Column, digits: int = 1, signed: bool = False) -> Column:
    """A share as ``12.3%`` or ``+12.3%``, without a thousands separator."""
    plain = F.translate(F.format_number(c.cast("double") * 100, digits), ",", "")
    return F.concat(_signed(plain, c, signed), F.lit("%"))
