"""Month arithmetic on ``DATE`` columns.

Months are kept as the first day of the month (a ``DATE``) inside plans: cheap
to compare and to shift.  The ``yyyy-MM`` text is produced at the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "month")


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_number(c: Column | str) -> Column:
    """Months since year 0, so that a difference counts month boundaries."""
    return F.year(_col(c)) * 12 + F.month(_col(c))


def month_diff(start: Column | str, end: Column | str) -> Column:
    """Month boundaries crossed from ``start`` to ``end``: 31 Jan -> 1 Feb is 1."""
    return month_number(end) - month_number(start)


def calendar_parts(c: Column | str) -> list[Column]:
    c = _col(c)
    return [F.quarter(c).alias("trimestre"), F.year(c).alias("ano"), F.month(c).alias("mes_ano")]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
