"""Row filters.  Dates are compared on the raw column so that parquet can prune."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendaflux.functions import values as V
from vendaflux.functions.months import month_key, month_start


def effective_only(v: DataFrame) -> DataFrame:
    """Confirmed billings with a positive value."""
    return v.filter((F.col("receita") > 0) & (F.col("status_faturamento") == V.STATUS_EFFECTIVE))


def horizon(v: DataFrame, as_of: date, months: int) -> DataFrame:
    """Rows dated on or after ``as_of`` minus ``months``."""
    return v.filter(F.col("data") >= shift(as_of, -months))


def horizon_range(v: DataFrame, as_of: date, months_from: int, months_to: int) -> DataFrame:
    """Half-open [as_of - months_from, as_of - months_to)."""
    d = F.col("data")
    return v.filter((d >= shift(as_of, -months_from)) & (d < shift(as_of, -months_to)))


def month_filter(v: DataFrame, month: date) -> DataFrame:
    first = month.replace(day=1)
    return v.filter((F.col("data") >= F.lit(first)) & (F.col("data") < shift(first, 1)))


def class_filter(abc: DataFrame, cls: str) -> DataFrame:
    return abc.filter(F.col("classe_abc") == cls)


def status_filter(summary: DataFrame, status: str) -> DataFrame:
    return summary.filter(F.col("status") == status)


def m0_filter(retention: DataFrame) -> DataFrame:
    return retention.filter(F.col("periodo_idx") == 0)


def matured_m1(summary: DataFrame) -> DataFrame:
    """Cohorts old enough to have a first-month retention."""
    return summary.filter(F.col("retencao_m1").isNotNull())


def with_month(v: DataFrame) -> DataFrame:
    return v.withColumns({"mes": month_start("data"), "mes_ref": month_key("data")})


def shift(as_of: date, months: int):
    """A constant: Catalyst folds it before the scan."""
    return F.add_months(F.lit(as_of), months)
