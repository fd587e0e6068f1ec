"""Join building blocks.  All are equi-joins; none carries a size-blind hint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendaflux.functions.months import month_key, month_start


def join_back(v: DataFrame, per_client: DataFrame, on: str = "cliente_id") -> DataFrame:
    """Bring a per-client aggregate back to the rows."""
    return v.join(per_client, on, "inner")


def full_by_key(prev: DataFrame, cur: DataFrame, on: str | Sequence[str],
                zero: Sequence[str]) -> DataFrame:
    """Full outer join of two periods, with missing figures set to zero."""
    return prev.join(cur, on, "full").fillna(0, subset=list(zero))


def keys_only_in_left(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``left`` that ``right`` does not have."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct()
    b = right.select(key).filter(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti")


def lookup(df: DataFrame, key: str, mapping: Mapping[str, object], name: str) -> DataFrame:
    """Value from a small fixed dictionary, as a map literal: no join."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.withColumn(name, F.try_element_at(pairs, F.col(key)))


def month_spine(v: DataFrame, keys: Sequence[str], start: date | None = None,
                end: date | None = None) -> DataFrame:
    """Revenue and transactions per key and calendar month, zero where nothing was billed.

    The bounds default to the first and last month of each key.  The calendar is
    generated from one row per key, so the raw rows are aggregated only once.
    """
    m = month_start("data")
    cells = v.groupBy(*keys, m.alias("_mes")).agg(
        F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    span = cells.groupBy(*keys).agg(F.min("_mes").alias("_a"), F.max("_mes").alias("_b"))
    first = F.lit(start) if start else F.col("_a")
    last = F.lit(end) if end else F.col("_b")
    calendar = span.select(*keys, F.explode(F.sequence(
        month_start(first), month_start(last), F.expr("interval 1 month"))).alias("_mes"))
    return calendar.join(cells, [*keys, "_mes"], "left").select(
        month_key("_mes").alias("mes_ref"), *keys,
        F.coalesce(F.col("_r").cast("double"), F.lit(0.0)).alias("receita"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("transacoes"),
    )
