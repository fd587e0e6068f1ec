"""Counts and totals used to check an extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions.months import month_key, month_start


def clients_by_channel(v: DataFrame) -> DataFrame:
    """Distinct clients per channel: grouped by client first, so a hot channel is spread."""
    return v.select("canal", "cliente_id").distinct().groupBy("canal").agg(F.count("cliente_id").alias("clientes"))


def rows_by_month(v: DataFrame) -> DataFrame:
    return v.groupBy(month_start("data").alias("_mes")).agg(
        F.count(F.lit(1)).alias("registros"), F.sum("receita").alias("_r"),
    ).select(month_key("_mes").alias("mes"), "registros", M.as_double(F.col("_r")).alias("receita"))


def global_totals(v: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct clients, revenue and first/last month.  Exact unless ``approximate`` is set."""
    if approximate:
        return v.agg(
            F.count(F.lit(1)).alias("total_registros"), F.approx_count_distinct("cliente_id").alias("total_clientes"),
            M.as_double(F.sum("receita")).alias("receita_total"),
            month_key(F.min("data")).alias("primeiro_mes"), month_key(F.max("data")).alias("ultimo_mes"))
    per_client = v.groupBy("cliente_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("receita").alias("_r"), F.min("data").alias("_a"), F.max("data").alias("_b"))
    return per_client.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_registros"), F.count("cliente_id").alias("total_clientes"),
        M.as_double(F.sum("_r")).alias("receita_total"),
        month_key(F.min("_a")).alias("primeiro_mes"), month_key(F.max("_b")).alias("ultimo_mes"))


def count_share(df: DataFrame, key: str, name: str = "registros") -> DataFrame:
    """Rows per key and their percentage of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn("pct", M.ratio(F.col(name) * 100, total))


def distinct_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def repeated_rows(df: DataFrame, cols: Sequence[str], name: str = "ocorrencias") -> DataFrame:
    """Rows (of ``cols``) that occur more than once, with their count, in two stages.

    A 64-bit hash of the row is counted first, so only hashes and counts of all rows are shuffled.  Whole rows move
    only where the hash repeats; they are counted by their columns, so a clash of hashes cannot make a duplicate.
    Copies are combined before either shuffle, so a row that fills a third of the table is one row by then."""
    marked = df.select(*cols, row_mark(cols).alias("_marca"))
    again = marked.groupBy("_marca").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_marca")
    return marked.join(again, "_marca", "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def row_mark(cols: Sequence[str]) -> Column:
    """Hash of a row; NULLs count by their place."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])


def duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keys (default: whole rows) that occur more than once, with their count."""
    return repeated_rows(df, list(cols or df.columns))
