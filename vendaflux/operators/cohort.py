"""Cohort retention.

The cohort of a client is the month of the first purchase; the life month is
the number of month boundaries since.  Operators on all clients start from one
row per client with the set of its months (``monthset``), built in one exchange;
a very large client is one row per task before it.  The span of the sets comes
from a small job over ``dates``: any table with the dates of the sales, best the
narrowest one.  Per channel, rows per (client, channel, month) are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions.months import month_diff, month_key, month_start
from vendaflux.functions.monthset import Span, has
from vendaflux.operators.filters import matured_m1
from vendaflux.plans.materialise import materialise


def cohort_cells(v: DataFrame, by: str | None = None) -> DataFrame:
    """Active clients and exact revenue per (by, cohort month, life month), plus the base size."""
    keys = [by] if by else []
    monthly = v.groupBy("cliente_id", *keys, month_start("data").alias("_mes")).agg(
        F.sum("receita").alias("_receita")
    )
    first = F.min("_mes").over(Window.partitionBy("cliente_id"))
    cells = (
        monthly.withColumn("_coorte", first)
        .groupBy(*keys, "_coorte", month_diff("_coorte", "_mes").alias("periodo_idx"))
        .agg(F.count(F.lit(1)).alias("clientes_ativos"), F.sum("_receita").alias("receita"))
    )
    base = F.max(F.when(F.col("periodo_idx") == 0, F.col("clientes_ativos")))
    return cells.withColumn("clientes_base", base.over(Window.partitionBy(*keys, "_coorte")))


def _retention():
    return M.half_even(M.ratio(F.col("clientes_ativos"), F.col("clientes_base")), 4)


def client_activity(v: DataFrame, dates: DataFrame | None = None, *more: Column) -> tuple[DataFrame, list[Column]]:
    """One row per client: ``_coorte``, offsets of the first and last month, further aggregates, and the words of its months."""
    span = Span.of(v if dates is None else dates)
    sets = [w.alias(f"_w{k}") for k, w in enumerate(span.collect("data"))]
    per_client = v.groupBy("cliente_id").agg(F.min("data").alias("_min"), F.max("data").alias("_max"), *sets, *more)
    per_client = per_client.withColumns({"_coorte": month_start("_min"), "_a": span.offset("_min"), "_b": span.offset("_max")})
    return per_client.drop("_min", "_max"), [F.col(f"_w{k}") for k in range(span.words)]


def _activity_cells(v: DataFrame, dates: DataFrame | None) -> DataFrame:
    """Active clients per (cohort month, life month); the months of a set are counted where it was made."""
    clients, words = client_activity(v, dates)
    months = F.filter(F.sequence("_a", "_b"), lambda i: has(words, i))
    return clients.select("_coorte", "_a", F.explode(months).alias("_i")).groupBy("_coorte", (F.col("_i") - F.col("_a")).alias("periodo_idx")).agg(
        F.count(F.lit(1)).alias("clientes_ativos"))


def cohort_retention(v: DataFrame, by: str | None = None, dates: DataFrame | None = None) -> DataFrame:
    """One row per cohort and observed life month; unobserved cells have no row."""
    if by:
        cells = cohort_cells(v, by)
    else:
        base = F.max(F.when(F.col("periodo_idx") == 0, F.col("clientes_ativos")))
        cells = _activity_cells(v, dates).withColumn("clientes_base", base.over(Window.partitionBy("_coorte")))
    keys = [by] if by else []
    return cells.select(
        *keys, month_key("_coorte").alias("coorte"), "periodo_idx",
        "clientes_ativos", "clientes_base", _retention().alias("retencao"),
    )


def cohort_by_channel(v: DataFrame, by: str = "canal") -> DataFrame:
    """Retention per channel; the cohort stays the client's first month in any channel."""
    return cohort_retention(v, by)


def cohort_counts(v: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    return _activity_cells(v, dates).select(month_key("_coorte").alias("coorte"), "periodo_idx", "clientes_ativos")


def cohort_revenue(v: DataFrame) -> DataFrame:
    per_client = v.groupBy("cliente_id").agg(F.min("data").alias("_min"), F.sum("receita").alias("_r"))
    return per_client.groupBy(month_key("_min").alias("coorte")).agg(M.as_double(F.sum("_r")).alias("receita"))


def cohort_summary(v: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Base size, revenue and retention at M1, M2 and M3 (NULL when there is no such cell)."""
    clients, words = client_activity(v, dates, F.sum("receita").alias("_r"))
    marks = [F.count(F.when(has(words, F.col("_a") + k), 1)).alias(f"_m{k}") for k in (1, 2, 3)]
    sums = clients.groupBy(month_key("_coorte").alias("coorte")).agg(
        F.count(F.lit(1)).alias("clientes_base"), F.sum("_r").alias("_r"), *marks)

    def mark(k: int) -> Column:
        share = M.half_even(M.ratio(F.col(f"_m{k}"), F.col("clientes_base")), 4)
        return F.when(F.col(f"_m{k}") > 0, share).alias(f"retencao_m{k}")

    return sums.select("coorte", "clientes_base", M.as_double(F.col("_r")).alias("receita"), mark(1), mark(2), mark(3))


def cohort_averages(summary: DataFrame) -> DataFrame:
    """Mean M1, M2, M3 over cohorts that have an M1; missing marks are skipped."""
    def mean(c: str):
        # retentions have four decimals, so the decimal sum is exact in any order
        return M.ratio(F.sum(F.col(c).cast("decimal(10,4)")), F.count(c))

    return matured_m1(summary).agg(
        F.count(F.lit(1)).alias("coortes"), *[mean(f"retencao_m{k}").alias(f"media_m{k}") for k in (1, 2, 3)],
    )


def cohort_best_worst(summary: DataFrame, n: int = 3) -> DataFrame:
    """The n best and n worst cohorts by M1; equal retentions are ordered by cohort."""
    base = matured_m1(summary).select("coorte", "retencao_m1")

    def side(label: str, order):
        top = base.orderBy(order, F.asc("coorte")).limit(n)
        # n rows by now
        pos = F.row_number().over(Window.orderBy(order, F.asc("coorte")))
        return top.select(F.lit(label).alias("grupo"), pos.cast("int").alias("posicao"), "coorte", "retencao_m1")

    return side("melhores", F.desc("retencao_m1")).unionByName(side("piores", F.asc("retencao_m1")))


def max_life_month(v: DataFrame) -> DataFrame:
    """Widest life month and number of cohorts."""
    per_client = v.groupBy("cliente_id").agg(month_start(F.min("data")).alias("_coorte"), F.max("data").alias("_max"))
    cohorts = per_client.groupBy("_coorte").agg(F.max(month_diff("_coorte", "_max")).alias("_k"))
    return cohorts.agg(F.max("_k").cast("int").alias("janela_meses"), F.count("_coorte").alias("coortes"))


def life_months(dates: DataFrame) -> int:
    """No life month in a table is larger than this: the months between its first and last date."""
    return Span.of(dates).months - 1


def retention_matrix(retention: DataFrame, max_k: int | None = None,
                     by: Sequence[str] = (), widest: int | None = None) -> DataFrame:
    """Cohorts as rows, life months as columns m0, m1, ...; absent cells are NULL.

    ``max_k`` may ask for more columns than there are life months, never for fewer.  ``widest`` names the last
    column where a bound is known (``life_months``), and nothing runs beforehand; a life month above it is then an
    error when the matrix is computed.  Without it the cells, few rows, are kept once and their widest is read.
    """
    if widest is None:
        retention = materialise(retention)
        widest = retention.agg(F.max("periodo_idx")).first()[0] or 0
        if max_k is not None and max_k < widest:
            raise ValueError(f"max_k {max_k} would drop life months up to {widest}")
        widest = max(widest, max_k or 0)
    else:
        beyond = F.raise_error(F.lit(f"a life month above {widest}")).cast("int")
        retention = retention.withColumn("periodo_idx", F.when(F.col("periodo_idx") > widest, beyond).otherwise(F.col("periodo_idx")))
    values = list(range(widest + 1))
    wide = retention.groupBy(*by, "coorte").pivot("periodo_idx", values).agg(F.first("retencao"))
    return wide.withColumnsRenamed({str(k): f"m{k}" for k in values})


def retention_heatmap_points(retention: DataFrame) -> DataFrame:
    """The matrix as (row, column, value) points for a chart."""
    return retention.select("coorte", "periodo_idx", "retencao")
