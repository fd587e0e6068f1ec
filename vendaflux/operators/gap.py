"""Actual against target.

Sales are aggregated on a date month; the ``yyyy-MM`` text is only made on the
aggregated rows, where it is joined with the target's key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.figures import money, percent
from vendaflux.functions.months import month_key, month_start

DIMS = list(V.DIMENSIONS)


def _by_month(v: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    out = v.groupBy(month_start("data").alias("_mes"), *keys).agg(*aggs)
    return out.withColumn("mes_ref", month_key("_mes")).drop("_mes")


def monthly_realised(v: DataFrame) -> DataFrame:
    return _by_month(v, [], F.sum("receita").alias("_r")).select(
        "mes_ref", M.as_double(F.col("_r")).alias("realizado"))


def monthly_target(m: DataFrame) -> DataFrame:
    return m.groupBy("mes_ref").agg(M.as_double(F.sum("meta_receita")).alias("meta"))


def detail_realised(v: DataFrame, keys: Sequence[str] = DIMS) -> DataFrame:
    return _by_month(v, keys, F.sum("receita").alias("_r")).select(
        "mes_ref", *keys, M.as_double(F.col("_r")).alias("realizado"))


def detail_kpis(v: DataFrame) -> DataFrame:
    """Realised, active clients and mean ticket per month and cell; clients are grouped before they are counted."""
    cells = v.groupBy(month_start("data").alias("_mes"), *DIMS, "cliente_id").agg(
        F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("_mes", *DIMS).agg(
        F.sum("_r").alias("_r"), F.sum("_n").alias("_n"), F.count("cliente_id").alias("clientes_ativos"),
    ).select(month_key("_mes").alias("mes_ref"), *DIMS, M.as_double(F.col("_r")).alias("realizado"),
             "clientes_ativos", M.ratio(F.col("_r"), F.col("_n")).alias("ticket_medio"))


def gap_monthly(v: DataFrame, m: DataFrame, tolerance: float = V.GAP_TOLERANCE) -> DataFrame:
    """Months present on both sides: realised, target, gap, gap % (4 digits, half even) and status."""
    real = _by_month(v, [], F.sum("receita").alias("_r"))
    goal = m.groupBy("mes_ref").agg(F.sum("meta_receita").alias("_m"))
    pct = M.half_even(M.ratio(F.col("_r") - F.col("_m"), F.col("_m")), 4)
    return real.join(goal, "mes_ref", "inner").select(
        "mes_ref", M.as_double(F.col("_r")).alias("realizado"), M.as_double(F.col("_m")).alias("meta"),
        M.as_double(F.col("_r") - F.col("_m")).alias("gap"), pct.alias("gap_pct"),
    ).withColumn("status", M.gap_status(F.col("gap_pct"), tolerance))


def gap_detail(v: DataFrame, m: DataFrame, tolerance: float = V.GAP_TOLERANCE) -> DataFrame:
    """Month x channel x region x product.  The gap % is not rounded; without a target it is 0 and the gap NULL.

    Further target columns, such as ``forecast_receita``, come along.
    """
    real = _by_month(v, DIMS, F.sum("receita").alias("_r"))
    extra = [c for c in m.columns if c not in V.TARGET_KEYS and c not in ("meta_receita", "mes")]
    goal = m.select(*V.TARGET_KEYS, F.col("meta_receita").alias("_m"), *extra)
    gap = F.col("_r") - F.col("_m")
    return real.join(goal, list(V.TARGET_KEYS), "left").select(
        *V.TARGET_KEYS, M.as_double(F.col("_r")).alias("realizado"), M.as_double(F.col("_m")).alias("meta_receita"),
        *[M.as_double(F.col(c)).alias(c) for c in extra],
        M.as_double(gap).alias("gap"), M.ratio_or_zero(gap, F.col("_m")).alias("gap_pct"),
    ).withColumn("status", M.gap_status(F.col("gap_pct"), tolerance))


def _exact_gap() -> Column:
    """Cell gaps carry four decimals, so a decimal sum gives the same total in any order."""
    return F.sum(F.col("gap").cast("decimal(28,4)"))


def gap_drivers(detail: DataFrame, dim: str) -> DataFrame:
    """Total gap per value of ``dim``."""
    return detail.groupBy(dim).agg(M.as_double(F.coalesce(_exact_gap(), F.lit(0))).alias("gap"))


def gap_extremes(detail: DataFrame, dim: str) -> DataFrame:
    """Worst and best value of ``dim`` by total gap."""
    from vendaflux.operators.ranking import extremes

    return extremes(gap_drivers(detail, dim), dim, "gap")


def gap_figures(monthly: DataFrame) -> DataFrame:
    """The monthly figures as a report shows them."""
    return monthly.select("mes_ref", money(F.col("realizado")).alias("realizado"), money(F.col("meta")).alias("meta"),
                          money(F.col("gap"), signed=True).alias("gap"), percent(F.col("gap_pct"), 1, signed=True).alias("gap_pct"))


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("meses"))


def gap_worst_cells(detail: DataFrame, n: int = 10) -> DataFrame:
    """Cells below target, the most negative gap first."""
    return detail.filter(F.col("status") == V.GAP_BELOW).orderBy("gap", *V.TARGET_KEYS).limit(n).select(
        *V.TARGET_KEYS, "realizado", "meta_receita", "gap")


def gap_series_points(monthly: DataFrame) -> DataFrame:
    sign = F.when(F.col("gap") >= 0, "positivo").otherwise("negativo")
    return monthly.select("mes_ref", "realizado", "meta", sign.alias("sinal"))


def gap_waterfall(detail: DataFrame, month: str) -> DataFrame:
    """Each channel's contribution to the gap of a month, with a running total by channel name."""
    per = detail.filter((F.col("mes_ref") == month) & F.col("gap").isNotNull()).groupBy("mes_ref", "canal").agg(
        _exact_gap().alias("_g"))
    w = Window.partitionBy("mes_ref").orderBy("canal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.select("mes_ref", "canal", M.as_double(F.col("_g")).alias("gap"),
                      M.as_double(F.sum("_g").over(w)).alias("gap_acumulado"))


def gap_grouping_sets(v: DataFrame, m: DataFrame, tolerance: float = V.GAP_TOLERANCE) -> DataFrame:
    """The gap by month, and by month with each dimension, from sales and targets apart.

    Neither side loses rows of the other: without sales 0 is realised, without a target the target, gap and status are
    NULL.  ``nivel`` names the level; the columns of the other dimensions are NULL.
    """
    none = F.lit(None).cast("decimal(28,4)")
    real = _by_month(v, DIMS, F.sum("receita").cast("decimal(28,4)").alias("_r")).select(*V.TARGET_KEYS, "_r", none.alias("_m"))
    goal = m.groupBy(*V.TARGET_KEYS).agg(F.sum("meta_receita").cast("decimal(28,4)").alias("_m")).select(
        *V.TARGET_KEYS, none.alias("_r"), "_m")
    month = F.col("mes_ref")
    sets = [[month], *[[month, F.col(x)] for x in DIMS]]
    level = F.lit("mes")
    for x in DIMS:
        level = F.when(F.grouping(x) == 0, x).otherwise(level)
    grouped = real.unionByName(goal).groupingSets(sets, month, *[F.col(x) for x in DIMS]).agg(
        level.alias("nivel"), F.coalesce(F.sum("_r"), F.lit(0)).alias("_r"), F.sum("_m").alias("_m"))
    gap = F.col("_r") - F.col("_m")
    return grouped.select(
        "nivel", *V.TARGET_KEYS, M.as_double(F.col("_r")).alias("realizado"), M.as_double(F.col("_m")).alias("meta"),
        M.as_double(gap).alias("gap"), M.half_even(M.ratio(gap, F.col("_m")), 4).alias("gap_pct"),
    ).withColumn("status", F.when(F.col("meta").isNotNull(), M.gap_status(F.col("gap_pct"), tolerance)))


def target_by_channel(m: DataFrame) -> DataFrame:
    """Months, total and mean target per channel."""
    per_month = m.groupBy("canal", "mes_ref").agg(F.sum("meta_receita").alias("_s"), F.count("meta_receita").alias("_n"))
    return per_month.groupBy("canal").agg(
        F.count(F.lit(1)).alias("meses"), M.as_double(F.sum("_s")).alias("meta_total"),
        M.ratio(F.sum("_s"), F.sum("_n")).alias("meta_media_mensal"))


def month_coverage(v: DataFrame, m: DataFrame) -> DataFrame:
    """Rows per month on each side."""
    real = _by_month(v, [], F.count(F.lit(1)).alias("registros")).select(
        F.lit("realizado").alias("fonte"), F.col("mes_ref").alias("mes"), "registros")
    goal = m.groupBy(F.col("mes_ref").alias("mes")).agg(F.count(F.lit(1)).alias("registros")).select(
        F.lit("forecast").alias("fonte"), "mes", "registros")
    return real.unionByName(goal)


def key_coverage(v: DataFrame, m: DataFrame, key: str = "canal") -> DataFrame:
    """Keys found on one side only.  NULL keys never match and are left out on both sides."""
    from vendaflux.operators.joins import keys_only_in_left

    def side(label: str, a: DataFrame, b: DataFrame) -> DataFrame:
        return keys_only_in_left(a, b, key).select(F.lit(label).alias("tipo"), F.col(key).alias("valor"))

    return side(f"{key}_so_no_realizado", v, m).unionByName(side(f"{key}_so_no_forecast", m, v))
