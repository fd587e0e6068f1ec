"""The four analyses end to end: each returns the result tables of one question.

``resumo``, ``detalhe`` and ``parametros`` are always present; further tables
are chart points, checks and insights.  ``write_results`` stores them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendaflux.functions import values as V
from vendaflux.functions.months import month_start
from vendaflux.operators import abc as A
from vendaflux.operators import adhoc as H
from vendaflux.operators import cohort as C
from vendaflux.operators import decompose as D
from vendaflux.operators import gap as G
from vendaflux.operators import insights as I
from vendaflux.operators import lifecycle as L
from vendaflux.operators import quality as Q
from vendaflux.plans.materialise import materialise
from vendaflux.sources.schema import require_columns
from vendaflux.sources.writers import params_from_row


def cohort_params(v: DataFrame) -> DataFrame:
    width = C.max_life_month(v)
    return params_from_row(width.select(
        F.lit(V.PARAM_COHORT_DEFINITION).alias("definicao_coorte"), F.col("janela_meses"),
        F.lit(V.PARAM_RETENTION_METRIC).alias("metrica_retencao")))


def abc_params(v: DataFrame, source: str = V.PARAM_SALES_SOURCE) -> DataFrame:
    clients = v.select("cliente_id").distinct().agg(F.count(F.lit(1)).alias("total_clientes"))
    return params_from_row(clients.select(
        F.lit(V.PARAM_ABC_RULE).alias("regra_abc"), F.lit(str(V.ABC_A)).alias("threshold_classe_a"),
        F.lit(str(V.ABC_B)).alias("threshold_classe_b"), "total_clientes", F.lit(f"Conforme {source}").alias("periodo_dados")))


def adhoc_params(v: DataFrame, recent: int = V.RECENT_MONTHS, prior: int = V.PRIOR_MONTHS) -> DataFrame:
    w = H.recent_prior(v, recent, prior)

    def span(name: str):
        inside = F.when(F.col("janela") == name, F.col("mes_ref"))
        return F.concat_ws(" a ", F.min(inside), F.max(inside))

    return params_from_row(w.agg(
        span("recente").alias("janela_recente"), span("anterior").alias("janela_anterior"),
        F.lit("média mensal").alias("metodo_delta"), F.lit("Pearson").alias("metodo_correlacao")))


def gap_params(m: DataFrame, tolerance: float = V.GAP_TOLERANCE, source: str = V.PARAM_TARGET_SOURCE) -> DataFrame:
    rows = m.agg(F.count(F.lit(1)).alias("linhas_meta"))
    return params_from_row(rows.select(
        F.lit(V.PARAM_GAP_GRAIN).alias("granularidade"), F.lit(source).alias("fonte_meta"), F.lit(f"±{tolerance:.0%}").alias("tolerancia_gap"),
        F.lit(V.PARAM_GAP_METHOD).alias("metodo_decomposicao"), "linhas_meta"))


def run_cohort(v: DataFrame, as_of: date | None = None, recurring: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """With ``as_of``, and the recurring products or ``tipo_produto``, the lifecycle tables come too."""
    require_columns(v, V.REQUIRED_COHORT)
    retention, summary = C.cohort_retention(v), C.cohort_summary(v)
    life = {}
    if as_of is not None and (recurring is not None or "tipo_produto" in v.columns):
        life = {"ciclo": L.lifecycle_counts(v, as_of, recurring), "reativacoes": L.reactivations(v, as_of, recurring)}
        if "canal" in v.columns:
            life |= {"churn": L.churn_by_channel(v, as_of, recurring=recurring), "tempo_ate_lost": L.time_to_lost(v, as_of, recurring=recurring)}
    return life | {
        "resumo": summary, "detalhe": C.retention_matrix(retention), "parametros": cohort_params(v),
        "grafico": C.retention_heatmap_points(retention), "insights": I.insights_cohort(summary),
        "entrada": Q.dq_cohort_input(v), "saida": Q.dq_cohort_output(retention, summary),
    }


def run_pareto(v: DataFrame) -> dict[str, DataFrame]:
    require_columns(v, V.REQUIRED_ABC)
    abc = materialise(A.abc_classify(v))
    return {
        "resumo": A.abc_summary(abc), "detalhe": abc, "parametros": abc_params(v),
        "grafico": A.pareto_points(abc), "insights": I.insights_abc(abc),
        "entrada": Q.dq_pareto_input(v), "saida": Q.dq_abc_output(abc, v),
    }


def run_adhoc(v: DataFrame, as_of: date | None = None) -> dict[str, DataFrame]:
    """Without a discount and a list price the second question is skipped, the first and the checks still run."""
    require_columns(v, V.REQUIRED_DECLINE)
    delta = H.product_delta(v)
    out = {
        "resumo": H.top_declines(delta), "detalhe": H.product_month_series(v), "parametros": adhoc_params(v),
        "grafico": H.delta_bar_points(delta), "insights": I.insights_adhoc(v, as_of), "entrada": Q.dq_adhoc_input(v, as_of=as_of),
    }
    correlation = H.discount_correlation(v, as_of=as_of)
    if correlation is not None:
        out["correlacao"] = correlation
        out["dispersao"] = H.scatter_points(H.client_discount_ticket(v, as_of=as_of))
    return out


def month_cells(v: DataFrame) -> DataFrame:
    """Sales pre-aggregated to month x channel x region x product, still in the sales contract."""
    return v.groupBy(month_start("data").alias("data"), *V.DIMENSIONS).agg(F.sum("receita").alias("receita"))


def run_gap(v: DataFrame, m: DataFrame, last_month: date | None = None,
            tolerance: float = V.GAP_TOLERANCE) -> dict[str, DataFrame]:
    """The fact is read once for the month cells, which serve the summary and the detail, and once
    for the decomposition, which needs distinct clients but only two months."""
    require_columns(v, V.REQUIRED_GAP_SALES)
    require_columns(m, V.REQUIRED_GAP_TARGETS)
    cells = materialise(month_cells(v))
    monthly, detail = G.gap_monthly(cells, m, tolerance), G.gap_detail(cells, m, tolerance)
    decomp = materialise(D.decompose_gap(v, last_month=last_month))
    return {
        "resumo": monthly, "detalhe": detail, "parametros": gap_params(m, tolerance),
        "decomposicao": decomp, "grafico": G.gap_series_points(monthly),
        "insights": I.insights_gap(cells, m, decomp, tolerance),
        "entrada": Q.dq_gap_input(v, m), "saida": Q.dq_gap_output(decomp, cells, m),
    }
