"""Cohort and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalog.registry import Entry, over_sales
from catalog.tables import AS_OF, datas, vendas
from vendaflux.operators import cohort as C
from vendaflux.operators import filters as X
from vendaflux.operators import insights as I
from vendaflux.operators import lifecycle as L
from vendaflux.plans.analyses import cohort_params

CALENDAR = 80  # months from the first to the last date of the test tables
_FIRST = "f AS (SELECT cliente_id, MIN(mes) AS c FROM vendas GROUP BY 1)"
_CELLS = """n AS (
  SELECT strftime(c, '%Y-%m') AS coorte, CAST(date_diff('month', c, mes) AS INTEGER) AS periodo_idx,
         COUNT(DISTINCT cliente_id) AS clientes_ativos
  FROM vendas JOIN f USING (cliente_id) GROUP BY 1, 2)"""
_RET = """ret AS (
  SELECT n.coorte, n.periodo_idx, n.clientes_ativos, b.clientes_ativos AS clientes_base,
         round_even(CAST(n.clientes_ativos AS DOUBLE) / b.clientes_ativos, 4) AS retencao
  FROM n JOIN n b ON b.coorte = n.coorte AND b.periodo_idx = 0)"""
_SUM = """resumo AS (
  SELECT r.coorte, MAX(clientes_base) AS clientes_base, ANY_VALUE(x.receita) AS receita,
         MAX(retencao) FILTER (periodo_idx = 1) AS retencao_m1, MAX(retencao) FILTER (periodo_idx = 2) AS retencao_m2,
         MAX(retencao) FILTER (periodo_idx = 3) AS retencao_m3
  FROM ret r JOIN (SELECT strftime(c, '%Y-%m') AS coorte, CAST(SUM(receita) AS DOUBLE) AS receita
                   FROM vendas JOIN f USING (cliente_id) GROUP BY 1) x ON x.coorte = r.coorte GROUP BY r.coorte)"""
_BESTS = """extremos AS (
  SELECT 'melhores' AS grupo, CAST(row_number() OVER (ORDER BY retencao_m1 DESC, coorte) AS INTEGER) AS posicao, coorte, retencao_m1
  FROM resumo WHERE retencao_m1 IS NOT NULL QUALIFY posicao <= 3
  UNION ALL
  SELECT 'piores', CAST(row_number() OVER (ORDER BY retencao_m1, coorte) AS INTEGER) AS p, coorte, retencao_m1
  FROM resumo WHERE retencao_m1 IS NOT NULL QUALIFY p <= 3)"""
_MEANS = """medias AS (
  SELECT COUNT(*) AS coortes, CAST(SUM(CAST(retencao_m1 AS DECIMAL(10,4))) AS DOUBLE) / COUNT(retencao_m1) AS media_m1,
         CAST(SUM(CAST(retencao_m2 AS DECIMAL(10,4))) AS DOUBLE) / COUNT(retencao_m2) AS media_m2,
         CAST(SUM(CAST(retencao_m3 AS DECIMAL(10,4))) AS DOUBLE) / COUNT(retencao_m3) AS media_m3
  FROM resumo WHERE retencao_m1 IS NOT NULL)"""


def _cohort_sql(select: str, *more: str) -> str:
    return over_sales(_FIRST, _CELLS, _RET, _SUM, *more, select=select)


# Each month of each client from entry to as_of, by joining a calendar: independent of the segment logic.
_LIFE = """cm AS (SELECT cliente_id, mes, MAX(CASE WHEN tipo_produto = 'recorrente' THEN 1 ELSE 0 END) AS rec, MIN(canal) AS canal
       FROM vendas GROUP BY 1, 2),
cli AS (SELECT cliente_id, MIN(mes) AS entrada, arg_max(canal, mes) AS canal FROM cm GROUP BY 1),
cal AS (SELECT cliente_id, entrada, cli.canal, CAST(unnest(generate_series(entrada, DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS m FROM cli),
sit AS (SELECT cal.cliente_id, cal.m, cal.entrada, cal.canal, COALESCE(cm.rec, 0) AS rec,
        MAX(CASE WHEN cm.rec = 1 THEN cal.m END) OVER w AS ultimo_rec,
        MAX(cm.mes) OVER w AS ultimo_fat
        FROM cal LEFT JOIN cm ON cm.cliente_id = cal.cliente_id AND cm.mes = cal.m
        WINDOW w AS (PARTITION BY cal.cliente_id ORDER BY cal.m ROWS UNBOUNDED PRECEDING)),
base AS (SELECT *, CASE WHEN rec = 1 THEN 'Ativo'
        WHEN date_diff('month', ultimo_fat, m) >= 12 THEN 'Inativo'
        WHEN date_diff('month', COALESCE(ultimo_rec, CAST(entrada - INTERVAL 1 MONTH AS DATE)), m) >= 3 THEN 'Lost' ELSE 'Em risco' END AS s FROM sit),
ciclo AS (SELECT cliente_id, m, entrada, canal, CASE WHEN s = 'Ativo' AND LAG(s) OVER (PARTITION BY cliente_id ORDER BY m) IN ('Lost', 'Inativo')
        THEN 'Reativado' ELSE s END AS status FROM base)"""


def _life(spark, d) -> DataFrame:
    return vendas(spark, d, "cliente_id", "data", "canal", "tipo_produto")


def _life_plain(spark, d) -> DataFrame:
    return vendas(spark, d, "cliente_id", "data", "tipo_produto")


def _sales(spark, d) -> DataFrame:
    return vendas(spark, d, "cliente_id", "data", "receita")


QUERIES = {
    "cohort_retention": Entry(lambda s, d: C.cohort_retention(_sales(s, d), dates=datas(s, d)), _cohort_sql("SELECT * FROM ret")),
    "cohort_counts": Entry(lambda s, d: C.cohort_counts(_sales(s, d), dates=datas(s, d)), _cohort_sql("SELECT * FROM n")),
    "cohort_revenue": Entry(lambda s, d: C.cohort_revenue(_sales(s, d)), _cohort_sql("SELECT coorte, receita FROM resumo")),
    "cohort_summary": Entry(lambda s, d: C.cohort_summary(_sales(s, d), dates=datas(s, d)), _cohort_sql("SELECT * FROM resumo")),
    "J_left_marks": Entry(
        lambda s, d: C.cohort_summary(_sales(s, d), dates=datas(s, d)).select("coorte", "retencao_m1", "retencao_m2", "retencao_m3"),
        _cohort_sql("""
SELECT b.coorte, a1.retencao AS retencao_m1, a2.retencao AS retencao_m2, a3.retencao AS retencao_m3 FROM (SELECT coorte FROM ret WHERE periodo_idx = 0) b
LEFT JOIN ret a1 ON a1.coorte = b.coorte AND a1.periodo_idx = 1 LEFT JOIN ret a2 ON a2.coorte = b.coorte AND a2.periodo_idx = 2
LEFT JOIN ret a3 ON a3.coorte = b.coorte AND a3.periodo_idx = 3""")),
    "cohort_averages": Entry(lambda s, d: C.cohort_averages(C.cohort_summary(_sales(s, d), dates=datas(s, d))), _cohort_sql("SELECT * FROM medias", _MEANS)),
    "cohort_best_worst": Entry(lambda s, d: C.cohort_best_worst(C.cohort_summary(_sales(s, d), dates=datas(s, d))), _cohort_sql("SELECT * FROM extremos", _BESTS)),
    "max_life_month": Entry(
        lambda s, d: C.max_life_month(_sales(s, d)),
        _cohort_sql("SELECT MAX(periodo_idx) AS janela_meses, COUNT(DISTINCT coorte) AS coortes FROM ret")),
    "m0_filter": Entry(
        lambda s, d: X.m0_filter(C.cohort_retention(_sales(s, d), dates=datas(s, d))).select("coorte", "clientes_base"),
        _cohort_sql("SELECT coorte, clientes_base FROM ret WHERE periodo_idx = 0")),
    "cohort_by_channel": Entry(
        lambda s, d: C.cohort_by_channel(vendas(s, d, "cliente_id", "data", "canal", "receita")),
        over_sales(_FIRST, """q AS (SELECT canal, strftime(c, '%Y-%m') AS coorte, CAST(date_diff('month', c, mes) AS INTEGER) AS periodo_idx,
 COUNT(DISTINCT cliente_id) AS clientes_ativos FROM vendas JOIN f USING (cliente_id) GROUP BY 1, 2, 3)""", select="""
SELECT q.*, b.clientes_ativos AS clientes_base, round_even(CAST(q.clientes_ativos AS DOUBLE) / b.clientes_ativos, 4) AS retencao
FROM q LEFT JOIN q b ON b.canal = q.canal AND b.coorte = q.coorte AND b.periodo_idx = 0""")),
    "retention_matrix": Entry(
        lambda s, d: C.retention_matrix(C.cohort_retention(_sales(s, d), dates=datas(s, d)), widest=C.life_months(datas(s, d))),
        _cohort_sql("SELECT coorte, " + ", ".join(f"MAX(retencao) FILTER (periodo_idx = {k}) AS m{k}" for k in range(CALENDAR)) + " FROM ret GROUP BY coorte")),
    "retention_heatmap_points": Entry(
        lambda s, d: C.retention_heatmap_points(C.cohort_retention(_sales(s, d), dates=datas(s, d))),
        _cohort_sql("SELECT coorte, periodo_idx, retencao FROM ret")),
    "params_cohort": Entry(
        lambda s, d: cohort_params(_sales(s, d)),
        _cohort_sql("""
SELECT 'definicao_coorte' AS parametro, 'Mês da primeira compra por cliente' AS valor
UNION ALL SELECT 'janela_meses', CAST(MAX(periodo_idx) AS VARCHAR) FROM ret
UNION ALL SELECT 'metrica_retencao', 'clientes_ativos / clientes_base (M0)'""")),
    "insights_cohort": Entry(
        lambda s, d: I.insights_cohort(C.cohort_summary(_sales(s, d), dates=datas(s, d))),
        _cohort_sql("""
SELECT 'media' AS topico, unnest(['m1', 'm2', 'm3']) AS chave, unnest([media_m1, media_m2, media_m3]) AS valor, CAST(NULL AS VARCHAR) AS texto FROM medias
UNION ALL SELECT grupo, CAST(posicao AS VARCHAR), retencao_m1, coorte FROM extremos""", _BESTS, _MEANS)),
    "lifecycle_status": Entry(
        lambda s, d: L.lifecycle_status(_life_plain(s, d), AS_OF),
        over_sales(_LIFE, select="SELECT cliente_id, strftime(m, '%Y-%m') AS mes_ref, status FROM ciclo")),
    "lifecycle_counts": Entry(
        lambda s, d: L.lifecycle_counts(_life_plain(s, d), AS_OF, dates=datas(s, d)),
        over_sales(_LIFE, select="SELECT strftime(m, '%Y-%m') AS mes_ref, status, COUNT(*) AS clientes FROM ciclo GROUP BY 1, 2")),
    "churn_by_channel": Entry(
        lambda s, d: L.churn_by_channel(_life(s, d), AS_OF),
        over_sales(_LIFE, select="""
SELECT canal, COUNT(*) AS clientes, COUNT(*) FILTER (status IN ('Lost', 'Inativo')) AS perdidos,
       (CAST(COUNT(*) FILTER (status IN ('Lost', 'Inativo')) AS DOUBLE) / COUNT(*)) AS taxa_churn
FROM ciclo WHERE m = DATE '2001-08-01' GROUP BY canal""")),
    "time_to_lost": Entry(
        lambda s, d: L.time_to_lost(_life(s, d), AS_OF),
        over_sales(_LIFE, select="""
SELECT canal, COUNT(*) AS clientes, (AVG(date_diff('month', entrada, perda))) AS meses_ate_lost
FROM (SELECT cliente_id, canal, entrada, MIN(m) FILTER (status = 'Lost') AS perda FROM ciclo GROUP BY ALL) WHERE perda IS NOT NULL GROUP BY canal""")),
    "reactivations": Entry(
        lambda s, d: L.reactivations(_life_plain(s, d), AS_OF),
        over_sales(
            "r AS (SELECT DISTINCT cliente_id, mes FROM vendas WHERE tipo_produto = 'recorrente')",
            "g AS (SELECT mes, LEAD(mes) OVER (PARTITION BY cliente_id ORDER BY mes) AS volta FROM r)",
            "h AS (SELECT volta IS NOT NULL AS voltou, CASE WHEN volta IS NULL THEN date_diff('month', mes, DATE '2001-08-01') ELSE date_diff('month', mes, volta) - 1 END AS vazios FROM g)",
            select="""
SELECT CAST(vazios AS INTEGER) AS meses_fora, COUNT(*) AS reativacoes,
       (CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM h WHERE vazios >= 3)) AS taxa_reativacao
FROM h WHERE voltou AND vazios >= 3 GROUP BY 1""")),
    "W_gap_months": Entry(
        lambda s, d: L.gap_months(_life_plain(s, d)),
        over_sales("r AS (SELECT DISTINCT cliente_id, mes FROM vendas WHERE tipo_produto = 'recorrente')", select="""
SELECT cliente_id, strftime(mes, '%Y-%m') AS mes_ref,
       CAST(date_diff('month', LAG(mes) OVER (PARTITION BY cliente_id ORDER BY mes), mes) - 1 AS INTEGER) AS meses_sem_recorrente FROM r""")),
}
