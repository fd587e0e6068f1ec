"""ABC, Pareto, Gini and client queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import Entry, over_sales
from catalog.tables import AS_OF, vendas
from vendaflux.functions import measures as M
from vendaflux.operators import abc as A
from vendaflux.operators import filters as X
from vendaflux.operators import insights as I
from vendaflux.plans.analyses import abc_params

_ABC = """cli AS (SELECT cliente_id, SUM(receita) AS x FROM vendas GROUP BY 1),
abc AS (
  SELECT row_number() OVER (ORDER BY x DESC, cliente_id) AS posicao_ranking, cliente_id, x, CAST(x AS DOUBLE) AS receita,
         CAST(x AS DOUBLE) / CAST(SUM(x) OVER () AS DOUBLE) AS pct_receita,
         CAST(SUM(x) OVER (ORDER BY x DESC, cliente_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(SUM(x) OVER () AS DOUBLE) AS pct_acumulado,
         CASE WHEN pct_acumulado <= 0.80::DOUBLE THEN 'A' WHEN pct_acumulado <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS classe_abc
  FROM cli)"""


def _keyed(key: str, source: str) -> str:
    """ABC inside each value of ``key``."""
    return f"""kc AS (SELECT {key}, cliente_id, SUM(receita) AS x FROM {source} GROUP BY 1, 2),
kabc AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY x DESC, cliente_id) AS posicao_ranking, cliente_id, x, CAST(x AS DOUBLE) AS receita,
         CAST(x AS DOUBLE) / CAST(SUM(x) OVER (PARTITION BY {key}) AS DOUBLE) AS pct_receita,
         CAST(SUM(x) OVER (PARTITION BY {key} ORDER BY x DESC, cliente_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           / CAST(SUM(x) OVER (PARTITION BY {key}) AS DOUBLE) AS pct_acumulado,
         CASE WHEN pct_acumulado <= 0.80::DOUBLE THEN 'A' WHEN pct_acumulado <= 0.95::DOUBLE THEN 'B' ELSE 'C' END AS classe_abc
  FROM kc)"""


_YEARS = "anos AS (SELECT *, CAST(year(data) AS INTEGER) AS periodo FROM vendas)"
_QUARTERS = "tris AS (SELECT *, CAST(year(data) * 4 + quarter(data) - 1 AS INTEGER) AS periodo FROM vendas)"
_T = """t AS (SELECT COUNT(*) AS n, CAST(SUM(x) AS DOUBLE) AS total,
 COUNT(*) FILTER (classe_abc = 'A') AS na, COUNT(*) FILTER (classe_abc = 'B') AS nb, COUNT(*) FILTER (classe_abc = 'C') AS nc,
 COALESCE(CAST(SUM(x) FILTER (classe_abc = 'A') AS DOUBLE), 0) AS ra, COALESCE(CAST(SUM(x) FILTER (classe_abc = 'B') AS DOUBLE), 0) AS rb,
 COALESCE(CAST(SUM(x) FILTER (classe_abc = 'C') AS DOUBLE), 0) AS rc,
 CAST(SUM(x) FILTER (posicao_ranking <= 3) AS DOUBLE) AS t3, CAST(SUM(x) FILTER (posicao_ranking <= 10) AS DOUBLE) AS t10 FROM abc)"""
_RISK = "CASE WHEN (t10 / total) > 0.50 THEN 'CRÍTICO' WHEN (t10 / total) > 0.35 THEN 'ELEVADO' ELSE 'MODERADO' END"


def _metrics(where: str) -> str:
    return f"""metricas AS (
  SELECT cliente_id, SUM(receita) AS x, (CAST(SUM(receita) AS DOUBLE) / COUNT(*)) AS ticket_medio, COUNT(*) AS qtd_transacoes,
         COUNT(DISTINCT mes) AS meses_ativo, COUNT(DISTINCT produto) AS qtd_produtos, MIN(data) AS primeira_compra, MAX(data) AS ultima_compra,
         CAST(date_diff('month', MIN(data), MAX(data)) AS INTEGER) AS meses_relacionamento
  FROM vendas WHERE {where} GROUP BY 1)"""


_CONFIRMED = "receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '1996-08-01'"
_REPORT = """relatorio AS (
  SELECT a.posicao_ranking, cliente_id, d.canal, d.regional, d.gerencia, a.receita, ticket_medio, a.pct_receita, a.pct_acumulado, a.classe_abc,
         meses_ativo, qtd_transacoes, qtd_produtos, meses_relacionamento, primeira_compra, ultima_compra,
         CASE WHEN a.classe_abc = 'A' AND date_diff('month', ultima_compra, DATE '2001-08-01') >= 3 THEN 'SIM' ELSE 'NAO' END AS alerta_cliente_a_inativo
  FROM abc a JOIN metricas m USING (cliente_id) JOIN (SELECT DISTINCT cliente_id, canal, regional, gerencia FROM vendas) d USING (cliente_id))"""


def _abc_sql(select: str, *more: str) -> str:
    return over_sales(_ABC, *more, select=select)


def _report_sql(select: str) -> str:
    abc = _ABC.replace("FROM vendas GROUP BY 1", f"FROM vendas WHERE {_CONFIRMED} GROUP BY 1")
    return over_sales(abc, _metrics(_CONFIRMED), _REPORT, select=select)


def _clients(spark, d):
    return vendas(spark, d, "cliente_id", "receita")


def _dated(spark, d):
    return vendas(spark, d, "cliente_id", "data", "receita")


def _confirmed(spark, d):
    return X.horizon(X.effective_only(vendas(spark, d, "cliente_id", "produto", "data", "receita", "status_faturamento")), AS_OF, 60)


def _report(spark, d):
    return A.abc_client_report(_confirmed(spark, d), T.clientes(spark, d), AS_OF, T.datas(spark, d))


QUERIES = {
    "client_metrics": Entry(
        lambda s, d: A.client_metrics(_confirmed(s, d), T.datas(s, d)).withColumn("receita", M.as_double(F.col("receita"))),
        over_sales(_metrics(_CONFIRMED), select="SELECT * EXCLUDE (x), CAST(x AS DOUBLE) AS receita FROM metricas")),
    "client_revenue": Entry(
        lambda s, d: A.client_revenue(_clients(s, d)).withColumn("receita", M.as_double(F.col("receita"))).orderBy(F.desc("receita"), "cliente_id"),
        _abc_sql("SELECT cliente_id, receita FROM abc ORDER BY receita DESC, cliente_id")),
    "abc_classify": Entry(lambda s, d: A.abc_classify(_clients(s, d)), _abc_sql("SELECT * EXCLUDE (x) FROM abc")),
    "class_filter": Entry(lambda s, d: X.class_filter(A.abc_classify(_clients(s, d)), "A").select("cliente_id", "receita"),
                          _abc_sql("SELECT cliente_id, receita FROM abc WHERE classe_abc = 'A'")),
    "abc_client_report": Entry(_report, _report_sql("SELECT * FROM relatorio")),
    "upsell_candidates": Entry(lambda s, d: A.upsell_candidates(_report(s, d)).select("cliente_id", "canal", "receita", "qtd_produtos"),
                               _report_sql("SELECT cliente_id, canal, receita, qtd_produtos FROM relatorio WHERE classe_abc = 'B' AND qtd_produtos >= 2")),
    "abc_summary": Entry(
        lambda s, d: A.abc_summary(A.rank_and_classify(A.client_revenue(_clients(s, d)))),
        _abc_sql("""
SELECT 'clientes_total' AS kpi, CAST(n AS DOUBLE) AS valor, 'Total de clientes na base' AS descricao FROM t
UNION ALL SELECT 'receita_total', total, 'Receita total no período (R$)' FROM t
UNION ALL SELECT 'top_10_participacao', (t10 / total), '% da receita concentrada nos 10 maiores clientes' FROM t
UNION ALL SELECT 'classe_A_clientes', CAST(na AS DOUBLE), 'Quantidade de clientes Classe A' FROM t
UNION ALL SELECT 'classe_A_participacao', (ra / total), '% da receita gerada pela Classe A' FROM t
UNION ALL SELECT 'classe_A_pct_clientes', (CAST(na AS DOUBLE) / n), '% dos clientes que são Classe A' FROM t
UNION ALL SELECT 'classe_B_clientes', CAST(nb AS DOUBLE), 'Quantidade de clientes Classe B' FROM t
UNION ALL SELECT 'classe_B_participacao', (rb / total), '% da receita gerada pela Classe B' FROM t
UNION ALL SELECT 'classe_C_clientes', CAST(nc AS DOUBLE), 'Quantidade de clientes Classe C' FROM t
UNION ALL SELECT 'classe_C_participacao', (rc / total), '% da receita gerada pela Classe C' FROM t""", _T)),
    "abc_distribution": Entry(
        lambda s, d: A.abc_distribution(_clients(s, d)),
        _abc_sql("SELECT classe_abc AS classe, COUNT(*) AS clientes, CAST(SUM(x) AS DOUBLE) AS receita_classe FROM abc GROUP BY 1")),
    "top_n_share": Entry(
        lambda s, d: A.top_n_share(_clients(s, d)),
        _abc_sql("""
SELECT CAST(k AS INTEGER) AS top_n, ((SELECT CAST(SUM(x) AS DOUBLE) FROM abc WHERE posicao_ranking <= k) / (SELECT CAST(SUM(x) AS DOUBLE) FROM abc)) AS participacao
FROM (SELECT unnest([1, 3, 10]) AS k)""")),
    "pareto_points": Entry(
        lambda s, d: A.pareto_points(A.rank_and_classify(A.client_revenue(_clients(s, d)))),
        _abc_sql("""SELECT posicao_ranking, cliente_id, receita, (pct_acumulado * 100) AS pct_acumulado, classe_abc
FROM abc WHERE posicao_ranking <= 50""")),
    "concentration_risk": Entry(
        lambda s, d: A.concentration_risk(_clients(s, d)),
        _abc_sql(f"SELECT (t10 / total) AS top_10_participacao, {_RISK} AS nivel_risco FROM t", _T)),
    "inactive_clients": Entry(
        lambda s, d: A.inactive_clients(_dated(s, d), AS_OF),
        over_sales(select="""
SELECT COUNT(*) AS clientes_inativos FROM (SELECT cliente_id, MAX(data) AS u FROM vendas WHERE receita > 0 GROUP BY 1 HAVING SUM(receita) > 0)
WHERE date_diff('month', u, DATE '2001-08-01') >= 3""")),
    "abc_by_channel": Entry(
        lambda s, d: A.abc_by_channel(vendas(s, d, "cliente_id", "canal", "receita")),
        over_sales(_keyed("canal", "vendas"), select="SELECT * EXCLUDE (x) FROM kabc")),
    "abc_over_time": Entry(
        lambda s, d: A.abc_over_time(_dated(s, d)),
        over_sales(_YEARS, _keyed("periodo", "anos"), select="""
SELECT periodo, COUNT(*) AS clientes, (COALESCE(CAST(SUM(x) FILTER (classe_abc = 'A') AS DOUBLE), 0) / CAST(SUM(x) AS DOUBLE)) AS classe_A_participacao,
       (CAST(COUNT(*) FILTER (classe_abc = 'A') AS DOUBLE) / COUNT(*)) AS classe_A_pct_clientes,
       (CAST(SUM(x) FILTER (posicao_ranking <= 10) AS DOUBLE) / CAST(SUM(x) AS DOUBLE)) AS top_10_participacao
FROM kabc GROUP BY 1""")),
    "W_class_prev": Entry(
        lambda s, d: A.class_previous(_dated(s, d)),
        over_sales(_YEARS, _keyed("periodo", "anos"), select="""
SELECT a.cliente_id, a.periodo, a.receita, a.classe_abc, b.classe_abc AS classe_anterior
FROM kabc a LEFT JOIN kabc b ON b.cliente_id = a.cliente_id AND b.periodo = a.periodo - 1""")),
    "abc_migration": Entry(
        lambda s, d: A.abc_migration(_dated(s, d)),
        over_sales(_YEARS, _keyed("periodo", "anos"), select="""
SELECT periodo, COALESCE(c0, 'novo') AS de, COALESCE(c1, 'perdido') AS para, COUNT(*) AS clientes, CAST(SUM(COALESCE(x1, x0)) AS DOUBLE) AS receita
FROM (SELECT COALESCE(a.periodo, CAST(b.periodo + 1 AS INTEGER)) AS periodo, b.classe_abc AS c0, a.classe_abc AS c1, a.x AS x1, b.x AS x0
      FROM kabc a FULL JOIN kabc b ON b.cliente_id = a.cliente_id AND b.periodo = a.periodo - 1)
WHERE periodo > (SELECT MIN(periodo) FROM kabc) AND periodo <= (SELECT MAX(periodo) FROM kabc) GROUP BY 1, 2, 3""")),
    "abc_over_time_quarter": Entry(
        lambda s, d: A.abc_over_time(_dated(s, d), "trimestre"),
        over_sales(_QUARTERS, _keyed("periodo", "tris"), select="""
SELECT (periodo // 4) || '-T' || (periodo % 4 + 1) AS periodo, COUNT(*) AS clientes,
       COALESCE(CAST(SUM(x) FILTER (classe_abc = 'A') AS DOUBLE), 0) / CAST(SUM(x) AS DOUBLE) AS classe_A_participacao,
       CAST(COUNT(*) FILTER (classe_abc = 'A') AS DOUBLE) / COUNT(*) AS classe_A_pct_clientes,
       CAST(SUM(x) FILTER (posicao_ranking <= 10) AS DOUBLE) / CAST(SUM(x) AS DOUBLE) AS top_10_participacao
FROM kabc GROUP BY kabc.periodo""")),
    "abc_migration_quarter": Entry(
        lambda s, d: A.abc_migration(_dated(s, d), "trimestre"),
        over_sales(_QUARTERS, _keyed("periodo", "tris"), select="""
SELECT (q // 4) || '-T' || (q % 4 + 1) AS periodo, COALESCE(c0, 'novo') AS de, COALESCE(c1, 'perdido') AS para, COUNT(*) AS clientes,
       CAST(SUM(COALESCE(x1, x0)) AS DOUBLE) AS receita
FROM (SELECT COALESCE(a.periodo, b.periodo + 1) AS q, b.classe_abc AS c0, a.classe_abc AS c1, a.x AS x1, b.x AS x0
      FROM kabc a FULL JOIN kabc b ON b.cliente_id = a.cliente_id AND b.periodo = a.periodo - 1)
WHERE q > (SELECT MIN(periodo) FROM kabc) AND q <= (SELECT MAX(periodo) FROM kabc) GROUP BY q, 2, 3""")),
    "gini": Entry(
        lambda s, d: A.gini(_clients(s, d)),
        over_sales("g AS (SELECT x, row_number() OVER (ORDER BY x, cliente_id DESC) AS i, COUNT(*) OVER () AS n FROM (SELECT cliente_id, SUM(receita) AS x FROM vendas GROUP BY 1))", select="""
SELECT COUNT(*) AS clientes, round(2 * SUM(CAST(i AS DOUBLE) * CAST(x AS DOUBLE)) / (COUNT(*) * CAST(SUM(x) AS DOUBLE)) - (COUNT(*) + 1.0::DOUBLE) / COUNT(*), 8) AS gini FROM g""")),
    "declining_a_clients": Entry(
        lambda s, d: A.declining_a_clients(_dated(s, d), AS_OF),
        _abc_sql("""
SELECT cliente_id, (rec / 3) AS media_recente, (ant / 3) AS media_anterior
FROM (SELECT cliente_id, COALESCE(CAST(SUM(receita) FILTER (mes >= DATE '2001-06-01') AS DOUBLE), 0) AS rec,
             COALESCE(CAST(SUM(receita) FILTER (mes >= DATE '2001-03-01' AND mes < DATE '2001-06-01') AS DOUBLE), 0) AS ant
      FROM vendas GROUP BY 1) JOIN abc USING (cliente_id) WHERE classe_abc = 'A' AND rec < ant""")),
    "top_clients": Entry(
        lambda s, d: A.top_clients(X.horizon(_dated(s, d).filter("receita > 0"), AS_OF, 60)),
        over_sales(select="""
SELECT cliente_id, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas WHERE receita > 0 AND data >= DATE '1996-08-01'
GROUP BY 1 ORDER BY SUM(receita) DESC, cliente_id LIMIT 10""")),
    "params_abc": Entry(
        lambda s, d: abc_params(_clients(s, d)),
        over_sales(select="""
SELECT 'regra_abc' AS parametro, 'A até 80%, B até 95%, C restante' AS valor UNION ALL SELECT 'threshold_classe_a', '0.8' UNION ALL SELECT 'threshold_classe_b', '0.95'
UNION ALL SELECT 'total_clientes', CAST(COUNT(DISTINCT cliente_id) AS VARCHAR) FROM vendas
UNION ALL SELECT 'periodo_dados', 'Conforme base_vendas_historica.csv'""")),
    "insights_abc": Entry(
        lambda s, d: I.insights_abc(A.rank_and_classify(A.client_revenue(_clients(s, d)))),
        _abc_sql(f"""
SELECT 'risco' AS topico, 'nivel' AS chave, (t10 / total) AS valor, {_RISK} AS texto FROM t
UNION ALL SELECT 'concentracao', 'top_10', (t10 / total), NULL FROM t
UNION ALL SELECT 'concentracao', 'top_3', (t3 / total), NULL FROM t
UNION ALL SELECT 'classe_A', 'pct_clientes', (CAST(na AS DOUBLE) / n), NULL FROM t
UNION ALL SELECT 'classe_A', 'pct_receita', (ra / total), NULL FROM t
UNION ALL SELECT 'classe_B', 'clientes', CAST(nb AS DOUBLE), NULL FROM t
UNION ALL SELECT 'classe_C', 'clientes', CAST(nc AS DOUBLE), NULL FROM t
UNION ALL SELECT 'classe_C', 'pct_receita', (rc / total), NULL FROM t""", _T)),
}
