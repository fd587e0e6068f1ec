"""Product decline, and discount against ticket."""

from __future__ import annotations

from catalog.registry import Entry, over_sales
from catalog.tables import AS_OF, datas, vendas
from vendaflux.operators import adhoc as H
from vendaflux.operators import filters as X
from vendaflux.operators import insights as I
from vendaflux.plans.analyses import adhoc_params

_DELTA = """m AS (SELECT mes, row_number() OVER (ORDER BY mes DESC) AS ordem FROM (SELECT DISTINCT mes FROM vendas) QUALIFY ordem <= 5),
w AS (SELECT produto, COALESCE(CAST(SUM(receita) FILTER (ordem <= 2) AS DOUBLE), 0) / 2 AS r, COALESCE(CAST(SUM(receita) FILTER (ordem > 2) AS DOUBLE), 0) / 3 AS a
      FROM vendas JOIN m USING (mes) GROUP BY 1),
delta AS (SELECT produto, (r) AS media_recente, (a) AS media_anterior, (r - a) AS delta,
                 (CASE WHEN a <> 0 THEN (r - a) / a END) AS delta_pct FROM w)"""


def _pairs_cte(where: str) -> str:
    return f"""pares AS (
  SELECT cliente_id, canal, (CAST(SUM(receita) AS DOUBLE) / COUNT(*)) AS ticket_medio,
         round(AVG(CASE WHEN valor_tabela > 0 THEN CAST(valor_tabela - receita AS DOUBLE) / CAST(valor_tabela AS DOUBLE) ELSE 0.0::DOUBLE END), 8) AS desconto_medio,
         COUNT(*) AS transacoes
  FROM vendas WHERE {where} GROUP BY 1, 2 HAVING COUNT(*) >= 3)"""


_YEAR = "receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '2000-08-01'"
_LABEL = """CASE WHEN r IS NULL THEN NULL WHEN r >= 0.7 THEN 'forte positiva' WHEN r >= 0.3 THEN 'moderada positiva' WHEN r > -0.3 THEN 'fraca'
 WHEN r > -0.7 THEN 'moderada negativa' ELSE 'forte negativa' END"""


def _products(spark, d):
    return vendas(spark, d, "data", "produto", "receita")


def _billed(spark, d):
    return vendas(spark, d, "cliente_id", "canal", "data", "receita", "valor_tabela", "status_faturamento")


def _pairs(spark, d):
    return H.client_discount_ticket(_billed(spark, d), as_of=AS_OF)


def _delta(spark, d):
    return H.product_delta(_products(spark, d), dates=datas(spark, d))


def _all(spark, d):
    return vendas(spark, d, "cliente_id", "canal", "data", "produto", "receita", "valor_tabela", "status_faturamento")


QUERIES = {
    "product_month": Entry(
        lambda s, d: H.product_month(X.horizon(X.effective_only(vendas(s, d, "cliente_id", "data", "produto", "receita", "status_faturamento")), AS_OF, 6)),
        over_sales(select="""
SELECT mes_ref, produto, CAST(SUM(receita) AS DOUBLE) AS receita, COUNT(DISTINCT cliente_id) AS clientes_ativos, COUNT(*) AS transacoes
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '2001-02-01' GROUP BY 1, 2""")),
    "product_month_series": Entry(
        lambda s, d: H.product_month_series(_products(s, d)),
        over_sales(select="""
SELECT mes_ref, produto, CAST(SUM(receita) AS DOUBLE) AS receita,
       CAST(SUM(receita) - LAG(SUM(receita)) OVER (PARTITION BY produto ORDER BY mes_ref) AS DOUBLE) AS delta_mes FROM vendas GROUP BY 1, 2""")),
    "W_month_delta": Entry(
        lambda s, d: H.product_month_series(_products(s, d)).filter("delta_mes IS NOT NULL").select("mes_ref", "produto", "delta_mes"),
        over_sales(select="""
SELECT mes_ref, produto, CAST(SUM(receita) - LAG(SUM(receita)) OVER (PARTITION BY produto ORDER BY mes_ref) AS DOUBLE) AS delta_mes
FROM vendas GROUP BY 1, 2 QUALIFY delta_mes IS NOT NULL""")),
    "product_delta": Entry(lambda s, d: _delta(s, d), over_sales(_DELTA, select="SELECT * FROM delta")),
    "top_declines": Entry(
        lambda s, d: H.top_declines(_delta(s, d)),
        over_sales(_DELTA, select="SELECT * FROM delta WHERE delta < 0 ORDER BY delta, produto LIMIT 10")),
    "delta_bar_points": Entry(
        lambda s, d: H.delta_bar_points(_delta(s, d)),
        over_sales(_DELTA, select="SELECT produto, delta, CASE WHEN delta < 0 THEN 'queda' ELSE 'crescimento' END AS sinal FROM delta")),
    "seasonality_index": Entry(
        lambda s, d: H.seasonality_index(vendas(s, d, "data", "receita")),
        over_sales("q AS (SELECT mes, SUM(receita) AS x FROM vendas GROUP BY 1)", select="""
SELECT CAST(month(mes) AS INTEGER) AS mes_ano, COUNT(*) AS meses, (CAST(SUM(x) AS DOUBLE) / COUNT(*)) AS media,
       ((CAST(SUM(x) AS DOUBLE) / COUNT(*)) / ((SELECT CAST(SUM(x) AS DOUBLE) FROM q) / (SELECT COUNT(*) FROM q))) AS indice FROM q GROUP BY 1""")),
    "client_discount_ticket": Entry(_pairs, over_sales(_pairs_cte(_YEAR), select="SELECT * FROM pares")),
    "scatter_points": Entry(
        lambda s, d: H.scatter_points(_pairs(s, d)),
        over_sales(_pairs_cte(_YEAR), select="SELECT cliente_id, desconto_medio, ticket_medio FROM pares")),
    "pearson_discount_ticket": Entry(
        lambda s, d: H.pearson_discount_ticket(_pairs(s, d)),
        over_sales(_pairs_cte(_YEAR), select=f"""
SELECT n, r, {_LABEL} AS interpretacao FROM (SELECT COUNT(*) AS n, round(corr(desconto_medio, ticket_medio), 6) AS r FROM pares)""")),
    "trend_line": Entry(
        lambda s, d: H.trend_line(_pairs(s, d)),
        over_sales(_pairs_cte(_YEAR), select="""
SELECT round(regr_slope(ticket_medio, desconto_medio), 4) AS inclinacao, round(regr_intercept(ticket_medio, desconto_medio), 4) AS intercepto FROM pares""")),
    "discount_correlation": Entry(
        lambda s, d: H.discount_correlation(_billed(s, d), as_of=AS_OF),
        over_sales(_pairs_cte(_YEAR), select=f"""
SELECT n, r, inclinacao, intercepto, {_LABEL} AS interpretacao
FROM (SELECT COUNT(*) AS n, round(corr(desconto_medio, ticket_medio), 6) AS r, round(regr_slope(ticket_medio, desconto_medio), 4) AS inclinacao,
             round(regr_intercept(ticket_medio, desconto_medio), 4) AS intercepto FROM pares)""")),
    "top_products": Entry(
        lambda s, d: H.top_products(X.horizon(_products(s, d).filter("receita > 0"), AS_OF, 6)),
        over_sales(select="""
SELECT produto, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas WHERE receita > 0 AND data >= DATE '2001-02-01'
GROUP BY 1 ORDER BY SUM(receita) DESC, produto LIMIT 5""")),
    "params_adhoc": Entry(
        lambda s, d: adhoc_params(vendas(s, d, "data")),
        over_sales(_DELTA, select="""
SELECT 'janela_recente' AS parametro, strftime(MIN(mes) FILTER (ordem <= 2), '%Y-%m') || ' a ' || strftime(MAX(mes) FILTER (ordem <= 2), '%Y-%m') AS valor FROM m
UNION ALL SELECT 'janela_anterior', strftime(MIN(mes) FILTER (ordem > 2), '%Y-%m') || ' a ' || strftime(MAX(mes) FILTER (ordem > 2), '%Y-%m') FROM m
UNION ALL SELECT 'metodo_delta', 'média mensal' UNION ALL SELECT 'metodo_correlacao', 'Pearson'""")),
    "insights_adhoc": Entry(
        lambda s, d: I.insights_adhoc(_all(s, d), AS_OF),
        over_sales(_DELTA, _pairs_cte(_YEAR), select=f"""
SELECT 'queda' AS topico, CAST(row_number() OVER (ORDER BY delta, produto) AS VARCHAR) AS chave, delta AS valor, produto AS texto
FROM (SELECT * FROM delta WHERE delta < 0 ORDER BY delta, produto LIMIT 10)
UNION ALL SELECT 'correlacao', 'r', r, {_LABEL} FROM (SELECT round(corr(desconto_medio, ticket_medio), 6) AS r FROM pares)""")),
}
