"""Actual against target, and the decomposition of the change."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import Entry, over_sales, over_targets
from catalog.tables import AS_OF, datas, metas, vendas
from vendaflux.operators import decompose as D
from vendaflux.operators import filters as X
from vendaflux.operators import gap as G
from vendaflux.operators import insights as I
from vendaflux.plans.analyses import gap_params, month_cells

JULY = date(2001, 7, 1)  # the last full month of the test tables

_MONTHLY = """mensal AS (
  SELECT mes_ref, CAST(r AS DOUBLE) AS realizado, CAST(g AS DOUBLE) AS meta, CAST(r - g AS DOUBLE) AS gap,
         round_even(CAST(r - g AS DOUBLE) / CAST(g AS DOUBLE), 4) AS gap_pct,
         CASE WHEN gap_pct > 0.02::DOUBLE THEN 'Acima' WHEN gap_pct < -0.02::DOUBLE THEN 'Abaixo' ELSE 'Na Meta' END AS status
  FROM (SELECT mes_ref, SUM(receita) AS r FROM vendas GROUP BY 1) JOIN (SELECT mes_ref, SUM(meta_receita) AS g FROM metas GROUP BY 1) USING (mes_ref))"""
_DETAIL = """det AS (
  SELECT mes_ref, canal, regional, produto, CAST(r AS DOUBLE) AS realizado, CAST(meta_receita AS DOUBLE) AS meta_receita, r AS rx, meta_receita AS mx,
         r - meta_receita AS gx, CAST(r - meta_receita AS DOUBLE) AS gap,
         COALESCE(CASE WHEN meta_receita <> 0 THEN CAST(r - meta_receita AS DOUBLE) / CAST(meta_receita AS DOUBLE) END, 0) AS gap_pct,
         CASE WHEN gap_pct > 0.02::DOUBLE THEN 'Acima' WHEN gap_pct < -0.02::DOUBLE THEN 'Abaixo' ELSE 'Na Meta' END AS status
  FROM (SELECT mes_ref, canal, regional, produto, SUM(receita) AS r FROM vendas GROUP BY 1, 2, 3, 4)
  LEFT JOIN metas USING (mes_ref, canal, regional, produto))"""


def _decomp(by: str, months: str) -> str:
    """Two-month comparison with clients and tickets, one CTE per period and a full join."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in by.split(", "))
    keys = ", ".join(f"COALESCE(a.{k}, b.{k}) AS {k}" for k in by.split(", "))
    return f"""{months},
p1 AS (SELECT {by}, COUNT(DISTINCT cliente_id) AS c, SUM(receita) AS r FROM vendas WHERE mes = (SELECT m1 FROM meses2) GROUP BY ALL),
p0 AS (SELECT {by}, COUNT(DISTINCT cliente_id) AS c, SUM(receita) AS r FROM vendas WHERE mes = (SELECT m0 FROM meses2) GROUP BY ALL),
pj AS (SELECT {keys}, COALESCE(b.c, 0) AS c0, COALESCE(a.c, 0) AS c1, COALESCE(b.r, 0) AS r0, COALESCE(a.r, 0) AS r1,
              COALESCE(CAST(b.r AS DOUBLE) / b.c, 0) AS t0, COALESCE(CAST(a.r AS DOUBLE) / a.c, 0) AS t1
       FROM p1 a FULL JOIN p0 b ON {on}),
decomp AS (SELECT {by}, c0 AS clientes_ant, c1 AS clientes_atual, (t0) AS ticket_ant, (t1) AS ticket_atual,
              ((c1 - c0) * t0) AS efeito_volume, (c0 * (t1 - t0)) AS efeito_preco, ((c1 - c0) * (t1 - t0)) AS efeito_cruzado,
              CAST(r1 - r0 AS DOUBLE) AS gap_total, CAST(r0 AS DOUBLE) AS receita_ant, CAST(r1 AS DOUBLE) AS receita_atual,
              (SELECT strftime(m0, '%Y-%m') FROM meses2) AS mes_anterior, (SELECT strftime(m1, '%Y-%m') FROM meses2) AS mes_atual FROM pj)"""


_LAST2 = """meses2 AS (SELECT MAX(mes) AS m1, (SELECT MAX(mes) FROM vendas WHERE mes < (SELECT MAX(mes) FROM vendas)) AS m0 FROM vendas)"""
_JULY2 = "meses2 AS (SELECT DATE '2001-07-01' AS m1, DATE '2001-06-01' AS m0)"
_ROLLING = """a AS (SELECT canal, COUNT(DISTINCT cliente_id) AS c, SUM(receita) AS r, CAST(SUM(receita) AS DOUBLE) / COUNT(*) AS t
  FROM vendas WHERE data >= DATE '2001-07-01' AND receita > 0 GROUP BY 1),
b AS (SELECT canal, COUNT(DISTINCT cliente_id) AS c, SUM(receita) AS r, CAST(SUM(receita) AS DOUBLE) / COUNT(*) AS t
  FROM vendas WHERE data >= DATE '2001-06-01' AND data < DATE '2001-07-01' AND receita > 0 GROUP BY 1),
j AS (SELECT COALESCE(a.canal, b.canal) AS canal, COALESCE(b.c, 0) AS c0, COALESCE(a.c, 0) AS c1, COALESCE(b.t, 0) AS t0, COALESCE(a.t, 0) AS t1,
             COALESCE(a.r, 0) - COALESCE(b.r, 0) AS g FROM a FULL JOIN b ON a.canal = b.canal),
decomp AS (SELECT canal, c0 AS clientes_ant, c1 AS clientes_atual, (t0) AS ticket_ant, (t1) AS ticket_atual,
  ((c1 - c0) * t0) AS efeito_volume, (c0 * (t1 - t0)) AS efeito_preco, ((c1 - c0) * (t1 - t0)) AS efeito_cruzado,
  CAST(g AS DOUBLE) AS gap_total FROM j)"""
_TOTALS = """tot AS (SELECT round(SUM(efeito_volume), 2) AS v, round(SUM(efeito_preco), 2) AS p, round(SUM(efeito_cruzado), 2) AS x,
  round(SUM(gap_total), 2) AS g FROM decomp)"""
_CHECK = """SELECT round(SUM(efeito_volume + efeito_preco + efeito_cruzado), 2) AS soma_efeitos, round(SUM(gap_total), 2) AS gap_real,
  round(SUM(efeito_volume + efeito_preco + efeito_cruzado) - SUM(gap_total), 2) + 0.0::DOUBLE AS diferenca FROM decomp"""


def _det_sql(select: str, *more: str) -> str:
    return over_targets(_DETAIL, *more, select=select)


def _v(spark, d):
    return vendas(spark, d, "data", "canal", "regional", "produto", "receita")


def _totals(spark, d):
    """Date and revenue only: no dimension is joined."""
    return vendas(spark, d, "data", "receita")


def _cv(spark, d):
    return vendas(spark, d, "data", "canal", "cliente_id", "receita")


def _dates(spark, d):
    """Every date of the billed lines, from the orders alone (each order has lines)."""
    return datas(spark, d)


def _detail(spark, d):
    return G.gap_detail(_v(spark, d), metas(spark, d))


def _insights(spark, d):
    decomp = D.decompose_gap(_cv(spark, d), last_month=JULY, dates=_dates(spark, d))
    return I.insights_gap(_v(spark, d), metas(spark, d), decomp)


_MIX = """q AS (SELECT produto, CAST(SUM(quantidade) FILTER (mes = DATE '2001-06-01') AS DOUBLE) AS q0,
  CAST(SUM(receita) FILTER (mes = DATE '2001-06-01') AS DOUBLE) AS r0,
  COALESCE(CAST(SUM(quantidade) FILTER (mes = DATE '2001-07-01') AS DOUBLE), 0) AS q1,
  COALESCE(CAST(SUM(receita) FILTER (mes = DATE '2001-07-01') AS DOUBLE), 0) AS r1
  FROM vendas WHERE mes IN (DATE '2001-06-01', DATE '2001-07-01') GROUP BY 1),
s AS (SELECT SUM(q0) AS tq0, SUM(q1) AS tq1, SUM(r0) AS tr0, SUM(r1) AS tr1 FROM q),
e AS (SELECT q.*, s.*, COALESCE(r0 / q0, tr0 / tq0) AS p0, COALESCE(q0, 0) / tq0 AS s0, q1 / tq1 AS s1 FROM q, s)"""


QUERIES = {
    "monthly_realised": Entry(lambda s, d: G.monthly_realised(vendas(s, d, "data", "receita")),
                              over_sales(select="SELECT mes_ref, CAST(SUM(receita) AS DOUBLE) AS realizado FROM vendas GROUP BY 1")),
    "monthly_target": Entry(lambda s, d: G.monthly_target(metas(s, d)),
                            over_targets(select="SELECT mes_ref, CAST(SUM(meta_receita) AS DOUBLE) AS meta FROM metas GROUP BY 1")),
    "detail_realised": Entry(lambda s, d: G.detail_realised(_v(s, d)), over_sales(select="""
SELECT mes_ref, canal, regional, produto, CAST(SUM(receita) AS DOUBLE) AS realizado FROM vendas GROUP BY 1, 2, 3, 4""")),
    "month_cells": Entry(lambda s, d: month_cells(_v(s, d)).withColumn("receita", F.col("receita").cast("double")), over_sales(select="""
SELECT mes AS data, canal, regional, produto, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas GROUP BY 1, 2, 3, 4""")),
    "detail_kpis": Entry(
        lambda s, d: G.detail_kpis(X.horizon(X.effective_only(vendas(
            s, d, "data", "canal", "regional", "produto", "cliente_id", "receita", "status_faturamento")), AS_OF, 24)),
        over_sales(select="""
SELECT mes_ref, canal, regional, produto, CAST(SUM(receita) AS DOUBLE) AS realizado, COUNT(DISTINCT cliente_id) AS clientes_ativos,
       (CAST(SUM(receita) AS DOUBLE) / COUNT(*)) AS ticket_medio
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '1999-08-01' GROUP BY 1, 2, 3, 4""")),
    "gap_monthly": Entry(lambda s, d: G.gap_monthly(_totals(s, d), metas(s, d)), over_targets(_MONTHLY, select="SELECT * FROM mensal")),
    "J_month_inner": Entry(
        lambda s, d: G.monthly_realised(vendas(s, d, "data", "receita")).join(G.monthly_target(metas(s, d)), "mes_ref"),
        over_targets(_MONTHLY, select="SELECT mes_ref, realizado, meta FROM mensal")),
    "gap_detail": Entry(_detail, _det_sql("SELECT * EXCLUDE (rx, mx, gx) FROM det")),
    "J_detail_left": Entry(
        lambda s, d: G.gap_detail(_v(s, d), metas(s, d).withColumn("forecast_receita", F.round(F.col("meta_receita") * F.lit("0.9").cast("decimal(2,1)"), 4)))
        .select("mes_ref", "canal", "regional", "produto", "realizado", "meta_receita", "forecast_receita"),
        _det_sql("SELECT mes_ref, canal, regional, produto, realizado, meta_receita, CAST(CAST(mx * 0.9 AS DECIMAL(28,4)) AS DOUBLE) AS forecast_receita FROM det")),
    "gap_status": Entry(
        lambda s, d: _detail(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("celulas")),
        _det_sql("SELECT status, COUNT(*) AS celulas FROM det GROUP BY 1")),
    "status_counts": Entry(lambda s, d: G.status_counts(G.gap_monthly(_totals(s, d), metas(s, d))),
                           over_targets(_MONTHLY, select="SELECT status, COUNT(*) AS meses FROM mensal GROUP BY 1")),
    "status_filter": Entry(lambda s, d: X.status_filter(G.gap_monthly(_totals(s, d), metas(s, d)), "Abaixo").select("mes_ref", "gap"),
                           over_targets(_MONTHLY, select="SELECT mes_ref, gap FROM mensal WHERE status = 'Abaixo'")),
    "gap_series_points": Entry(
        lambda s, d: G.gap_series_points(G.gap_monthly(_totals(s, d), metas(s, d))),
        over_targets(_MONTHLY, select="SELECT mes_ref, realizado, meta, CASE WHEN gap >= 0 THEN 'positivo' ELSE 'negativo' END AS sinal FROM mensal")),
    "gap_drivers_product": Entry(lambda s, d: G.gap_drivers(_detail(s, d), "produto"),
                                 _det_sql("SELECT produto, COALESCE(CAST(SUM(gx) AS DOUBLE), 0) AS gap FROM det GROUP BY 1")),
    "gap_drivers_channel": Entry(lambda s, d: G.gap_drivers(_detail(s, d), "canal"),
                                 _det_sql("SELECT canal, COALESCE(CAST(SUM(gx) AS DOUBLE), 0) AS gap FROM det GROUP BY 1")),
    "extremes": Entry(
        lambda s, d: G.gap_extremes(_detail(s, d), "produto"),
        _det_sql("""SELECT arg_min(produto, g) AS pior, MIN(g) AS pior_valor, arg_max(produto, g) AS melhor, MAX(g) AS melhor_valor FROM dp""",
                 "dp AS (SELECT produto, CAST(SUM(gx) AS DOUBLE) AS g FROM det GROUP BY 1)")),
    "gap_worst_cells": Entry(
        lambda s, d: G.gap_worst_cells(_detail(s, d)),
        _det_sql("SELECT mes_ref, canal, regional, produto, realizado, meta_receita, gap FROM det WHERE status = 'Abaixo' ORDER BY gap, mes_ref, canal, regional, produto LIMIT 10")),
    "gap_waterfall": Entry(
        lambda s, d: G.gap_waterfall(_detail(s, d), "2001-07"),
        _det_sql("""SELECT mes_ref, canal, CAST(SUM(gx) AS DOUBLE) AS gap, CAST(SUM(SUM(gx)) OVER (ORDER BY canal) AS DOUBLE) AS gap_acumulado
FROM det WHERE mes_ref = '2001-07' AND gx IS NOT NULL GROUP BY 1, 2""")),
    "gap_grouping_sets": Entry(
        lambda s, d: G.gap_grouping_sets(_v(s, d), metas(s, d)),
        over_targets(
            """u AS (SELECT mes_ref, canal, regional, produto, CAST(receita AS DECIMAL(28,4)) AS r, CAST(NULL AS DECIMAL(28,4)) AS m FROM vendas
UNION ALL SELECT mes_ref, canal, regional, produto, NULL, meta_receita FROM metas)""",
            """gs AS (SELECT 'mes' AS nivel, mes_ref, NULL AS canal, NULL AS regional, NULL AS produto, COALESCE(SUM(r), 0) AS rx, SUM(m) AS mx FROM u GROUP BY mes_ref
UNION ALL SELECT 'canal', mes_ref, canal, NULL, NULL, COALESCE(SUM(r), 0), SUM(m) FROM u GROUP BY mes_ref, canal
UNION ALL SELECT 'regional', mes_ref, NULL, regional, NULL, COALESCE(SUM(r), 0), SUM(m) FROM u GROUP BY mes_ref, regional
UNION ALL SELECT 'produto', mes_ref, NULL, NULL, produto, COALESCE(SUM(r), 0), SUM(m) FROM u GROUP BY mes_ref, produto)""", select="""
SELECT nivel, mes_ref, canal, regional, produto, CAST(rx AS DOUBLE) AS realizado, CAST(mx AS DOUBLE) AS meta, CAST(rx - mx AS DOUBLE) AS gap,
       round_even(CASE WHEN mx <> 0 THEN CAST(rx - mx AS DOUBLE) / CAST(mx AS DOUBLE) END, 4) AS gap_pct,
       CASE WHEN mx IS NULL THEN NULL WHEN gap_pct > 0.02::DOUBLE THEN 'Acima' WHEN gap_pct < -0.02::DOUBLE THEN 'Abaixo' ELSE 'Na Meta' END AS status FROM gs""")),
    "target_by_channel": Entry(
        lambda s, d: G.target_by_channel(metas(s, d).filter(F.col("mes") >= F.lit(date(2000, 8, 1)))),
        over_targets(select="""
SELECT canal, COUNT(DISTINCT mes_ref) AS meses, CAST(SUM(meta_receita) AS DOUBLE) AS meta_total, (CAST(SUM(meta_receita) AS DOUBLE) / COUNT(*)) AS meta_media_mensal
FROM metas WHERE mes >= DATE '2000-08-01' GROUP BY 1""")),
    "month_coverage": Entry(
        lambda s, d: G.month_coverage(X.horizon(_totals(s, d).filter("receita > 0"), AS_OF, 24), metas(s, d).filter("meta_receita > 0")),
        over_targets(select="""
SELECT 'realizado' AS fonte, mes_ref AS mes, COUNT(*) AS registros FROM vendas WHERE receita > 0 AND data >= DATE '1999-08-01' GROUP BY 2
UNION ALL SELECT 'forecast', mes_ref, COUNT(*) FROM metas WHERE meta_receita > 0 GROUP BY 2""")),
    "key_coverage": Entry(
        lambda s, d: G.key_coverage(X.horizon(vendas(s, d, "data", "mes_ref"), AS_OF, 18), metas(s, d), "mes_ref"),
        over_targets(select="""
SELECT 'mes_ref_so_no_realizado' AS tipo, mes_ref AS valor FROM (SELECT DISTINCT mes_ref FROM vendas WHERE data >= DATE '2000-02-01') WHERE mes_ref NOT IN (SELECT mes_ref FROM metas)
UNION ALL SELECT 'mes_ref_so_no_forecast', mes_ref FROM (SELECT DISTINCT mes_ref FROM metas) WHERE mes_ref NOT IN (SELECT mes_ref FROM vendas WHERE data >= DATE '2000-02-01')""")),
    "channel_month_kpis": Entry(
        lambda s, d: D.channel_month_kpis(_cv(s, d), JULY),
        over_sales(select="""
SELECT canal, COUNT(DISTINCT cliente_id) AS clientes, CAST(SUM(receita) AS DOUBLE) AS receita, (CAST(SUM(receita) AS DOUBLE) / COUNT(DISTINCT cliente_id)) AS ticket_medio
FROM vendas WHERE mes = DATE '2001-07-01' GROUP BY 1""")),
    "channel_rolling_kpis": Entry(
        lambda s, d: D.channel_rolling_kpis(_cv(s, d), AS_OF),
        over_sales(select="""
SELECT canal, COUNT(DISTINCT cliente_id) AS clientes, CAST(SUM(receita) AS DOUBLE) AS receita, (CAST(SUM(receita) AS DOUBLE) / COUNT(*)) AS ticket_medio
FROM vendas WHERE data >= DATE '2001-07-01' AND receita > 0 GROUP BY 1""")),
    "decompose_gap": Entry(lambda s, d: D.decompose_gap(_cv(s, d), dates=_dates(s, d)), over_sales(_decomp("canal", _LAST2), select="SELECT * FROM decomp")),
    "decompose_gap_full_month": Entry(lambda s, d: D.decompose_gap(_cv(s, d), last_month=JULY, calendar=True),
                                      over_sales(_decomp("canal", _JULY2), select="SELECT * FROM decomp")),
    "decompose_gap_rolling": Entry(lambda s, d: D.decompose_gap_rolling(_cv(s, d), AS_OF), over_sales(_ROLLING, select="SELECT * FROM decomp")),
    "decompose_detail": Entry(
        lambda s, d: D.decompose_detail(vendas(s, d, "data", "canal", "produto", "cliente_id", "receita"), JULY, _dates(s, d)),
        over_sales(_decomp("canal, produto", _JULY2), select="SELECT * FROM decomp")),
    "decompose_mix": Entry(
        lambda s, d: D.decompose_mix(vendas(s, d, "data", "produto", "quantidade", "receita"), JULY, _dates(s, d)),
        over_sales(_MIX, select="""
SELECT round(MAX((tq1 - tq0) * tr0 / tq0), 2) AS efeito_volume, round(MAX(tq1) * SUM((s1 - s0) * p0), 2) AS efeito_mix,
       round(SUM(r1 - q1 * p0), 2) AS efeito_preco, round(MAX(tr1 - tr0), 2) AS gap_total FROM e""")),
    "effect_totals": Entry(
        lambda s, d: D.effect_totals(D.decompose_gap(_cv(s, d), last_month=JULY, dates=_dates(s, d))),
        over_sales(_decomp("canal", _JULY2), _TOTALS, select="""
SELECT v AS efeito_volume, p AS efeito_preco, x AS efeito_cruzado, g AS gap_total, CASE WHEN abs(v) > abs(p) THEN 'VOLUME' ELSE 'PREÇO' END AS efeito_dominante,
       (abs(v) / abs(g) * 100) AS pct_volume, (abs(p) / abs(g) * 100) AS pct_preco FROM tot""")),
    "decompose_check": Entry(lambda s, d: D.decompose_check(D.decompose_gap(_cv(s, d), last_month=JULY, dates=_dates(s, d))),
                             over_sales(_decomp("canal", _JULY2), select=_CHECK)),
    "decompose_check_rolling": Entry(lambda s, d: D.decompose_check(D.decompose_gap_rolling(_cv(s, d), AS_OF)),
                                     over_sales(_ROLLING, select=_CHECK)),
    "params_gap": Entry(lambda s, d: gap_params(metas(s, d)), over_targets(select="""
SELECT 'granularidade' AS parametro, 'mes_ref × canal × regional × produto' AS valor UNION ALL SELECT 'tolerancia_gap', '±2%'
UNION ALL SELECT 'metodo_decomposicao', 'Efeito Volume + Efeito Preço + Efeito Cruzado (aditivo)'
UNION ALL SELECT 'linhas_meta', CAST(COUNT(*) AS VARCHAR) FROM metas UNION ALL SELECT 'fonte_meta', 'forecast_mensal.csv'""")),
    "gap_figures": Entry(
        lambda s, d: G.gap_figures(G.gap_monthly(_v(s, d), metas(s, d))),
        over_targets(_MONTHLY, select="""
SELECT mes_ref, 'R$ ' || format('{:,}', CAST(round_even(realizado, 0) AS BIGINT)) AS realizado, 'R$ ' || format('{:,}', CAST(round_even(meta, 0) AS BIGINT)) AS meta,
       'R$ ' || CASE WHEN gap >= 0 THEN '+' ELSE '' END || format('{:,}', CAST(round_even(gap, 0) AS BIGINT)) AS gap,
       CASE WHEN gap_pct >= 0 THEN '+' ELSE '' END || printf('%.1f', gap_pct * 100) || '%' AS gap_pct FROM mensal""")),
    "insights_gap": Entry(_insights, over_targets(_MONTHLY, _DETAIL, _decomp("canal", _JULY2), _TOTALS,
        "ult AS (SELECT * FROM mensal ORDER BY mes_ref DESC LIMIT 1)", "dp AS (SELECT produto, CAST(SUM(gx) AS DOUBLE) AS g FROM det GROUP BY 1)",
        "dc AS (SELECT canal, CAST(SUM(gx) AS DOUBLE) AS g FROM det GROUP BY 1)", select="""
SELECT 'ultimo_mes' AS topico, 'realizado' AS chave, realizado AS valor, mes_ref AS texto FROM ult
UNION ALL SELECT 'ultimo_mes', 'meta', meta, mes_ref FROM ult UNION ALL SELECT 'ultimo_mes', 'gap', gap, mes_ref FROM ult
UNION ALL SELECT 'ultimo_mes', 'gap_pct', gap_pct, mes_ref FROM ult UNION ALL SELECT 'ultimo_mes', 'status', NULL, status FROM ult
UNION ALL SELECT 'meses', k, CAST((SELECT COUNT(*) FROM mensal WHERE status = k) AS DOUBLE), NULL FROM (SELECT unnest(['Acima', 'Na Meta', 'Abaixo']) AS k)
UNION ALL SELECT 'produto', 'detrator', MIN(g), arg_min(produto, g) FROM dp UNION ALL SELECT 'produto', 'destaque', MAX(g), arg_max(produto, g) FROM dp
UNION ALL SELECT 'canal', canal, g, CASE WHEN g < 0 THEN 'negativo' ELSE 'positivo' END FROM dc
UNION ALL SELECT 'decomposicao', 'gap_total', g, NULL FROM tot UNION ALL SELECT 'decomposicao', 'efeito_volume', v, NULL FROM tot
UNION ALL SELECT 'decomposicao', 'efeito_preco', p, NULL FROM tot UNION ALL SELECT 'decomposicao', 'efeito_cruzado', x, NULL FROM tot
UNION ALL SELECT 'decomposicao', 'pct_volume', (abs(v) / abs(g) * 100), NULL FROM tot UNION ALL SELECT 'decomposicao', 'pct_preco', (abs(p) / abs(g) * 100), NULL FROM tot
UNION ALL SELECT 'decomposicao', 'dominante', NULL, CASE WHEN abs(v) > abs(p) THEN 'VOLUME' ELSE 'PREÇO' END FROM tot
UNION ALL SELECT 'canal_efeito_volume', canal, round(efeito_volume, 2), NULL FROM decomp UNION ALL SELECT 'canal_efeito_preco', canal, round(efeito_preco, 2), NULL FROM decomp
UNION ALL SELECT 'canal_efeito_cruzado', canal, round(efeito_cruzado, 2), NULL FROM decomp""")),
}
