"""Sources, extracts, filters, join and window building blocks, profile counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import tables as T
from catalog.registry import Entry, over_sales, over_targets
from catalog.tables import AS_OF, RECURRING, vendas
from vendaflux.functions import measures as M
from vendaflux.functions.months import calendar_parts, month_diff, month_key
from vendaflux.operators import filters as X
from vendaflux.operators import joins as J
from vendaflux.operators import profile as P
from vendaflux.operators.adhoc import last_months, latest_months, recent_prior
from vendaflux.operators.ranking import cumulative_share, global_rank, share_of_total
from vendaflux.operators.abc import client_revenue
from vendaflux.plans.materialise import ensure_checkpoint_dir
from vendaflux.sources import extracts as E
from vendaflux.sources import readers as R
from vendaflux.sources.writers import params_table, write_by_month, write_csv, write_results

_CONTRACT = ("data", "mes_ref", "cliente_id", "produto", "canal", "regional", "quantidade", "receita", "desconto_pct")


def _scan(spark, d):
    """The extract as CSV files with the columns in another order, read back by name."""
    v = vendas(spark, d, *reversed(_CONTRACT)).withColumnRenamed("cliente_id", "CLIENTE_ID")
    raw = v.withColumns({"mes_ref": F.lit("-"), "quantidade": F.col("quantidade").cast("bigint")})
    back = R.scan_sales(spark, write_csv(raw, _scratch(spark)), "csv")
    return back.select(*_CONTRACT).withColumns({
        "quantidade": F.col("quantidade").cast(dict(v.dtypes)["quantidade"]),
        "receita": F.col("receita").cast("double"), "desconto_pct": F.col("desconto_pct").cast("double")})


def _scan_targets(spark, d):
    """The targets as parquet files in another order of columns, read back by name."""
    m = T.metas(spark, d).select("meta_receita", "produto", "regional", "canal", "mes_ref")
    path = _scratch(spark)
    m.write.parquet(path)
    return R.scan_targets(spark, path).select("mes_ref", "canal", "regional", "produto", M.as_double(F.col("meta_receita")).alias("meta_receita"))


def _rename(spark, d):
    return R.rename_columns(T.table(spark, d, "customer"), {"c_custkey": "cliente_id", "c_mktsegment": "canal"}).select(
        "cliente_id", "canal")


def _standardise(spark, d):
    raw = T.table(spark, d, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("CLIENTE_ID"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Data"),
        F.when(F.col("o_orderstatus") == "P", F.lit("  ")).otherwise(F.col("o_orderstatus")).alias("Canal"),
        F.when(F.col("o_orderstatus") == "F", F.lit("n/d")).otherwise(F.lit("1.5")).alias("Receita"))
    clean = R.standardise(raw, fills={"canal": "Sem canal", "receita": "0"})
    return clean.groupBy("data", "canal").agg(
        F.count("cliente_id").alias("linhas"), F.sum("receita").cast("double").alias("receita"))


def _normalise(spark, d):
    v = vendas(spark, d, "canal", "receita")
    mapping = v.select("canal").distinct().filter(F.col("canal") != "BUILDING").select(
        F.col("canal").alias("de"), F.initcap("canal").alias("para"))
    return R.normalise_keys(v, "canal", mapping).groupBy("canal").agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("receita").cast("double").alias("receita"))


def _sums(v, *keys):
    return v.groupBy(*keys).agg(F.count(F.lit(1)).alias("linhas"), F.sum("receita").cast("double").alias("receita"))


def _full(spark, d):
    rows = vendas(spark, d, "data", "canal", "receita")
    months = latest_months(rows, 2)
    kept = rows.withColumn("_mes", F.trunc("data", "month")).join(F.broadcast(months), "_mes")  # two rows

    def month(n, name):
        return kept.filter(F.col("ordem") == n).groupBy("canal").agg(F.sum("receita").cast("double").alias(name))

    return J.full_by_key(month(2, "receita_ant"), month(1, "receita_atual"), "canal", ["receita_ant", "receita_atual"])


def _left_base(spark, d):
    from vendaflux.operators.cohort import cohort_cells

    return cohort_cells(vendas(spark, d, "cliente_id", "data", "receita")).select(
        month_key("_coorte").alias("coorte"), "periodo_idx", "clientes_ativos", "clientes_base")


def _contract(spark, d):
    v = vendas(spark, d, "cliente_id", "receita")
    terms = T.table(spark, d, "customer").filter(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("cliente_id"), (F.col("c_nationkey") / 100.0).alias("desconto_contratual"))
    return E.contract_discount(v, terms).groupBy("desconto_contratual").agg(
        F.count(F.lit(1)).alias("linhas"), F.sum("receita").cast("double").alias("receita"))


def _coverage(spark, d):
    v = X.horizon(vendas(spark, d, "data", "valor_tabela"), AS_OF, 12)
    return P.count_share(v.withColumn("status_desconto", M.discount_coverage(F.col("valor_tabela"))), "status_desconto")


def _bands(spark, d):
    v = X.horizon(vendas(spark, d, "data", "valor_tabela", "receita"), AS_OF, 12).filter("receita > 0 AND valor_tabela > 0")
    band = M.discount_band(M.discount_pct(F.col("valor_tabela"), F.col("receita")))
    return v.groupBy(band.alias("faixa_desconto")).agg(F.count(F.lit(1)).alias("registros"))


def _lookup(spark, d):
    v = vendas(spark, d, "produto", "quantidade")
    prices = {"ECONOMY": 100, "LARGE": 300, "MEDIUM": 200, "PROMO": 50, "SMALL": 120}
    return J.lookup(v, "produto", prices, "preco_base").groupBy("produto", "preco_base").agg(F.count(F.lit(1)).alias("linhas"))


def _scalars(spark, d):
    v = vendas(spark, d, "data", "receita")
    return v.select(
        "data", month_key("data").alias("mes_ref"), *calendar_parts("data"),
        month_diff(F.lit(AS_OF), "data").alias("diferenca_meses"), F.add_months("data", -6).alias("seis_meses_antes"),
        M.half_even(M.ratio(F.col("receita"), F.lit(1000000)), 4).alias("milhoes"),
        M.clip(F.col("receita").cast("double"), 1000.0, 50000.0).alias("limitada"),
        M.ratio_or_zero(F.col("receita"), F.lit(0)).alias("por_zero"))


def _scratch(spark) -> str:
    """A fresh folder next to the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/saida-{uuid.uuid4().hex}"


def _scan_csv(spark, d):
    """The extract written as CSV and read back with the declared types."""
    v = vendas(spark, d, "data", "cliente_id", "produto", "canal", "regional", "quantidade", "receita", "desconto_pct")
    path = write_csv(v.withColumns({"quantidade": F.col("quantidade").cast("bigint"), "custo": F.lit(None).cast("string")}).select(
        "data", F.lit("-").alias("mes_ref"), "cliente_id", "produto", "canal", "regional", "quantidade", "receita", "custo", "desconto_pct"),
        _scratch(spark))
    return R.scan_sales(spark, path, "csv").select(
        "data", "mes_ref", "cliente_id", "produto", "canal", "regional", "quantidade", F.col("receita").cast("double"),
        F.col("desconto_pct").cast("double"))


def _write_by_month(spark, d):
    """The extract written by month; the month filter then reads three folders only."""
    path = write_by_month(vendas(spark, d, "cliente_id", "mes_ref", "receita"), _scratch(spark))
    return _sums(spark.read.schema("cliente_id bigint, receita decimal(18,4), mes_ref string").parquet(path).filter(
        F.col("mes_ref").between("2001-04", "2001-06")), "mes_ref")


def _write_results(spark, d):
    """Result tables written by the executors, then the detail read back."""
    revenue = client_revenue(vendas(spark, d, "cliente_id", "receita")).withColumn("receita", M.as_double(F.col("receita")))
    paths = write_results({"resumo": revenue.agg(F.sum("receita").alias("receita")), "detalhe": revenue,
                           "parametros": params_table(spark, ordem="receita")}, _scratch(spark))
    return spark.read.parquet(paths["detalhe"])


_LIFE = """vida AS (
  SELECT cliente_id, MIN(data) AS primeira_compra, MAX(data) AS ultima_compra,
         COUNT(DISTINCT mes) AS meses_com_compra, COUNT(*) AS total_transacoes, SUM(receita) AS receita_total
  FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '1996-08-01' GROUP BY cliente_id)"""

QUERIES = {
    "scan_sales": Entry(_scan, over_sales(select="""
SELECT data, mes_ref, cliente_id, produto, canal, regional, quantidade, CAST(receita AS DOUBLE) AS receita,
       CAST(desconto_pct AS DOUBLE) AS desconto_pct FROM vendas""")),
    "write_csv": Entry(_scan_csv, over_sales(select="""
SELECT data, mes_ref, cliente_id, produto, canal, regional, CAST(quantidade AS BIGINT) AS quantidade, CAST(receita AS DOUBLE) AS receita,
       CAST(desconto_pct AS DOUBLE) AS desconto_pct FROM vendas""")),
    "write_by_month": Entry(_write_by_month, over_sales(select="""
SELECT mes_ref, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas WHERE mes_ref BETWEEN '2001-04' AND '2001-06' GROUP BY 1""")),
    "write_results": Entry(_write_results, over_sales(select="SELECT cliente_id, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas GROUP BY 1")),
    "scan_targets": Entry(
        _scan_targets,
        over_targets(select="SELECT mes_ref, canal, regional, produto, CAST(meta_receita AS DOUBLE) AS meta_receita FROM metas")),
    "rename_columns": Entry(_rename, "SELECT c_custkey AS cliente_id, c_mktsegment AS canal FROM customer"),
    "standardise": Entry(_standardise, """
SELECT CAST(o_orderdate AS DATE) AS data, CASE WHEN o_orderstatus = 'P' THEN 'Sem canal' ELSE o_orderstatus END AS canal,
       COUNT(*) AS linhas, SUM(CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE 1.5::DOUBLE END) AS receita
FROM orders GROUP BY ALL"""),
    "normalise_keys": Entry(_normalise, over_sales(select="""
SELECT CASE WHEN canal = 'BUILDING' THEN canal ELSE upper(canal[1]) || lower(canal[2:]) END AS canal,
       COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas GROUP BY 1""")),
    "sales_base": Entry(
        lambda s, d: E.sales_base(T.faturamento(s, d), T.clientes(s, d), T.produtos(s, d), AS_OF),
        over_sales(select="""
SELECT cliente_id, data, CAST(receita AS DOUBLE) AS receita, canal, regional, produto
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '1999-08-01'""")),
    "sales_cohort_base": Entry(
        lambda s, d: E.sales_cohort_base(T.faturamento(s, d), T.clientes(s, d), T.produtos(s, d), AS_OF, recurring=RECURRING, dates=T.datas(s, d)),
        over_sales(_LIFE, select="""
SELECT v.cliente_id, v.data, CAST(v.receita AS DOUBLE) AS receita, v.canal, v.regional, v.gerencia, v.produto, v.tipo_produto,
       strftime(x.primeira_compra, '%Y-%m') AS safra, x.primeira_compra, x.ultima_compra,
       CAST(date_diff('month', x.primeira_compra, v.data) AS INTEGER) AS meses_de_vida,
       x.meses_com_compra, x.total_transacoes, CAST(x.receita_total AS DOUBLE) AS receita_total_cliente
FROM vendas v JOIN vida x USING (cliente_id)
WHERE v.receita > 0 AND v.status_faturamento = 'Efetivado' AND v.data >= DATE '1996-08-01'""")),
    "client_lifespan": Entry(
        lambda s, d: E.client_lifespan(X.horizon(X.effective_only(vendas(s, d, "cliente_id", "data", "receita", "status_faturamento")), AS_OF, 60), T.datas(s, d))
        .withColumn("receita_total", M.as_double(F.col("receita_total"))),
        over_sales(_LIFE, select="""
SELECT cliente_id, primeira_compra, ultima_compra, meses_com_compra, total_transacoes, CAST(receita_total AS DOUBLE) AS receita_total FROM vida""")),
    "sales_discount_base": Entry(
        lambda s, d: E.sales_discount_base(T.faturamento(s, d), T.clientes(s, d), T.produtos(s, d), AS_OF, recurring=RECURRING),
        over_sales(select="""
SELECT cliente_id, data, produto, CAST(receita AS DOUBLE) AS receita,
       CASE WHEN valor_tabela > 0 THEN CAST(valor_tabela - receita AS DOUBLE) / CAST(valor_tabela AS DOUBLE) ELSE 0.0::DOUBLE END AS desconto_pct,
       canal, regional, gerencia, tipo_produto, mes_ref,
       CAST(quarter(data) AS INTEGER) AS trimestre, CAST(year(data) AS INTEGER) AS ano
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '1999-08-01'""")),
    "target_base": Entry(
        lambda s, d: E.target_base(T.metas(s, d), AS_OF).withColumn("meta_receita", M.as_double(F.col("meta_receita"))),
        over_targets(select="""
SELECT mes_ref, canal, regional, produto, CAST(meta_receita AS DOUBLE) AS meta_receita
FROM metas WHERE meta_receita > 0 AND mes >= DATE '1999-08-01'""")),
    "target_from_growth": Entry(
        lambda s, d: T.metas(s, d).withColumn("meta_receita", M.as_double(F.col("meta_receita"))),
        over_targets(select="SELECT mes, mes_ref, canal, regional, produto, CAST(meta_receita AS DOUBLE) AS meta_receita FROM metas")),
    "target_allocate": Entry(
        lambda s, d: E.target_allocate(
            T.metas(s, d).groupBy("mes_ref", "canal").agg(F.sum("meta_receita").alias("meta_receita")),
            vendas(s, d, "data", "canal", "regional", "produto", "receita"), ["mes_ref", "canal"], ["regional", "produto"]
        ),
        over_targets("g AS (SELECT mes_ref, canal, CAST(CAST(SUM(meta_receita) AS DECIMAL(28,2)) * 100 AS HUGEINT) AS cents FROM metas GROUP BY ALL)",
                     """c AS (SELECT mes_ref, canal, regional, produto, CAST(SUM(receita) * 10000 AS HUGEINT) AS w
 FROM vendas GROUP BY ALL HAVING SUM(receita) > 0)""",
                     """base AS (SELECT g.mes_ref, canal, any_value(cents) AS cents, COALESCE(MAX(m) FILTER (m <= g.mes_ref), MIN(m)) AS src
 FROM g LEFT JOIN (SELECT DISTINCT mes_ref AS m, canal FROM c) USING (canal) GROUP BY 1, 2)""",
                     """parts AS (SELECT b.mes_ref, b.canal, regional, produto, cents, w, SUM(w) OVER (PARTITION BY b.mes_ref, b.canal) AS t
 FROM base b JOIN c ON c.canal = b.canal AND c.mes_ref = b.src)""",
                     """cut AS (SELECT *, (cents * w) // t AS f, row_number() OVER (PARTITION BY mes_ref, canal ORDER BY (cents * w) % t DESC, regional, produto) AS nth FROM parts)""",
                     select="""
SELECT mes_ref, canal, regional, produto, CAST(w AS DOUBLE) / CAST(t AS DOUBLE) AS participacao,
       CAST(CAST(f + CASE WHEN nth <= cents - SUM(f) OVER (PARTITION BY mes_ref, canal) THEN 1 ELSE 0 END AS DECIMAL(20,0)) AS DOUBLE) / 100 AS meta_receita
FROM cut""")),
    "target_rollup": Entry(
        lambda s, d: E.target_rollup(T.metas(s, d), ["mes_ref", "canal"]),
        over_targets(select="SELECT mes_ref, canal, CAST(SUM(meta_receita) AS DOUBLE) AS meta_receita FROM metas GROUP BY ALL")),
    "effective_only": Entry(
        lambda s, d: _sums(X.effective_only(vendas(s, d, "receita", "status_faturamento", "data")), F.year("data").alias("ano")),
        over_sales(select="""SELECT CAST(year(data) AS INTEGER) AS ano, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' GROUP BY 1""")),
    "horizon": Entry(
        lambda s, d: _sums(X.horizon(vendas(s, d, "receita", "data"), AS_OF, 6), month_key("data").alias("mes_ref")),
        over_sales(select="""SELECT mes_ref, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas WHERE data >= DATE '2001-02-01' GROUP BY 1""")),
    "horizon_range": Entry(
        lambda s, d: _sums(X.horizon_range(vendas(s, d, "receita", "data", "canal"), AS_OF, 2, 1), "canal"),
        over_sales(select="""SELECT canal, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas WHERE data >= DATE '2001-06-01' AND data < DATE '2001-07-01' GROUP BY 1""")),
    "month_filter": Entry(
        lambda s, d: _sums(X.month_filter(vendas(s, d, "receita", "data", "produto"), AS_OF.replace(month=7)), "produto"),
        over_sales(select="""SELECT produto, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas WHERE mes_ref = '2001-07' GROUP BY 1""")),
    "product_type": Entry(
        lambda s, d: _sums(vendas(s, d, "produto", "tipo_produto", "receita"), "produto", "tipo_produto"),
        over_sales(select="SELECT produto, tipo_produto, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas GROUP BY ALL")),
    "discount_pct": Entry(
        lambda s, d: vendas(s, d, "cliente_id", "data", "valor_tabela", "receita").select(
            "cliente_id", "data", M.as_double(F.col("valor_tabela")).alias("valor_tabela"),
            M.discount_pct(F.col("valor_tabela"), F.col("receita")).alias("desconto_pct")),
        over_sales(select="""
SELECT cliente_id, data, CAST(valor_tabela AS DOUBLE) AS valor_tabela,
       CASE WHEN valor_tabela > 0 THEN CAST(valor_tabela - receita AS DOUBLE) / CAST(valor_tabela AS DOUBLE) ELSE 0.0::DOUBLE END AS desconto_pct
FROM vendas""")),
    "discount_band": Entry(_bands, over_sales("f AS (SELECT CAST(valor_tabela - receita AS DOUBLE) / CAST(valor_tabela AS DOUBLE) AS x FROM vendas WHERE receita > 0 AND valor_tabela > 0 AND data >= DATE '2000-08-01')", select="""
SELECT CASE WHEN x <= 0 THEN '0% (sem desconto)' WHEN x <= 0.05::DOUBLE THEN '1-5%' WHEN x <= 0.10::DOUBLE THEN '5-10%'
            WHEN x <= 0.20::DOUBLE THEN '10-20%' ELSE '20%+' END AS faixa_desconto, COUNT(*) AS registros FROM f GROUP BY 1""")),
    "discount_coverage": Entry(_coverage, over_sales("k AS (SELECT CASE WHEN valor_tabela > 0 THEN 'COM desconto calculável' ELSE 'SEM desconto' END AS status_desconto FROM vendas WHERE data >= DATE '2000-08-01')", select="""
SELECT status_desconto, COUNT(*) AS registros, (CAST(COUNT(*) * 100 AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)) AS pct FROM k GROUP BY 1""")),
    "month_key": Entry(lambda s, d: vendas(s, d, "data").select(month_key("data").alias("mes_ref")).groupBy("mes_ref").agg(F.count(F.lit(1)).alias("linhas")),
                       over_sales(select="SELECT mes_ref, COUNT(*) AS linhas FROM vendas GROUP BY 1")),
    "calendar_parts": Entry(lambda s, d: vendas(s, d, "data").groupBy(*calendar_parts("data")).agg(F.count(F.lit(1)).alias("linhas")),
                            over_sales(select="""
SELECT CAST(quarter(data) AS INTEGER) AS trimestre, CAST(year(data) AS INTEGER) AS ano, CAST(month(data) AS INTEGER) AS mes_ano, COUNT(*) AS linhas FROM vendas GROUP BY ALL""")),
    "scalar_functions": Entry(_scalars, over_sales(select="""
SELECT data, mes_ref, CAST(quarter(data) AS INTEGER) AS trimestre, CAST(year(data) AS INTEGER) AS ano, CAST(month(data) AS INTEGER) AS mes_ano,
       CAST(date_diff('month', DATE '2001-08-01', data) AS INTEGER) AS diferenca_meses,
       CAST(data - INTERVAL 6 MONTH AS DATE) AS seis_meses_antes,
       round_even(CAST(receita AS DOUBLE) / 1000000, 4) AS milhoes,
       least(greatest(CAST(receita AS DOUBLE), 1000.0::DOUBLE), 50000.0::DOUBLE) AS limitada, 0.0::DOUBLE AS por_zero
FROM vendas""")),
    "J_star": Entry(
        lambda s, d: _sums(E.star_join(T.faturamento(s, d), T.clientes(s, d), T.produtos(s, d)), "canal", "regional", "produto"),
        over_sales(select="SELECT canal, regional, produto, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita FROM vendas GROUP BY ALL")),
    "J_back": Entry(
        lambda s, d: J.join_back(vendas(s, d, "cliente_id", "data", "receita"),
                                 client_revenue(vendas(s, d, "cliente_id", "receita")).select("cliente_id", M.as_double(F.col("receita")).alias("receita_total_cliente")))
        .withColumn("receita", M.as_double(F.col("receita"))),
        over_sales("t AS (SELECT cliente_id, CAST(SUM(receita) AS DOUBLE) AS receita_total_cliente FROM vendas GROUP BY 1)", select="""
SELECT cliente_id, data, CAST(receita AS DOUBLE) AS receita, receita_total_cliente FROM vendas JOIN t USING (cliente_id)""")),
    "J_rank_dim": Entry(
        lambda s, d: cumulative_share(client_revenue(vendas(s, d, "cliente_id", "receita")), "receita", "cliente_id").join(
            T.clientes(s, d), "cliente_id").select("posicao_ranking", "cliente_id", "canal", "regional", "gerencia"),
        over_sales("t AS (SELECT cliente_id, canal, regional, gerencia, SUM(receita) AS x FROM vendas GROUP BY ALL)", select="""
SELECT row_number() OVER (ORDER BY x DESC, cliente_id) AS posicao_ranking, cliente_id, canal, regional, gerencia FROM t""")),
    "J_left_base": Entry(_left_base, over_sales(
        "f AS (SELECT cliente_id, MIN(mes) AS c FROM vendas GROUP BY 1)",
        "n AS (SELECT strftime(c, '%Y-%m') AS coorte, CAST(date_diff('month', c, mes) AS INTEGER) AS periodo_idx, COUNT(DISTINCT cliente_id) AS clientes_ativos FROM vendas JOIN f USING (cliente_id) GROUP BY 1, 2)",
        select="""SELECT n.*, b.clientes_ativos AS clientes_base FROM n LEFT JOIN (SELECT coorte, clientes_ativos FROM n WHERE periodo_idx = 0) b USING (coorte)""")),
    "J_full": Entry(_full, over_sales("m AS (SELECT mes, row_number() OVER (ORDER BY mes DESC) AS ordem FROM (SELECT DISTINCT mes FROM vendas))", select="""
SELECT canal, COALESCE(CAST(SUM(receita) FILTER (ordem = 2) AS DOUBLE), 0) AS receita_ant, COALESCE(CAST(SUM(receita) FILTER (ordem = 1) AS DOUBLE), 0) AS receita_atual
FROM vendas JOIN m USING (mes) WHERE ordem <= 2 GROUP BY canal""")),
    "J_anti": Entry(
        lambda s, d: J.keys_only_in_left(T.clientes(s, d), X.horizon(vendas(s, d, "cliente_id", "data"), AS_OF, 6), "cliente_id"),
        over_sales(select="SELECT c_custkey AS cliente_id FROM customer WHERE c_custkey NOT IN (SELECT cliente_id FROM vendas WHERE data >= DATE '2001-02-01')")),
    "J_setdiff": Entry(
        lambda s, d: J.keys_only_in_left(vendas(s, d, "mes_ref"), T.metas(s, d), "mes_ref"),
        over_targets(select="SELECT mes_ref FROM vendas EXCEPT SELECT mes_ref FROM metas")),
    "J_lookup": Entry(_lookup, over_sales(select="""
SELECT produto, CASE produto WHEN 'ECONOMY' THEN 100 WHEN 'LARGE' THEN 300 WHEN 'MEDIUM' THEN 200 WHEN 'PROMO' THEN 50 WHEN 'SMALL' THEN 120 END AS preco_base,
       COUNT(*) AS linhas FROM vendas GROUP BY ALL""")),
    "J_scalar": Entry(
        lambda s, d: share_of_total(vendas(s, d, "canal", "receita").groupBy("canal").agg(F.sum("receita").alias("receita")), "receita")
        .withColumn("receita", M.as_double(F.col("receita"))),
        over_sales("t AS (SELECT canal, SUM(receita) AS x FROM vendas GROUP BY 1)", select="""
SELECT canal, CAST(x AS DOUBLE) AS receita, CAST(x AS DOUBLE) / (SELECT CAST(SUM(x) AS DOUBLE) FROM t) AS participacao FROM t""")),
    "J_spine": Entry(
        lambda s, d: J.month_spine(vendas(s, d, "cliente_id", "data", "receita"), ["cliente_id"]),
        over_sales("c AS (SELECT cliente_id, mes, SUM(receita) AS r, COUNT(*) AS n FROM vendas GROUP BY ALL)",
                   "k AS (SELECT cliente_id, CAST(unnest(generate_series(MIN(mes), MAX(mes), INTERVAL 1 MONTH)) AS DATE) AS mes FROM c GROUP BY 1)", select="""
SELECT strftime(mes, '%Y-%m') AS mes_ref, cliente_id, COALESCE(CAST(r AS DOUBLE), 0) AS receita, COALESCE(n, 0) AS transacoes
FROM k LEFT JOIN c USING (cliente_id, mes)""")),
    "J_contract": Entry(_contract, over_sales(select="""
SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS desconto_contratual, COUNT(*) AS linhas, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas JOIN customer ON c_custkey = cliente_id GROUP BY 1""")),
    "W_rank": Entry(
        lambda s, d: global_rank(client_revenue(vendas(s, d, "cliente_id", "receita")), "receita", "cliente_id").select("posicao_ranking", "cliente_id"),
        over_sales("t AS (SELECT cliente_id, SUM(receita) AS x FROM vendas GROUP BY 1)", select="""
SELECT row_number() OVER (ORDER BY x DESC, cliente_id) AS posicao_ranking, cliente_id FROM t""")),
    "W_share": Entry(
        lambda s, d: share_of_total(client_revenue(vendas(s, d, "cliente_id", "receita")), "receita").select("cliente_id", "participacao"),
        over_sales("t AS (SELECT cliente_id, SUM(receita) AS x FROM vendas GROUP BY 1)", select="""
SELECT cliente_id, CAST(x AS DOUBLE) / CAST(SUM(x) OVER () AS DOUBLE) AS participacao FROM t""")),
    "W_cum": Entry(
        lambda s, d: cumulative_share(client_revenue(vendas(s, d, "cliente_id", "receita")), "receita", "cliente_id").select("cliente_id", "pct_acumulado"),
        over_sales("t AS (SELECT cliente_id, SUM(receita) AS x FROM vendas GROUP BY 1)", select="""
SELECT cliente_id, CAST(SUM(x) OVER (ORDER BY x DESC, cliente_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(SUM(x) OVER () AS DOUBLE) AS pct_acumulado FROM t""")),
    "W_over_agg": Entry(
        lambda s, d: cumulative_share(
            vendas(s, d, "produto_id", "receita").groupBy("produto_id").agg(F.sum("receita").alias("receita")), "receita", "produto_id"
        ).select("produto_id", M.as_double(F.col("receita")).alias("receita"), "pct_acumulado"),
        over_sales(select="""
SELECT produto_id, CAST(SUM(receita) AS DOUBLE) AS receita,
       CAST(SUM(SUM(receita)) OVER (ORDER BY SUM(receita) DESC, produto_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / CAST(SUM(SUM(receita)) OVER () AS DOUBLE) AS pct_acumulado
FROM vendas GROUP BY produto_id""")),
    "W_count_share": Entry(
        lambda s, d: P.count_share(vendas(s, d, "produto"), "produto"),
        over_sales(select="""
SELECT produto, COUNT(*) AS registros, (CAST(COUNT(*) * 100 AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE)) AS pct FROM vendas GROUP BY 1""")),
    "W_last_months": Entry(
        lambda s, d: last_months(vendas(s, d, "data")),
        over_sales(select="SELECT mes_ref, CAST(row_number() OVER (ORDER BY mes_ref DESC) AS INTEGER) AS ordem FROM (SELECT DISTINCT mes_ref FROM vendas) QUALIFY ordem <= 2")),
    "W_recent_prior": Entry(
        lambda s, d: recent_prior(vendas(s, d, "data")),
        over_sales(select="""
SELECT mes_ref, CAST(row_number() OVER (ORDER BY mes_ref DESC) AS INTEGER) AS ordem, CASE WHEN ordem <= 2 THEN 'recente' ELSE 'anterior' END AS janela
FROM (SELECT DISTINCT mes_ref FROM vendas) QUALIFY ordem <= 5""")),
    "S_multi": Entry(
        lambda s, d: E.sales_base(T.faturamento(s, d), T.clientes(s, d), T.produtos(s, d), AS_OF, 1).orderBy("data", "canal", "cliente_id"),
        over_sales(select="""
SELECT cliente_id, data, CAST(receita AS DOUBLE) AS receita, canal, regional, produto
FROM vendas WHERE receita > 0 AND status_faturamento = 'Efetivado' AND data >= DATE '2000-08-01' ORDER BY data, canal, cliente_id""")),
    "clients_by_channel": Entry(
        lambda s, d: P.clients_by_channel(X.horizon(vendas(s, d, "data", "canal", "cliente_id"), AS_OF, 60)),
        over_sales(select="SELECT canal, COUNT(DISTINCT cliente_id) AS clientes FROM vendas WHERE data >= DATE '1996-08-01' GROUP BY 1")),
    "rows_by_month": Entry(
        lambda s, d: P.rows_by_month(X.horizon(vendas(s, d, "data", "receita"), AS_OF, 60)),
        over_sales(select="""SELECT mes_ref AS mes, COUNT(*) AS registros, CAST(SUM(receita) AS DOUBLE) AS receita
FROM vendas WHERE data >= DATE '1996-08-01' GROUP BY 1""")),
    "global_totals": Entry(
        lambda s, d: P.global_totals(vendas(s, d, "data", "receita", "cliente_id")),
        over_sales(select="""
SELECT COUNT(*) AS total_registros, COUNT(DISTINCT cliente_id) AS total_clientes, CAST(SUM(receita) AS DOUBLE) AS receita_total,
       MIN(mes_ref) AS primeiro_mes, MAX(mes_ref) AS ultimo_mes FROM vendas""")),
    "distinct_keys": Entry(
        lambda s, d: P.distinct_keys(vendas(s, d, "canal", "regional", "produto"), ["canal", "regional", "produto"]),
        over_sales(select="SELECT DISTINCT canal, regional, produto FROM vendas")),
    "duplicates": Entry(
        lambda s, d: P.duplicates(T.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "SELECT l_orderkey, l_linenumber, COUNT(*) AS ocorrencias FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1"),
}
