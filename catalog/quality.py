"""Data-quality reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import Entry, over_sales, over_targets
from catalog.tables import datas, metas, vendas
from vendaflux.operators import abc as A
from vendaflux.operators import cohort as C
from vendaflux.operators import decompose as D
from vendaflux.operators import quality as Q
from catalog.cohorts import _CELLS, _FIRST, _RET, _SUM
from catalog.concentration import _ABC
from catalog.targets import _JULY2, _decomp

_CONTRACT = ("data", "mes_ref", "cliente_id", "produto", "canal", "regional", "quantidade", "receita", "desconto_pct")


def _report(*rules: tuple[str, str]) -> str:
    """Rows (regra, violacoes, ok) from (name, scalar SQL) pairs."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS regra, CAST(COALESCE(({sql}), 0) AS BIGINT) AS violacoes" for name, sql in rules)
    return f"SELECT regra, violacoes, violacoes = 0 AS ok FROM ({rows})"


def _count(cond: str, source: str = "vendas") -> str:
    return f"SELECT COUNT(*) FILTER ({cond}) FROM {source}"


def _fails(rule: str, source: str = "vendas") -> str:
    return f"SELECT COUNT(*) FILTER (({rule}) IS NOT TRUE) FROM {source}"


_NULLS = " + ".join(f"COUNT(*) FILTER ({c} IS NULL)" for c in _CONTRACT)
_FORECAST = "fc AS (SELECT mes_ref, canal, regional, produto, meta_receita FROM metas)"
_WINDOWS = """m AS (SELECT mes, row_number() OVER (ORDER BY mes DESC) AS ordem FROM (SELECT DISTINCT mes FROM vendas) QUALIFY ordem <= 5),
w AS (SELECT produto, COUNT(*) FILTER (ordem <= 2) AS nr, COUNT(*) FILTER (ordem > 2) AS na FROM vendas JOIN m USING (mes) GROUP BY 1)"""


def _contract(spark, d):
    return vendas(spark, d, *_CONTRACT)


def _forecast(spark, d):
    m = metas(spark, d).select("mes_ref", "canal", "regional", "produto", "meta_receita")
    return m.withColumn("forecast_receita", F.col("meta_receita"))


def _gap_sales(spark, d):
    return vendas(spark, d, "data", "receita", "canal", "regional", "produto", "cliente_id")


QUERIES = {
    "dq_sales": Entry(
        lambda s, d: Q.dq_sales(_contract(s, d)),
        over_sales(select=_report(
            ("colunas_ausentes", "SELECT 1"), ("nulos", f"SELECT {_NULLS} FROM vendas"),
            ("linhas_duplicadas", f"SELECT SUM(n - 1) FROM (SELECT COUNT(*) AS n FROM vendas GROUP BY {', '.join(_CONTRACT)})"),
            ("desconto_fora_da_faixa", _fails("desconto_pct BETWEEN 0 AND 0.25")), ("quantidade_nao_positiva", _fails("quantidade > 0")),
            ("receita_nao_positiva", _fails("receita > 0"))))),
    "dq_targets": Entry(
        lambda s, d: Q.dq_targets(_forecast(s, d)),
        over_targets(_FORECAST, select=_report(
            ("colunas_ausentes", "SELECT 0"),
            ("nulos", "SELECT COUNT(*) FILTER (mes_ref IS NULL OR canal IS NULL OR regional IS NULL OR produto IS NULL OR meta_receita IS NULL) FROM fc"),
            ("chave_duplicada", "SELECT SUM(n - 1) FROM (SELECT COUNT(*) AS n FROM fc GROUP BY mes_ref, canal, regional, produto)"),
            ("meta_nao_positiva", _fails("meta_receita > 0", "fc"))))),
    "dq_cohort_input": Entry(
        lambda s, d: Q.dq_cohort_input(vendas(s, d, "cliente_id", "data", "receita")),
        over_sales(select=_report(("colunas_ausentes", "SELECT 0"), ("cliente_nulo", _count("cliente_id IS NULL")),
                                  ("receita_nao_positiva", _fails("receita > 0"))))),
    "dq_pareto_input": Entry(
        lambda s, d: Q.dq_pareto_input(vendas(s, d, "cliente_id", "receita")),
        over_sales(select=_report(("colunas_ausentes", "SELECT 0"), ("cliente_nulo", _count("cliente_id IS NULL")),
                                  ("receita_negativa", _fails("receita >= 0"))))),
    "dq_adhoc_input": Entry(
        lambda s, d: Q.dq_adhoc_input(vendas(s, d, "cliente_id", "canal", "data", "produto", "receita", "valor_tabela", "desconto_pct")),
        over_sales(_WINDOWS, select=_report(
            ("colunas_ausentes", "SELECT 0"), ("meses_insuficientes", "SELECT greatest(5 - COUNT(*), 0) FROM m"),
            ("receita_negativa", _fails("receita >= 0")), ("meses_zerados", "SELECT date_diff('month', MIN(mes), MAX(mes)) + 1 - COUNT(*) FROM m"),
            ("produto_em_uma_so_janela", "SELECT COUNT(*) FILTER (nr = 0 OR na = 0) FROM w"),
            ("correlacao_fora_de_faixa", "SELECT 0"), ("soma_dos_deltas", "SELECT 0")))),
    "dq_gap_input": Entry(
        lambda s, d: Q.dq_gap_input(_gap_sales(s, d), metas(s, d)),
        over_targets(select=_report(
            ("colunas_ausentes_vendas", "SELECT 0"), ("colunas_ausentes_metas", "SELECT 0"), ("meta_nao_positiva", _fails("meta_receita > 0", "metas")),
            ("canal_sem_vendas", "SELECT COUNT(*) FROM (SELECT canal FROM metas EXCEPT SELECT canal FROM vendas)")))),
    "dq_cohort_output": Entry(
        lambda s, d: Q.dq_cohort_output(
            C.cohort_retention(vendas(s, d, "cliente_id", "data", "receita"), dates=datas(s, d)), C.cohort_summary(vendas(s, d, "cliente_id", "data", "receita"), datas(s, d))),
        over_sales(_FIRST, _CELLS, _RET, _SUM, select=_report(
            ("base_por_coorte", "SELECT COUNT(*) FILTER (b <> 1) FROM (SELECT coorte, COUNT(*) FILTER (periodo_idx = 0) AS b FROM ret GROUP BY 1)"),
            ("retencao_fora_de_faixa", _fails("retencao BETWEEN 0 AND 1", "ret")), ("m0_diferente_de_1", _count("periodo_idx = 0 AND retencao <> 1", "ret")),
            ("receita_nao_positiva", _fails("receita > 0", "resumo"))))),
    "dq_abc_output": Entry(
        lambda s, d: Q.dq_abc_output(A.abc_classify(vendas(s, d, "cliente_id", "receita")), vendas(s, d, "receita")),
        over_sales(_ABC, select=_report(
            ("acumulado_final", "SELECT CAST(abs(MAX(pct_acumulado) - 1) >= 0.001 AS INTEGER) FROM abc"),
            ("cliente_sem_classe", _fails("classe_abc IN ('A', 'B', 'C')", "abc")), ("cliente_repetido", "SELECT COUNT(*) - COUNT(DISTINCT cliente_id) FROM abc"),
            ("classe_A_receita", "SELECT CAST(SUM(x) FILTER (classe_abc = 'A') / SUM(x) NOT BETWEEN 0.75 AND 0.85 AS INTEGER) FROM abc"),
            ("classe_A_clientes", "SELECT CAST(COUNT(*) FILTER (classe_abc = 'A') / COUNT(*) > 0.30 AS INTEGER) FROM abc"),
            ("receita_perdida", "SELECT CAST(SUM(x) <> (SELECT SUM(receita) FROM vendas) AS INTEGER) FROM abc")))),
    "dq_gap_output": Entry(
        lambda s, d: Q.dq_gap_output(D.decompose_gap(_gap_sales(s, d), last_month=date(2001, 7, 1), dates=vendas(s, d, "data")), _gap_sales(s, d), metas(s, d)),
        over_targets(_decomp("canal", _JULY2), select=_report(
            ("efeitos_nao_fecham", _fails("abs(efeito_volume + efeito_preco + efeito_cruzado - gap_total) < 0.01", "decomp")),
            ("soma_canais_difere", "SELECT CAST(abs(SUM(gap_total) - (SELECT CAST(SUM(CASE WHEN mes_ref = '2001-07' THEN receita ELSE -receita END) AS DOUBLE) FROM vendas WHERE mes_ref IN ('2001-06', '2001-07'))) >= 0.01 AS INTEGER) FROM decomp"),
            ("mes_em_um_so_lado", "SELECT COUNT(*) FROM (SELECT DISTINCT mes_ref FROM vendas) a FULL JOIN (SELECT DISTINCT mes_ref FROM metas) b ON a.mes_ref = b.mes_ref WHERE a.mes_ref IS NULL OR b.mes_ref IS NULL")))),
}
