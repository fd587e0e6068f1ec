from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import rows
from vendaflux.operators import abc as A
from vendaflux.operators import cohort as C
from vendaflux.operators import profile as P
from vendaflux.operators import quality as Q
from vendaflux.sources import synth

GOOD = (date(2024, 1, 5), "2024-01", 1, "P", "X", "S", 2, Decimal(10), Decimal(6), Decimal("0.10"))
SCHEMA = ("data date, mes_ref string, cliente_id bigint, produto string, canal string, regional string, quantidade bigint, "
          "receita decimal(18,4), custo decimal(18,4), desconto_pct decimal(9,6)")


def report(df):
    return {r.regra: r.violacoes for r in df.collect()}


def row(**changes):
    names = [f.strip().split()[0] for f in SCHEMA.replace("(18,4)", "").replace("(9,6)", "").split(",")]
    return tuple(changes.get(n, x) for n, x in zip(names, GOOD))


def test_bad_rows(spark):
    bad = [row(), row(), row(), row(cliente_id=None), row(receita=Decimal(0)), row(receita=Decimal(-1)), row(desconto_pct=Decimal("0.26"))]
    df = spark.createDataFrame(bad, SCHEMA)
    assert report(Q.dq_sales(df)) == {
        "colunas_ausentes": 0, "nulos": 1, "linhas_duplicadas": 2, "desconto_fora_da_faixa": 1,
        "quantidade_nao_positiva": 0, "receita_nao_positiva": 2, "custo_nao_positiva": 0}
    assert report(Q.dq_cohort_input(df)) == {"colunas_ausentes": 0, "cliente_nulo": 1, "receita_nao_positiva": 2}
    assert report(Q.dq_pareto_input(df)) == {"colunas_ausentes": 0, "cliente_nulo": 1, "receita_negativa": 1}
    assert report(Q.dq_sales(df.drop("custo")))["colunas_ausentes"] == 1


def test_bad_targets(spark):
    schema = "mes_ref string, canal string, regional string, produto string, meta_receita double, forecast_receita double"
    m = spark.createDataFrame([("2024-01", "X", "S", "P", 1.0, 1.0), ("2024-01", "X", "S", "P", 0.0, None), ("2024-02", "Y", "S", "P", 5.0, 1.0)], schema)
    assert report(Q.dq_targets(m)) == {"colunas_ausentes": 0, "nulos": 1, "chave_duplicada": 1, "meta_nao_positiva": 1}
    v = spark.createDataFrame([row()], SCHEMA)
    assert report(Q.dq_gap_input(v, m))["canal_sem_vendas"] == 1


def test_outputs_of_good_data(spark):
    v = synth.synth_sales(spark, 5000, 200)
    retention, summary = C.cohort_retention(v), C.cohort_summary(v)
    assert set(report(Q.dq_cohort_output(retention, summary)).values()) == {0}
    abc = report(Q.dq_abc_output(A.abc_classify(v), v))
    assert abc["receita_perdida"] == abc["acumulado_final"] == abc["cliente_repetido"] == abc["cliente_sem_classe"] == 0


def test_adhoc_input_reports_gaps(spark):
    data = [(date(2024, m, 1), p, 1, "X", Decimal(r), Decimal(10), Decimal(0)) for m, p, r in ((1, "a", 5), (2, "a", 5), (4, "a", -5), (4, "b", 5))]
    df = spark.createDataFrame(data, "data date, produto string, cliente_id bigint, canal string, receita decimal(18,4), "
                                     "valor_tabela decimal(18,4), desconto_pct decimal(9,6)")
    got = report(Q.dq_adhoc_input(df))
    assert (got["meses_insuficientes"], got["meses_zerados"], got["receita_negativa"], got["produto_em_uma_so_janela"]) == (2, 1, 1, 1)
    assert got["soma_dos_deltas"] == 0


def test_clashing_hashes_make_no_duplicate(spark, monkeypatch):
    """With one hash for all rows the full columns decide; NULLs are equal to NULLs."""
    data = [(1, "a", None), (1, "a", None), (1, "b", None), (1, None, "a"), (2, "b", 'x'), (2, "b", 'x'), (2, "b", 'x')]
    df = spark.createDataFrame(data, "k int, x string, y string")
    want = [(1, "a", None, 2), (2, "b", "x", 3)]
    assert rows(P.duplicates(df)) == want
    monkeypatch.setattr(P, "row_mark", lambda cols: F.lit(7).cast("bigint"))
    assert rows(P.duplicates(df)) == want
