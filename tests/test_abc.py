import random
from datetime import date
from decimal import Decimal

import pytest

from conftest import by_key, rows
from vendaflux.operators import abc as A
from vendaflux.operators.ranking import extremes, global_rank, top_n


def clients(spark, revenues):
    return spark.createDataFrame([(i, Decimal(str(r))) for i, r in revenues], "cliente_id bigint, receita decimal(18,4)")


def test_border_is_inclusive(spark):
    v = clients(spark, [(1, 50), (2, 30), (3, 15), (4, 5)])  # cumulative 0.50 0.80 0.95 1.00
    got = by_key(A.abc_classify(v), "cliente_id")
    assert [got[i]["classe_abc"] for i in (1, 2, 3, 4)] == ["A", "A", "B", "C"]
    assert [got[i]["posicao_ranking"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4]


def test_one_client_above_80_percent_leaves_a_empty(spark):
    got = by_key(A.abc_classify(clients(spark, [(1, 90), (2, 10)])), "cliente_id")
    assert got[1]["classe_abc"] == "B" and got[2]["classe_abc"] == "C"


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_rank_against_brute_force_with_a_hot_value(spark, hot):
    """A value shared by many rows is split over ranges by the tie breaker."""
    rnd = random.Random(7)
    data = [(i, Decimal("5.0000") if rnd.random() < hot else Decimal(rnd.randrange(1, 400)) / 4) for i in range(3000)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "cliente_id bigint, receita decimal(18,4)").repartition(7)
    total, cum, want = sum(x for _, x in data), Decimal(0), []
    for pos, (i, x) in enumerate(sorted(data, key=lambda p: (-p[1], p[0])), 1):
        cum += x
        want.append((i, pos, cum))
    got = global_rank(df, "receita", "cliente_id")
    assert [(r.cliente_id, r.posicao_ranking, r.acumulado) for r in got.orderBy("posicao_ranking").collect()] == want
    assert {(r.total, r.n_total) for r in got.select("total", "n_total").distinct().collect()} == {(total, 3000)}


def test_rank_inside_keys_keeps_null_keys(spark):
    data = [(None, 1, 5), (None, 2, 7), ("x", 1, 3), ("x", 3, 3), ("x", 2, 9)]
    df = spark.createDataFrame([(k, i, Decimal(r)) for k, i, r in data], "canal string, cliente_id bigint, receita decimal(18,4)")
    got = global_rank(df, "receita", "cliente_id", ["canal"])
    assert sorted(((r.canal or "", r.posicao_ranking, r.cliente_id, int(r.acumulado)) for r in got.collect())) == [
        ("", 1, 2, 7), ("", 2, 1, 12), ("x", 1, 2, 9), ("x", 2, 1, 12), ("x", 3, 3, 15)]


def test_one_client_with_a_third_of_the_rows(spark):
    """Client 0 holds a third of all rows; results equal a plain computation."""
    rnd = random.Random(3)
    data = [(0 if rnd.random() < 0.34 else rnd.randrange(1, 300), Decimal(rnd.randrange(100, 9999)) / 100) for _ in range(20000)]
    sums = {}
    for c, r in data:
        sums[c] = sums.get(c, Decimal(0)) + r
    got = by_key(A.abc_classify(clients(spark, data)), "cliente_id")
    order = sorted(sums, key=lambda c: (-sums[c], c))
    total, cum = float(sum(sums.values())), Decimal(0)
    for pos, c in enumerate(order, 1):
        cum += sums[c]
        share = float(cum) / total
        assert got[c]["posicao_ranking"] == pos and got[c]["pct_acumulado"] == pytest.approx(share, abs=1e-12)
        assert got[c]["classe_abc"] == ("A" if share <= 0.8 else "B" if share <= 0.95 else "C")


def test_summary_and_risk(spark):
    v = clients(spark, [(i, 100 - i) for i in range(20)])
    s = {r.kpi: r.valor for r in A.abc_summary(A.rank_and_classify(A.client_revenue(v))).collect()}
    assert s["clientes_total"] == 20 and s["receita_total"] == 1810
    assert s["classe_A_clientes"] + s["classe_B_clientes"] + s["classe_C_clientes"] == 20
    assert s["classe_A_participacao"] + s["classe_B_participacao"] + s["classe_C_participacao"] == pytest.approx(1)
    assert rows(A.concentration_risk(v)) == [(pytest.approx(955 / 1810), "CRÍTICO")]


def test_gini(spark):
    assert rows(A.gini(clients(spark, [(1, 5), (2, 5), (3, 5), (4, 5)]))) == [(4, 0.0)]
    assert rows(A.gini(clients(spark, [(1, 0), (2, 0), (3, 0), (4, 8)]))) == [(4, 0.75)]


def test_migration(spark):
    schema = "cliente_id bigint, data date, receita decimal(18,4)"
    data = [(1, 2020, 80), (2, 2020, 15), (3, 2020, 5), (1, 2021, 50), (2, 2021, 30), (4, 2021, 20), (1, 2022, 1)]
    v = spark.createDataFrame([(c, date(y, 5, 1), Decimal(r)) for c, y, r in data], schema)
    got = {(r.periodo, r.de, r.para): (r.clientes, r.receita) for r in A.abc_migration(v).collect()}
    assert got == {
        (2021, "A", "A"): (1, 50.0), (2021, "B", "A"): (1, 30.0), (2021, "C", "perdido"): (1, 5.0), (2021, "novo", "C"): (1, 20.0),
        (2022, "A", "C"): (1, 1.0), (2022, "A", "perdido"): (1, 30.0), (2022, "C", "perdido"): (1, 20.0)}


def test_top_and_extremes_break_ties_by_key(spark):
    v = clients(spark, [(3, 5), (1, 5), (2, 9)])
    assert [r.cliente_id for r in top_n(v, "receita", "cliente_id", 2).collect()] == [2, 1]
    assert rows(extremes(v, "cliente_id", "receita")) == [(1, 5.0, 2, 9.0)]


def test_inactive_counts_every_class(spark):
    v = spark.createDataFrame([(1, date(2024, 1, 31), Decimal(1)), (2, date(2024, 2, 1), Decimal(1)), (3, date(2023, 1, 1), Decimal(0))],
                              "cliente_id bigint, data date, receita decimal(18,4)")
    assert rows(A.inactive_clients(v, date(2024, 4, 30))) == [(1,)]
