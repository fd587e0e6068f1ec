from datetime import date
from decimal import Decimal

import pytest

from conftest import by_key, rows
from vendaflux.operators import decompose as D
from vendaflux.operators import gap as G
from vendaflux.operators.joins import keys_only_in_left, month_spine

SALES = "data date, canal string, regional string, produto string, cliente_id bigint, receita decimal(18,4)"
TARGETS = "mes_ref string, canal string, regional string, produto string, meta_receita decimal(18,4)"


def sales(spark, *rows_):
    return spark.createDataFrame([(d, c, "S", "P", i, Decimal(str(r))) for d, c, i, r in rows_], SALES)


def targets(spark, *rows_):
    return spark.createDataFrame([(m, c, "S", "P", Decimal(str(x))) for m, c, x in rows_], TARGETS)


JAN, FEB = date(2024, 1, 10), date(2024, 2, 10)


def test_border_rounds_by_month_but_not_by_cell(spark):
    v, m = sales(spark, (JAN, "X", 1, "102.004")), targets(spark, ("2024-01", "X", 100))
    assert rows(G.gap_monthly(v, m)) == [("2024-01", 102.004, 100.0, 2.004, 0.02, "Na Meta")]
    d = by_key(G.gap_detail(v, m), "mes_ref")["2024-01"]
    assert d["status"] == "Acima" and d["gap_pct"] == pytest.approx(0.02004)


def test_missing_target_and_target_without_sales(spark):
    v = sales(spark, (JAN, "X", 1, 50), (FEB, "X", 1, 50))
    m = targets(spark, ("2024-01", "X", 100), ("2024-01", "Y", 100))
    assert rows(G.gap_monthly(v, m)) == [("2024-01", 50.0, 200.0, -150.0, -0.75, "Abaixo")]
    d = by_key(G.gap_detail(v, m), "mes_ref")
    assert set(d) == {"2024-01", "2024-02"}  # the target of Y without sales has no row
    assert (d["2024-02"]["gap"], d["2024-02"]["gap_pct"], d["2024-02"]["status"]) == (None, 0.0, "Na Meta")
    assert rows(G.key_coverage(v, m)) == [("canal_so_no_forecast", "Y")]
    assert rows(G.month_coverage(v, m)) == [("forecast", "2024-01", 2), ("realizado", "2024-01", 1), ("realizado", "2024-02", 1)]


def test_forecast_column_comes_along(spark):
    m = spark.createDataFrame([("2024-01", "X", "S", "P", Decimal(100), Decimal(99))], TARGETS + ", forecast_receita decimal(18,4)")
    assert G.gap_detail(sales(spark, (JAN, "X", 1, 50)), m).first().forecast_receita == 99.0


def test_grouping_sets(spark):
    v = sales(spark, (JAN, "X", 1, 50), (JAN, "Y", 1, 70))
    m = targets(spark, ("2024-01", "X", 100), ("2024-01", "Y", 60))
    got = {(r.nivel, r.canal, r.produto): (r.realizado, r.gap, r.status) for r in G.gap_grouping_sets(v, m).collect()}
    assert got == {("mes", None, None): (120.0, -40.0, "Abaixo"), ("canal", "X", None): (50.0, -50.0, "Abaixo"),
                   ("canal", "Y", None): (70.0, 10.0, "Acima"), ("regional", None, None): (120.0, -40.0, "Abaixo"),
                   ("produto", None, "P"): (120.0, -40.0, "Abaixo")}


def test_grouping_sets_keep_both_sides(spark):
    """A target without sales, sales without a target, a target key that occurs twice."""
    v = sales(spark, (JAN, "X", 1, 50), (FEB, "Z", 1, 7))
    m = targets(spark, ("2024-01", "X", 20), ("2024-01", "X", 20), ("2024-01", "W", 60))
    got = {(r.nivel, r.mes_ref, r.canal): (r.realizado, r.meta, r.gap, r.status) for r in G.gap_grouping_sets(v, m).filter("nivel in ('mes', 'canal')").collect()}
    assert got == {("mes", "2024-01", None): (50.0, 100.0, -50.0, "Abaixo"), ("mes", "2024-02", None): (7.0, None, None, None),
                   ("canal", "2024-01", "X"): (50.0, 40.0, 10.0, "Acima"), ("canal", "2024-01", "W"): (0.0, 60.0, -60.0, "Abaixo"),
                   ("canal", "2024-02", "Z"): (7.0, None, None, None)}
    monthly = {r.mes_ref: (r.realizado, r.meta, r.gap, r.status) for r in G.gap_monthly(v, m).collect()}
    assert all(got["mes", k, None] == x for k, x in monthly.items()) and monthly


def test_worked_decomposition(spark):
    """100 clients at 1000 become 95 at 980: -5000, -2000, +100, together -6900."""
    v = sales(spark, *[(JAN, "X", i, 1000) for i in range(100)], *[(FEB, "X", i, 980) for i in range(95)])
    d = D.decompose_gap(v).first()
    assert (d.efeito_volume, d.efeito_preco, d.efeito_cruzado, d.gap_total) == (-5000.0, -2000.0, 100.0, -6900.0)
    assert (d.mes_anterior, d.mes_atual) == ("2024-01", "2024-02")
    assert rows(D.decompose_check(D.decompose_gap(v))) == [(-6900.0, -6900.0, 0.0)]
    t = D.effect_totals(D.decompose_gap(v)).first()
    assert t.efeito_dominante == "VOLUME" and t.pct_volume == pytest.approx(5000 / 69)


def test_new_channel_goes_to_the_cross_effect(spark):
    v = sales(spark, (JAN, "X", 1, 10), (FEB, "X", 1, 10), (FEB, "N", 2, 30))
    d = by_key(D.decompose_gap(v), "canal")["N"]
    assert (d["efeito_volume"], d["efeito_preco"], d["efeito_cruzado"], d["gap_total"]) == (0.0, 0.0, 30.0, 30.0)


def test_previous_month_is_the_one_present(spark):
    v = sales(spark, (JAN, "X", 1, 10), (date(2024, 4, 2), "X", 1, 25))
    assert D.decompose_gap(v).first().mes_anterior == "2024-01"
    d = D.decompose_gap(v, calendar=True).first()
    assert (d.mes_anterior, d.mes_atual, d.receita_ant, d.gap_total) == ("2024-03", "2024-04", 0.0, 25.0)
    fixed = D.decompose_gap(v, last_month=date(2024, 4, 1), calendar=True).first()
    assert fixed.asDict() == d.asDict()


def test_one_month_gives_nothing(spark):
    assert D.decompose_gap(sales(spark, (JAN, "X", 1, 10))).collect() == []


def test_rolling_ticket_is_per_transaction(spark):
    v = sales(spark, (date(2024, 2, 5), "X", 1, 10), (date(2024, 2, 6), "X", 1, 20), (date(2024, 3, 5), "X", 1, 40))
    d = D.decompose_gap_rolling(v, date(2024, 4, 1)).first()
    assert (d.ticket_ant, d.ticket_atual, d.clientes_ant, d.gap_total) == (15.0, 40.0, 1, 10.0)
    assert rows(D.decompose_check(D.decompose_gap_rolling(v, date(2024, 4, 1)))) == [(25.0, 10.0, 15.0)]


def test_mix_adds_up(spark):
    data = [(JAN, "a", 10, 100), (JAN, "b", 10, 300), (FEB, "a", 20, 220), (FEB, "b", 5, 140), (FEB, "new", 4, 90)]
    v = spark.createDataFrame([(d, p, float(q), Decimal(r)) for d, p, q, r in data], "data date, produto string, quantidade double, receita decimal(18,4)")
    m = D.decompose_mix(v).first()
    # mean price 20; volume 9 x 20; at old prices 20x10 + 5x30 + 4x20 = 430
    assert (m.efeito_volume, m.efeito_mix, m.efeito_preco, m.gap_total) == (180.0, 430.0 - 29 * 20, 20.0, 50.0)
    assert m.efeito_volume + m.efeito_mix + m.efeito_preco == m.gap_total


def test_null_keys_do_not_hide_the_rest(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "canal string")
    b = spark.createDataFrame([("x",), (None,)], "canal string")
    assert rows(keys_only_in_left(a, b, "canal")) == [("y",)]


def test_spine_fills_empty_months(spark):
    v = sales(spark, (JAN, "X", 1, 10), (date(2024, 3, 1), "X", 2, 5))
    assert rows(month_spine(v, ["canal"])) == [("2024-01", "X", 10.0, 1), ("2024-02", "X", 0.0, 0), ("2024-03", "X", 5.0, 1)]
    assert month_spine(v, ["canal"], date(2023, 12, 1), date(2024, 4, 30)).count() == 5


def test_waterfall_and_worst(spark):
    v = sales(spark, (JAN, "A", 1, 10), (JAN, "B", 1, 30))
    m = targets(spark, ("2024-01", "A", 20), ("2024-01", "B", 25))
    detail = G.gap_detail(v, m)
    assert rows(G.gap_waterfall(detail, "2024-01")) == [("2024-01", "A", -10.0, -10.0), ("2024-01", "B", 5.0, -5.0)]
    assert [r.canal for r in G.gap_worst_cells(detail).collect()] == ["A"]
    assert rows(G.gap_extremes(detail, "canal")) == [("A", -10.0, "B", 5.0)]
