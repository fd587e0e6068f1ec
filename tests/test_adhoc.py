from datetime import date
from decimal import Decimal

from conftest import by_key, rows
from vendaflux.operators import adhoc as H

SCHEMA = "data date, produto string, receita decimal(18,4)"


def v(spark, *data):
    return spark.createDataFrame([(date(2024, m, 5), p, Decimal(r)) for m, p, r in data], SCHEMA)


def test_means_over_windows_with_a_missing_product(spark):
    df = v(spark, (1, "a", 999), (2, "a", 30), (3, "a", 30), (4, "a", 30), (5, "a", 10), (6, "a", 10), (6, "b", 8), (3, "c", 9))
    d = by_key(H.product_delta(df), "produto")
    assert (d["a"]["media_recente"], d["a"]["media_anterior"], d["a"]["delta"]) == (10.0, 30.0, -20.0)
    assert (d["b"]["media_recente"], d["b"]["delta_pct"]) == (4.0, None)
    assert (d["c"]["media_recente"], d["c"]["delta"]) == (0.0, -3.0)
    assert [r.produto for r in H.top_declines(H.product_delta(df)).collect()] == ["a", "c"]
    assert {r.produto: r.sinal for r in H.delta_bar_points(H.product_delta(df)).collect()} == {"a": "queda", "b": "crescimento", "c": "queda"}


def test_fewer_months_than_the_windows(spark):
    d = H.product_delta(v(spark, (1, "a", 30), (2, "a", 10), (3, "a", 10))).first()
    assert (d.media_recente, d.media_anterior) == (10.0, 10.0)


def test_last_month_argument(spark):
    df = v(spark, *[(m, "a", m) for m in range(1, 8)])
    assert by_key(H.product_delta(df, last_month=date(2024, 6, 1)), "produto")["a"]["media_recente"] == 5.5
    assert [r.mes_ref for r in H.last_months(df).orderBy("ordem").collect()] == ["2024-07", "2024-06"]


def test_series_and_season(spark):
    df = v(spark, (1, "a", 10), (3, "a", 4))
    assert rows(H.product_month_series(df)) == [("2024-01", "a", 10.0, None), ("2024-03", "a", 4.0, -6.0)]
    s = by_key(H.seasonality_index(df), "mes_ano")
    assert (s[1]["indice"], s[3]["indice"]) == (10 / 7, 4 / 7)


def test_correlation(spark):
    data = [(c, "X", Decimal(100), Decimal(100 - d)) for c, d in ((1, 0), (2, 10), (3, 20)) for _ in range(3)]
    data.append((9, "X", Decimal(100), Decimal(1)))  # fewer than three billings
    df = spark.createDataFrame(data, "cliente_id bigint, canal string, valor_tabela decimal(18,4), receita decimal(18,4)")
    r = H.discount_correlation(df).first()
    assert (r.n, r.r, r.inclinacao, r.intercepto, r.interpretacao) == (3, -1.0, -100.0, 100.0, "forte negativa")
    assert H.discount_correlation(df.drop("valor_tabela")) is None


def test_product_month_counts_clients_once(spark):
    df = spark.createDataFrame([(date(2024, 1, d), "a", c, Decimal(2)) for d, c in ((1, 1), (2, 1), (3, 2))],
                               "data date, produto string, cliente_id bigint, receita decimal(18,4)")
    assert rows(H.product_month(df)) == [("2024-01", "a", 6.0, 2, 3)]
