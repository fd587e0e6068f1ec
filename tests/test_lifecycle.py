from datetime import date
from decimal import Decimal

from conftest import rows
from vendaflux.operators import lifecycle as L

R, C = "recorrente", "complementar"


def months(spark, purchases, as_of):
    v = spark.createDataFrame([(1, date(2023 + (m - 1) // 12, (m - 1) % 12 + 1, 10), t, "X", Decimal(1)) for m, t in purchases],
                              "cliente_id bigint, data date, tipo_produto string, canal string, receita decimal(18,4)")
    return v, [r.status for r in L.lifecycle_status(v, as_of).orderBy("mes_ref").collect()]


def brute(purchases, last):
    """Month by month, as the rules read."""
    first = min(m for m, _ in purchases)
    out, before = [], None
    for m in range(first, last + 1):
        rec = any(x == m and t == R for x, t in purchases)
        last_rec = max([x for x, t in purchases if t == R and x <= m], default=first - 1)
        last_any = max(x for x, _ in purchases if x <= m)
        state = "Ativo" if rec else "Inativo" if m - last_any >= 12 else "Lost" if m - last_rec >= 3 else "Em risco"
        out.append("Reativado" if state == "Ativo" and before in ("Lost", "Inativo") else state)
        before = state
    return out


def test_paths(spark):
    paths = [
        [(1, R), (4, R)],                      # 2 empty months: never lost
        [(1, R), (5, R)],                      # 3 empty months: lost, then back
        [(1, R), (13, R)],                     # 11 empty months
        [(1, R), (14, R)],                     # 12 empty months: dormant, then back
        [(1, C), (2, C), (3, C), (4, C)],      # complementary only
        [(1, C), (6, R)],                      # first recurring billing after being lost
        [(1, R), (2, C), (3, C), (4, C), (20, C), (21, R)],
        [(1, R), (1, C), (2, R)],
    ]
    for p in paths:
        last = 24
        _, got = months(spark, p, date(2024, 12, 1))
        assert got == brute(p, last), p


def test_counts_close_over_all_statuses(spark):
    v, got = months(spark, [(1, R), (5, R)], date(2023, 8, 1))
    assert sum(r.clientes for r in L.lifecycle_counts(v, date(2023, 8, 1)).collect()) == len(got) == 8


def test_reactivation_churn_and_time(spark):
    v, _ = months(spark, [(1, R), (5, R)], date(2023, 12, 1))
    assert rows(L.reactivations(v, date(2023, 12, 1))) == [(3, 1, 0.5)]  # the second lapse is still open
    assert rows(L.churn_by_channel(v, date(2023, 12, 1))) == [("X", 1, 1, 1.0)]
    assert rows(L.time_to_lost(v, date(2023, 12, 1))) == [("X", 1, 3.0)]
    assert rows(L.gap_months(v)) == [(1, "2023-01", None), (1, "2023-05", 3)]


def test_channel_of_the_latest_month(spark):
    v = spark.createDataFrame(
        [(1, date(2023, 1, 1), R, "B"), (1, date(2023, 2, 1), R, "C"), (1, date(2023, 2, 2), C, "A")],
        "cliente_id bigint, data date, tipo_produto string, canal string")
    assert rows(L.churn_by_channel(v, date(2023, 2, 1))) == [("A", 1, 0, 0.0)]


def test_status_counts_add_up_to_the_clients_entered(spark):
    """On the test tables: every entered client has exactly one status per month."""
    from pyspark.sql import functions as F

    from catalog.tables import AS_OF, vendas

    v = vendas(spark, "/root/testdata/sf0.001", "cliente_id", "data", "tipo_produto")
    entered = v.groupBy("cliente_id").agg(F.date_format(F.min("data"), "yyyy-MM").alias("e"))
    counts = L.lifecycle_counts(v, AS_OF).groupBy("mes_ref").agg(F.sum("clientes").alias("n"))
    want = counts.join(entered, F.col("e") <= F.col("mes_ref")).groupBy("mes_ref", "n").agg(F.count(F.lit(1)).alias("k"))
    assert want.filter("n <> k").count() == 0 and want.count() == counts.count() > 0
