from datetime import date
from decimal import Decimal

import pytest

from conftest import by_key, rows
from vendaflux.operators import cohort as C

SCHEMA = "cliente_id bigint, data date, receita decimal(18,4)"


def example(spark):
    """100 clients enter in January 2023; 72, 58 and 51 of them buy in the next months."""
    data = [(c, date(2023, 1, 1 + c % 28), Decimal(10)) for c in range(100)]
    for month, kept in ((2, 72), (3, 58), (4, 51)):
        data += [(c, date(2023, month, 3), Decimal(10)) for c in range(kept)]
    data += [(0, date(2023, 2, 20), Decimal(5))]  # a second purchase in the month counts once
    data += [(500, date(2023, 3, 31), Decimal(7)), (500, date(2023, 5, 1), Decimal(7))]
    return spark.createDataFrame(data, SCHEMA)


def test_worked_example(spark):
    got = rows(C.cohort_retention(example(spark)))
    assert got == [
        ("2023-01", 0, 100, 100, 1.0), ("2023-01", 1, 72, 100, 0.72), ("2023-01", 2, 58, 100, 0.58), ("2023-01", 3, 51, 100, 0.51),
        ("2023-03", 0, 1, 1, 1.0), ("2023-03", 2, 1, 1, 1.0)]


def test_summary_and_matrix(spark):
    v = example(spark)
    s = by_key(C.cohort_summary(v), "coorte")
    assert s["2023-01"]["receita"] == 2815.0 and s["2023-01"]["retencao_m3"] == 0.51
    assert s["2023-03"]["retencao_m1"] is None and s["2023-03"]["retencao_m2"] == 1.0
    m = C.retention_matrix(C.cohort_retention(v))
    assert m.columns == ["coorte", "m0", "m1", "m2", "m3"]
    assert by_key(m, "coorte")["2023-03"] == {"coorte": "2023-03", "m0": 1.0, "m1": None, "m2": 1.0, "m3": None}
    assert C.retention_matrix(C.cohort_retention(v), 5).columns == ["coorte", *[f"m{k}" for k in range(6)]]
    with pytest.raises(ValueError, match="drop life months"):
        C.retention_matrix(C.cohort_retention(v), 2)
    assert rows(C.cohort_averages(C.cohort_summary(v))) == [(1, 0.72, 0.58, 0.51)]
    assert rows(C.max_life_month(v)) == [(3, 2)]


def test_matrix_of_a_long_history(spark):
    v = spark.createDataFrame([(1, date(2000 + k // 12, k % 12 + 1, 3), Decimal(1)) for k in range(100)], SCHEMA)
    assert C.retention_matrix(C.cohort_retention(v)).columns[-1] == "m99"


def test_channel_keeps_the_global_cohort(spark):
    v = spark.createDataFrame([(1, date(2023, 1, 5), Decimal(1), "A"), (1, date(2023, 2, 5), Decimal(1), "B")], SCHEMA + ", canal string")
    assert rows(C.cohort_by_channel(v)) == [("A", "2023-01", 0, 1, 1, 1.0), ("B", "2023-01", 1, 1, None, None)]


def test_best_and_worst_ties(spark):
    s = spark.createDataFrame([("2023-0%d" % i, r) for i, r in enumerate([0.5, 0.5, 0.1, None, 0.9], 1)], "coorte string, retencao_m1 double")
    got = [(r.grupo, r.posicao, r.coorte) for r in C.cohort_best_worst(s, 2).orderBy("grupo", "posicao").collect()]
    assert got == [("melhores", 1, "2023-05"), ("melhores", 2, "2023-01"), ("piores", 1, "2023-03"), ("piores", 2, "2023-01")]
