import random
from datetime import date

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import rows
from vendaflux.functions.monthset import Span, has, size
from vendaflux.operators import cohort as C
from vendaflux.sources.extracts import client_lifespan


def test_sets_of_a_long_history(spark):
    """Forty years need eight words; sizes and members equal plain sets."""
    rnd = random.Random(2)
    data = [(c, date(1980 + rnd.randrange(40), 1 + rnd.randrange(12), 1 + rnd.randrange(28))) for c in range(12) for _ in range(rnd.choice([1, 30, 300]))]
    v = spark.createDataFrame(data, "cliente_id int, data date")
    span = Span.of(v)
    assert span.words == 8
    sets = v.groupBy("cliente_id").agg(*[w.alias(f"w{k}") for k, w in enumerate(span.collect("data"))])
    words = [F.col(f"w{k}") for k in range(span.words)]
    months = F.filter(F.sequence(F.lit(0), F.lit(span.months + 5)), lambda i: has(words, i))
    got = {r[0]: (r[1], r[2]) for r in sets.select("cliente_id", size(words), months).collect()}
    for c in range(12):
        want = sorted({d.year * 12 + d.month - span.first for k, d in data if k == c})
        assert got[c] == (len(want), want)


def test_no_rows_and_dates_outside(spark):
    v = spark.createDataFrame([(1, date(2020, 1, 5)), (1, date(2021, 1, 5))], "cliente_id int, data date").withColumn("receita", F.lit(1).cast("decimal(18,4)"))
    assert rows(client_lifespan(v.limit(0))) == []
    assert rows(C.cohort_retention(v.limit(0))) == []
    with pytest.raises(PySparkException, match="outside the months"):
        client_lifespan(v, v.filter("data < DATE '2021-01-01'")).collect()
    assert [r.periodo_idx for r in C.cohort_retention(v).orderBy("periodo_idx").collect()] == [0, 12]


def test_matrix_of_a_known_width(spark):
    v = spark.createDataFrame([(1, date(2020, 1, 5)), (1, date(2020, 3, 5)), (2, date(2020, 3, 5))], "cliente_id int, data date")
    ret = C.cohort_retention(v)
    wide = C.retention_matrix(ret, widest=C.life_months(v))
    assert wide.columns == ["coorte", "m0", "m1", "m2"] and rows(wide) == [("2020-01", 1.0, None, 1.0), ("2020-03", 1.0, None, None)]
    with pytest.raises(PySparkException, match="life month above 1"):
        C.retention_matrix(ret, widest=1).collect()
