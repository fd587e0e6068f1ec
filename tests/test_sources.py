import random
import re
from datetime import date
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from conftest import rows
from vendaflux.functions import values as V
from vendaflux.operators import decompose as D
from vendaflux.operators import quality as Q
from vendaflux.sources import extracts as E
from vendaflux.sources import readers as R
from vendaflux.sources import schema as S
from vendaflux.sources import synth
from vendaflux.sources import writers as W


def test_csv_round_trip(spark, tmp_path):
    v = synth.synth_sales(spark, 500, 20)
    W.write_csv(v, str(tmp_path / "vendas"))
    back = R.scan_sales(spark, str(tmp_path / "vendas"), "csv")
    assert back.schema.fieldNames() == S.SALES.fieldNames()
    assert rows(back) == rows(v)
    m = synth.synth_targets(v)
    W.write_results({"metas": m}, str(tmp_path), "parquet")
    assert rows(R.scan_targets(spark, str(tmp_path / "metas"))) == rows(m)


def test_files_are_read_by_column_name(spark, tmp_path):
    text = [" Cliente_ID ,extra,DATA,receita,canal", "7,x,2024-02-03,12.5,A", "8,y,n/a,, "]
    (tmp_path / "v.csv").write_text("\n".join(text))
    v = R.scan_sales(spark, str(tmp_path / "v.csv"))
    assert rows(v.select("cliente_id", "extra", "data", "receita", "canal", "mes_ref")) == sorted([
        (7, "x", date(2024, 2, 3), Decimal("12.5000"), "A", "2024-02"), (8, "y", None, None, None, None)], key=str)
    assert S.column_set_diff(v, ("produto", "data", "receita")) == {"produto"}
    with pytest.raises(ValueError, match="produto"):
        S.require_columns(v, ("produto",))
    spark.createDataFrame([(5.25, 3)], "RECEITA double, cliente_id int").write.parquet(str(tmp_path / "p"))
    assert dict(R.scan_sales(spark, str(tmp_path / "p")).dtypes) == {"receita": "decimal(18,4)", "cliente_id": "bigint"}


def test_month_layout_prunes(spark, tmp_path):
    v = synth.synth_sales(spark, 500, 20)
    path = W.write_by_month(v, str(tmp_path / "m"))
    df = spark.read.parquet(path)
    one = df.filter(df.mes_ref == "2024-01")
    assert "PartitionFilters: [isnotnull(mes_ref" in one._jdf.queryExecution().toString()
    assert df.count() == 500


def test_synthetic_data_repeats_and_keeps_its_rules(spark):
    a, b = synth.synth_sales(spark, 3000, 100), synth.synth_sales(spark, 3000, 100, partitions=3)
    assert rows(a) == rows(b)
    assert rows(a) != rows(synth.synth_sales(spark, 3000, 100, seed=7))
    report = {r.regra: r.violacoes for r in Q.dq_sales(a).collect()}
    assert set(report.values()) == {0}
    quantities = {r.canal: (r.lo, r.hi) for r in a.groupBy("canal").agg({"quantidade": "min", "cliente_id": "min"}).join(
        a.groupBy("canal").agg({"quantidade": "max"}), "canal").toDF("canal", "c1", "c2", "c3").selectExpr(
        "canal", "least(c1, c2) AS lo", "c3 AS hi").collect()}
    for name, _, lo, hi, _ in V.SYNTH_CHANNELS:
        assert quantities[name][0] >= lo and quantities[name][1] <= hi
    lo, hi = a.selectExpr("min(data)", "max(data)").first()
    assert str(lo) >= V.SYNTH_START and str(hi) <= V.SYNTH_END
    m = synth.synth_targets(a)
    assert set(r.violacoes for r in Q.dq_targets(m).collect()) == {0}
    joined = a.groupBy(*V.TARGET_KEYS).sum("receita").join(m, list(V.TARGET_KEYS)).selectExpr("meta_receita / `sum(receita)` AS x", "forecast_receita / meta_receita AS y")
    for r in joined.collect():
        assert 0.9499 <= r.x <= 1.0801 and 0.9599 <= r.y <= 1.0401


def test_standardise_and_rename(spark):
    raw = spark.createDataFrame([(" 7 ", "2024-01-05", "  ", "abc"), ("x", "n/a", "PME", "1.5")], "Cliente string, ` DATA ` string, canal string, receita string")
    clean = R.standardise(R.rename_columns(raw, {"Cliente": "cliente_id"}), fills={"canal": "?", "receita": 0})
    got = clean.select("cliente_id", "data", "canal", "receita", "custo").collect()
    assert [tuple(r) for r in got] == [(7, date(2024, 1, 5), "?", Decimal("0.0000"), None), (None, None, "PME", Decimal("1.5000"), None)]


def test_normalise_keys(spark):
    v = spark.createDataFrame([("Pequenas Empresas", 1), ("PME", 2), (None, 3)], "canal string, n int")
    mapping = spark.createDataFrame([("Pequenas Empresas", "PME")], "de string, para string")
    assert rows(R.normalise_keys(v, "canal", mapping)) == [("PME", 1), ("PME", 2), (None, 3)]


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "cliente_id int")
    assert S.column_set_diff(df, V.REQUIRED_COHORT) == {"data", "receita"}
    with pytest.raises(ValueError, match="data"):
        S.require_columns(df, V.REQUIRED_COHORT)


def test_jdbc_options_split_the_read():
    o = R.jdbc_options("jdbc:x://h/db", "SELECT * FROM faturamento", "cliente_id", "1", "1000", 64)
    assert o["dbtable"] == "(SELECT * FROM faturamento) AS extrato"
    assert (o["partitionColumn"], o["lowerBound"], o["upperBound"], o["numPartitions"]) == ("cliente_id", "1", "1000", "64")


def test_params(spark):
    assert rows(W.params_table(spark, a=1, b=None)) == [("a", "1"), ("b", None)]


def test_growth_target_window_and_factor(spark):
    data = [(date(2020, 12, 31), 100), (date(2021, 1, 1), 100), (date(2022, 12, 31), 7), (date(2023, 1, 1), 100), (date(2022, 12, 1), -5)]
    v = spark.createDataFrame([(d, "X", "S", "P", Decimal(r)) for d, r in data], "data date, canal string, regional string, produto string, receita decimal(18,4)")
    got = E.target_from_growth(v, date(2024, 1, 1)).select("mes_ref", "meta_receita")
    assert rows(got) == [("2022-01", Decimal("105.0000")), ("2023-12", Decimal("7.3500"))]


def test_allocation_keeps_the_total(spark):
    v = spark.createDataFrame([(date(2024, 1, 1), "X", p, Decimal(r)) for p, r in (("a", 1), ("b", 3))], "data date, canal string, produto string, receita decimal(18,4)")
    t = spark.createDataFrame([("2024-01", "X", Decimal(80))], "mes_ref string, canal string, meta_receita decimal(18,4)")
    assert rows(E.target_allocate(t, v, ["mes_ref", "canal"], ["produto"])) == [("2024-01", "X", "a", 0.25, 20.0), ("2024-01", "X", "b", 0.75, 60.0)]


def test_contract_discount(spark):
    v = spark.createDataFrame([(1,), (2,)], "cliente_id int")
    terms = spark.createDataFrame([(1, 0.1)], "cliente_id int, desconto_contratual double")
    assert rows(E.contract_discount(v, terms)) == [(1, 0.1), (2, 0.0)]


def apportioned(cents, weights):
    """Largest remainder over sorted keys, in whole numbers."""
    total = sum(weights.values())
    parts = {k: cents * w // total for k, w in weights.items()}
    left = cents - sum(parts.values())
    for k in sorted(weights, key=lambda k: (-(cents * weights[k] % total), k))[:left]:
        parts[k] += 1
    return parts


def test_allocation_against_brute_force(spark):
    """Months without sales, keys that never sold, awkward shares: the cents of every target are all there."""
    rnd = random.Random(11)
    months, shops, items = [date(2024, m, 1) for m in range(1, 7)], ["A", "B", "C"], ["p", "q", "r", "s", "t", "u", "v"]
    sales = [(m, c, p, Decimal(rnd.randrange(1, 10 ** 6)) / 10000) for m in months for c in shops[:2] for p in items if rnd.random() < 0.6 and (c, m.month) not in {("A", 3), ("A", 4), ("B", 1)}]
    goals = [(f"2024-{m:02}", c, Decimal(rnd.randrange(1, 10 ** 7)) / 100) for m in range(1, 8) for c in shops]
    v = spark.createDataFrame(sales, "data date, canal string, produto string, receita decimal(18,4)")
    t = spark.createDataFrame(goals + [("2024-01", "A", Decimal("0.01"))], "mes_ref string, canal string, meta_receita decimal(18,2)")
    want = {}
    for m, c, goal in goals:
        if (m, c) == ("2024-01", "A"):
            goal += Decimal("0.01")
        sold = sorted({f"{d:%Y-%m}" for d, k, _, _ in sales if k == c})
        base = max([x for x in sold if x <= m], default=min(sold, default=None))
        weights = {p: int(x * 10000) for d, k, p, x in sales if k == c and f"{d:%Y-%m}" == base} if base else {p: 1 for p in {s[2] for s in sales}}
        want |= {(m, c, p): n for p, n in apportioned(int(goal * 100), weights).items()}
    got = E.target_allocate(t, v, ["mes_ref", "canal"], ["produto"]).collect()
    assert {(r.mes_ref, r.canal, r.produto): round(r.meta_receita * 100) for r in got} == want and len(got) == len(want)
    for m, c, goal in goals:
        share = sum(r.participacao for r in got if (r.mes_ref, r.canal) == (m, c))
        assert share == pytest.approx(1)


def test_allocation_of_a_total_target_and_without_sales(spark):
    v = spark.createDataFrame([(date(2024, 1, 1), "X", Decimal(1)), (date(2024, 1, 9), "Y", Decimal(2)), (date(2024, 1, 9), "Z", Decimal(-5))], "data date, canal string, receita decimal(18,4)")
    t = spark.createDataFrame([("2024-05", Decimal(100))], "mes_ref string, meta_receita decimal(18,4)")
    assert rows(E.target_allocate(t, v, ["mes_ref"], ["canal"]).select("canal", "meta_receita")) == [("X", 33.33), ("Y", 66.67)]
    none = E.target_allocate(t, v.limit(0), ["mes_ref"], ["canal"])
    assert rows(none.select("mes_ref", "canal", "meta_receita")) == [("2024-05", None, 100.0)]


@pytest.mark.parametrize("most", [R.LITERAL_LABELS, 0])
def test_both_routes_of_a_mapping_give_the_same_rows(spark, most):
    """One label holds half of the rows; labels without a mapping, NULLs and chains are kept as they are."""
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c", None, "HOT"]), i) for i in range(2000)]
    v = spark.createDataFrame(data, "canal string, n int").repartition(7)
    pairs = {"hot": "HOT", "a": "b", "b": "x", "zz": "y"}
    mapping = spark.createDataFrame([*pairs.items(), (None, "never")], "de string, para string")
    got = R.normalise_keys(v, "canal", mapping, most)
    assert got.columns == v.columns and rows(got) == sorted(((pairs.get(c, c), n) for c, n in data), key=str)
    assert rows(R.normalise_keys(v, "canal", mapping.limit(0), most)) == rows(v)


def test_hot_label_is_dealt_to_several_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, x in zip(old, ("-1", "false")):
        spark.conf.set(k, x)
    try:
        v = spark.range(4000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("l").alias("canal"), "id")
        mapping = spark.createDataFrame([(f"x{i}", "y") for i in range(500)] + [("hot", "HOT")], "de string, para string")
        got = R.normalise_keys(v, "canal", mapping).withColumn("task", F.spark_partition_id()).filter("canal = 'HOT'")
        assert got.select("task").distinct().count() > 3 and got.count() == 2666
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_stored_months_prune_the_scan(spark, tmp_path):
    """Months come from folder names; the scan lists only the months wanted, and results equal those of the whole table."""
    data = [(date(2024, m, 3), f"2024-{m:02}", c, k, Decimal(10 * m + k)) for m in (1, 2, 4, 5) for c in "XY" for k in range(m)]
    v = spark.createDataFrame(data, "data date, mes_ref string, canal string, cliente_id int, receita decimal(18,4)")
    stored = spark.read.parquet(W.write_by_month(v, str(tmp_path / "extract")))
    assert R.stored_months(stored) == ["2024-05", "2024-04", "2024-02", "2024-01"]
    two = R.latest_stored_months(stored, 2)
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[mes_ref#\d+ IN \(2024-05,2024-04\)\]", plan)
    assert rows(two.select("mes_ref").distinct()) == [("2024-04",), ("2024-05",)]
    text = D.decompose_gap(two, dates=two)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text
    assert rows(D.decompose_gap(two)) == rows(D.decompose_gap(v))
    assert rows(R.latest_stored_months(stored, 1, "2024-03").select("mes_ref").distinct()) == [("2024-02",)]
    months = spark.createDataFrame([("2024-01", 1), ("2024-01", 2), ("2024-04", 1), ("2030-01", 1)], "mes_ref string, k int")
    some = R.rows_of_months(stored, months.filter("k = 1"))
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower() and some.count() == 10


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("São Paulo", 1), ("x, \"y\"", 2)], ["região", "n"]).coalesce(1)
    path = W.write_csv(df, str(tmp_path / "csv"), bom=True)
    data = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert data.startswith("﻿região,n\n".encode()) and data.decode("utf-8-sig").startswith("região,n\nSão Paulo,1")
    assert not next(iter((tmp_path / W.write_csv(df, str(tmp_path / "plain"))).glob("part-*"))).read_bytes().startswith(b"\xef")
    assert path.endswith("csv")
