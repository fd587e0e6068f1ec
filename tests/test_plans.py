"""What the physical plans must and must not contain."""

import re

import pytest

from catalog import entries
from catalog.tables import AS_OF, vendas
from vendaflux.operators.filters import effective_only, horizon
from vendaflux.operators.ranking import global_rank
from vendaflux.plans import analyses
from vendaflux.plans.materialise import ensure_checkpoint_dir
from vendaflux.sources import synth
from vendaflux.sources.writers import write_results

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_no_python_and_no_cross_join(spark):
    for name, e in entries().items():
        if name.startswith(("write_", "insights_")):
            continue  # these run jobs while they are built
        text = plan(e.run(spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_reach_the_scan(spark):
    v = horizon(effective_only(vendas(spark, SF, "cliente_id", "data", "receita", "status_faturamento")), AS_OF, 12)
    text = plan(v)
    assert "GreaterThanOrEqual(o_orderdate,2000-08-01T00:00)" in text and "l_returnflag" in text
    schema = re.search(r"ReadSchema: struct<([^>]*l_returnflag[^>]*)>", text).group(1)
    assert "l_tax" not in schema and "l_shipdate" not in schema


@pytest.mark.parametrize("name", ["abc_classify", "abc_by_channel", "gini", "W_rank"])
def test_ranking_sends_no_client_rows_to_one_task(spark, no_broadcast, name):
    """A single-partition exchange may only carry range totals or partial aggregates."""
    lines = plan(entries()[name].run(spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate" in lines[i + 1], lines[i + 1]


@pytest.mark.parametrize("name", ["cohort_retention", "lifecycle_counts", "client_metrics", "gap_detail", "churn_by_channel"])
def test_rows_are_combined_before_the_shuffle(spark, no_broadcast, name):
    """Hash aggregation, not a sort of the raw rows, feeds the first exchange after the joins."""
    text = plan(entries()[name].run(spark, SF))
    assert "partial_" in text and "SortAggregate" not in text


def test_analyses_write_their_tables(spark, tmp_path):
    v = synth.synth_sales(spark, 4000, 150).persist()
    m = synth.synth_targets(v)
    runs = {"coorte": analyses.run_cohort(v), "pareto": analyses.run_pareto(v), "adhoc": analyses.run_adhoc(v), "gap": analyses.run_gap(v, m)}
    for name, tables in runs.items():
        assert {"resumo", "detalhe", "parametros"} <= set(tables)
        for path in write_results(tables, str(tmp_path / name)).values():
            assert spark.read.parquet(path).columns
    assert {"correlacao", "dispersao", "entrada"} <= set(runs["adhoc"])  # the discount is given as such
    assert "correlacao" not in (bare := analyses.run_adhoc(v.drop("desconto_pct"))) and "entrada" in bare
    bad = [r.regra for r in runs["gap"]["saida"].collect() if not r.ok]
    assert bad == []
    v.unpersist()


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_ranked_rows_move_once(spark, no_broadcast):
    """Client rows are shuffled to their range only; nothing is checkpointed."""
    df = spark.range(5000).selectExpr("id AS cliente_id", "CAST(id % 700 AS DECIMAL(18,4)) AS receita")
    text = plan(global_rank(df, "receita", "cliente_id"))
    lines = text.splitlines()
    below = [after for line, after in zip(lines, lines[1:]) if re.search(r"(?<!Broadcast)Exchange ", line)]
    assert "rangepartitioning" not in text and "Scan ExistingRDD" not in text
    # offsets are aggregated before they move, or are few rows by then; the rows themselves move once
    assert sum("Aggregate" not in x and "Window" not in x for x in below) == 1, below


@pytest.mark.parametrize("name", ["dq_sales", "duplicates"])
def test_duplicate_screening_shuffles_hashes_first(spark, no_broadcast, name):
    """The exchange that all rows pass carries the hash and a count."""
    text = plan(entries()[name].run(spark, SF))
    assert re.search(r"HashAggregate\(keys=\[_marca#\d+L?\], functions=\[partial_count", text)
    assert "LeftSemi" in text


def test_no_month_sequence_and_no_expand(spark):
    assert "sequence(" not in plan(entries()["lifecycle_counts"].run(spark, SF))
    for name in ("client_metrics", "client_lifespan", "cohort_retention"):
        text = plan(entries()[name].run(spark, SF))
        assert "Expand" not in text and "bit_or" in text, name


def test_months_are_looked_up_without_the_fact(spark):
    """The billed lines are read once; the months come from the orders."""
    for name in ("decompose_gap", "decompose_detail", "decompose_mix", "product_delta"):
        text = plan(entries()[name].run(spark, SF))
        assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) == 1, name


def test_gap_facts_need_no_checkpoint(spark, no_broadcast):
    text = plan(entries()["insights_gap"].run(spark, SF))
    assert "Scan ExistingRDD" not in text and "Expand" in text
