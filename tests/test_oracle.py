"""Every registered query gives the rows of its SQL counterpart, at the smallest scale."""

from pathlib import Path

import pytest

from catalog import entries
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


# queries that may have no rows at the smallest scale
MAY_BE_EMPTY = {"declining_a_clients", "J_anti", "upsell_candidates", "duplicates", "client_discount_ticket", "scatter_points"}


@pytest.mark.parametrize("name", sorted(entries()))
def test_query(spark, con, name):
    message = compare(spark, con, SF, entries()[name])
    assert message == "" or (message == "no rows" and name in MAY_BE_EMPTY)


def test_contract():
    """Catalog queries have SQL; a corpus query has SQL or a test that names it and a brute-force computation."""
    import __spark_entry__ as e

    queries, sql = set(e.queries()), set(e.oracle_sql())
    assert set(entries()) <= sql <= queries
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("llm/test_*.py")).lower()
    assert [name for name in queries - sql if f"brute force: {name}" not in tests] == []


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["coorte", "periodo_idx", "clientes_ativos", "clientes_base", "retencao"]
    assert df.count() > 0
