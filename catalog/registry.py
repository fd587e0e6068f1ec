"""A query (Spark) with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# The sales view of the test tables (see FIXTURES.md), written as SQL.
SALES_CTE = """vendas AS (
  SELECT o.o_custkey AS cliente_id,
         CAST(o.o_orderdate AS DATE) AS data,
         CAST(date_trunc('month', o.o_orderdate) AS DATE) AS mes,
         strftime(o.o_orderdate, '%Y-%m') AS mes_ref,
         l.l_partkey AS produto_id,
         p.p_type AS produto,
         CASE WHEN p.p_type IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'recorrente' ELSE 'complementar' END AS tipo_produto,
         c.c_mktsegment AS canal, r.r_name AS regional, n.n_name AS gerencia,
         l.l_quantity AS quantidade,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS valor_tabela,
         CAST(l.l_discount AS DECIMAL(4,2)) AS desconto_pct,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS receita,
         CASE WHEN l.l_returnflag <> 'R' THEN 'Efetivado' ELSE 'Estornado' END AS status_faturamento
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  JOIN part p ON p.p_partkey = l.l_partkey
)"""

# Target of a month = the same month one year before, plus 5 %.
TARGET_CTE = """metas AS (
  SELECT strftime(mes + INTERVAL 1 YEAR, '%Y-%m') AS mes_ref, CAST(mes + INTERVAL 1 YEAR AS DATE) AS mes,
         canal, regional, produto, CAST(SUM(receita) * 1.05 AS DECIMAL(28,4)) AS meta_receita
  FROM vendas
  WHERE receita > 0 AND data >= DATE '1998-08-01' AND data < DATE '2000-08-01'
  GROUP BY ALL
)"""


def over_sales(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([SALES_CTE, *ctes]) + "\n" + select


def over_targets(*ctes: str, select: str) -> str:
    return over_sales(TARGET_CTE, *ctes, select=select)
