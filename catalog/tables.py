"""The test tables seen through the sales contract.

``lineitem`` is the billing line; ``orders`` gives its date and client.  Orders
are joined with the client dimension first: that side is several times smaller
than the lines and a very large client is a hot key only there.  The lines are
then joined on the order key, which is unique on the orders side.

Only the dimensions that supply a wanted column are joined.  The keys are
enforced foreign keys in these tables, so leaving a dimension out loses no row
and saves a shuffle of the fact.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_key
from vendaflux.sources.extracts import target_from_growth

AS_OF = date(2001, 8, 1)
RECURRING = ("ECONOMY", "LARGE", "MEDIUM")

_CLIENT = {"canal", "regional", "gerencia"}
_PRODUCT = {"produto", "tipo_produto"}


# Declared schemas: without one, every read starts a job that opens file footers.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def clientes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("cliente_id"), F.col("c_mktsegment").alias("canal"),
        F.col("r_name").alias("regional"), F.col("n_name").alias("gerencia"))


def produtos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("produto_id"), F.col("p_type").alias("produto"))


def _status() -> Column:
    return F.when(F.col("l_returnflag") != "R", V.STATUS_EFFECTIVE).otherwise(V.STATUS_REVERSED)


# Contract columns that come from the billing line; only the wanted ones are built.
_LINE: dict[str, Callable[[], Column]] = {
    "produto_id": lambda: F.col("l_partkey"),
    "quantidade": lambda: F.col("l_quantity"),
    "valor_tabela": lambda: M.from_units(M.hundredths(F.col("l_extendedprice")), 2),
    "desconto_pct": lambda: M.from_units(M.hundredths(F.col("l_discount")), 2),
    "receita": lambda: M.net_revenue(F.col("l_extendedprice"), F.col("l_discount")),
    "status_faturamento": _status,
}


def vendas(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """The sales fact with the wanted contract columns."""
    want = set(cols)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("cliente_id"), F.col("o_orderdate").cast("date").alias("data"))
    if want & _CLIENT:
        orders = orders.join(clientes(spark, sf_dir), "cliente_id")
    products = want & _PRODUCT
    named = [n for n in _LINE if n in want or (products and n == "produto_id")]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *[_LINE[n]().alias(n) for n in named])
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if products:
        out = out.join(produtos(spark, sf_dir), "produto_id")
    if "tipo_produto" in want:
        out = out.withColumn("tipo_produto", M.product_type(F.col("produto"), RECURRING))
    if "mes_ref" in want:
        out = out.withColumn("mes_ref", month_key("data"))
    return out.select(*cols)


def datas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates of the fact, from the narrowest table that has them."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("data"))


def faturamento(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact alone, before any dimension."""
    return vendas(spark, sf_dir, "cliente_id", "produto_id", "data", "receita", "valor_tabela", "status_faturamento")


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets derived from last year's sales."""
    return target_from_growth(vendas(spark, sf_dir, "data", "canal", "regional", "produto", "receita"), AS_OF)
