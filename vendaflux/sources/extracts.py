"""Star-join extracts: the transaction table that the four analyses read.

Input tables, by contract column:

* ``fact``      cliente_id, produto_id, data, receita, status_faturamento, valor_tabela
* ``clients``   cliente_id, canal, regional, gerencia
* ``products``  produto_id, produto
* ``targets``   mes, canal, regional, produto, meta_receita

Joins carry no broadcast hint.  Spark broadcasts a dimension whose size is
below ``spark.sql.autoBroadcastJoinThreshold`` (statically, or at run time from
measured shuffle sizes) and otherwise does a shuffled join whose skewed
partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_diff, month_key, month_start
from vendaflux.functions.monthset import Span, size
from vendaflux.operators.filters import effective_only, horizon


def star_join(fact: DataFrame, clients: DataFrame | None = None,
              products: DataFrame | None = None) -> DataFrame:
    """Inner equi-joins of the fact with the dimensions given."""
    out = fact
    if clients is not None:
        out = out.join(clients, "cliente_id", "inner")
    if products is not None:
        out = out.join(products, "produto_id", "inner")
    return out


def sales_base(fact: DataFrame, clients: DataFrame, products: DataFrame, as_of: date,
               years: int = 2) -> DataFrame:
    """One row per confirmed billing with channel, region and product."""
    kept = horizon(effective_only(fact), as_of, 12 * years)
    return star_join(kept, clients, products).select(
        "cliente_id", "data", M.as_double(F.col("receita")).alias("receita"),
        "canal", "regional", "produto",
    )


def sales_cohort_base(fact: DataFrame, clients: DataFrame, products: DataFrame, as_of: date,
                      years: int = 5, recurring: Sequence[str] = V.RECURRING_PRODUCTS, dates: DataFrame | None = None) -> DataFrame:
    """Each confirmed billing with its client's cohort, life month and lifetime figures.

    The client figures come from a pre-aggregate per client, which collapses a
    very large client to a row per task before the shuffle.  A window over raw
    rows would keep all rows of one client in one task.  The figures are joined
    to the client dimension first, so the fact is joined on the client only once.
    """
    kept = horizon(effective_only(fact), as_of, 12 * years)
    per_client = clients.join(client_lifespan(kept, dates), "cliente_id", "inner")
    return star_join(kept, per_client, products).select(
        "cliente_id", "data", M.as_double(F.col("receita")).alias("receita"),
        "canal", "regional", "gerencia", "produto",
        M.product_type(F.col("produto"), recurring).alias("tipo_produto"),
        month_key("primeira_compra").alias("safra"),
        "primeira_compra", "ultima_compra",
        month_diff("primeira_compra", "data").alias("meses_de_vida"),
        "meses_com_compra", "total_transacoes",
        M.as_double(F.col("receita_total")).alias("receita_total_cliente"),
    )


def client_lifespan(v: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """First and last purchase, months with purchase, transactions and revenue per client.

    Months are kept as a set of bits, so one exchange on the client is enough.  Their span comes from a small job over
    ``dates`` (any table with the dates of ``v``, itself by default).
    """
    span = Span.of(v if dates is None else dates)
    sets = [w.alias(f"_w{k}") for k, w in enumerate(span.collect("data"))]
    per_client = v.groupBy("cliente_id").agg(
        F.min("data").alias("primeira_compra"), F.max("data").alias("ultima_compra"), *sets,
        F.count(F.lit(1)).alias("total_transacoes"), F.sum("receita").alias("receita_total"),
    )
    return per_client.select(
        "cliente_id", "primeira_compra", "ultima_compra", size([F.col(f"_w{k}") for k in range(span.words)]).alias("meses_com_compra"),
        "total_transacoes", "receita_total")


def sales_discount_base(fact: DataFrame, clients: DataFrame, products: DataFrame, as_of: date,
                        years: int = 2, recurring: Sequence[str] = V.RECURRING_PRODUCTS) -> DataFrame:
    """Each confirmed billing with its discount, product type and calendar parts."""
    kept = horizon(effective_only(fact), as_of, 12 * years)
    return star_join(kept, clients, products).select(
        "cliente_id", "data", "produto", M.as_double(F.col("receita")).alias("receita"),
        M.discount_pct(F.col("valor_tabela"), F.col("receita")).alias("desconto_pct"),
        "canal", "regional", "gerencia",
        M.product_type(F.col("produto"), recurring).alias("tipo_produto"),
        month_key("data").alias("mes_ref"),
        F.quarter("data").alias("trimestre"), F.year("data").alias("ano"),
    )


def contract_discount(v: DataFrame, conditions: DataFrame) -> DataFrame:
    """Bring the contractual discount of each client; a client without terms has 0."""
    terms = conditions.select("cliente_id", F.col("desconto_contratual").alias("_d"))
    return v.join(terms, "cliente_id", "left").withColumn(
        "desconto_contratual", F.coalesce(F.col("_d").cast("double"), F.lit(0.0))
    ).drop("_d")


def target_base(targets: DataFrame, as_of: date, years: int = 2) -> DataFrame:
    """Positive targets inside the horizon, with a month key."""
    first = F.add_months(F.lit(as_of), -12 * years)
    return targets.filter((F.col("meta_receita") > 0) & (F.col("mes") >= first)).select(
        month_key("mes").alias("mes_ref"), "canal", "regional", "produto", "meta_receita",
    )


def target_from_growth(v: DataFrame, as_of: date, growth: float = V.TARGET_GROWTH,
                       keys: Sequence[str] = V.DIMENSIONS) -> DataFrame:
    """Target = same month of the previous year times (1 + growth), per key.

    The source window is [as_of - 3 years, as_of - 1 year).  Exact decimal result.
    """
    d = F.col("data")
    source = v.filter(
        (d >= F.add_months(F.lit(as_of), -36)) & (d < F.add_months(F.lit(as_of), -12)) & (F.col("receita") > 0)
    )
    factor = F.lit(str(round(1 + growth, 4))).cast("decimal(6,4)")
    return source.groupBy(month_start("data").alias("_mes"), *keys).agg(
        F.sum("receita").alias("_soma")
    ).select(
        F.add_months("_mes", 12).alias("mes"),
        month_key(F.add_months("_mes", 12)).alias("mes_ref"), *keys,
        (F.col("_soma").cast("decimal(28,4)") * factor).cast("decimal(28,4)").alias("meta_receita"),
    )


def _share_months(target: DataFrame, cells: DataFrame, coarse: Sequence[str]) -> DataFrame:
    """For each target the month whose sales give its shares (``_base``): its own month if it has sales, else the latest
    before it that has, else the earliest after it; NULL when its keys never sold."""
    months = cells.groupBy(*coarse).agg(F.collect_set("mes_ref").alias("_meses"))  # calendar months
    sold = target.join(months, list(coarse), "left")
    before = F.array_max(F.filter("_meses", lambda m: m <= F.col("mes_ref")))
    return sold.withColumn("_base", F.coalesce(before, F.array_min("_meses"))).drop("_meses")


def target_allocate(target: DataFrame, v: DataFrame, keys: Sequence[str],
                    fine_keys: Sequence[str]) -> DataFrame:
    """Spread a coarse target over finer keys in proportion to sales, to the cent.

    ``keys`` are the columns of the coarse target (with ``mes_ref``), ``fine_keys`` the additional ones.  Targets of
    one key are added up and taken in whole cents.  Shares come from the sales of the same month; without any, from
    the latest month before it with sales of these keys, else the earliest after it.  Keys that never sold are split
    in equal parts over all finer keys seen; with no sales at all the finer keys stay NULL.  Cells with a sum of zero
    or less weigh nothing.

    Cents are apportioned by largest remainder (equal remainders: by the finer keys), so the parts of a target add
    up to it exactly.  Products stay exact up to 10^16 in money: cents and weights are integers in decimals.
    """
    coarse = [k for k in keys if k != "mes_ref"] or ["_todos"]
    spread = target if "_todos" not in coarse else target.withColumn("_todos", F.lit(1))
    cents = F.rint if dict(target.dtypes)["meta_receita"] == "double" else F.round
    spread = spread.groupBy("mes_ref", *coarse).agg(
        cents(F.sum("meta_receita") * 100).cast("decimal(18,0)").alias("_centavos"))
    sales = v if "_todos" not in coarse else v.withColumn("_todos", F.lit(1))
    weight = (F.sum("receita").cast("decimal(28,4)") * 10000).cast("decimal(19,0)")
    cells = sales.groupBy(month_start("data").alias("_mes"), *coarse, *fine_keys).agg(weight.alias("_peso")).filter(
        "_peso > 0").withColumn("mes_ref", month_key("_mes")).drop("_mes")
    spread = _share_months(spread, cells, coarse)
    weighed = spread.filter("_base IS NOT NULL").join(
        cells.withColumnRenamed("mes_ref", "_base"), ["_base", *coarse]).select("mes_ref", *coarse, *fine_keys, "_centavos", "_peso")
    # keys without any sale get every value of the finer keys (dimension values, as one constant); the output is that large
    fine = cells.agg(F.array_sort(F.collect_set(F.struct(*fine_keys)))).scalar()
    never = spread.filter("_base IS NULL").drop("_base").withColumn("_finas", fine)
    equal = never.select("mes_ref", *coarse, "_centavos", F.explode_outer("_finas").alias("_f")).select(
        "mes_ref", *coarse, *[F.col(f"_f.{k}").alias(k) for k in fine_keys], "_centavos", F.lit(1).cast("decimal(19,0)").alias("_peso"))
    parts = weighed.unionByName(equal)

    # integer part and remainder of cents * weight / total; the cents left go to the largest remainders
    one = Window.partitionBy("mes_ref", *coarse)
    parts = parts.withColumns({"_total": F.sum("_peso").over(one).cast("decimal(19,0)"), "_valor": F.abs("_centavos")})
    exact = F.col("_valor") * F.col("_peso")
    parts = parts.withColumns({"_resto": exact % F.col("_total"), "_parte": F.expr("(_valor * _peso) div _total")})
    order = one.orderBy(F.desc("_resto"), *[F.asc(k) for k in fine_keys])
    parts = parts.withColumns({"_sobra": F.col("_valor") - F.sum("_parte").over(one), "_pos": F.row_number().over(order)})
    whole = F.col("_parte") + (F.col("_pos") <= F.col("_sobra")).cast("bigint")
    return parts.select(
        *keys, *fine_keys, M.ratio(F.col("_peso"), F.col("_total")).alias("participacao"),
        M.as_double((F.signum(F.col("_centavos")).cast("bigint") * whole).cast("decimal(20,0)") / 100).alias("meta_receita"))


def target_rollup(target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Aggregate a finer target (for example seller by month) up to ``keys``."""
    return target.groupBy(*keys).agg(M.as_double(F.sum("meta_receita")).alias("meta_receita"))
