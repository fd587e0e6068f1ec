"""Product decline, and the relation between discount and ticket."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_key, month_start
from vendaflux.operators.filters import effective_only, horizon


def product_month(v: DataFrame) -> DataFrame:
    """Revenue, active clients and transactions per month and product.

    Counting clients after grouping by client keeps a hot product from
    gathering its rows in one task.
    """
    cells = v.groupBy(month_start("data").alias("_mes"), "produto", "cliente_id").agg(
        F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("_n"))
    return cells.groupBy("_mes", "produto").agg(
        F.sum("_r").alias("_r"), F.count("cliente_id").alias("clientes_ativos"), F.sum("_n").alias("transacoes"),
    ).select(month_key("_mes").alias("mes_ref"), "produto", M.as_double(F.col("_r")).alias("receita"),
             "clientes_ativos", "transacoes")


def product_month_series(v: DataFrame) -> DataFrame:
    """Monthly revenue per product with its change from the previous month present."""
    cells = v.groupBy(month_start("data").alias("_mes"), "produto").agg(F.sum("receita").alias("_r"))
    w = Window.partitionBy("produto").orderBy("_mes")  # one row per month
    return cells.select(
        month_key("_mes").alias("mes_ref"), "produto", M.as_double(F.col("_r")).alias("receita"),
        M.as_double(F.col("_r") - F.lag("_r").over(w)).alias("delta_mes"),
    )


def latest_months(v: DataFrame, n: int, last_month: date | None = None) -> DataFrame:
    """The n latest months present (at most n rows), with ``ordem`` 1 for the newest."""
    months = v.groupBy(month_start("data").alias("_mes")).agg(F.count(F.lit(1)).alias("_n"))
    if last_month is not None:
        months = months.filter(F.col("_mes") <= F.trunc(F.lit(last_month), "month"))
    top = months.orderBy(F.desc("_mes")).limit(n)
    return top.select("_mes", F.row_number().over(Window.orderBy(F.desc("_mes"))).alias("ordem"))


def last_months(v: DataFrame, n: int = 2) -> DataFrame:
    return latest_months(v, n).select(month_key("_mes").alias("mes_ref"), "ordem")


def recent_prior(v: DataFrame, recent: int = V.RECENT_MONTHS, prior: int = V.PRIOR_MONTHS,
                 last_month: date | None = None) -> DataFrame:
    """Which of the latest months belong to the recent and to the prior window."""
    return latest_months(v, recent + prior, last_month).select(
        month_key("_mes").alias("mes_ref"), "ordem",
        F.when(F.col("ordem") <= recent, "recente").otherwise("anterior").alias("janela"),
    )


def window_rows(v: DataFrame, recent: int, prior: int, last_month: date | None,
                dates: DataFrame | None = None) -> DataFrame:
    """Rows of the two windows with their ``ordem``; the month list has recent + prior rows."""
    months = latest_months(v if dates is None else dates, recent + prior, last_month)
    first = months.agg(F.min("_mes")).scalar()
    kept = v.filter(F.col("data") >= first).withColumn("_mes", month_start("data"))
    return kept.join(F.broadcast(months), "_mes", "inner")


def product_delta(v: DataFrame, recent: int = V.RECENT_MONTHS, prior: int = V.PRIOR_MONTHS,
                  last_month: date | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Mean monthly revenue per product: recent window against the prior one.

    The windows have different lengths, so means are compared.  A month in
    which a product was not billed counts as zero.  ``dates`` may name a cheaper
    table with the same dates to look the months up in.
    """
    sums = window_rows(v, recent, prior, last_month, dates).groupBy("produto").agg(
        F.coalesce(F.sum(F.when(F.col("ordem") <= recent, F.col("receita"))), F.lit(0)).alias("_rec"),
        F.coalesce(F.sum(F.when(F.col("ordem") > recent, F.col("receita"))), F.lit(0)).alias("_ant"),
    )
    now, before = F.col("_rec").cast("double") / recent, F.col("_ant").cast("double") / prior
    return sums.select(
        "produto", now.alias("media_recente"), before.alias("media_anterior"),
        (now - before).alias("delta"), M.ratio(now - before, before).alias("delta_pct"),
    )


def top_declines(delta: DataFrame, n: int = V.TOP_DECLINES) -> DataFrame:
    """The n products with the largest negative delta."""
    return delta.filter(F.col("delta") < 0).orderBy(F.asc("delta"), F.asc("produto")).limit(n)


def delta_bar_points(delta: DataFrame) -> DataFrame:
    sign = F.when(F.col("delta") < 0, "queda").otherwise("crescimento")
    return delta.select("produto", "delta", sign.alias("sinal"))


def seasonality_index(v: DataFrame) -> DataFrame:
    """Mean revenue of each calendar month over the mean of all months."""
    months = v.groupBy(month_start("data").alias("_mes")).agg(F.sum("receita").alias("_r"))
    per = months.groupBy(F.month("_mes").alias("mes_ano")).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()  # twelve rows
    overall = M.ratio(F.sum("_s").over(everything), F.sum("_n").over(everything))
    mean = M.ratio(F.col("_s"), F.col("_n"))
    return per.select("mes_ano", F.col("_n").alias("meses"), mean.alias("media"),
                      (mean / overall).alias("indice"))


def has_discount(v: DataFrame) -> bool:
    """Whether a discount is given (``desconto_pct``) or follows from a list price (``valor_tabela``)."""
    return bool({"desconto_pct", "valor_tabela"} & set(v.columns))


def discount_scope(v: DataFrame, as_of: date | None, months: int = 12) -> DataFrame:
    """Confirmed billings of the ``months`` before ``as_of``; without a date or a status column that test is left out."""
    if "status_faturamento" in v.columns:
        v = effective_only(v)
    return v if as_of is None else horizon(v, as_of, months)


def client_discount_ticket(v: DataFrame, min_tx: int = V.MIN_TRANSACTIONS, as_of: date | None = None) -> DataFrame:
    """Mean ticket and mean discount per client and channel with at least ``min_tx`` billings.

    The discount is ``desconto_pct`` where the table has it, else what the list price leaves.
    """
    if "desconto_pct" in v.columns:
        discount = F.col("desconto_pct").cast("double")
    else:
        discount = M.discount_pct(F.col("valor_tabela"), F.col("receita"))
    per = discount_scope(v, as_of).groupBy("cliente_id", "canal").agg(
        F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("transacoes"), F.avg(discount).alias("_d"),
    )
    return per.filter(F.col("transacoes") >= min_tx).select(
        "cliente_id", "canal", M.ratio(F.col("_r"), F.col("transacoes")).alias("ticket_medio"),
        F.round(F.col("_d"), 8).alias("desconto_medio"), "transacoes",
    )


def scatter_points(pairs: DataFrame) -> DataFrame:
    return pairs.select("cliente_id", "desconto_medio", "ticket_medio")


def pearson_discount_ticket(pairs: DataFrame) -> DataFrame:
    """Pearson r of discount and ticket over clients, with its reading."""
    r = F.round(F.corr("desconto_medio", "ticket_medio"), 6)
    return pairs.agg(F.count(F.lit(1)).alias("n"), r.alias("r")).select(
        "n", "r", M.correlation_label(F.col("r")).alias("interpretacao"))


def trend_line(pairs: DataFrame) -> DataFrame:
    """Least-squares line ticket = intercept + slope * discount."""
    return pairs.agg(
        F.round(F.regr_slope("ticket_medio", "desconto_medio"), 4).alias("inclinacao"),
        F.round(F.regr_intercept("ticket_medio", "desconto_medio"), 4).alias("intercepto"),
    )


def discount_correlation(v: DataFrame, min_tx: int = V.MIN_TRANSACTIONS, as_of: date | None = None) -> DataFrame | None:
    """r, line, n and reading in one pass; None when the table has neither a discount nor a list price."""
    if not has_discount(v):
        return None
    pairs = client_discount_ticket(v, min_tx, as_of)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.corr("desconto_medio", "ticket_medio"), 6).alias("r"),
        F.round(F.regr_slope("ticket_medio", "desconto_medio"), 4).alias("inclinacao"),
        F.round(F.regr_intercept("ticket_medio", "desconto_medio"), 4).alias("intercepto"),
    ).withColumn("interpretacao", M.correlation_label(F.col("r")))


def top_products(v: DataFrame, n: int = V.TOP_PRODUCTS) -> DataFrame:
    per = v.groupBy("produto").agg(F.sum("receita").alias("_r"))
    return per.orderBy(F.desc("_r"), F.asc("produto")).limit(n).select(
        "produto", M.as_double(F.col("_r")).alias("receita"))
