"""Revenue concentration: ABC classes, KPIs, migration, Gini."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_diff
from vendaflux.functions.monthset import Span, size
from vendaflux.operators.ranking import global_rank, top_n


def client_revenue(v: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact revenue per client (and key)."""
    return v.groupBy(*by, "cliente_id").agg(F.sum("receita").alias("receita"))


def client_metrics(v: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Revenue, ticket, activity and dates per client, in one read of the fact and one exchange.

    Active months are a set of bits, so the one distinct count left is that of products; rows are combined per client
    and product before the shuffle.  The span of months comes from a small job over ``dates`` (any table with the
    dates of ``v``, itself by default).
    """
    n, total = F.count(F.lit(1)), F.sum("receita")
    span = Span.of(v if dates is None else dates)
    sets = [w.alias(f"_w{k}") for k, w in enumerate(span.collect("data"))]
    per_client = v.groupBy("cliente_id").agg(
        total.alias("receita"), M.ratio(total, n).alias("ticket_medio"), n.alias("qtd_transacoes"), *sets,
        F.countDistinct("produto").alias("qtd_produtos"),
        F.min("data").alias("primeira_compra"), F.max("data").alias("ultima_compra"),
        month_diff(F.min("data"), F.max("data")).alias("meses_relacionamento"),
    )
    return per_client.select(
        "cliente_id", "receita", "ticket_medio", "qtd_transacoes",
        size([F.col(f"_w{k}") for k in range(span.words)]).alias("meses_ativo"), "qtd_produtos",
        "primeira_compra", "ultima_compra", "meses_relacionamento")


def rank_and_classify(revenue: DataFrame, by: Sequence[str] = (), a: float = V.ABC_A,
                      b: float = V.ABC_B, cut_by: DataFrame | None = None) -> DataFrame:
    """Rank, share, cumulative share and class over exact revenues.

    Equal revenues are ordered by client.  A cumulative share of exactly ``a``
    is still A; everything above ``b`` is C.
    """
    ranked = global_rank(revenue, "receita", "cliente_id", by, cut_by)
    cumulative = M.ratio(F.col("acumulado"), F.col("total"))
    return ranked.withColumns({
        "pct_receita": M.ratio(F.col("receita"), F.col("total")),
        "pct_acumulado": cumulative,
        "classe_abc": M.abc_class(cumulative, a, b),
    })


def abc_classify(v: DataFrame, a: float = V.ABC_A, b: float = V.ABC_B) -> DataFrame:
    return _published(rank_and_classify(client_revenue(v), (), a, b))


def _published(abc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return abc.select(
        *by, "posicao_ranking", "cliente_id", M.as_double(F.col("receita")).alias("receita"),
        "pct_receita", "pct_acumulado", "classe_abc",
    )


def abc_by_channel(v: DataFrame, by: str = "canal") -> DataFrame:
    """ABC inside each channel."""
    return _published(rank_and_classify(client_revenue(v, [by]), [by]), [by])


def abc_client_report(fact: DataFrame, clients: DataFrame, as_of: date, dates: DataFrame | None = None) -> DataFrame:
    """One row per client: metrics, class, dimension, and an alert for lapsed class A clients.

    ``fact`` is already limited to the wanted billings.  Clients without a
    dimension row drop out after the ranking, as in an inner join.
    """
    abc = rank_and_classify(client_metrics(fact, dates), cut_by=client_revenue(fact))
    lapsed = month_diff(F.col("ultima_compra"), F.lit(as_of)) >= V.INACTIVE_AFTER_MONTHS
    alert = F.when((F.col("classe_abc") == "A") & lapsed, V.FLAG_YES).otherwise(V.FLAG_NO)
    return abc.join(clients, "cliente_id", "inner").select(
        "posicao_ranking", "cliente_id", "canal", "regional", "gerencia",
        M.as_double(F.col("receita")).alias("receita"), "ticket_medio",
        "pct_receita", "pct_acumulado", "classe_abc",
        "meses_ativo", "qtd_transacoes", "qtd_produtos", "meses_relacionamento",
        "primeira_compra", "ultima_compra", alert.alias("alerta_cliente_a_inativo"),
    )


def _class_totals(abc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the count and revenue of each class and of the top 1, 3 and 10."""
    def cnt(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    def amount(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("receita"))), F.lit(0))

    aggs = [F.count(F.lit(1)).alias("n"), F.sum("receita").alias("total")]
    for cls in "ABC":
        is_cls = F.col("classe_abc") == cls
        aggs += [cnt(is_cls).alias(f"n_{cls}"), amount(is_cls).alias(f"r_{cls}")]
    for n in (1, 3, 10):
        aggs.append(amount(F.col("posicao_ranking") <= n).alias(f"top_{n}"))
    return abc.groupBy(*keys).agg(*aggs)


def abc_summary(abc: DataFrame) -> DataFrame:
    """The ten concentration KPIs as rows (kpi, valor, descricao)."""
    t = _class_totals(abc)
    total, n = F.col("total"), F.col("n")
    figures = {
        "clientes_total": n.cast("double"),
        "receita_total": M.as_double(total),
        "top_10_participacao": M.ratio(F.col("top_10"), total),
        "classe_A_pct_clientes": M.ratio(F.col("n_A"), n),
    }
    for cls in "ABC":
        figures[f"classe_{cls}_clientes"] = F.col(f"n_{cls}").cast("double")
        figures[f"classe_{cls}_participacao"] = M.ratio(F.col(f"r_{cls}"), total)
    rows = [
        F.struct(F.lit(kpi).alias("kpi"), figures[kpi].alias("valor"), F.lit(text).alias("descricao"))
        for kpi, text in V.ABC_KPIS
    ]
    return t.select(F.inline(F.array(*rows)))


def abc_distribution(v: DataFrame) -> DataFrame:
    """Clients and revenue per class."""
    abc = rank_and_classify(client_revenue(v))
    return abc.groupBy(F.col("classe_abc").alias("classe")).agg(
        F.count(F.lit(1)).alias("clientes"), M.as_double(F.sum("receita")).alias("receita_classe")
    )


def top_n_share(v: DataFrame, sizes: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """Revenue share of the n largest clients, for each n.

    Only a distributed top-k and a total are needed, so nothing is ranked globally.
    """
    revenue = client_revenue(v)
    top = top_n(revenue, "receita", "cliente_id", max(sizes))
    pos = F.row_number().over(Window.orderBy(F.desc("receita"), F.asc("cliente_id")))  # max(sizes) rows
    total = revenue.agg(F.sum("receita")).scalar()
    parts = [F.sum(F.when(F.col("_pos") <= n, F.col("receita"))).alias(f"s{n}") for n in sizes]
    rows = [F.struct(F.lit(n).alias("top_n"), M.ratio(F.col(f"s{n}"), F.col("_t")).alias("participacao"))
            for n in sizes]
    return top.withColumn("_pos", pos).agg(*parts).withColumn("_t", total).select(F.inline(F.array(*rows)))


def pareto_points(abc: DataFrame, n: int = V.PARETO_POINTS) -> DataFrame:
    """The n largest clients with revenue, cumulative share in percent and class."""
    return abc.filter(F.col("posicao_ranking") <= n).select(
        "posicao_ranking", "cliente_id", M.as_double(F.col("receita")).alias("receita"),
        (F.col("pct_acumulado") * 100).alias("pct_acumulado"), "classe_abc",
    )


def concentration_risk(v: DataFrame, n: int = V.TOP_CLIENTS) -> DataFrame:
    """Share of the n largest clients and its risk level."""
    return top_n_share(v, (n,)).select(
        F.col("participacao").alias("top_10_participacao"), M.risk_level(F.col("participacao")).alias("nivel_risco")
    )


def inactive_clients(v: DataFrame, as_of: date) -> DataFrame:
    """Count of clients with revenue whose last purchase is 3 or more months ago (any class)."""
    per_client = v.filter(F.col("receita") > 0).groupBy("cliente_id").agg(
        F.max("data").alias("_ultima"), F.sum("receita").alias("_r"))
    lapsed = month_diff(F.col("_ultima"), F.lit(as_of)) >= V.INACTIVE_AFTER_MONTHS
    return per_client.filter((F.col("_r") > 0) & lapsed).agg(F.count(F.lit(1)).alias("clientes_inativos"))


# Consecutive number of each period, and how it is published.
_PERIODS: dict[str, tuple[Callable[[], Column], Callable[[Column], Column]]] = {
    "ano": (lambda: F.year("data"), lambda i: i),
    "trimestre": (lambda: F.year("data") * 4 + F.quarter("data") - 1,
                  lambda i: F.format_string("%d-T%d", F.floor(i / 4), i % 4 + 1)),
    "mes": (lambda: F.year("data") * 12 + F.month("data") - 1,
            lambda i: F.format_string("%d-%02d", F.floor(i / 12), i % 12 + 1)),
}


def _classes_by_period(v: DataFrame, period: str) -> DataFrame:
    number, _ = _PERIODS[period]
    dated = v.select("cliente_id", "receita", number().alias("_p"))
    return rank_and_classify(client_revenue(dated, ["_p"]), ["_p"])


def _label(period: str, number: Column) -> Column:
    return _PERIODS[period][1](number).alias("periodo")


def abc_over_time(v: DataFrame, period: str = "ano") -> DataFrame:
    """Per period (ano, trimestre, mes): clients, share of clients in A, revenue share of A, top-10 share."""
    t = _class_totals(_classes_by_period(v, period), ["_p"])
    return t.select(
        _label(period, F.col("_p")), F.col("n").alias("clientes"),
        M.ratio(F.col("r_A"), F.col("total")).alias("classe_A_participacao"),
        M.ratio(F.col("n_A"), F.col("n")).alias("classe_A_pct_clientes"),
        M.ratio(F.col("top_10"), F.col("total")).alias("top_10_participacao"),
    )


def _with_neighbours(v: DataFrame, period: str) -> DataFrame:
    """Class of each client and period, the class of the period before, and whether the next one exists."""
    w = Window.partitionBy("cliente_id").orderBy("_p")  # one row per client and period
    previous = F.when(F.lag("_p").over(w) == F.col("_p") - 1, F.lag("classe_abc").over(w))
    follows = F.coalesce(F.lead("_p").over(w) == F.col("_p") + 1, F.lit(False))
    return _classes_by_period(v, period).select(
        "cliente_id", "_p", "receita", "classe_abc", previous.alias("classe_anterior"), follows.alias("_segue"))


def class_previous(v: DataFrame, period: str = "ano") -> DataFrame:
    """Class of each client in each period, and in the period before (NULL when absent)."""
    return _with_neighbours(v, period).select(
        "cliente_id", _label(period, F.col("_p")), M.as_double(F.col("receita")).alias("receita"),
        "classe_abc", "classe_anterior")


def abc_migration(v: DataFrame, period: str = "ano") -> DataFrame:
    """Clients and revenue per (period, class before, class now), with new and lost clients.

    ``receita`` is the revenue of the period; for lost clients that of the one
    before.  The first period has no predecessor, and nobody is lost after the
    last.  Two windows on the client replace a full outer self-join.
    """
    rows = _with_neighbours(v, period)
    bounds = rows.agg(F.struct(F.min("_p").alias("a"), F.max("_p").alias("b"))).scalar()
    moved = F.struct(
        F.col("_p").alias("_q"), F.coalesce("classe_anterior", F.lit("novo")).alias("de"),
        F.col("classe_abc").alias("para"), (F.col("_p") > bounds["a"]).alias("ok"))
    lost = F.struct(
        (F.col("_p") + 1).alias("_q"), F.col("classe_abc").alias("de"), F.lit("perdido").alias("para"),
        (~F.col("_segue") & (F.col("_p") < bounds["b"])).alias("ok"))
    events = rows.select("receita", F.inline(F.array(moved, lost))).filter("ok")
    return events.groupBy("_q", "de", "para").agg(
        F.count(F.lit(1)).alias("clientes"), F.sum("receita").alias("_r")
    ).select(_label(period, F.col("_q")), "de", "para", "clientes", M.as_double(F.col("_r")).alias("receita"))


def gini(v: DataFrame) -> DataFrame:
    """Gini coefficient of client revenue (0 = equal, 1 = all with one client)."""
    ranked = global_rank(client_revenue(v), "receita", "cliente_id")
    ascending = (F.col("n_total") - F.col("posicao_ranking") + 1).cast("double")
    weighted = F.sum(ascending * F.col("receita").cast("double"))
    n = F.count(F.lit(1)).cast("double")
    total = F.sum("receita").cast("double")
    return ranked.agg(F.count(F.lit(1)).alias("clientes"),
                      F.round(weighted * 2 / (n * total) - (n + 1) / n, 8).alias("gini"))


def upsell_candidates(report: DataFrame, min_products: int = 2) -> DataFrame:
    """Class B clients that already buy several products."""
    return report.filter((F.col("classe_abc") == "B") & (F.col("qtd_produtos") >= min_products))


def declining_a_clients(v: DataFrame, as_of: date, n: int = 3) -> DataFrame:
    """Class A clients whose mean monthly revenue of the last n months is below the n before.

    Months are calendar months up to and including that of ``as_of``; an empty
    month counts as zero.  One aggregation gives revenue and both windows.
    """
    back = month_diff(F.col("data"), F.lit(as_of))
    recent = F.sum(F.when(back.between(0, n - 1), F.col("receita")))
    prior = F.sum(F.when(back.between(n, 2 * n - 1), F.col("receita")))
    per_client = v.groupBy("cliente_id").agg(
        F.sum("receita").alias("receita"),
        F.coalesce(recent, F.lit(0)).alias("_rec"), F.coalesce(prior, F.lit(0)).alias("_ant"),
    )
    abc = rank_and_classify(per_client)
    return abc.filter((F.col("classe_abc") == "A") & (F.col("_rec") < F.col("_ant"))).select(
        "cliente_id",
        (F.col("_rec").cast("double") / n).alias("media_recente"),
        (F.col("_ant").cast("double") / n).alias("media_anterior"),
    )


def top_clients(v: DataFrame, n: int = V.TOP_CLIENTS) -> DataFrame:
    return top_n(client_revenue(v), "receita", "cliente_id", n).select(
        "cliente_id", M.as_double(F.col("receita")).alias("receita"))
