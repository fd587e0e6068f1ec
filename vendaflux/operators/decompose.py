"""Why revenue changed between two periods: volume, price, mix and their interaction."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions.months import month_key, month_start
from vendaflux.operators.filters import shift


def two_months(dates: DataFrame, last_month: date | None = None, calendar: bool = False) -> DataFrame:
    """One row with the current and the previous month.

    The previous month is the latest one *present* before the current, or the
    calendar month before it when ``calendar`` is set.
    """
    months = dates.select(month_start("data").alias("_mes")).distinct()
    if last_month is not None:
        months = months.filter(F.col("_mes") <= F.trunc(F.lit(last_month), "month"))
    newest = F.sort_array(F.collect_set("_mes"), asc=False)  # months are few
    row = months.agg(newest.alias("_m"))
    current = F.try_element_at("_m", F.lit(1))
    previous = F.add_months(current, -1) if calendar else F.try_element_at("_m", F.lit(2))
    return row.select(F.struct(current.alias("atual"), previous.alias("anterior")).alias("par"))


class _Pair(NamedTuple):
    current: Column
    previous: Column

    def rows(self, v: DataFrame) -> DataFrame:
        """Rows of the two months with ``_p`` = 1 (current) or 0 (previous)."""
        month = month_start("data")
        inside = (F.col("data") >= self.previous) & (F.col("data") < F.add_months(self.current, 1))
        kept = v.filter(inside).filter((month == self.current) | (month == self.previous))
        return kept.withColumn("_p", F.when(F.col("data") >= self.current, 1).otherwise(0))


def _pair(v: DataFrame, last_month: date | None, calendar: bool, dates: DataFrame | None) -> _Pair:
    """The two months, as constants when the caller fixes both, else as one scalar subquery.

    Either way the fact is filtered by date before any shuffle.  With fewer
    than two months the previous one is NULL and nothing is left.
    """
    if last_month is not None and calendar:
        first = F.lit(last_month.replace(day=1))
        return _Pair(first, F.add_months(first, -1))
    pair = two_months(v if dates is None else dates, last_month, calendar).scalar()
    return _Pair(pair["atual"], pair["anterior"])


def _when(p: int, c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.col("_p") == p, c)


def _effects(df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Effects from clients, ticket and revenue of both periods (``c0 c1 t0 t1 r0 r1``)."""
    dc, dt = F.col("c1") - F.col("c0"), F.col("t1") - F.col("t0")
    return df.select(
        *keys,
        F.col("c0").alias("clientes_ant"), F.col("c1").alias("clientes_atual"),
        F.col("t0").alias("ticket_ant"), F.col("t1").alias("ticket_atual"),
        (dc * F.col("t0")).alias("efeito_volume"),
        (F.col("c0") * dt).alias("efeito_preco"),
        (dc * dt).alias("efeito_cruzado"),
        M.as_double(F.col("r1") - F.col("r0")).alias("gap_total"),
        *extra,
    )


def decompose_gap(v: DataFrame, by: Sequence[str] = ("canal",), last_month: date | None = None,
                  calendar: bool = False, dates: DataFrame | None = None) -> DataFrame:
    """Volume, price and cross effect between the last two months, per ``by``.

    Ticket is revenue over distinct clients.  A group present in one month only
    has zeros in the other.  volume + price + cross = gap.  ``dates`` may name
    a cheaper table with the same dates to look the months up in.
    """
    pair = _pair(v, last_month, calendar, dates)
    clients = pair.rows(v).groupBy(*by, "_p", "cliente_id").agg(F.sum("receita").alias("_r"))
    sums = clients.groupBy(*by).agg(
        F.count(_when(0, "cliente_id")).alias("c0"), F.count(_when(1, "cliente_id")).alias("c1"),
        F.coalesce(F.sum(_when(0, "_r")), F.lit(0)).alias("r0"),
        F.coalesce(F.sum(_when(1, "_r")), F.lit(0)).alias("r1"),
    ).withColumns({
        "t0": M.ratio_or_zero(F.col("r0"), F.col("c0")), "t1": M.ratio_or_zero(F.col("r1"), F.col("c1")),
    })
    months = [month_key(pair.previous).alias("mes_anterior"), month_key(pair.current).alias("mes_atual")]
    money = [M.as_double(F.col("r0")).alias("receita_ant"), M.as_double(F.col("r1")).alias("receita_atual")]
    return _effects(sums, by, [*money, *months])


def decompose_detail(v: DataFrame, last_month: date | None = None, dates: DataFrame | None = None) -> DataFrame:
    """The same effects per channel and product."""
    return decompose_gap(v, ("canal", "produto"), last_month, dates=dates)


def decompose_gap_rolling(v: DataFrame, as_of: date, by: Sequence[str] = ("canal",)) -> DataFrame:
    """Rolling months ending at ``as_of``, with the ticket as the mean per transaction.

    With this ticket the effects do not add up to the gap in general; the
    residue is what ``decompose_check`` reports.
    """
    d = F.col("data")
    recent, start = shift(as_of, -1), shift(as_of, -2)
    kept = v.filter((d >= start) & (F.col("receita") > 0)).withColumn("_p", F.when(d >= recent, 1).otherwise(0))
    clients = kept.groupBy(*by, "_p", "cliente_id").agg(F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("_n"))
    sums = clients.groupBy(*by).agg(*[
        a for p in (0, 1) for a in (
            F.count(_when(p, "cliente_id")).alias(f"c{p}"),
            F.coalesce(F.sum(_when(p, "_r")), F.lit(0)).alias(f"r{p}"),
            F.coalesce(F.sum(_when(p, "_n")), F.lit(0)).alias(f"n{p}"),
        )
    ]).withColumns({f"t{p}": M.ratio_or_zero(F.col(f"r{p}"), F.col(f"n{p}")) for p in (0, 1)})
    return _effects(sums, by)


def channel_month_kpis(v: DataFrame, month: date | None = None) -> DataFrame:
    """Distinct clients, revenue and ticket per channel for one month (default: the last present)."""
    first = F.lit(month.replace(day=1)) if month else v.agg(F.trunc(F.max("data"), "month")).scalar()
    kept = v.filter((F.col("data") >= first) & (F.col("data") < F.add_months(first, 1)))
    return _clients_revenue(kept).select(
        "canal", "clientes", M.as_double(F.col("_r")).alias("receita"),
        M.ratio(F.col("_r"), F.col("clientes")).alias("ticket_medio"))


def channel_rolling_kpis(v: DataFrame, as_of: date) -> DataFrame:
    """The same for the rolling month before ``as_of``, with the mean per transaction as ticket."""
    kept = v.filter((F.col("data") >= shift(as_of, -1)) & (F.col("receita") > 0))
    return _clients_revenue(kept).select(
        "canal", "clientes", M.as_double(F.col("_r")).alias("receita"),
        M.ratio(F.col("_r"), F.col("_n")).alias("ticket_medio"))


def _clients_revenue(v: DataFrame) -> DataFrame:
    per_client = v.groupBy("canal", "cliente_id").agg(F.sum("receita").alias("_r"), F.count(F.lit(1)).alias("_n"))
    return per_client.groupBy("canal").agg(
        F.count("cliente_id").alias("clientes"), F.sum("_r").alias("_r"), F.sum("_n").alias("_n"))


def decompose_mix(v: DataFrame, last_month: date | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Volume, mix and price effect over products, with quantities.

    Prices are revenue over quantity.  Volume values the change in total
    quantity at the previous mean price, mix the change of product shares at
    previous product prices, price the change of product prices.  A product
    without a previous price takes the previous mean.  The three add up to the
    change in revenue.  The shares cancel out, so sums over products suffice.
    """
    rows = _pair(v, last_month, False, dates).rows(v)
    q, r = F.col("quantidade").cast("decimal(20,4)"), F.col("receita")
    per = rows.groupBy("produto").agg(
        *[F.coalesce(F.sum(_when(p, q)), F.lit(0)).alias(f"q{p}") for p in (0, 1)],
        *[F.coalesce(F.sum(_when(p, r)), F.lit(0)).alias(f"r{p}") for p in (0, 1)])
    old_price = M.ratio(F.col("r0"), F.col("q0"))
    t = per.agg(
        *[F.sum(c).cast("double").alias(c) for c in ("q0", "q1", "r0", "r1")],
        F.coalesce(F.sum(F.col("q1").cast("double") * old_price), F.lit(0.0)).alias("known"),
        F.coalesce(F.sum(F.when(F.col("q0") == 0, F.col("q1"))).cast("double"), F.lit(0.0)).alias("new_q"))
    mean0 = M.ratio(F.col("r0"), F.col("q0"))
    at_old = F.col("known") + F.col("new_q") * mean0
    return t.select(
        F.round((F.col("q1") - F.col("q0")) * mean0, 2).alias("efeito_volume"),
        F.round(at_old - F.col("q1") * mean0, 2).alias("efeito_mix"),
        F.round(F.col("r1") - at_old, 2).alias("efeito_preco"),
        F.round(F.col("r1") - F.col("r0"), 2).alias("gap_total"))


def effect_totals(decomp: DataFrame) -> DataFrame:
    """Totals of the effects and the gap, the dominant effect, and its share of the gap in percent."""
    def total(c: str) -> Column:
        # groups are few, but a sum of doubles depends on their order: keep cents
        return F.round(F.sum(c), 2).alias(c)

    t = decomp.agg(*[total(c) for c in ("efeito_volume", "efeito_preco", "efeito_cruzado", "gap_total")])

    def pct(c: str) -> Column:
        return M.ratio_or_zero(F.abs(F.col(c)), F.abs(F.col("gap_total"))) * 100

    return t.select(
        "*", M.dominant_effect(F.col("efeito_volume"), F.col("efeito_preco")).alias("efeito_dominante"),
        pct("efeito_volume").alias("pct_volume"), pct("efeito_preco").alias("pct_preco"))


def decompose_check(decomp: DataFrame) -> DataFrame:
    """Sum of effects, sum of gaps and their difference."""
    effects = F.col("efeito_volume") + F.col("efeito_preco") + F.col("efeito_cruzado")
    t = decomp.agg(F.sum(effects).alias("_e"), F.sum("gap_total").alias("_g"))
    # "+ 0.0" turns a negative zero into zero
    return t.select(F.round("_e", 2).alias("soma_efeitos"), F.round("_g", 2).alias("gap_real"),
                    (F.round(F.col("_e") - F.col("_g"), 2) + F.lit(0.0)).alias("diferenca"))
