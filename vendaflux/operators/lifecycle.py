"""Client lifecycle, month by month.

Status of a client in a month, from the first purchase to ``as_of``:

* Ativo     recurring billing in the month
* Reativado recurring billing in the month, and the month before was Lost or Inativo
* Inativo   12 or more months without any billing (wins over Lost)
* Lost      3 or more consecutive months without recurring billing
* Em risco  fewer than 3 months without recurring billing

Months without recurring billing are counted from the last recurring month or,
when there is none yet, from the month before the first purchase.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.functions import measures as M
from vendaflux.functions import values as V
from vendaflux.functions.months import month_diff, month_key, month_number, month_start
from vendaflux.functions.monthset import Span


def client_months(v: DataFrame, by: str | None = None, recurring: Sequence[str] | None = None) -> DataFrame:
    """One row per client and billed month, with a recurring flag (and the channel, if asked).

    A client seen in several channels in a month keeps the alphabetically first.
    The channel is a grouping key and not ``min(channel)``: a text minimum would
    make Spark sort the raw rows instead of hashing them.

    ``recurring`` names the recurring products; without it the table must say so in ``tipo_produto``.
    """
    keys = [by] if by else []
    is_recurring = F.col("tipo_produto") == V.PRODUCT_RECURRING if recurring is None else F.coalesce(F.col("produto").isin(*recurring), F.lit(False))
    cells = v.groupBy("cliente_id", month_start("data").alias("_mes"), *keys).agg(F.max(is_recurring.cast("int")).alias("_recorrente"))
    if not by:
        return cells
    # one exchange on the client serves this window and the later ones
    month = Window.partitionBy("cliente_id", "_mes")
    return cells.repartition("cliente_id").withColumns({
        "_recorrente": F.max("_recorrente").over(month),
        "_pos": F.row_number().over(month.orderBy(by)),
    }).filter(F.col("_pos") == 1).drop("_pos")


def gap_months(v: DataFrame, recurring: Sequence[str] | None = None) -> DataFrame:
    """Empty months before each recurring billing month of a client (NULL for the first)."""
    w = Window.partitionBy("cliente_id").orderBy("_mes")
    return client_months(v, recurring=recurring).filter("_recorrente = 1").select(
        "cliente_id", month_key("_mes").alias("mes_ref"),
        (month_diff(F.lag("_mes").over(w), F.col("_mes")) - 1).cast("int").alias("meses_sem_recorrente"),
    )


def _segments(v: DataFrame, as_of: date, by: str | None = None, recurring: Sequence[str] | None = None) -> DataFrame:
    """Billed months with the last recurring month before, and the first month of the next billing.

    A client has at most one row per month here, so the window is small for any client.
    """
    w = Window.partitionBy("cliente_id").orderBy("_mes")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    recurring_month = F.when(F.col("_recorrente") == 1, F.col("_mes"))
    start = F.min("_mes").over(Window.partitionBy("cliente_id"))
    rows = client_months(v, by, recurring).filter(F.col("_mes") <= F.lit(as_of))
    if by:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn(by, F.last(by).over(whole))
    return rows.withColumns({
        "_entrada": start,
        "_ultimo": F.coalesce(F.last(recurring_month, ignorenulls=True).over(before), F.add_months(start, -1)),
        "_fim": F.coalesce(F.add_months(F.lead("_mes").over(w), -1), F.trunc(F.lit(as_of), "month")),
    })


def _last_recurring() -> Column:
    return F.when(F.col("_recorrente") == 1, F.col("_mes")).otherwise(F.col("_ultimo"))


def _status_at(m: Column) -> Column:
    """Status of a segment in month ``m``."""
    billed = (m == F.col("_mes")) & (F.col("_recorrente") == 1)
    return (
        F.when(billed & (month_diff(F.col("_ultimo"), m) - 1 >= V.LOST_AFTER_MONTHS), V.LIFE_BACK)
        .when(billed, V.LIFE_ACTIVE)
        .when(month_diff(F.col("_mes"), m) >= V.DORMANT_AFTER_MONTHS, V.LIFE_DORMANT)
        .when(month_diff(_last_recurring(), m) >= V.LOST_AFTER_MONTHS, V.LIFE_LOST)
        .otherwise(V.LIFE_AT_RISK)
    )


def _status_rows(segments: DataFrame, keep: list[str]) -> DataFrame:
    """Expand each billed month to the months up to the next billing, and name the status.

    The status depends on the segment alone, so the expanded rows need no window and no shuffle.
    """
    months = F.sequence("_mes", "_fim", F.expr("interval 1 month"))
    rows = segments.select(*keep, "_mes", "_recorrente", "_ultimo", "_entrada", F.explode(months).alias("_m"))
    return rows.select(*keep, "_m", "_entrada", _status_at(F.col("_m")).alias("status"))


def lifecycle_status(v: DataFrame, as_of: date, recurring: Sequence[str] | None = None) -> DataFrame:
    """One row per client and month with its status."""
    return _status_rows(_segments(v, as_of, recurring=recurring), ["cliente_id"]).select(
        "cliente_id", month_key("_m").alias("mes_ref"), "status"
    )


def _events(segments: DataFrame) -> DataFrame:
    """Where segments enter and leave each status: at most four stays each, as (month number, status, + or - clients).

    Segments of the same months and kind are counted first; they number no more than the calendar allows.
    """
    kinds = segments.groupBy(month_number("_mes").alias("m"), F.col("_recorrente").alias("r"), month_number("_ultimo").alias("u"),
                             month_number("_fim").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    month, end = F.col("m"), F.col("e")
    rest = month + F.col("r")  # months without recurring billing begin here
    last_recurring = F.when(F.col("r") == 1, month).otherwise(F.col("u"))
    lost, dormant = F.greatest(rest, last_recurring + V.LOST_AFTER_MONTHS), F.greatest(rest, month + V.DORMANT_AFTER_MONTHS)
    billed = F.when(month - F.col("u") - 1 >= V.LOST_AFTER_MONTHS, V.LIFE_BACK).otherwise(V.LIFE_ACTIVE)
    stays = [(billed, month, rest - 1), (F.lit(V.LIFE_AT_RISK), rest, F.least(lost, dormant) - 1),
             (F.lit(V.LIFE_LOST), lost, dormant - 1), (F.lit(V.LIFE_DORMANT), dormant, end)]
    rows = kinds.select("n", F.inline(F.array(*[
        F.struct(status.alias("status"), first.alias("a"), F.least(last, end).alias("b")) for status, first, last in stays]))).filter("a <= b")
    return rows.select("status", F.inline(F.array(
        F.struct(F.col("a").alias("_m"), F.col("n").alias("_d")), F.struct((F.col("b") + 1).alias("_m"), (-F.col("n")).alias("_d")))))


def lifecycle_counts(v: DataFrame, as_of: date, recurring: Sequence[str] | None = None, dates: DataFrame | None = None) -> DataFrame:
    """Clients per month and status; the statuses of a month add up to the clients already entered.

    Segments give events, which are summed by month and cumulated: no row is made for the months that a client only
    stays in a status.  The calendar adds a zero for each month and status, so months without an event are there; its
    first month comes from a small job over ``dates`` (any table with the dates of ``v``, itself by default).
    """
    changes = _events(_segments(v, as_of, recurring=recurring)).groupBy("status", "_m").agg(F.sum("_d").alias("_d"))
    last = as_of.year * 12 + as_of.month
    statuses = F.array(*[F.lit(x) for x in (V.LIFE_ACTIVE, V.LIFE_BACK, V.LIFE_AT_RISK, V.LIFE_LOST, V.LIFE_DORMANT)])
    first = Span.of(v if dates is None else dates).first
    calendar = v.sparkSession.range(first or last, last + 1, numPartitions=1).select(
        F.explode(statuses).alias("status"), F.col("id").cast("int").alias("_m"), F.lit(0).cast("bigint").alias("_d"))
    by_month = changes.unionByName(calendar).groupBy("status", "_m").agg(F.sum("_d").alias("_d"))
    running = Window.partitionBy("status").orderBy("_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # calendar months
    counts = by_month.withColumn("clientes", F.sum("_d").over(running)).filter((F.col("clientes") > 0) & (F.col("_m") <= last))
    month = F.col("_m") - 1
    return counts.select(F.format_string("%04d-%02d", F.floor(month / 12), month % 12 + 1).alias("mes_ref"), "status", "clientes")


def churn_by_channel(v: DataFrame, as_of: date, by: str = "canal", recurring: Sequence[str] | None = None) -> DataFrame:
    """Share of clients whose status in the month of ``as_of`` is Lost or Inativo.

    The channel of a client is the one of its latest billed month.
    """
    now = F.trunc(F.lit(as_of), "month")  # only a client's last segment reaches it
    current = _segments(v, as_of, by, recurring).filter(F.col("_fim") == now).select(by, _status_at(now).alias("status"))
    gone = F.count(F.when(F.col("status").isin(V.LIFE_LOST, V.LIFE_DORMANT), 1))
    return current.groupBy(by).agg(
        F.count(F.lit(1)).alias("clientes"), gone.alias("perdidos")
    ).withColumn("taxa_churn", M.ratio(F.col("perdidos"), F.col("clientes")))


def time_to_lost(v: DataFrame, as_of: date, by: str = "canal", recurring: Sequence[str] | None = None) -> DataFrame:
    """Mean months from first purchase to the first Lost month, over clients that reached it.

    A segment is Lost from the third month after the last recurring one, if it lasts until then.
    """
    lost = F.greatest(F.col("_mes"), F.add_months(_last_recurring(), V.LOST_AFTER_MONTHS))
    per_client = _segments(v, as_of, by, recurring).withColumn("_perda", lost).filter(F.col("_perda") <= F.col("_fim")).groupBy(
        "cliente_id", by).agg(F.min("_perda").alias("_perda"), F.min("_entrada").alias("_entrada"))
    return per_client.groupBy(by).agg(
        F.count(F.lit(1)).alias("clientes"),
        M.ratio(F.sum(month_diff("_entrada", "_perda")), F.count(F.lit(1))).alias("meses_ate_lost"),
    )


def reactivations(v: DataFrame, as_of: date, recurring: Sequence[str] | None = None) -> DataFrame:
    """Returns to recurring billing after 3 or more empty months, by months away.

    ``taxa_reativacao`` is the share of all lapses (returned or not, within
    ``as_of``) that came back after exactly that many months.
    """
    w = Window.partitionBy("cliente_id").orderBy("_mes")
    billed = client_months(v, recurring=recurring).filter((F.col("_recorrente") == 1) & (F.col("_mes") <= F.lit(as_of)))
    gaps = billed.select(
        F.lead("_mes").over(w).alias("_volta"), "_mes",
    ).select(
        F.col("_volta").isNotNull().alias("_voltou"),
        (month_diff(F.col("_mes"), F.coalesce("_volta", F.lit(as_of)))
         - F.when(F.col("_volta").isNull(), 0).otherwise(1)).alias("_vazios"),
    ).filter(F.col("_vazios") >= V.LOST_AFTER_MONTHS)
    counts = gaps.groupBy("_voltou", "_vazios").agg(F.count(F.lit(1)).alias("_n"))
    # one row per distinct gap length, bounded by the calendar
    total = F.sum("_n").over(Window.partitionBy())
    return counts.withColumn("_total", total).filter("_voltou").select(
        F.col("_vazios").cast("int").alias("meses_fora"), F.col("_n").alias("reativacoes"),
        M.ratio(F.col("_n"), F.col("_total")).alias("taxa_reativacao"),
    )
