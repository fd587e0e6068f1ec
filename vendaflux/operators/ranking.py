"""Global rank, running sum and shares without a single-task window.

``row_number() over (order by x)`` has no partition key, so Spark sends every
row to one task.  Here one job takes a bounded sample and cuts the order into
ranges of about equal size.  A cut is a value and a tie breaker, so a value
that very many rows share is cut as well.  The cuts are constants of the plan:
the range of a row is an expression that gives the same for a recomputed row.

The rows then move once, to their range, and are numbered there; the ranges'
totals (few rows, combined before the shuffle) give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendaflux.functions import measures as M

#: Sampled rows for each range; ranges at most, so that the sample on the driver is bounded.
SAMPLED_PER_RANGE, MOST_RANGES = 32, 8192


def order_cuts(df: DataFrame, value: str, tie: str) -> list[tuple]:
    """Pairs (value, tie) that cut the order (value descending, tie ascending) into ranges of about equal size.

    The sample is the rows with the smallest hashes of the tie breaker: the same for every run over the same rows."""
    ranges = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    size = ranges * SAMPLED_PER_RANGE
    sample = df.select(value, tie).orderBy(F.xxhash64(tie, value)).limit(size).collect()  # at most ``size`` pairs
    known = sorted((r for r in sample if r[0] is not None and r[1] is not None), key=lambda r: r[1])
    known.sort(key=lambda r: r[0], reverse=True)
    step = max(1, len(known) // ranges)
    return [tuple(r) for r in known[step::step]]


def range_of(value: str, tie: str, cuts: list[tuple], schema: T.StructType) -> Column:
    """Number of cuts at or before a row, by binary search in a constant."""
    if not cuts:
        return F.lit(0)
    kinds = [schema[value].dataType, schema[tie].dataType]
    table = F.array(*[F.struct(F.lit(v).cast(kinds[0]).alias("v"), F.lit(t).cast(kinds[1]).alias("t")) for v, t in cuts])
    v, t = F.col(value), F.col(tie)

    def go(low: Column, step: Column) -> Column:
        cut = F.get(table, low + step - 1)
        before = F.coalesce((cut["v"] > v) | ((cut["v"] == v) & (cut["t"] <= t)) | v.isNull(), F.lit(False))
        return F.when(before, low + step).otherwise(low)

    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), go)


def global_rank(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), cut_by: DataFrame | None = None) -> DataFrame:
    """Add ``posicao_ranking``, ``acumulado``, ``total`` and ``n_total`` (descending by ``value``).

    ``df`` must have one row per (``by``, ``tie``) and an exact ``value``
    (decimal or integer): then a recomputed row always has the same value.
    ``cut_by`` may name a cheaper table of the same values and ties for the job that finds the cuts.
    """
    cuts = order_cuts(df if cut_by is None else cut_by, value, tie)
    ranged = df.withColumn("_faixa", range_of(value, tie, cuts, df.schema))
    # At most one row per key and range: the windows below run on range totals only.
    per_range = ranged.groupBy(*by, "_faixa").agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*by).orderBy("_faixa")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per_range.select(
        *by, "_faixa",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_s").over(whole).alias("total"),
        F.sum("_n").over(whole).alias("n_total"),
    )
    local = Window.partitionBy(*by, "_faixa").orderBy(F.desc(value), F.asc(tie))
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.withColumns({
        "_rn": F.row_number().over(local),
        "_cum": F.sum(value).over(running),
    })
    # Without keys the offsets have at most one row per range, a proven bound for a broadcast.
    side = (offsets if by else F.broadcast(offsets)).withColumnsRenamed({k: f"_o_{k}" for k in (*by, "_faixa")})
    same = F.col("_faixa") == F.col("_o__faixa")
    for k in by:  # a NULL key is a group of its own
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return numbered.join(side, same).select(
        *df.columns,
        (F.col("_n0") + F.col("_rn")).cast("bigint").alias("posicao_ranking"),
        (F.col("_s0") + F.col("_cum")).alias("acumulado"),
        "total", "n_total",
    )


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Each value over the table-wide total, as a scalar subquery (no cross join, no window)."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn("participacao", M.ratio(F.col(value), total))


def cumulative_share(df: DataFrame, value: str, tie: str) -> DataFrame:
    """Rank, share and cumulative share by descending value."""
    return global_rank(df, value, tie).withColumns({
        "pct_receita": M.ratio(F.col(value), F.col("total")),
        "pct_acumulado": M.ratio(F.col("acumulado"), F.col("total")),
    }).drop("acumulado", "total", "n_total")


def top_n(df: DataFrame, by: str, tie: str, n: int, descending: bool = True) -> DataFrame:
    """Distributed top-k: each task keeps n rows, then n rows per task are merged."""
    order = F.desc(by) if descending else F.asc(by)
    return df.orderBy(order, F.asc(tie)).limit(n)


def extremes(df: DataFrame, key: str, by: str) -> DataFrame:
    """Keys of the smallest and the largest ``by`` in one pass; ties go to the smaller key."""
    low = F.min(F.struct(F.col(by).alias("v"), F.col(key).alias("k"))).alias("lo")
    high = F.min(F.struct((-F.col(by)).alias("v"), F.col(key).alias("k"))).alias("hi")
    return df.agg(low, high).select(
        F.col("lo.k").alias("pior"), M.as_double(F.col("lo.v")).alias("pior_valor"),
        F.col("hi.k").alias("melhor"), M.as_double(-F.col("hi.v")).alias("melhor_valor"),
    )
