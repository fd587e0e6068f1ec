"""Synthetic sales and targets at any scale.

Every random figure is a hash of (row id or key, seed, stream number), so a
retried task makes the same rows and the same seed gives the same table on any
number of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vendaflux.functions import values as V
from vendaflux.functions.measures import clip
from vendaflux.functions.months import month_key


def uniform(seed: int, stream: int, *keys: Column) -> Column:
    """Uniform in (0, 1) from the top 53 bits of a 64-bit hash."""
    h = F.xxhash64(*keys, F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(2 ** 53))


def between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def weighted(u: Column, options: Sequence[tuple[str, float]]) -> Column:
    edge, choice = 0.0, None
    for name, weight in options[:-1]:
        edge += weight
        choice = F.when(u < edge, name) if choice is None else choice.when(u < edge, name)
    return choice.otherwise(options[-1][0])


def normal(u1: Column, u2: Column, mean: float, sd: float) -> Column:
    return F.lit(mean) + F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def _per(col: Column, pairs: Sequence[tuple[object, object]], default: Column | None = None) -> Column:
    out = None
    for key, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out if default is None else out.otherwise(default)


def synth_sales(spark: SparkSession, n_rows: int = V.SYNTH_ROWS, n_clients: int = V.SYNTH_CLIENTS,
                start: str = V.SYNTH_START, end: str = V.SYNTH_END, seed: int = V.SYNTH_SEED,
                partitions: int | None = None) -> DataFrame:
    """Sales with weighted products, channels and regions, season, discount, noise and cost."""
    ids = spark.range(0, n_rows, 1, partitions) if partitions else spark.range(n_rows)

    def u(stream: int) -> Column:
        return uniform(seed, stream, F.col("id"))

    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    base = ids.select(
        "id", F.date_add(F.lit(start).cast("date"), F.floor(u(1) * days).cast("int")).alias("data"),
        (F.lit(V.SYNTH_FIRST_CLIENT) + F.floor(u(2) * n_clients)).cast("bigint").alias("cliente_id"),
        weighted(u(3), [(p, w) for p, w, _ in V.SYNTH_PRODUCTS]).alias("produto"),
        weighted(u(4), [(c, w) for c, w, *_ in V.SYNTH_CHANNELS]).alias("canal"),
        weighted(u(5), V.SYNTH_REGIONS).alias("regional"))
    channel = F.col("canal")
    quantity = _per(channel, [(c, F.floor(between(u(6), lo, hi + 1)).cast("bigint")) for c, _, lo, hi, _ in V.SYNTH_CHANNELS])
    extra = _per(channel, [(c, between(u(8), 0, top)) for c, *_, top in V.SYNTH_CHANNELS])
    discount = F.round(clip(between(u(7), *V.SYNTH_BASE_DISCOUNT) + extra, *V.DISCOUNT_RANGE), 4)
    price = _per(F.col("produto"), [(p, float(x)) for p, _, x in V.SYNTH_PRODUCTS])
    season = _per(F.month("data"), list(V.SYNTH_SEASON.items()), F.lit(1.0))
    rows = base.withColumns({"quantidade": quantity, "desconto_pct": discount})
    noise = normal(u(9), u(10), 1.0, V.SYNTH_NOISE_SD)
    revenue = clip(F.col("quantidade") * price * season * (1 - F.col("desconto_pct")) * noise, float(V.SYNTH_MIN_REVENUE))
    cost = clip(F.col("_r") * between(u(11), *V.SYNTH_COST_RANGE), float(V.SYNTH_MIN_COST))
    return rows.withColumn("_r", revenue).select(
        "data", month_key("data").alias("mes_ref"), "cliente_id", "produto", "canal", "regional", "quantidade",
        F.round("_r", 2).cast("decimal(18,4)").alias("receita"), F.round(cost, 2).cast("decimal(18,4)").alias("custo"),
        F.col("desconto_pct").cast("decimal(9,6)").alias("desconto_pct"))


def synth_targets(v: DataFrame, seed: int = V.SYNTH_SEED) -> DataFrame:
    """Target = realised x U(0.95, 1.08), forecast = target x U(0.96, 1.04), per month and cell."""
    keys = list(V.TARGET_KEYS)
    cells = v.groupBy(*keys).agg(F.sum("receita").cast("double").alias("_r"))
    key_cols = [F.col(k) for k in keys]
    target = F.round(F.col("_r") * between(uniform(seed, 21, *key_cols), *V.SYNTH_TARGET_RANGE), 2)
    forecast = F.round(F.col("_m") * between(uniform(seed, 22, *key_cols), *V.SYNTH_FORECAST_RANGE), 2)
    return cells.withColumn("_m", target).select(
        *keys, F.col("_m").cast("decimal(18,4)").alias("meta_receita"), forecast.cast("decimal(18,4)").alias("forecast_receita"))
