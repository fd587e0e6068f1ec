"""Column contract of the sales and target tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

SALES = T.StructType([
    T.StructField("data", T.DateType()),
    T.StructField("mes_ref", T.StringType()),
    T.StructField("cliente_id", T.LongType()),
    T.StructField("produto", T.StringType()),
    T.StructField("canal", T.StringType()),
    T.StructField("regional", T.StringType()),
    T.StructField("quantidade", T.LongType()),
    T.StructField("receita", MONEY),
    T.StructField("custo", MONEY),
    T.StructField("desconto_pct", T.DecimalType(9, 6)),
])

TARGETS = T.StructType([
    T.StructField("mes_ref", T.StringType()),
    T.StructField("canal", T.StringType()),
    T.StructField("regional", T.StringType()),
    T.StructField("produto", T.StringType()),
    T.StructField("meta_receita", MONEY),
    T.StructField("forecast_receita", MONEY),
])


def column_set_diff(df: DataFrame, required: Iterable[str]) -> set[str]:
    """Required columns that ``df`` does not have.  Extra columns are fine."""
    return set(required) - set(df.columns)


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = column_set_diff(df, required)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}; found {df.columns}")
    return df
