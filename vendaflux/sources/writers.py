"""Sinks: result tables, CSV summaries, parameter tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                  mode: str = "overwrite") -> dict[str, str]:
    """One folder per table (``resumo``, ``detalhe``, ``parametros``), written by the executors."""
    out = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, target, mode=mode)
        else:
            df.write.mode(mode).format(fmt).save(target)
        out[name] = target
    return out


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> str:
    """CSV with a header, in UTF-8.  ``bom`` puts a byte order mark before the header of each file, by which
    spreadsheets recognise UTF-8."""
    if bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    return path


def write_by_month(df: DataFrame, path: str, month_col: str = "mes_ref", mode: str = "overwrite") -> str:
    """Sales extract laid out for month pruning.

    The rebalance hint gathers a month in few files, and lets adaptive execution
    split a month that holds a large part of the rows over several tasks.
    """
    df.hint("rebalance", month_col).write.mode(mode).partitionBy(month_col).parquet(path)
    return path


def params_table(spark: SparkSession, **params: object) -> DataFrame:
    """Parameters known on the driver, as (parametro, valor) text rows."""
    rows = [(k, None if v is None else str(v)) for k, v in params.items()]
    return spark.createDataFrame(rows, "parametro string, valor string")


def params_from_row(one_row: DataFrame) -> DataFrame:
    """Turn a one-row frame (fixed texts plus computed figures) into (parametro, valor) rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("parametro"), F.col(c).cast("string").alias("valor"))
        for c in one_row.columns
    ])
    return one_row.select(F.inline(pairs))
