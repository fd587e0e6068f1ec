"""Readers: the sales and target tables from files or from a database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendaflux.functions.months import month_key
from vendaflux.sources import schema as S


def conform(df: DataFrame, fields: T.StructType) -> DataFrame:
    """Columns of the contract by name, in any order and case, with its types; others are kept, missing ones stay missing.

    A value that cannot be cast becomes NULL, it does not fail the job.
    """
    types = {f.name: f.dataType for f in fields.fields}

    def clean(c: str) -> Column:
        name = c.strip().lower()
        if name not in types:
            return F.col(f"`{c}`")
        value = F.col(f"`{c}`")
        if dict(df.dtypes)[c] == "string":
            value = F.nullif(F.trim(value), F.lit(""))
        return value.try_cast(types[name]).alias(name)

    return df.select(*[clean(c) for c in df.columns])


def _scan(spark: SparkSession, path: str, fields: T.StructType, fmt: str | None) -> DataFrame:
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    return conform(raw, fields)


def scan_sales(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Sales fact.  The month key is always derived from the date."""
    df = _scan(spark, path, S.SALES, fmt)
    return df.withColumn("mes_ref", month_key("data")) if "data" in df.columns else df


def scan_targets(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return _scan(spark, path, S.TARGETS, fmt)


def jdbc_options(url: str, query: str, partition_col: str, lower: str, upper: str,
                 partitions: int, fetch_size: int = 10_000) -> dict[str, str]:
    return {
        "url": url,
        "dbtable": f"({query}) AS extrato",
        "partitionColumn": partition_col,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": str(fetch_size),
    }


def scan_jdbc(spark: SparkSession, url: str, query: str, partition_col: str,
              lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """Pull an extract with one range query per partition, never through the driver."""
    opts = jdbc_options(url, query, partition_col, lower, upper, partitions)
    return spark.read.format("jdbc").options(**opts, **options).load()


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``mapping`` is user name -> contract name."""
    return df.withColumnsRenamed(dict(mapping))


def standardise(df: DataFrame, fields: T.StructType = S.SALES,
                fills: Mapping[str, object] | None = None) -> DataFrame:
    """Trim and lower the column names, cast to the contract types, fill missing values.

    A value that cannot be cast becomes NULL (or the fill), it does not fail the job.
    """
    fills = fills or {}
    found = {c.strip().lower(): c for c in df.columns}

    def clean(f: T.StructField) -> Column:
        if f.name not in found:
            return F.lit(fills.get(f.name)).cast(f.dataType).alias(f.name)
        c = F.col(f"`{found[f.name]}`")
        if dict(df.dtypes)[found[f.name]] == "string":
            c = F.nullif(F.trim(c), F.lit(""))
        c = c.try_cast(f.dataType)
        if f.name in fills:
            c = F.coalesce(c, F.lit(fills[f.name]).cast(f.dataType))
        return c.alias(f.name)

    return df.select(*[clean(f) for f in fields.fields])


#: Labels that a mapping may have to be put into the plan as a constant map (each row looks through it).
LITERAL_LABELS = 200
#: Parts that a hot label is dealt to where the mapping is joined.
SALTS = 16


def normalise_keys(df: DataFrame, col: str, mapping: DataFrame, literal_labels: int = LITERAL_LABELS) -> DataFrame:
    """Replace label variants.  ``mapping`` has unique ``de`` labels and their ``para`` label.

    The mapping is counted first (a small job, at most ``literal_labels`` + 1 rows are read).  Up to that number it
    becomes a constant map: the rows move nowhere.  A larger one is joined, and labels that hold more than one part in
    ``SALTS`` of the rows are dealt to ``SALTS`` parts, with their mapping row in each.  Both ways give the same rows.
    """
    known = mapping.select("de", "para").filter("de IS NOT NULL").limit(literal_labels + 1).collect()
    if len(known) <= literal_labels:
        if not known:
            return df
        table = F.create_map(*[F.lit(x) for r in known for x in (r["de"], r["para"])])
        return df.withColumn(col, F.coalesce(F.try_element_at(table, F.col(col)), F.col(col)))
    return _normalise_by_join(df, col, mapping)


def _normalise_by_join(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    hot = [r[0] for r in counts.filter(F.col("_n") * SALTS > total).select(col).collect()]  # fewer than SALTS labels
    # the part follows from the input partition, so a repeated task deals its rows as before
    part = F.when(F.col(col).isin(hot), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    parts = F.when(F.col("de").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    m = mapping.select(F.col("de").alias("_de"), F.col("para").alias("_para"), F.explode(parts).alias("_parte_de"))
    joined = df.withColumn("_parte", part).join(m, (F.col(col) == F.col("_de")) & (F.col("_parte") == F.col("_parte_de")), "left")
    return joined.withColumn(col, F.coalesce("_para", col)).select(*df.columns)


def stored_months(stored: DataFrame, month_col: str = "mes_ref") -> list[str]:
    """Months of an extract that ``write_by_month`` laid out, newest first, from its folder names: no row is read."""
    found = {part.partition("=")[2] for file in stored.inputFiles() for part in file.split("/") if part.startswith(f"{month_col}=")}
    return sorted(found - {"__HIVE_DEFAULT_PARTITION__"}, reverse=True)


def latest_stored_months(stored: DataFrame, n: int, last_month: str | None = None, month_col: str = "mes_ref") -> DataFrame:
    """The rows of the ``n`` latest months present (up to ``last_month``): a filter on constants, so other folders are not listed in the scan."""
    months = [m for m in stored_months(stored, month_col) if last_month is None or m <= last_month][:n]
    return stored.filter(F.col(month_col).isin(months))


def rows_of_months(stored: DataFrame, months: DataFrame, month_col: str = "mes_ref") -> DataFrame:
    """The rows whose month is in a table of months (distinct first): its months prune the folders while the query runs."""
    return stored.join(months.select(month_col).distinct(), month_col, "left_semi")
