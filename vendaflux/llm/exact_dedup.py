"""Exact dedup with counting quotient filters.

A filter holds 64-bit fingerprints of texts.  The high bits of a fingerprint (its quotient) give the place, the low
bits (its remainder) are stored there in sorted order with a counter; two bit maps say which quotients occur and where
each run of remainders ends.  Every partition builds filters of its own rows, one for each slice of the quotients.
Filters of the same slice hold sorted fingerprints, so they merge without loss: equal remainders add their counters.
Only fingerprints counted more than once can belong to equal texts; these go on to a comparison of the bytes.

Cases: a null text counts as empty.  Null ids come last, so one is kept only where a group has no other.  Of rows with
the same text and the same id exactly one is kept.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import SPACE, text_of, written

#: Bits of the quotient inside a slice, and fingerprints that a slice should hold at most.
QUOTIENT_BITS = 12
SLICE_ROWS = 100_000
#: Places of the small pre-filter in front of the byte comparison: a bound for what is broadcast.
PREFILTER = 1 << 18


@dataclass
class CountingQuotientFilter:
    """Fingerprints of one slice (``width`` low bits), sorted, with counters."""

    width: int
    occupied: np.ndarray  # bit map over quotients
    run_ends: np.ndarray  # bit map over slots
    remainders: np.ndarray
    counters: np.ndarray

    @classmethod
    def build(cls, prints: np.ndarray, counts: np.ndarray, width: int) -> CountingQuotientFilter:
        values, place = np.unique(prints, return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(values)).astype(np.int64)
        low = width - QUOTIENT_BITS
        quotients = (values >> np.uint64(low)).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if len(values) else np.zeros(0, bool)
        return cls(width, np.packbits(occupied), np.packbits(ends), values & np.uint64((1 << low) - 1), total)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in order, with their counts."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << QUOTIENT_BITS))
        ends = np.unpackbits(self.run_ends, count=n)
        run = np.cumsum(ends) - ends
        return (quotients[run].astype(np.uint64) << np.uint64(self.width - QUOTIENT_BITS)) | self.remainders, self.counters

    def to_row(self) -> dict:
        return {k: getattr(self, k).tobytes() for k in ("occupied", "run_ends", "remainders", "counters")}

    @classmethod
    def from_row(cls, row, width: int) -> CountingQuotientFilter:
        return cls(width, np.frombuffer(row.occupied, np.uint8), np.frombuffer(row.run_ends, np.uint8),
                   np.frombuffer(row.remainders, np.uint64), np.frombuffer(row.counters, np.int64))

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        parts = [f.items() for f in filters]
        return cls.build(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]), filters[0].width)


FILTER_SCHEMA = "slice int, occupied binary, run_ends binary, remainders binary, counters binary"


def partition_filters(prints: DataFrame, slice_bits: int) -> DataFrame:
    """One filter for each slice of each partition of ``fp``."""
    width = 64 - slice_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            new = batch.fp.to_numpy(np.int64).view(np.uint64)
            values, place = np.unique(np.concatenate([held[0], new]), return_inverse=True)
            held = values, np.bincount(place, weights=np.concatenate([held[1], np.ones(len(new))])).astype(np.int64)
        slices = (held[0] >> np.uint64(width)).astype(np.int64) if slice_bits else np.zeros(len(held[0]), np.int64)
        cuts = np.flatnonzero(np.diff(slices)) + 1
        rows = [{"slice": int(s[0])} | CountingQuotientFilter.build(p & np.uint64((1 << width) - 1) if slice_bits else p, c, width).to_row()
                for s, p, c in zip(np.split(slices, cuts), np.split(held[0], cuts), np.split(held[1], cuts), strict=True) if len(s)]
        for at in range(0, len(rows), 64):
            yield pd.DataFrame(rows[at: at + 64])

    return prints.select("fp").mapInPandas(build, FILTER_SCHEMA)


def repeated_prints(filters: DataFrame, slice_bits: int) -> DataFrame:
    """Fingerprints counted more than once over all filters: ``fp``, ``n``."""
    width = 64 - slice_bits

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_row(r, width) for r in rows.itertuples()])
        prints, counts = whole.items()
        high = np.uint64(key[0]) << np.uint64(width) if slice_bits else np.uint64(0)
        twice = counts > 1
        return pd.DataFrame({"fp": (prints[twice] | high).view(np.int64), "n": counts[twice]})

    return filters.groupBy("slice").applyInPandas(merge, "fp long, n long")


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``row`` to tell rows apart.

    The hot group of a text is counted in each partition first, in the filters and again before the comparison of
    bytes, so no task gets more than one row of it from each partition.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    prints = F.xxhash64("norm")
    base = written(texts.select("doc_id", F.sha2("norm", 256).alias("sha"), prints.alias("fp"),
                                F.monotonically_increasing_id().alias("row")), "dedup_rows")
    slice_bits = max(0, int(np.ceil(np.log2(max(1, base.count()) / SLICE_ROWS))))
    twice = written(repeated_prints(partition_filters(base, slice_bits), slice_bits), "dedup_prints")

    places = twice.select(F.pmod("fp", F.lit(PREFILTER)).alias("place")).distinct()
    suspects = (texts.withColumn("fp", prints).withColumn("place", F.pmod("fp", F.lit(PREFILTER)))
                .join(F.broadcast(places), "place", "left_semi")  # at most PREFILTER small rows
                .join(twice, "fp", "left_semi"))
    same = suspects.groupBy("fp", "norm").agg(F.count("*").alias("group_size"))  # compares the bytes
    same = (same.withColumn("sha", F.sha2("norm", 256)).groupBy("fp", "sha")
            .agg(F.sum("group_size").alias("group_size"), F.count("*").alias("texts"))
            .withColumn("group_size", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
                        .otherwise(F.col("group_size"))).where("group_size > 1").drop("texts"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = base.join(twice.select("fp"), "fp", "left_semi").groupBy("fp", "sha").agg(F.min(order).alias("first"))
    groups = same.join(first, ["fp", "sha"]).select("fp", "sha", "group_size", "first.doc_id", "first.row")
    groups = groups.withColumnsRenamed({"doc_id": "keep_id", "row": "keep_row"})
    alone = F.col("group_size").isNull()
    return base.join(groups, ["fp", "sha"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"), "row")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in id and text one stays."""
    def key(of: str, sha: Column) -> Column:
        return F.concat_ws("/", F.coalesce(F.col(of).cast("string"), F.lit("")), sha)

    keep = exact_dedup(docs, id_col, text_col).where("kept").select(key("doc_id", F.col("text_sha256")).alias("__key"))
    rows = docs.withColumn("__key", key(id_col, F.sha2(normalised(text_col), 256))).join(keep, "__key", "left_semi")
    once = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return rows.withColumn("__nth", once).where("__nth = 1").select(docs.columns)


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, false) AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
