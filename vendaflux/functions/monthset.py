"""Sets of months as bits.

The months in which a client was active fit in a few integers: bit ``i`` of word ``k`` stands for month ``63 k + i`` after
the first month of the span.  Such sets are built by ``bit_or``, which combines before a shuffle and needs no distinct
count.  The span comes from one small job, so a history may have any length: a longer one has more words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.functions.months import month_number

BITS = 63  # the sign bit stays free


@dataclass(frozen=True)
class Span:
    """Months from ``first`` (a month number) on, and how many."""

    first: int
    months: int

    @classmethod
    def of(cls, dates: DataFrame, column: str = "data") -> Span:
        """The span of a table; it may be a wider or narrower table than the one whose sets are built, with no date missing."""
        low, high = dates.agg(month_number(F.min(column)), month_number(F.max(column))).first()
        return cls(0, 1) if low is None else cls(low, high - low + 1)

    @property
    def words(self) -> int:
        return -(-self.months // BITS)

    def offset(self, date: Column | str) -> Column:
        return month_number(date) - self.first

    def collect(self, date: Column | str) -> list[Column]:
        """Aggregates: the words of the set of months of ``date``.  A date outside the span is an error."""
        at = self.offset(date)
        outside = F.raise_error(F.lit("a date lies outside the months that the set was made for")).cast("bigint")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(BITS)))
        bit = F.when((at < 0) | (at >= self.months), outside).otherwise(bit)
        if self.words == 1:
            return [F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint"))]
        word = F.floor(at / BITS)
        return [F.coalesce(F.bit_or(F.when((word == k) | (at < 0) | (at >= self.months), bit)), F.lit(0).cast("bigint")) for k in range(self.words)]


def size(words: list[Column]) -> Column:
    """Months in a set."""
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("bigint")


def has(words: list[Column], at: Column) -> Column:
    """Whether the month at an offset (not negative) is in a set; offsets past the span are not."""
    found = F.lit(False)
    for k, w in reversed(list(enumerate(words))):
        found = F.when(F.floor(at / BITS) == k, F.getbit(w, F.pmod(at, F.lit(BITS)).cast("int")) == 1).otherwise(found)
    return found
