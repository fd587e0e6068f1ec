"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut at line and sentence ends, and longer sentences into runs of words by content: a run ends where a hash of
two neighbouring words (of two characters, in words without end and in scripts without spaces) says so, so that an edit
moves no cut but those beside it.  The digest of each paragraph that this gives goes into one cell of three
sub-tables; a cell holds a count, the exclusive or of its digests, and that of their checks.  Two sketches subtract cell
by cell: what both texts have cancels out.  Cells left with a single digest give it away; taking it out of its other
cells uncovers more, until the sketch is empty and all paragraphs in which the versions differ are known.  Where a
sketch is too small for that, the pair is tried again with larger ones, which spread the digests over several tables;
the very last are compared as they are.

Everything is DataFrame functions.  Documents meet their successors in buckets of neighbouring ids, so each text moves
once; only the first document of a bucket moves again, to the bucket before.  Digests are made and compared where a text
meets its successor, and are never written.

Cases: a null text is an empty one.  Ids come in descending order, null last, equal ids by text.  A single document is
its own successor.  Repeated paragraphs count once.  Two texts without paragraphs are alike (1.0).  Extra columns are
ignored.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import text_of, written

#: Cells of a sub-table, rounds of peeling, how much larger each retry is, and tries with sketches before arrays are compared.
CELLS, ROUNDS, LARGER, RETRIES = 16, 8, 4, 2
#: A line is cut at the first sentence end after so many characters: at every one.
LONG_LINE = 1
SENTENCE = rf"[^\n]{{{LONG_LINE},}}?[.!?](?=\s)|[^\n]+"
#: Sentences of more characters are cut by content.  Units of that: words, and single characters of longer ones.
LONG_SENTENCE = 48
UNIT = r"\s*(?:\S{1,32}+(?!\S)|\S)|\s+"
#: One of so many units ends a run; most characters of a run.
UNITS, LONGEST = 8, 256
#: Documents of a bucket of ids, and quantiles of ids between which buckets are even.
BUCKET, QUANTILES = 2000, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(sentence: Column) -> Column:
    """A sentence with a line end after each run."""
    def ends(units: Column, u: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(F.get(units, i - 1), u), F.lit(UNITS)) == 0

    return let(F.regexp_extract_all(sentence, F.lit(UNIT), F.lit(0)), lambda units: F.array_join(
        F.transform(units, lambda u, i: F.when(ends(units, u, i), F.concat(u, F.lit("\n"))).otherwise(u)), ""))


def paragraph_keys(text: Column) -> Column:
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    cut = F.array_join(F.transform(sentences, lambda s: F.when(F.length(s) > LONG_SENTENCE, _runs(s)).otherwise(s)), "\n")
    pieces = F.transform(F.regexp_extract_all(cut, F.lit(rf"[^\n]{{1,{LONGEST}}}"), F.lit(0)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _places(key: Column, level: int) -> list[Column]:
    return [(F.pmod(F.xxhash64(key, F.lit(3 * level + j)), F.lit(CELLS)) + j * CELLS).cast("int").alias(f"p{j}") for j in range(3)]


def _placed(keys: Column, level: int, tables: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("k"), _check(k).alias("h"), *_places(k, level),
                                                F.pmod(F.xxhash64(k, F.lit("table"), F.lit(level)), F.lit(tables)).alias("t")))


def _hit(p: Column, at: Column) -> Column:
    return (p["p0"] == at) | (p["p1"] == at) | (p["p2"] == at)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.cast("long").alias("k"), h.cast("long").alias("h"))


def sketch(placed: Column) -> Column:
    """The cells of placed digests: ``c`` (count), ``k`` and ``h`` (exclusive or of digests and of checks)."""
    def add(s: Column, p: Column) -> Column:
        return _cell(s["c"] + 1, s["k"].bitwiseXOR(p["k"]), s["h"].bitwiseXOR(p["h"]))

    def cells(j: int, four: Column, some: Column) -> Column:
        return F.transform(F.sequence(4 * four, 4 * four + 3), lambda at: F.aggregate(
            F.filter(some, lambda p: p[f"p{j}"] == at), _cell(F.lit(0), F.lit(0), F.lit(0)), add))

    def table(j: int) -> Column:  # four cells at a time, from the digests that these have
        return F.flatten(F.transform(F.sequence(F.lit(j * CELLS // 4), F.lit((j + 1) * CELLS // 4 - 1)), lambda four: let(
            F.filter(placed, lambda p: F.shiftright(p[f"p{j}"], 2) == four), lambda some: cells(j, four, some))))

    return F.concat(table(0), table(1), table(2))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, level: int) -> Column:
    """Number of digests recovered from a difference; null where some remain hidden."""
    def pure(now: Column) -> Column:
        alone = F.filter(now, lambda c: (F.abs(c["c"]) == 1) & (c["h"] == _check(c["k"])))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(c["k"].alias("k"), c["h"].alias("h"), *_places(c["k"], level), c["c"].alias("sign"))))

    def without(now: Column, keys: Column) -> Column:
        return F.transform(now, lambda c, at: F.aggregate(keys, c, lambda s, p: F.when(
            _hit(p, at), _cell(s["c"] - p["sign"], s["k"].bitwiseXOR(p["k"]), s["h"].bitwiseXOR(p["h"]))).otherwise(s)))

    def step(state: Column, _: Column) -> Column:
        taken = let(pure(state["cells"]), lambda keys: F.struct(without(state["cells"], keys).alias("cells"), (state["found"] + F.size(keys)).alias("found")))
        return F.when(state["go"], let(taken, lambda t: F.struct(
            t["cells"].alias("cells"), t["found"].alias("found"), (t["found"] > state["found"]).alias("go")))).otherwise(state)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("go"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(
        F.forall(s["cells"], lambda c: (c["c"] == 0) & (c["k"] == 0)), s["found"]))


def difference(a: Column, b: Column, level: int) -> Column:
    """Size of the difference of two arrays of digests by sketches of this level; null where they are too small."""
    tables = LARGER ** level

    def one(x: Column, y: Column) -> Column:
        return peel(subtract(sketch(x), sketch(y)), level)

    if tables == 1:
        return let(_placed(a, level, 1), lambda x: let(_placed(b, level, 1), lambda y: one(x, y)))
    parts = let(_placed(a, level, tables), lambda x: let(_placed(b, level, tables), lambda y: F.transform(
        F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: let(F.filter(x, lambda p: p["t"] == t), lambda u: let(
            F.filter(y, lambda p: p["t"] == t), lambda v: F.when((F.size(u) == 0) & (F.size(v) == 0), 0).otherwise(one(u, v)))))))
    return F.aggregate(parts, F.lit(0), lambda s, d: s + d)  # null where one is


def first_sketch(keys: Column) -> Column:
    return let(_placed(keys, 0, 1), sketch)


def alike(a: Column, b: Column, first_a: Column, first_b: Column) -> Column:
    """What both arrays of digests have, over what either has, from them and their first sketches.

    A level is tried where the one before was too small, and where its cells are as many as the difference by the squares
    of the first cells' counts."""
    first = let(subtract(first_a, first_b), lambda x: F.struct(
        F.aggregate(x, F.lit(0), lambda n, c: n + c["c"] * c["c"]).alias("squares"), peel(x, 0).alias("d")))
    larger = lambda f: F.coalesce(*[F.when(f["squares"] <= 9 * CELLS * LARGER ** level, difference(a, b, level))
                                    for level in range(1, RETRIES)], exact)
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(let(let(first, lambda f: F.coalesce(f["d"], larger(f))), lambda d: (total - d) / (total + d)))


def fingerprint(first: Column, whole: Column) -> Column:
    """The first sketch as text: the digest ``whole`` of the whole text, then place, count, digests and checks of cells in use."""
    cells = F.transform(first, lambda c, at: F.when(c["c"] != 0, F.concat_ws(
        "-", at.cast("string"), c["c"].cast("string"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 16, "0"))))
    return F.concat(F.lower(F.lpad(F.hex(whole), 16, "0")), F.lit(":"), F.lower(F.array_join(cells, ",")))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next`` of ``doc_id, text``: the text of the next smaller id; of the largest, for the smallest.

    Also the digests of both, ``keys`` and ``next_keys``."""
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("x"))
    n, cuts = ids.agg(F.count("*"), F.percentile_approx("x", [i / QUANTILES for i in range(QUANTILES + 1)], 1000)).first()
    if n:
        cuts = sorted(set(cuts))
        lows = F.array(*[F.lit(c) for c in cuts])
        per = max(1, n // BUCKET // max(1, len(cuts)))
        x = F.col("doc_id").cast("double")
        at = let(F.greatest(F.size(F.filter(lows, lambda c: c <= x)), F.lit(1)), lambda i: F.struct(
            i.alias("i"), F.element_at(lows, i).alias("low"), F.element_at(lows, F.least(i + 1, F.lit(len(cuts)))).alias("high")))
        bucket = let(at, lambda b: (b["i"] - 1) * per + F.when(b["high"] > b["low"], F.floor(
            F.least((x - b["low"]) / (b["high"] - b["low"]), F.lit(0.999999)) * per)).otherwise(0))
        bucket = F.coalesce(F.greatest(bucket, F.lit(0)).cast("long"), F.lit(-1).cast("long"))
    else:
        bucket = F.lit(-1).cast("long")
    rows = docs.withColumn("bucket", bucket)
    # the first document of each bucket: its largest id, of equal ids the first text; ids alone are read to find it
    tops = written(rows.groupBy("bucket").agg(F.max("doc_id").alias("top")), "fingerprint_tops")
    used = [r.bucket for r in tops.orderBy(F.desc("bucket")).select("bucket").collect()]  # one row per BUCKET documents
    turn = docs.sparkSession.createDataFrame([(b, used[(i + 1) % len(used)]) for i, b in enumerate(used)], "bucket long, then long")
    firsts = (rows.alias("r").join(tops.alias("t"), (F.col("r.bucket") == F.col("t.bucket")) & F.col("r.doc_id").eqNullSafe(F.col("t.top")))
              .groupBy(F.col("t.bucket").alias("then")).agg(F.min("r.text").alias("head")))
    heads = turn.join(firsts, "then").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    # digests are made once a text, behind the shuffle by bucket that the window uses
    rows = rows.repartition("bucket").withColumn("keys", paragraph_keys(F.col("text")))
    ahead = rows.select("*", F.lead("text").over(w).alias("next"), F.lead("keys").over(w).alias("next_keys"))
    return (ahead.join(heads, "bucket", "left").select(
        "doc_id", "text", "keys", F.coalesce("next", "head").alias("next"), F.coalesce("next_keys", paragraph_keys(F.col("head"))).alias("next_keys")))


def likeness(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with arrays of digests ``a`` and ``b``) and ``likeness``: what both have, over what either has."""
    a, b = F.col("a"), F.col("b")
    return pairs.withColumn("likeness", let(first_sketch(a), lambda x: let(first_sketch(b), lambda y: alike(a, b, x, y))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    docs = with_next(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substring("next", F.lit(1), F.floor(n / 2).cast("int")))
    rows = docs.withColumn("edited", edited)

    def compared(keys: Column, edited_keys: Column, next_keys: Column) -> Column:
        firsts = F.array(first_sketch(keys), first_sketch(edited_keys), first_sketch(next_keys))
        return let(firsts, lambda f: F.struct(
            fingerprint(f[0], F.xxhash64("text")).alias("fingerprint"), fingerprint(f[1], F.xxhash64("edited")).alias("edited_fingerprint"),
            alike(keys, edited_keys, f[0], f[1]).alias("near_edited"), alike(keys, next_keys, f[0], f[2]).alias("near_next")))

    keys = F.array("keys", paragraph_keys(F.col("edited")), "next_keys")
    out = let(keys, lambda k: compared(k[0], k[1], k[2]))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.inline(F.array(out)))
