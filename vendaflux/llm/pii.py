"""Personal data: fixed patterns, and bootstrapped contextual extraction of further identifiers.

Fixed patterns give the base spans, which are also the seeds.  The words left and right of seeds are lexical patterns.
Patterns and identifier-like strings (six characters or more, with a digit) form a graph: a pattern is as good as the
instances it holds, an instance as good as its patterns.  Rounds of two aggregations score both; occurrences inside a
pattern of high confidence, whose string scores high over all its patterns, become spans of kind ``id``.

Everything is DataFrame functions.  A regular expression runs only over texts that a cheap test lets through; all
repeated groups are possessive, so that long runs neither recurse nor backtrack.

Cases: a null or empty text has no spans.  Repeated rows, and rows with a null id, give a row each.  Spans of different
kinds may overlap; those of one kind don't, and kind ``id`` never overlaps a base span.  Extra columns are ignored.
No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.llm.common import text_of, written

LOCAL = "A-Za-z0-9._%+-"
# The kinds in order, each with the test that a text must pass, and the expression (as the contract's, with
# possessive quantifiers; a local part starts where no such character stands before it, or where the last match ended).
BASE = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){12}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
IDENTIFIER = r"(?<![A-Za-z0-9_.@+/-])[A-Za-z_@+/][A-Za-z_.@+/-]*+[0-9][A-Za-z0-9_.@+/-]*+|(?<![A-Za-z0-9_.@+/-])[0-9][A-Za-z0-9_.@+/-]*+"
LEAST_LENGTH, REACH = 6, 48
#: Matches of a text that are placed together.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Rounds; smoothing of a pattern's score; least confidence of a pattern and of a string; seeds a pattern needs.
ROUNDS, SMOOTHING, CONFIDENT, ACCEPTED, SUPPORT = 3, 2.0, 0.6, 0.75, 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a name in a lambda is bound."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(steps: Column, at: Column) -> Column:
    """Spans of matches one after the other from a position on."""
    start = F.struct(at.cast("int").alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        b = a + F.length(x["value"])
        span = F.struct(a.alias("start"), b.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(b.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(steps, start, add, lambda s: s["spans"])


def spans_of(text: Column, expression: str) -> Column:
    """Start, end (code points) and value of all matches, from the pieces between them, and the text before and after
    each as far as ``REACH`` characters or the match beside it.

    Spans are appended to an array; texts with more than ``BLOCK`` matches are done in blocks, so that an append copies
    no more than a block."""
    def steps(pieces: Column, values: Column) -> Column:
        n = F.size(values)
        last = F.concat(F.array(F.lit("")), values)
        after = F.zip_with(F.slice(pieces, F.lit(2), n), F.slice(F.concat(F.slice(values, F.lit(2), n), F.array(F.lit(""))), F.lit(1), n),
                           lambda p, v: F.left(F.concat(p, F.left(v, F.lit(REACH))), F.lit(REACH)))
        before = F.zip_with(F.slice(last, F.lit(1), n), F.slice(pieces, F.lit(1), n),
                            lambda v, p: F.right(F.concat(F.right(v, F.lit(REACH)), p), F.lit(REACH)))
        return F.zip_with(F.arrays_zip(F.transform(F.slice(pieces, F.lit(1), n), F.length).alias("gap"), values.alias("value")),
                          F.arrays_zip(before.alias("before"), after.alias("after")),
                          lambda x, c: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after")))

    def in_blocks(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda k: F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))

        def join(blocks: Column) -> Column:
            lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"])))
            starts = F.aggregate(lengths, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
            return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), _placed))

        return _let(blocks, join)

    found = _let(F.struct(F.split(text, expression, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("values")),
                 lambda m: steps(m["pieces"], m["values"]))
    return _let(found, lambda s: F.when(F.size(s) <= BLOCK, _placed(s, F.lit(0))).otherwise(in_blocks(s)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    backwards = F.reverse(number)

    def worth(i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3)
                        & (F.right(p, F.lit(3)).cast("int") <= 255))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(kind: str, text: Column) -> Column:
    test, expression = BASE[kind]
    may = F.contains(text, F.lit(test)) if kind == "email" else text.rlike(test)
    return F.when(may, F.filter(spans_of(text, expression), lambda s: valid(kind, s["value"]))).otherwise(F.array().cast(SPANS))


def overlaps(spans: Column, s: Column) -> Column:
    """Whether a span meets one of ``spans``, which are in order and apart from each other: the last that begins before
    its end is the only one that can; many are searched by halving."""
    def search(spans: Column) -> Column:
        n = F.size(spans)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(31))])
        before = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
            (low.cast("long") + step <= n) & (F.get(spans, (low.cast("long") + step - 1).cast("int"))["start"] < s["end"]), low + step).otherwise(low))
        return _let(before, lambda i: (i > 0) & (F.get(spans, i - 1)["end"] > s["start"]))

    near = F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(F.size(spans) <= BLOCK, near).otherwise(search(spans))


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~overlaps(others, s))


def with_context(spans: Column, seed: bool) -> Column:
    """Each span with the words left and right of it."""
    def around(s: Column) -> Column:
        left = F.lower(F.regexp_extract(s["before"], r"(\S{1,32})\s*$", 1))
        right = F.lower(F.regexp_extract(s["after"], r"^\s*(\S{1,32})", 1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), left.alias("left"), right.alias("right"), F.lit(seed).alias("seed"))

    return F.transform(spans, around)


def label(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns and of strings, from ``value, pattern, seed`` (each pair once).

    A pattern's confidence is the mean score of its strings, pulled to 0 by ``SMOOTHING`` strings of score 0; a string
    that is no seed gets the mean confidence of its patterns.  Only sums over one side of the graph are shuffled."""
    values = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for i in range(rounds):
        patterns = (edges.join(values, "value").groupBy("pattern")
                    .agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("confidence"), F.sum(F.col("seed").cast("long")).alias("seeds")))
        patterns = written(patterns, "pii_patterns")
        values = written(edges.join(patterns, "pattern").groupBy("value").agg(
            F.when(F.max(F.col("seed").cast("int")) == 1, 1.0).otherwise(F.avg("confidence")).alias("score")), "pii_values")
    return patterns, values


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the spans of each base kind, and ``found`` (spans of kind ``id``); spans are start, end, value."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(k, text).alias(k) for k in BASE])
    others = F.filter(spans_of(text, IDENTIFIER), lambda s: (F.length(s["value"]) >= LEAST_LENGTH))
    free = others
    for kind in BASE:
        free = _apart(free, F.col(kind))
    nodes = F.concat(with_context(F.concat(*BASE), True), with_context(F.when(text.rlike("[0-9]"), free).otherwise(F.array().cast(SPANS)), False))
    bare = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias(k) for k in BASE]
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", *bare, nodes.alias("nodes")), "pii_rows")

    seen = rows.select("row", F.explode("nodes").alias("n")).select("row", "n.*")
    both = F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("R "), "right"))
    edges = (seen.withColumn("pattern", F.explode(both)).where("length(pattern) > 2")
             .groupBy("value", "pattern").agg(F.max("seed").alias("seed")))
    patterns, values = score_graph(written(edges, "pii_edges"))
    good = patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SUPPORT)).select("pattern")
    new = (seen.where("NOT seed").withColumn("pattern", F.explode(both)).join(good, "pattern", "left_semi")
           .join(values.where(F.col("score") >= ACCEPTED).select("value"), "value", "left_semi"))
    found = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias("found"))
    return rows.drop("nodes").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,end:int,value:string>>")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "█") -> DataFrame:
    """``doc_id, text`` with every span that ``find`` gives, base and discovered, replaced by marks of the same length."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text")), "pii_texts")
    found = find(rows, "row").select(F.col("doc_id").alias("row"), F.concat(*BASE, "found").alias("spans"))
    masked = F.aggregate("spans", F.col("text"), lambda t, s: F.overlay(t, F.repeat(F.lit(mark), s["end"] - s["start"]), s["start"] + 1, s["end"] - s["start"]))
    return rows.join(found, "row").select(F.col("id").alias("doc_id"), masked.alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``."""
    base = F.concat(*[label(k, F.col(k)) for k in BASE])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.concat(base, label("id", F.col("found"))), ",").alias("spans"))
