"""Mixing sources to target weights by entropy balancing.

The mix gives each source a number of words to take.  Among all rates that meet these constraints, with no document taken
more than ``CAP`` times, the one nearest to "take every document once" (least relative entropy, one as base measure) is
``min(CAP, exp(multiplier of the source * words of the document))``.  The multipliers solve a convex dual: in each Newton
iteration Spark sums the words taken and their slope over (source, size) classes.  The words taken only grow with the
multiplier, and bounds of the solution are known from the start, so a step that leaves them is replaced by halving them
(at the cap the slope may be 0).  An iteration that does not settle is an error.  Sources may be any number: sizes,
targets and multipliers are tables.

Rates become whole copies: within a source the error is carried from longer to shorter documents, so what is missing in
the end is about half of the shortest one.  Sums are exact decimals, so reruns agree whatever the partitions.

``balance`` solves the same dual for several constraint columns at once, whose groups the driver can hold.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a group of its own, last in order.
Repeated rows are documents of their own.  Extra columns are ignored.  No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import WORD, free_name, text_of, written

#: No document is taken more often than this.
CAP = 3
#: Rows of one size in a cell that are ranked in one task.
RANKED_ROWS = 4096
#: Relative error of a settled target, and iterations after which a dual that has not settled is an error.
TOLERANCE, STEPS = 1e-9, 200
EXACT = "decimal(38,8)"


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """``source, total, weight, target``: the sum of all totals shared by weights that repeat in the order of sources
    (code points, null last); what is above ``cap`` times a total goes to the others by weight, until none is above.

    ``sizes`` has one row for each source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    weight = F.get(F.array(*[F.lit(w) for w in cycle]), F.pmod(place, F.lit(len(cycle))))
    now = written(sizes.withColumn("weight", weight).withColumn("stopped", F.lit(False)), "mix_targets")
    while True:
        left, parts = now.agg(F.sum("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("total") * cap)), F.lit(0)),
                              F.sum(F.when(~F.col("stopped"), F.col("weight")))).first()
        share = F.lit(float(left or 0)) * F.col("weight") / float(parts or 1)
        above = ~F.col("stopped") & (share > F.col("total") * cap)
        if not now.where(above).limit(1).count():
            return now.select("source", "total", "weight", F.when(F.col("stopped"), F.col("total") * cap).otherwise(share).cast("double").alias("target"))
        now = written(now.withColumn("stopped", F.col("stopped") | above), "mix_targets")


def multipliers(classes: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """``goals`` (``source, total, target``) with the multiplier ``lam`` of each source, for ``classes`` of ``source, size, n``.

    With whole sizes of 1 or more, ``exp(lam) * total`` bounds the words taken from above below 0, and at ``log(cap)``
    every document is at the cap, so the solution lies between these."""
    ratio = F.col("target") / F.col("total")
    limit = math.log(cap)
    moments = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size") * F.col("size").cast("double")).cast("double")).alias("m2"))
    now = goals.alias("g").join(moments.alias("m"), F.col("g.source").eqNullSafe(F.col("m.source")), "left").select("g.*", "m2")
    nothing = (F.col("total") == 0) | (F.col("target") <= 0)
    start = F.log(ratio) * F.col("total") / F.col("m2")
    now = now.withColumn("low", F.when(nothing, F.lit(-700.0)).otherwise(F.least(F.log(ratio), F.lit(0.0))))
    now = now.withColumn("high", F.when(nothing, F.lit(-700.0)).when(ratio > 1, F.lit(limit)).otherwise(F.lit(0.0)))
    full = ratio >= cap * (1 - 1e-12)
    now = now.withColumn("lam", F.when(nothing, F.lit(-700.0)).when(full, F.lit(limit)).otherwise(F.greatest("low", F.least("high", start))))
    now = written(now.withColumn("settled", nothing | full).drop("m2"), "mix_dual")
    kept = classes.where("size > 0")
    for _ in range(steps):
        if not now.where("NOT settled").limit(1).count():
            return now.select("source", "total", "target", "lam")
        open_ = now.where("NOT settled").select(F.col("source").alias("s"), "lam")
        tilt = F.col("lam") * F.col("size")
        words = F.col("n") * F.col("size")
        sums = kept.join(open_, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum((words * F.least(F.exp(F.least(tilt, F.lit(limit))), F.lit(float(cap)))).cast(EXACT)).cast("double").alias("taken"),
            F.sum(F.when(tilt < limit, words * F.col("size") * F.exp(F.least(tilt, F.lit(limit)))).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        gap = F.col("target") - F.col("taken")
        known = now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        fine = F.col("settled") | F.coalesce(F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0)), F.lit(False))
        low, high = F.when(gap > 0, F.col("lam")).otherwise(F.col("low")), F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
        known = known.select("source", "total", "target", "lam", "slope", gap.alias("gap"), fine.alias("settled"), low.alias("low"), high.alias("high"))
        newton = F.col("lam") + F.try_divide("gap", "slope")
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        half = (F.col("low") + F.col("high")) / 2
        moved = F.when(F.col("settled"), F.col("lam")).when(inside, newton).otherwise(half)
        # bounds that touch leave nothing to search
        stuck = F.col("settled") | (F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.lit(1e-300)))
        now = written(known.select("source", "total", "target", moved.alias("lam"), "low", "high", stuck.alias("settled")), "mix_dual")
    raise RuntimeError(f"the balance did not settle in {steps} steps")


def balance(cells: DataFrame, goals: dict[str, dict[str | None, float]], cap: float = CAP,
            tolerance: float = TOLERANCE, steps: int = STEPS) -> dict[str, dict[str | None, float]]:
    """Multipliers of each group of several constraint columns: ``goals`` names a target for each group of each column.

    ``cells`` has the constraint columns and ``mass``; rates are ``min(cap, exp(sum of multipliers))``.  The dual is
    convex (beyond the cap it goes on in a straight line); a Newton step is halved until the dual falls.  The Hessian is
    a matrix on the driver, so groups may number a few thousand together.
    """
    spark, columns = cells.sparkSession, list(goals)
    index = {(c, g): i for i, (c, g) in enumerate((c, g) for c in columns for g in goals[c])}
    aims = np.array([goals[c][g] for c, g in index], float)
    if len(index) > 4000:
        raise ValueError("too many groups for a full Hessian")
    for c in columns:
        numbers = spark.createDataFrame([(g, i) for (k, g), i in index.items() if k == c], f"`{c}` {dict(cells.dtypes)[c]}, `i_{c}` int")
        cells = cells.alias("a").join(F.broadcast(numbers).alias("b"), F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).select(  # at most 4000 rows
            "a.*", f"b.i_{c}")
    ids = [F.col(f"i_{c}") for c in columns]
    cells = written(cells.where("mass > 0").groupBy(*ids).agg(F.sum("mass").alias("mass")), "mix_cells")
    limit = math.log(cap)

    def look(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        table = F.array(*[F.lit(float(x)) for x in lam])
        tilt = sum((F.get(table, i) for i in ids), F.lit(0.0))
        now = cells.select(*ids, "mass", tilt.alias("u"))
        rate = F.exp(F.least("u", F.lit(limit)))
        now = now.select(*ids, (F.col("mass") * rate).alias("m"), (F.col("mass") * (rate + cap * F.greatest(F.col("u") - limit, F.lit(0.0)))).alias("d"))
        sums = (now.withColumn("i", F.explode(F.array(*ids))).withColumn("j", F.explode(F.array(*ids))).groupBy("i", "j")
                .agg(F.sum("m"), F.sum("d")).collect())
        have, curve, value = np.zeros(len(index)), np.zeros((len(index),) * 2), 0.0
        for i, j, m, d in sums:
            curve[i, j] = m  # beyond the cap a bound of the curvature, so that the step is never 0 there
            if i == j:
                have[i] = m
                value += d / len(columns)
        return value - float(lam @ aims), aims - have, curve

    lam = np.zeros(len(index))
    value, gap, curve = look(lam)
    for _ in range(steps):
        if np.all(np.abs(gap) <= tolerance * np.maximum(1.0, aims)):
            return {c: {g: float(lam[index[c, g]]) for g in goals[c]} for c in columns}
        step, size = np.linalg.lstsq(curve + 1e-12 * max(1.0, curve.max()) * np.eye(len(index)), gap, rcond=None)[0], 1.0
        while True:
            tried = look(lam + size * step)
            if tried[0] <= value - 1e-4 * size * float(step @ gap) + 1e-12 * abs(value) or size < 1e-6:
                break
            size /= 2
        lam, (value, gap, curve) = lam + size * step, tried
    raise RuntimeError(f"the balance did not settle in {steps} steps")


def copies_by_size(classes: DataFrame, cell: list[str], cap: int = CAP) -> DataFrame:
    """Whole copies of each (cell, size): ``each`` for all of its ``n`` documents, one more for ``more`` of them.

    The rows of a cell are its distinct sizes, no more than its longest document has words."""
    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ascending=False)
        carry, each, more = 0.0, [], []
        for size, n, rate in zip(rows["size"], rows["n"], rows["rate"], strict=True):
            want = carry + n * rate * size
            total = min(max(int(round(want / size)), 0), n * cap) if size else 0
            carry = want - total * size if size else carry
            each.append(total // n)
            more.append(total % n)
        return rows.assign(each=each, more=more)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", each long, more long"
    return classes.groupBy(*cell).applyInPandas(spread, schema)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cycle: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, rate, copies, taken`` (words, copies counted)."""
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                                F.xxhash64(text_col).alias("print"), F.monotonically_increasing_id().alias("row")), "mix_sizes")
    classes = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix_classes")
    goals = targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")), cycle, cap)
    solved = written(multipliers(classes, goals, cap).select(F.col("source").alias("s"), F.col("total").alias("source_size"), "target", "lam",
                                                             F.monotonically_increasing_id().alias("cell")), "mix_rates")
    tilt = F.least(F.col("lam") * F.col("size"), F.lit(math.log(cap)))
    rate = F.when(F.col("size") == 0, 0.0).when(tilt >= math.log(cap), float(cap)).otherwise(F.exp(tilt))
    rated = classes.join(solved, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    plan = written(copies_by_size(rated.select("cell", "source", "size", "n", "source_size", "target", "rate"), ["cell"], cap), "mix_copies")

    # which documents of a class get one more: the first by a hash of id and text; large classes are ranked in parts
    of_class = plan.withColumnRenamed("source", "s").withColumnRenamed("size", "class_size")
    ranked = sized.join(of_class, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("class_size"))).drop("s", "class_size")
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("doc_id", "print"), F.ceil(F.col("n") / RANKED_ROWS)))
    parts = ranked.where("more > 0").groupBy("cell", "size", "part").agg(F.count("*").alias("in_part"))
    before = parts.withColumn("before", F.sum("in_part").over(
        Window.partitionBy("cell", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    split = ranked.where("more = 0").withColumn("nth", F.lit(1).cast("long"))
    nth = F.row_number().over(Window.partitionBy("cell", "size", "part").orderBy(F.xxhash64("doc_id", "print"), "doc_id", "print", "row"))
    chosen = (ranked.where("more > 0").withColumn("nth", nth).join(before.drop("in_part"), ["cell", "size", "part"])
              .withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before"))
    copies = F.col("each") + (F.col("nth") <= F.col("more")).cast("long")
    return (split.unionByName(chosen).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "row"))


def mixed(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Rows equal in id, source and text are told apart by number only: the mix's copies of all of them are made from one."""
    key, nth, times = (free_name(docs, x) for x in ("key", "nth", "times"))
    keyed = docs.withColumn(key, F.concat_ws("/", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(source_col, text_col))))
    plan = (mix(keyed, key, text_col, source_col, **options).groupBy(F.col("doc_id").alias(key))
            .agg(F.sum("copies").alias(times)).where(F.col(times) > 0))
    once = F.row_number().over(Window.partitionBy(key).orderBy(key))
    rows = keyed.join(plan, key).withColumn(nth, once).where(F.col(nth) == 1)
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)
