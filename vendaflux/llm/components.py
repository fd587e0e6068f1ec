"""Connected components of an edge list, by alternating large-star and small-star steps.

Between the steps each task replaces the edges that it writes by stars, so few steps are left for the rest: none where
the edges fit into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vendaflux.llm.common import written

MAX_ROUNDS = 60
#: Edges that a task joins into stars at once.
TOGETHER = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """An edge to the least node of its component for each other node of the edges ``a, b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    least = list(range(len(nodes)))

    def root(i: int) -> int:
        while least[i] != i:
            least[i] = i = least[least[i]]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a):].tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            least[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(nodes))], np.int64)
    other = roots != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[other], "b": nodes[roots[other]]})


def _in_tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of a task as stars, at most ``TOGETHER`` of them (and a batch) at once."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= TOGETHER:
            edges = pd.concat(held)
            held = [stars(edges.a.to_numpy(), edges.b.to_numpy())]
            if len(held[0]) >= TOGETHER // 2:
                yield held.pop()
    if held:
        edges = pd.concat(held)
        yield stars(edges.a.to_numpy(), edges.b.to_numpy())


def _step(edges: DataFrame) -> tuple[DataFrame, tuple, tuple]:
    """``edges`` with those of each task as stars, written, and the marks of the edges before and after that."""
    seen = [Observation(), Observation()]
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    now = written(edges.observe(seen[0], *mark).mapInPandas(_in_tasks, "a long, b long").observe(seen[1], *mark), "cc")
    return now, *((x.get["n"], x.get["h"]) for x in seen)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``; ``root`` is the smallest node of the component.

    Groups are only reduced to their least node, so a node with very many edges is combined before the shuffle; the
    join that follows is one that Spark can split.  Edges that the two star steps leave as they are are stars."""
    now, _, mark = _step(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        then, moved, new = _step(_small_star(_large_star(now)))
        if moved == mark:
            roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now, mark = then, new
    raise RuntimeError("components did not settle")
