"""Similarity join on word shingles by T-occurrence search.

Two documents link when ``100 * |intersection| >= 85 * |union|`` of their shingle sets.

1. Documents with the same set form a class; one node stands for it.
2. Prefixes.  In a global order of shingles, two sets that link share one of their first ``n - ceil(0.85 n) + 1``.  The
   order is by hash, with shingles that very many prefixes hold (found in a first pass) last.  Only prefix entries are
   shuffled, by shingle: that is the inverted index.
3. Candidates.  Nodes in one inverted list are candidates where their sizes agree and a parity bit map, whose
   difference never exceeds the sets', does not exclude them.  Short lists give pairs; a long list gives a spanning
   forest of its candidate pairs, never the pairs themselves.  Connected candidates form a cell.
4. In a cell (in blocks, where it is large) every member is searched with DivideSkip: the longest inverted lists are set
   aside, the short ones are merged by counting, members that occur often enough are probed for in the long lists by
   binary search, and those that reach the overlap link.  Out comes a forest of links; components follow from these.

Cases: a null or empty text has an empty set and links with nothing; a text of fewer words than a shingle has one, its
whole sequence.  A row with a null id has a size but no component.  Rows with one id are one node of each text; the
component is the smallest id of its rows.  Extra columns are ignored.  No rows give no rows.

Shingles and sets are known by 64-bit hashes: two different ones agree with a probability of 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import free_name, written
from vendaflux.llm.components import components

#: Inverted lists up to this length give pairs; prefixes avoid shingles in lists above COMMON; the driver holds and
#: sends at most MAX_COMMON of these (COMMON is doubled until they fit).
SHORT, COMMON, MAX_COMMON = 16, 64, 1 << 18
#: Shingles in a block of a cell, word hashes a task remembers, places of the pre-filter in front of the text join.
BLOCK, CACHE, PREFILTER = 1_000_000, 300_000, 1 << 18
#: Weight of probing against merging when lists are divided.
PROBE = 0.5
U = np.uint64


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, width: int) -> None:
        self.width, self.held = width, WordHashes()
        self.factors = [U(xxhash.xxh64_intdigest(f"place {i}") | 1) for i in range(width)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and the contract's white space only
        if not words:
            return np.zeros(0, U)
        if len(words) < self.width:
            return np.array([xxhash.xxh64_intdigest(b"\x00".join(words), 7)], U)
        if len(self.held) > CACHE:
            self.held.clear()
        hashes = np.fromiter(map(self.held.__getitem__, words), U, len(words))
        n = len(words) - self.width + 1
        mix = hashes[:n] * self.factors[0]
        for i in range(1, self.width):
            mix ^= mix >> U(31)
            mix += hashes[i: i + n]
            mix *= self.factors[i]
        mix ^= mix >> U(29)
        mix *= U(0xBF58476D1CE4E5B9)
        mix ^= mix >> U(32)
        mix.sort()
        return mix[np.append(True, mix[1:] != mix[:-1])]


def prefix_length(n, percent: int):
    return n + (-percent * n // 100) + 1


def bit_map(hashes: np.ndarray, percent: int) -> bytes:
    """Parity of the hashes at each bit; as wide as the size needs for unrelated sets to differ too much."""
    bits, most = 512, (100 - percent) / (100 + percent)
    while bits < 6 * most * len(hashes):
        bits *= 4
    odd = np.bincount((hashes >> U(20) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bit maps as rows of 64-bit words, folded to ``size`` bytes."""
    out = np.zeros((len(maps), size // 8), U)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(m, U).reshape(-1, size // 8), axis=0)
    return out


def node_of(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes())], U).view(np.int64)[0])


def sets_of(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """``doc_id, n, node, prefix, bits`` of each row; the shingles in ``common`` (sorted) come last in prefixes.

    Of rows with the same set that a task has seen before, prefix and bits are left out."""
    sent = docs.sparkSession.sparkContext.broadcast(common)  # at most MAX_COMMON numbers

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, last, seen = Shingler(width), sent.value, set()
        for batch in batches:
            rows = []
            for text in batch.text:
                h = shingles(text)
                n = len(h)
                if not n:
                    rows.append((0, None, None, None))
                    continue
                node = node_of(h)
                if node in seen:
                    rows.append((n, node, None, None))
                    continue
                if len(seen) > 4 * CACHE:
                    seen.clear()
                seen.add(node)
                order = h
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                    order = np.concatenate([h[~late], h[late]])
                rows.append((n, node, order[: prefix_length(n, percent)].view(np.int64), bit_map(h, percent)))
            n, node, prefix, bits = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pd.DataFrame({"doc_id": batch.doc_id.to_numpy(), "n": np.array(n, np.int64), "node": pd.array(node, dtype="Int64"),
                                "prefix": list(prefix), "bits": list(bits)})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(
        build, f"doc_id {kind}, n long, node long, prefix array<long>, bits binary")


def common_shingles(docs: DataFrame, width: int, percent: int) -> np.ndarray:
    """Shingles that more than COMMON prefixes hold in the order by hash, or than the smallest doubling of it that leaves
    at most MAX_COMMON.  Tasks hand on those that several of their sets hold.  Links don't depend on this choice, only
    the length of inverted lists does."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, seen = Shingler(width), set()
        for batch in batches:
            parts = []
            for text in batch.text:
                h = shingles(text)
                if len(h) and (node := node_of(h)) not in seen:
                    if len(seen) > 4 * CACHE:
                        seen.clear()
                    seen.add(node)
                    parts.append(h[: prefix_length(len(h), percent)])
            values, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
            more = counts > 1
            yield pd.DataFrame({"h": values[more].view(np.int64), "c": counts[more].astype(np.int64)})

    lengths = written(docs.where("doc_id IS NOT NULL").select("text").mapInPandas(count, "h long, c long").groupBy("h")
                      .agg(F.sum("c").alias("c")).where(F.col("c") > COMMON), "join_common")
    at = COMMON
    while lengths.where(F.col("c") > at).count() > MAX_COMMON:
        at *= 2
    return np.sort(np.array([r.h for r in lengths.where(F.col("c") > at).select("h").collect()], np.int64).view(U))


def inverted_lists(sets: DataFrame) -> DataFrame:
    """Prefix entries of nodes that share a shingle with another, with the size of the set and the length of the shingle's
    list: ``h, node, n, c``.

    One exchange by shingle serves the removal of repeats and the count."""
    entries = sets.where("prefix IS NOT NULL").select(F.explode("prefix").alias("h"), "node", F.col("n").cast("int").alias("n")).repartition("h").distinct()
    return entries.withColumn("c", F.count("*").over(Window.partitionBy("h"))).where("c > 1")


def short_list_edges(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of lists up to SHORT; sizes are compared before pairs move."""
    rows = lists.where(F.col("c") <= SHORT)
    a, b = rows.alias("a"), rows.alias("b")
    pairs = (a.join(b, F.col("a.h") == F.col("b.h"))
             .where(f"a.node < b.node AND 100L * least(a.n, b.n) >= {percent}L * greatest(a.n, b.n)").select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    pairs = (pairs.join(bits.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
             .join(bits.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.minimum(batch.ba.str.len(), batch.bb.str.len()).to_numpy()
            keep = np.zeros(len(batch), bool)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                differ = np.bitwise_count(folded(list(batch.ba.iloc[at]), s) ^ folded(list(batch.bb.iloc[at]), s)).sum(axis=1)
                keep[at] = (100 + percent) * differ <= (100 - percent) * (batch.na + batch.nb).to_numpy()[at]
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(near, "a long, b long")


def long_list_edges(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the candidate pairs of each longer list."""
    rows = lists.where(F.col("c") > SHORT).select("h", "node").join(bits, "node").select("h", "node", "n", "bits")

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "node"], ignore_index=True)
        n, node, width = rows.n.to_numpy(), rows.node.to_numpy(), rows.bits.str.len().to_numpy()
        group, edges, maps = np.arange(len(rows)), [], {}
        for w in np.unique(width):  # widths grow with sizes; a smaller set meets larger ones at its own width
            first = int(np.searchsorted(width, w))
            maps[w] = first, folded(list(rows.bits.iloc[first:]), int(w))
        ends = np.searchsorted(n, n * 100 // percent, side="right")
        for i in range(len(rows)):
            others = np.arange(i + 1, ends[i])
            others = others[group[others] != group[i]]
            if not len(others):
                continue
            first, at = maps[width[i]]
            differ = np.bitwise_count(at[others - first] ^ at[i - first]).sum(axis=1)
            found = others[(100 + percent) * differ <= (100 - percent) * (n[others] + n[i])]
            for g, j in {group[j]: j for j in found}.items():
                edges.append((node[i], node[j]))
                group[group == g] = group[i]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return rows.groupBy("h").applyInPandas(forest, "a long, b long")


def divide_skip(sets: list[np.ndarray], queries: range, percent: int) -> list[tuple[int, int]]:
    """Links of a block as a forest: each query against all members of another group of links."""
    sizes = np.array([len(s) for s in sets])
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    members, bounds = owner[order], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(tokens)))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    group, links = np.arange(len(sets)), []
    lengths = np.diff(bounds)
    for q in queries:
        mine = flat[starts[q]: starts[q + 1]]
        need = -(-percent * sizes[q] // 100)  # overlap with the smallest set that can link
        mine = mine[np.argsort(lengths[mine], kind="stable")]
        skip = min(int(need / (PROBE * np.log2(max(2, lengths[mine[-1]])) + 1)), int(need) - 1, len(mine) - 1)
        short, long_ = mine[: len(mine) - skip], mine[len(mine) - skip:]
        merged = np.concatenate([members[bounds[t]: bounds[t + 1]] for t in short])
        count = np.bincount(merged, minlength=len(sets))
        may = np.flatnonzero((count >= max(1, need - skip)) & (group != group[q]))
        may = may[(100 * np.minimum(sizes[may], sizes[q]) >= percent * np.maximum(sizes[may], sizes[q]))]
        if not len(may):
            continue
        overlap = count[may]
        for t in long_:
            part = members[bounds[t]: bounds[t + 1]]
            overlap = overlap + (part[np.minimum(np.searchsorted(part, may), len(part) - 1)] == may)
        linked = may[100 * overlap >= percent * (sizes[may] + sizes[q] - overlap)]
        for g, j in {group[j]: j for j in linked}.items():
            links.append((q, int(j)))
            group[group == g] = group[q]
    return links


def blocks_of(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """``root, node, doc_id, block, blocks``: large cells in blocks of about ``block`` shingles."""
    sizes = cells.groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    return cells.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def shingles_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (``root, node, doc_id, block, blocks``) with ``shingles`` (sorted, packed) from the nodes' texts."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PREFILTER))
    places = wanted.select(place("doc_id").alias("place")).distinct()
    texts = (docs.withColumn("place", place("doc_id")).join(F.broadcast(places), "place", "left_semi")  # at most PREFILTER rows
             .drop("place").join(wanted, "doc_id"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for batch in batches:
            sets = [shingles(text) for text in batch.text]
            right = np.array([len(h) > 0 and node_of(h) == node for h, node in zip(sets, batch.node, strict=True)], bool)
            yield batch.assign(shingles=[h.tobytes() for h in sets]).loc[right, ["root", "node", "block", "blocks", "shingles"]]

    return texts.select("text", "root", "node", "block", "blocks").mapInPandas(pack, "root long, node long, block int, blocks int, shingles binary")


def cell_links(cells: DataFrame, percent: int) -> DataFrame:
    """Links (a forest) inside cells: ``a, b`` of ``root, node, block, blocks, shingles``; each block meets each other."""
    placed = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = [F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node", ignore_index=True)
        x, y = rows.x.iat[0], rows.y.iat[0]
        rows = rows.iloc[np.argsort(rows.block.to_numpy() != x, kind="stable")]
        sets = [np.frombuffer(s, U) for s in rows.shingles]
        first = int((rows.block == x).sum())
        links = divide_skip(sets, range(first if x != y else len(sets)), percent)
        node = rows.node.to_numpy()
        return pd.DataFrame([(node[i], node[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    return placed.select("root", "block", "node", "shingles", *key).groupBy("root", "x", "y").applyInPandas(search, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(sets_of(docs, width, percent, common_shingles(docs, width, percent)), "join_sets")
    nodes = written(sets.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits")), "join_nodes")
    bits = nodes.select("node", "n", "bits")
    lists = written(inverted_lists(sets), "join_lists")
    near = short_list_edges(lists, bits, percent).unionByName(long_list_edges(lists, bits, percent))
    cells = written(components(near).join(nodes.select("node", "doc_id", "n"), "node"), "join_cells")
    links = cell_links(shingles_of(docs, blocks_of(cells), width), percent)
    linked = components(links)
    least = linked.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    of_node = linked.join(least, "root").select("node", "least")
    of_node = nodes.select("node", "doc_id").join(of_node, "node", "left").select("node", F.coalesce("least", "doc_id").alias("least"))
    known = sets.select("doc_id", "n", "node").join(of_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
    unknown = docs.where("doc_id IS NULL").select("doc_id", set_sizes(width)("text").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return known.unionByName(unknown)


def set_sizes(width: int):
    """Size of the shingle set of each text."""
    def size(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingles = Shingler(width)
        for batch in texts:
            yield pd.Series([len(shingles(t)) for t in batch], dtype="int64")

    return F.pandas_udf(size, "long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` of each component, with all columns: the one with the smallest id, a null id last.

    Rows are told apart by number, so copies under one id or without an id go too."""
    row = free_name(docs, "row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "join_rows")
    found = join(numbered, row, text_col, width, percent)
    others = found.where("component_id <> doc_id OR n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    ids = numbered.select(row, F.col(id_col).alias("id"))
    least = others.join(ids, row).groupBy("component_id").agg(F.min_by(row, F.struct(F.col("id").isNull(), "id", row)).alias("stays"))
    gone = others.join(least, "component_id").where(F.col(row) != F.col("stays")).select(row)
    return numbered.join(gone, row, "left_anti").select(docs.columns)


#: The same for four-word shingles at 85 %, as plain joins of all shingles: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.y, r.root FROM r JOIN l ON r.doc_id = l.x),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
