"""Prefix trie of conversations: which beginnings they share, and what sharing them saves.

Turns become 128-bit ids of role and text, numbered within their conversation.  ``WIDTH`` turns make a block: one row
with a column for each position.  Spark's ROLLUP over these columns aggregates all prefixes together, with
``grouping_id`` telling their length.  A long conversation goes on in further blocks; each is keyed by the node that the
block before it ended in, so one aggregation serves blocks of every depth.  A second ROLLUP over the nodes sums their
subtrees; sums of later blocks are first carried up block by block, in rounds that double the distance.

Nothing gathers a conversation or a node's members: turns are numbered and blocks are keyed in cells of bounded width,
ids of members are joined in bounded pieces and hashed as a stream.

Cases: a null role or text becomes empty; null turns come first, equal turns by role and text.  Rows with a null
conversation id belong to no conversation and are left out.  Repeated rows are turns of their own.  Extra columns are
ignored.  Texts may be of any length.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vendaflux.llm.common import WORD, text_of, written

#: Turns in a block; turns or blocks in a cell; ids joined in one piece.
WIDTH, CELL, PIECE = 8, 1024, 1024


def _before(cells: DataFrame, key: list[str], order: str, **sums: Column) -> DataFrame:
    """For cells after the first: what the cells of the same key before it hold.  ``cells`` has a row for each cell."""
    window = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return cells.select(*key, order, *[total.over(window).alias(name) for name, total in sums.items()])


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, at`` (from 0), ``turn``: id and words of each turn."""
    role, text = text_of(role_col), text_of(text_col)
    identity = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, 16)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("nth"), F.floor(F.col(turn_col) / CELL).alias("cell"),
        role.alias("role"), F.struct(identity.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("turn"))
    cells = rows.groupBy("conv_id", "cell").agg(F.count("*").alias("n"))
    before = _before(cells, ["conv_id"], "cell", before=F.sum("n")).where("before > 0")
    order = Window.partitionBy("conv_id", "cell").orderBy(F.col("nth").asc_nulls_first(), "role", "turn")
    rows = rows.withColumn("at", F.row_number().over(order) - 1).alias("a").join(
        before.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("a.cell").eqNullSafe(F.col("b.cell")), "left")
    return rows.select("a.conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "turn")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations that begin as another one: the first turns of conversation ``c - c % every``, as many as ``c``'s hash
    says, in place of as many own turns.  A conversation without turns has one row with a null ``at``."""
    own = written(numbered(turns), "trie_turns")
    takes = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("takes", takes).withColumn("giver", F.col("conv_id") - F.col("conv_id") % every)
    heads = (own.where((F.col("at") < most - 1) & (F.col("conv_id") % every == 0)).groupBy(F.col("conv_id").alias("giver"))
             .agg(F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("head")))  # at most ``most`` - 1 each
    convs = convs.join(heads, "giver", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice(
        "head", F.lit(1), F.col("takes").cast("int"))).otherwise(F.array().cast("array<struct<at:long,turn:struct<id:binary,words:long>>>")))
    convs = convs.select("conv_id", "n", "takes", "head", F.size("head").cast("long").alias("given"))
    kept = own.join(convs.select("conv_id", "takes", "given"), "conv_id").where(F.col("at") >= F.col("takes"))
    kept = kept.select("conv_id", (F.col("at") - F.col("takes") + F.col("given")).alias("at"), "turn")
    new = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.at", "x.turn")
    none = convs.where("given = 0 AND n <= takes").select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("struct<id:binary,words:long>").alias("turn"))
    return kept.unionByName(new).unionByName(none)


def _mark(lane: int, at: Column, turn: Column) -> Column:
    """A 64-bit mark of a turn at a position; the marks of all turns of a prefix, joined by XOR, name its node."""
    return F.xxhash64(F.lit(lane), at, turn["id"])


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """A row for each block: ``conv_id, block, k1, k2`` (node where it begins), ``t1`` to ``t<width>``, ``reach`` (turns
    of the conversation, as far as this block can tell: one more than its last turn's if it goes on), ``e1, e2`` (node of its end)."""
    at = F.col("at")
    named = [F.max(F.when(F.pmod(at, F.lit(width)) == i, F.col("turn"))).alias(f"t{i + 1}") for i in range(width)]
    lanes = [F.coalesce(F.bit_xor(F.when(at.isNotNull(), _mark(lane, at, F.col("turn")))), F.lit(0).cast("long")).alias(f"x{lane}") for lane in (1, 2)]
    block = F.coalesce(F.floor(at / width), F.lit(0)).alias("block")
    made = turns.groupBy("conv_id", block).agg(*named, F.count("at").alias("n"), *lanes)
    made = written(made.withColumn("cell", F.floor(F.col("block") / CELL)), "trie_blocks")
    cells = made.groupBy("conv_id", "cell").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.max("block").alias("last"))
    before = _before(cells, ["conv_id"], "cell", b1=F.bit_xor("x1"), b2=F.bit_xor("x2"), first=F.min("last")).where("first IS NOT NULL").drop("first")
    last = cells.groupBy("conv_id").agg(F.max("last").alias("last"))
    inner = Window.partitionBy("conv_id", "cell").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    keyed = made.select("*", F.coalesce(F.bit_xor("x1").over(inner), zero).alias("i1"), F.coalesce(F.bit_xor("x2").over(inner), zero).alias("i2"))
    keyed = keyed.join(before, ["conv_id", "cell"], "left").join(last, "conv_id")
    for lane in ("1", "2"):
        keyed = keyed.withColumn(f"k{lane}", F.col(f"i{lane}").bitwiseXOR(F.coalesce(F.col(f"b{lane}"), zero)))
        keyed = keyed.withColumn(f"e{lane}", F.col(f"k{lane}").bitwiseXOR(F.col(f"x{lane}")))
    goes_on = F.col("block") < F.col("last")
    return keyed.select("conv_id", "block", "k1", "k2", "e1", "e2", goes_on.alias("goes_on"), *[f"t{i + 1}" for i in range(width)],
                        (F.col("block") * width + F.col("n") + goes_on.cast("long")).alias("reach"))


def _by_level(level: Column, choices: list[Column]) -> Column:
    """The choice for a level, from 0 on."""
    out = choices[-1]
    for i in range(len(choices) - 2, -1, -1):
        out = F.when(level == i, choices[i]).otherwise(out)
    return out


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """Sums for every prefix of every block: ``block, k1, k2``, the positions, ``level`` (positions in the prefix), sums.

    ``grouping_id`` has a bit for each position that a row leaves out.  Rows whose last position is empty are no prefix,
    and the empty prefix of a later block is the node before it; both are dropped."""
    names = ", ".join(f"t{i + 1}" for i in range(width))
    rolled = rows.sparkSession.sql(f"SELECT block, k1, k2, {names}, {width} - CAST(bit_count(grouping_id()) AS INT) AS level, {sums} "
                                   f"FROM {{rows}} GROUP BY block, k1, k2, ROLLUP ({names})", rows=rows)
    filled = _by_level(F.col("level"), [F.col("block") == 0, *[F.col(f"t{i + 1}").isNotNull() for i in range(width)]])
    return rolled.where(filled)


def _named(nodes: DataFrame, width: int) -> DataFrame:
    """With ``n1, n2`` and ``p1, p2``, the names of node and parent (the root has no parent)."""
    level = F.col("level")
    for lane in (1, 2):
        marks = [_mark(lane, F.col("block") * width + i, F.col(f"t{i + 1}")) for i in range(width)]
        node, up = F.col(f"k{lane}"), F.col(f"k{lane}")
        for i, mark in enumerate(marks):
            node = node.bitwiseXOR(F.when(level > i, mark).otherwise(F.lit(0).cast("long")))
            up = up.bitwiseXOR(F.when(level > i + 1, mark).otherwise(F.lit(0).cast("long")))
        nodes = nodes.withColumn(f"n{lane}", node).withColumn(f"p{lane}", F.when(level > 0, up))
    return nodes


def _below(nodes: DataFrame, width: int) -> DataFrame | None:
    """For each node at which later blocks begin (``k1, k2``): ``leaves, saved`` of all that hangs below, ``kids`` right below."""
    deepest = nodes.agg(F.max("block")).first()[0] or 0
    if not deepest:
        return None
    sums = nodes.where("block > 0").groupBy("k1", "k2").agg(
        F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("own").alias("saved"), F.sum((F.col("level") == 1).cast("long")).alias("kids"))
    ups = nodes.where(F.col("level") == width).select(F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    now = written(sums.join(ups, ["k1", "k2"]), "trie_below")
    for _ in range(deepest.bit_length()):
        # sums over the next 2^i blocks and the block 2^i above: both double
        more = now.where("u1 IS NOT NULL").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        far = now.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"))
        now = written(now.join(more, ["k1", "k2"], "left").join(far, ["u1", "u2"], "left").select(
            "k1", "k2", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "kids",
            F.col("w1").alias("u1"), F.col("w2").alias("u2")), "trie_below")
    return now.drop("u1", "u2")


def _ends(blocks: DataFrame) -> DataFrame:
    """``n1, n2, ends_sha256`` of nodes at which conversations end: ids in ascending order, joined in pieces and hashed as a stream."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                                               pa.array([d[2] for d in done], pa.string())], ["n1", "n2", "ends_sha256"])

        node, h = None, None
        for batch in batches:
            done = []
            for n1, n2, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (n1, n2) == node:
                    h.update(b",")
                else:
                    if node:
                        done.append((*node, h.hexdigest()))
                    node, h = (n1, n2), hashlib.sha256()
                h.update(ids.encode())
            yield out(done)
        if node:
            yield out([(*node, h.hexdigest())])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = (blocks.where("NOT goes_on").groupBy(F.col("e1").alias("n1"), F.col("e2").alias("n2"), F.floor(F.col("conv_id") / PIECE).alias("piece"))
              .agg(ids.alias("ids")))
    ordered = pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece").select("n1", "n2", "ids")
    return ordered.mapInArrow(digests, "n1 long, n2 long, ends_sha256 string")


def trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for each node of ``conv_id, at, turn`` (as ``rebuilt`` gives them, each conversation's positions complete from
    0): ``node`` (its name), ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    blocks = written(_blocks(turns, width), "trie_keyed")
    nodes = _named(_rollup(blocks, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(reach) AS reach"), width)
    words = _by_level(F.col("level"), [F.lit(0).cast("long"), *[F.col(f"t{i + 1}.words") for i in range(width)]])
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * words).withColumn("leaf", F.col("reach") == F.col("block") * width + F.col("level"))
    nodes = written(nodes.drop("reach", "p1", "p2"), "trie_nodes")
    below = _below(nodes, width)
    none = F.lit(0).cast("long")
    if below is None:
        nodes = nodes.select("*", none.alias("leaves"), none.alias("saved"), none.alias("kids"))
    else:
        below = below.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "leaves", "saved", "kids")
        nodes = nodes.join(below, ["n1", "n2"], "left")
    full = F.col("level") == width  # only there may later blocks hang
    nodes = nodes.select("block", "k1", "k2", *[f"t{i + 1}" for i in range(width)], F.col("level").alias("deep"), "conv_id", "n_convs",
                         (F.col("leaf").cast("long") + F.when(full, F.coalesce("leaves", none)).otherwise(none)).alias("leaves"),
                         (F.col("own") + F.when(full, F.coalesce("saved", none)).otherwise(none)).alias("saved"),
                         F.when(full, F.coalesce("kids", none)).otherwise(none).alias("kids"))
    counts = ", ".join(f"count_if(deep = {i + 1}) AS c{i + 1}" for i in range(width))
    summed = _rollup(nodes, width, f"min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens, sum(kids) AS kids, {counts}")
    children = _by_level(F.col("level"), [*[F.col(f"c{i + 1}") for i in range(width)], F.col("kids")])
    summed = _named(summed, width).select("n1", "n2", "p1", "p2", "conv_id", (F.col("block") * width + F.col("level")).alias("depth"),
                                          "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens")
    summed = written(summed, "trie_sums")
    parents = summed.where("n_children > 0").select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    return (summed.join(parents, ["p1", "p2"], "left").join(_ends(blocks), ["n1", "n2"], "left")
            .select(F.concat(F.hex("n1"), F.hex("n2")).alias("node"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


#: The same rows from DuckDB: each node is the list of its turns; a checksum runs over bytes with a table of 256 values.
SQL = """
WITH steps AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)
), t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(turn ORDER BY nth) AS turns FROM t GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
         lambda a, x: xor(a >> 8, step[CAST((xor(a, x) & 255) + 1 AS INTEGER)])), 4294967295) % 4 AS takes
  FROM c, steps
), r AS (
  SELECT h.conv_id, list_concat(coalesce(g.turns, [])[1:h.takes], h.turns[h.takes + 1:]) AS turns
  FROM h LEFT JOIN c g ON g.conv_id = h.conv_id - h.conv_id % 20
), m AS (
  SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r
), n AS (
  SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN len(turns) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM m GROUP BY ALL
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1
), own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.node[depth].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM n LEFT JOIN kids ON kids.node = n.node
), below AS (
  SELECT node[1:up] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(depth + 1)) AS up FROM own) GROUP BY 1
)
SELECT own.conv_id, own.depth, p.conv_id AS parent_conv_id, own.n_convs, CAST(own.n_children AS BIGINT) AS n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN below b ON b.node = own.node LEFT JOIN n p ON own.depth > 0 AND p.node = own.node[1:own.depth - 1]
"""
