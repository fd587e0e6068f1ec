"""Spelling variants: words one edit apart, each with the more frequent form it probably stands for.

Words go into tries, one for each word length and reading direction, whose edges are a distributed table.  A word walks
its own path from half its length on (the edit lies in one half, so one of both directions shares the other half) in the
trie of its length, where it may replace a letter, and in that of words one letter shorter, where it may leave one out.
The frontier of states (word, position, node, edits) joins the edges of its nodes level by level; an edge with a single
word below ends a walk.  What the walks reach is compared letter by letter once more, so hashed nodes cannot add a
neighbour, and equal hashes keep all their edges, so they cannot lose one.  Each pair is looked for from one side only:
letters are replaced by later ones, and insertions are deletions of the other word.

Cases: null or empty texts have no words; a null id counts as empty text before the colon.  Repeated rows count again.
Extra columns are ignored.  No words give no rows.  Words may be of any length: a task holds one text, and the frontier
takes a round for each position at which two words of one length still agree.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendaflux.llm.common import written

#: Distinct words that a task counts before it passes them on.
HELD = 300_000
EDGE = "depth int, node long, letter string, child long, id long"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 97,
                least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, n``: runs of Latin letters, A-Z lower-cased, with a letter left out where ``modulus`` divides the hash of id and run."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the letters are those of Latin-1, so a text is read as Latin-1 bytes; all other characters become question marks
        runs = re.compile(rb"[a-z\xc0-\xff]+")
        held: Counter[bytes] = Counter()

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{key or ''}:".encode())
                for run, n in Counter(runs.findall((text or "").encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % modulus == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= least_length:
                        held[run] += n
                if len(held) > HELD:
                    yield packed()
                    held.clear()
        yield packed()

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _walks(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of all tries from the depth where walks may begin, and the first state of each walk."""
    def paths(word: str, trie: int, back: bool) -> list[int]:
        h = (14695981039346656037 ^ (2 * trie + back)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF  # 64-bit FNV-1a over letters
        out = [h]
        for c in word:
            h = (h ^ ord(c)) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    def begin(length: int, back: bool) -> int:
        return length - length // 2 if back else length // 2

    def packed(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[], [], [], [], []]
        for batch in batches:
            for word, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for back in (False, True):
                    s, at = word[::-1] if back else word, begin(len(word), back)
                    nodes = [_signed(h) for h in paths(s, len(s), back)[at:]]
                    more = (range(at, len(s) + 1), nodes, [*s[at:], ""], [*nodes[1:], key], [key] * len(nodes))  # the end has the word for child
                    for column, values in zip(columns, more, strict=True):
                        column.extend(values)
                if len(columns[0]) > HELD:
                    yield packed(columns, kinds)
                    columns = [[], [], [], [], []]
        yield packed(columns, kinds)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                for back in (False, True):
                    s, at = word[::-1] if back else word, begin(len(word), back)
                    rows += [(s, back, same, at, _signed(paths(s[:at], len(s) - (not same), back)[-1])) for same in (True, False)]
            yield packed([list(c) for c in zip(*rows, strict=True)] or [[]] * 5, first)

    kinds = pa.schema([("depth", pa.int32()), ("node", pa.int64()), ("letter", pa.string()), ("child", pa.int64()), ("id", pa.int64())])
    first = pa.schema([("s", pa.string()), ("back", pa.bool_()), ("same", pa.bool_()), ("depth", pa.int32()), ("node", pa.int64())])
    return (words.select("word", "id").mapInArrow(edges, EDGE),
            words.select("word").mapInArrow(states, "s string, back boolean, same boolean, depth int, node long"))


def _letter(s: Column, at: Column) -> Column:
    return F.substring(s, at + 1, F.lit(1))


def _step(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """All states one letter on: ``s, back, same, goal`` (the text with its edit, null before one), ``depth, node, k, id``."""
    s, at, goal = F.col("s"), F.col("depth"), F.col("goal")
    own, after = _letter(s, at), _letter(s, at + 1)
    left_out = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 2, F.length(s)))
    e = F.col("e")
    replaced = F.concat(F.substring(s, F.lit(1), at), e["letter"], F.substring(s, at + 2, F.length(s)))
    wanted = (F.when(goal.isNotNull(), e["letter"] == _letter(goal, at))
              .when(F.col("same"), (e["letter"] > own) | ((e["letter"] == own) & (e["k"] > 1)))
              .otherwise((e["letter"] == own) | (e["letter"] == after)))
    # of equal letters in a row only the last is left out
    edited = (F.when(goal.isNotNull(), goal).when(F.col("same") & (e["letter"] != own), replaced)
              .when(~F.col("same") & (e["letter"] != own), left_out))
    return (frontier.join(nodes, ["depth", "node"]).select("*", F.explode("edges").alias("e")).where(wanted)
            .select("s", "back", "same", edited.alias("goal"), (at + 1).alias("depth"), e["child"].alias("node"), e["k"].alias("k"), e["id"].alias("id")))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n`` for all pairs of ``word, n`` that are one edit apart, in both orders."""
    words = written(words.select("word", "n", F.xxhash64("word").alias("id")), "spelling_words")
    edges, begin = _walks(words)
    joined = edges.groupBy("depth", "node", "letter", "child").agg(F.count("*").alias("k"), F.max("id").alias("id"))
    nodes = joined.groupBy("depth", "node").agg(F.collect_list(F.struct("letter", "child", "k", "id")).alias("edges"))  # at most one per letter
    nodes = written(nodes, "spelling_nodes")
    begin = written(begin, "spelling_begin")
    # own walks in their own trie go on only where another word shares the node
    depths = [r[0] for r in nodes.where("size(edges) > 1 OR edges[0].k > 1").select("depth").distinct().collect()]  # word lengths
    first = {r[0] for r in begin.select("depth").distinct().collect()}
    reached, frontier = [], None
    for depth in range(min(first, default=0), max([*depths, *first], default=-1) + 1):
        here = begin.where(F.col("depth") == depth).select("s", "back", "same", F.lit(None).cast("string").alias("goal"), "depth", "node") if depth in first else None
        frontier = here if frontier is None else frontier if here is None else frontier.unionByName(here)
        if frontier is None:
            continue
        step = written(_step(frontier, nodes.where(F.col("depth") == depth)), "spelling_step")
        reached.append(step.where("k = 1"))
        frontier = step.where("k > 1").drop("k", "id")
    if not reached:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).where(F.lit(False))
    found = reached[0]
    for more in reached[1:]:
        found = found.unionByName(more)
    word = F.when(F.col("back"), F.reverse("s")).otherwise(F.col("s"))
    found = found.select(word.alias("word"), "id").distinct()
    met = (found.join(words.select("id", F.col("word").alias("near"), F.col("n").alias("near_n")), "id")
           .where(F.levenshtein("word", "near", 1) == 1).drop("id").join(words.select("word", "n"), "word"))
    met = written(met.select("word", "n", "near", "near_n"), "spelling_pairs")
    return met.unionByName(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))).distinct()


def group(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a word's form is its most frequent near word, if ``times`` as frequent."""
    words = written(words.select("word", "n"), "spelling_counts")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.order")).alias("form_n"))
    formed = words.join(best, "word", "left").withColumn("is", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False)))
    formed = written(formed.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                   F.when(F.col("is"), F.col("form")).alias("form"), F.when(F.col("is"), F.col("form_n")).alias("form_n")), "spelling_forms")
    # roots: each round doubles the steps that a word has followed; a form is more frequent, so paths end
    ahead = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        far = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(ahead.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    return (formed.join(ahead.drop("moved"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts, grouped."""
    return group(count_words(docs, id_col, text_col))


#: The same rows from DuckDB: neighbours by texts with one letter left out, roots by recursion.
SQL = """
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128
           THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))),
         lambda a, x: xor(a >> 8, step[CAST((xor(a, x) & 255) + 1 AS INTEGER)])), 4294967295) AS h
  FROM runs, steps
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, v.n, c.word, c.n FROM cut c JOIN v ON v.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT p.word, f.word, f.form FROM path p JOIN f ON f.word = p.next
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN path p ON p.word = f.word AND p.next IS NULL
"""
