"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units at places that no piece of the model can cross.  Each distinct unit is encoded once: its
substrings up to the longest piece are exploded and joined to the piece table, the edges that match are grouped by unit
and folded with Spark's ``aggregate``.  For a unigram model the fold is Viterbi's: the best score of each position, from
the edges that end there.  A BPE model defines its segmentation by the order of merges, which is not the path with the
best sum, so its lattice is folded by merges: boundaries are bits of a number, and the best edge that spans exactly two
symbols removes the one between.  Characters without a piece fall back to bytes, or to the unknown piece.

Documents then look their units up: the most frequent ones (``HEAD``) in a packed dictionary that tasks hold, the others
by a join on the unit.  Ids of a text equal those of the reference library for the same model file.

Cases: a null or empty text has no ids.  The space mark itself decodes to a space.  Units longer than ``LONGEST`` are
folded by the same rules in a plain helper.  Repeated rows get the same ids.  Other columns are kept.  No rows give no
rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vendaflux.llm.common import text_of, written

MARK = "▁"
#: Units in the dictionary that tasks hold (about 25 bytes each); characters of a unit that fit the bits of a number.
HEAD, LONGEST = 3_000_000, 60
#: Distinct units that a task counts before it hands them on.
COUNTED = 250_000
#: Bytes of texts that are cut together, and units whose lattices are made in one task.
SLICE, PART = 1_000_000, 20_000
#: Units that one task packs for the dictionary.
PACKED = 100_000
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Model:
    """Pieces of a model: normal ones with scores, bytes, the unknown id, and how texts begin."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    bpe: bool
    prefix: bool = True
    names: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Model:
        """The model in a file.  Scores of a BPE model are the order of its merges (0, -1, -2, ...), those of a unigram
        model logarithms of probabilities; that tells how its lattice is folded."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in ids]
        normal = {names[i]: (i, sp.get_score(i)) for i in ids
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        byte = {int(names[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        bpe = all(score == int(score) for _, score in normal.values())
        return cls(normal, [byte[b] for b in range(256)] if byte else [], sp.unk_id(), bpe, bool(sp.encode("a", out_type=str)[0].startswith(MARK)), names)

    @property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def pairs(self) -> frozenset[str]:
        """Neighbouring characters inside pieces; between others a text can be cut."""
        return frozenset(p[i: i + 2] for p in self.pieces for i in range(len(p) - 1))

    def table(self, spark: SparkSession) -> DataFrame:
        """The piece table; as many rows as the model has pieces."""
        return spark.createDataFrame([(p, i, s) for p, (i, s) in self.pieces.items()], "piece string, id int, score double")

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")] if self.byte_ids else [self.unknown]


def normalised(text: str, prefix: bool) -> str:
    text = text.replace(" ", MARK)
    return MARK + text if prefix and text else text


class Cutter:
    """Cuts texts into units: between characters that no piece has side by side, and before the space marks of a word.

    All characters of several texts are looked at together, in a table of a byte for each two characters of pieces."""

    def __init__(self, pairs: frozenset[str], prefix: bool) -> None:
        self.prefix = prefix
        chars = sorted({MARK}.union(*pairs))
        self.kinds = len(chars) + 1  # 0 for all characters that no piece joins to others
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, self.kinds)
        apart = np.ones((self.kinds, self.kinds), bool)
        for a, b in pairs:
            apart[self.kind[ord(a)], self.kind[ord(b)]] = b == MARK != a
        self.apart = apart.ravel()

    def __call__(self, texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
        """Units of all texts one after the other, and how many there are before each text and in all."""
        marked = [normalised(t, self.prefix) if t else "" for t in texts]
        joined = "".join(marked)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[codes]
        cut = np.ones(len(codes) + 1, bool)
        both = kind[:-1].astype(np.int32)
        both *= self.kinds
        both += kind[1:]
        cut[1:-1] = self.apart[both]
        begins = np.cumsum([0, *map(len, marked)])
        cut[begins] = True
        at = np.flatnonzero(cut)
        widths = (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes in UTF-8 beyond the first
        more = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(widths, out=more[1:], dtype=np.int32)
        offsets = (at + more[at]).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(joined.encode("utf-8")))
        return units, np.searchsorted(at, begins)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with about SLICE bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def distinct_units(docs: DataFrame, model: Model) -> DataFrame:
    """``unit, n`` of all texts, counted in each task first."""
    pairs, prefix = model.pairs(), model.prefix

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = Cutter(pairs, prefix), []

        def together() -> pa.Table:
            return pa.concat_tables(held).group_by("unit").aggregate([("n", "sum")]).rename_columns(["unit", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                found = cut(part.column(0).to_pylist())[0].value_counts()
                held.append(pa.table([found.field(0), found.field(1)], ["unit", "n"]))
                if sum(map(len, held)) > 2 * COUNTED:
                    held = [together()]
                    if len(held[0]) > COUNTED:
                        yield from held.pop().to_batches(COUNTED)
        if held:
            yield from together().to_batches(COUNTED)

    return docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """Edges of each unit (up to LONGEST characters): ``unit, n, edges`` with start, end, id and score."""
    # dealt by unit before they grow: edges are grouped where they are made, and a part fits into memory
    rows = units.repartition(max(1, -(-units.count() // PART)), "unit").withColumn("h", F.xxhash64("unit"))
    rows = rows.select("h", "unit", "n", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    rows = rows.select("h", "unit", "n", "start", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(model.longest), F.length("unit") - F.col("start")))).alias("size"))
    rows = rows.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size")))
    pieces = F.broadcast(model.table(units.sparkSession))  # a row for each piece of the model
    edges = rows.join(pieces, "piece").select("h", "unit", "n", F.struct(
        (-F.col("score")).alias("cost"), "start", (F.col("start") + F.col("size")).alias("end"), "id").alias("edge"))
    # the hash comes first because numbers are sorted faster than texts
    return edges.groupBy("h", "unit", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges")).select("unit", "n", "edges")


def _fallback_ids(model: Model, char: Column) -> Column:
    if not model.byte_ids:
        return F.array(F.lit(model.unknown))
    hexes = F.hex(F.encode(char, "UTF-8"))
    ids = F.array(*[F.lit(i) for i in model.byte_ids])
    return F.transform(F.sequence(F.lit(0), (F.length(hexes) / 2).cast("int") - 1), lambda i: F.element_at(
        ids, (F.conv(F.substring(hexes, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") + 1)))


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(model: Model) -> Column:
    """Ids of a unit by merges, from ``unit`` and ``edges`` (in order of cost, then start)."""
    one = F.lit(1).cast("long")
    size = F.length("unit")
    bits = F.transform(F.filter(F.col("edges"), lambda e: e["end"] - e["start"] > 1), lambda e: F.struct(
        (_left(one, e["start"]).bitwiseOR(_left(one, e["end"]))).alias("ends"),
        (_left(one, e["end"]) - _left(one, e["start"] + 1)).alias("inner")))

    def merge(state: Column, _: Column) -> Column:
        best = F.get(F.filter(state["bits"], lambda e: (state["mask"].bitwiseAND(e["ends"]) == e["ends"])
                                     & (F.bit_count(state["mask"].bitwiseAND(e["inner"])) == 1)), F.lit(0))
        return F.struct(F.coalesce(state["mask"] - state["mask"].bitwiseAND(best["inner"]), state["mask"]).alias("mask"), state["bits"].alias("bits"))

    full = _left(one, size + 1) - 1
    start = F.struct(full.alias("mask"), bits.alias("bits"))
    # a unit of n characters has n - 1 merges at most
    mask = F.aggregate(F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>")), start, merge, lambda s: s["mask"])
    return _ids_between(model, _once(mask, lambda m: F.filter(
        F.sequence(F.lit(0), size), lambda i: F.call_function("shiftright", m, i).bitwiseAND(one) == 1)))


def _ids_between(model: Model, cuts: Column) -> Column:
    """Ids of the pieces between neighbouring cuts."""
    def ids(pair: Column) -> Column:
        edge = F.get(F.filter(F.col("edges"), lambda e: (e["start"] == pair["a"]) & (e["end"] == pair["b"])), F.lit(0))
        return F.when(edge.isNotNull(), F.array(edge["id"])).otherwise(_fallback_ids(model, F.substring("unit", pair["a"] + 1, F.lit(1))))

    def pairs(at: Column) -> Column:
        return F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return F.flatten(F.transform(_once(cuts, pairs), ids))


def fold_viterbi(model: Model) -> Column:
    """Ids of a unit with the best sum of scores: the fold keeps the least cost and the last start of each position."""
    worst = max((-s for _, s in model.pieces.values()), default=0.0) + UNKNOWN_PENALTY
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("start")))

    def reach(best: Column, end: Column) -> Column:
        ways = F.transform(F.filter(F.col("edges"), lambda e: e["end"] == end), lambda e: F.struct(
            (F.element_at(best, e["start"] + 1)["cost"] + e["cost"]).alias("cost"), e["start"].alias("start")))
        step = F.array(F.struct((F.element_at(best, end)["cost"] + worst).alias("cost"), (end - 1).alias("start")))
        known = F.exists(F.col("edges"), lambda e: (e["end"] == end) & (e["start"] == end - 1))
        return F.concat(best, F.array(F.array_min(F.when(known, ways).otherwise(F.concat(ways, step)))))

    best = F.aggregate(F.sequence(F.lit(1), F.length("unit")), start, reach)

    def back(best: Column) -> Column:
        path = F.aggregate(F.sequence(F.lit(1), F.length("unit")), F.array(F.length("unit")), lambda p, _: F.when(
            F.element_at(p, 1) > 0, F.concat(F.array(F.element_at(best, F.element_at(p, 1) + 1)["start"]), p)).otherwise(p))
        return path

    return _ids_between(model, _once(best, back))


def plain_ids(unit: str, model: Model) -> list[int]:
    """The same for one unit of any length."""
    pieces, n = model.pieces, len(unit)
    if model.bpe:
        left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            b = right[a]
            if b < n and (p := pieces.get(unit[a: end[b]])):
                heapq.heappush(heap, (-p[1], a, b, end[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and right[a] == b and end[b] == stop):
                continue
            alive[b], end[a], right[a] = False, stop, right[b]
            if right[a] < n:
                left[right[a]] = a
            if left[a] >= 0:
                offer(left[a])
            offer(a)
        spans = [(i, end[i]) for i in range(n) if alive[i]]
    else:
        worst = max((-s for _, s in pieces.values()), default=0.0) + UNKNOWN_PENALTY
        best = [(0.0, 0)]
        for e in range(1, n + 1):
            ways = [(best[s][0] - pieces[unit[s:e]][1], s) for s in range(max(0, e - model.longest), e) if unit[s:e] in pieces]
            if unit[e - 1] not in pieces:
                ways.append((best[e - 1][0] + worst, e - 1))
            best.append(min(ways))
        spans, e = [], n
        while e:
            spans.append((best[e][1], e))
            e = best[e][1]
        spans.reverse()
    out: list[int] = []
    for a, b in spans:
        out.extend([pieces[unit[a:b]][0]] if unit[a:b] in pieces else model.fallback(unit[a:b]))
    return out


def unit_ids(units: DataFrame, model: Model) -> DataFrame:
    """``unit, n, ids`` of distinct units."""
    units = written(units, "pieces_distinct")
    short = units.where(F.length("unit") <= LONGEST)
    folded = written(lattice(short, model).select("unit", "n", (fold_merges if model.bpe else fold_viterbi)(model).alias("ids")), "pieces_folded")
    # units none of whose characters has a piece have no edge
    bare = short.join(folded.select("unit"), "unit", "left_anti").select("unit", "n", F.flatten(F.transform(
        F.split("unit", ""), lambda c: F.when(c != "", _fallback_ids(model, c)).otherwise(F.array().cast("array<int>")))).alias("ids"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=[np.array(plain_ids(u, model), np.int32) for u in batch.unit])

    long_ = units.where(F.length("unit") > LONGEST).select("unit", "n").mapInPandas(rest, "unit string, n long, ids array<int>")
    return folded.unionByName(bare).unionByName(long_)


@dataclass
class Dictionary:
    """Units by hash, with their ids: three arrays."""

    hashes: np.ndarray
    bounds: np.ndarray
    ids: np.ndarray

    @classmethod
    def collect(cls, encoded: DataFrame) -> Dictionary:
        """Gather a bounded number of units.  Tasks sort and pack them by ranges of their hash; here they are only joined on."""
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                    b.column(0).to_numpy().tobytes(), np.diff(lists.offsets.to_numpy()).astype(np.uint32).tobytes(),
                    lists.flatten().to_numpy().astype(kind).tobytes())], ["h", "n", "ids"])

        top = encoded.agg(F.max(F.array_max("ids"))).first()[0] or 0
        kind = np.uint16 if top < 1 << 16 else np.int32
        ranges = max(1, -(-encoded.count() // PACKED))
        ordered = encoded.select(F.xxhash64("unit").alias("h"), "ids").repartitionByRange(ranges, "h").sortWithinPartitions("h")
        parts = ordered.mapInArrow(pack, "h binary, n binary, ids binary").collect()
        hashes = np.frombuffer(b"".join(p.h for p in parts), np.int64)
        bounds = np.concatenate([np.zeros(1, np.uint32), np.cumsum(np.frombuffer(b"".join(p.n for p in parts), np.uint32), dtype=np.uint32)])
        return cls(hashes, bounds, np.frombuffer(b"".join(p.ids for p in parts), kind))

    def find(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of the units (UTF-8) begin, how many each has, and which are not held (those have one id)."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, units, repeat(42)), np.uint64, len(units)).view(np.int64)  # as Spark's xxhash64
        if not len(self.hashes):
            return np.zeros(len(units), np.int64), np.ones(len(units), np.int64), np.ones(len(units), bool)
        at, order = np.empty(len(units), np.int64), np.argsort(h)
        at[order] = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)  # neighbours in memory one after the other
        lost = self.hashes[at] != h
        starts = np.where(lost, 0, self.bounds[at]).astype(np.int64)
        return starts, np.where(lost, 1, self.bounds[at + 1] - starts), lost

    def get(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units one after the other, how many there are before each unit and in all, and which units are not
        held (those have one id, -1).  Each distinct unit is looked up once."""
        coded = units.dictionary_encode()
        which = coded.indices.to_numpy()
        starts, sizes, lost = (x[which] for x in self.find(coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(self.hashes):
            return np.full(len(units), -1, np.int32), bounds, lost
        taken = np.repeat(starts - bounds[:-1], sizes)
        taken += np.arange(bounds[-1])
        ids = self.ids[taken].astype(np.int32)
        ids[bounds[:-1][lost]] = -1
        return ids, bounds, lost


def written_as(model: Model) -> list[bytes]:
    """The bytes that each id stands for, with spaces for marks."""
    byte = {i: b for b, i in enumerate(model.byte_ids)}
    names = [bytes([byte[i]]) if i in byte else " ⁇ ".encode() if i == model.unknown else n.encode("utf-8") if n in model.pieces else b""
             for i, n in enumerate(model.names)]
    return [n.replace(MARK.encode(), b" ") for n in names]


def decoder(model: Model) -> Callable[[np.ndarray], str]:
    names, prefix = written_as(model), model.prefix

    def text(ids: np.ndarray) -> str:
        joined = b"".join(map(names.__getitem__, ids.tolist()))
        return (joined[1:] if prefix and joined[:1] == b" " else joined).decode("utf-8", "replace")

    return text


def encode(docs: DataFrame, model: Model, text_col: str = "text", out: str = "ids", head: int = HEAD, round_trip: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text, and on demand whether decoding them gives it back (spaces for space marks)."""
    spark, pairs, prefix = docs.sparkSession, model.pairs(), model.prefix
    encoded = written(unit_ids(distinct_units(docs.select(F.col(text_col).alias("text")), model), model), "pieces_units")
    total = encoded.count()
    common = encoded if total <= head else encoded.orderBy(F.desc("n"), "unit").limit(head)
    held_by_all = Dictionary.collect(common)
    sent = spark.sparkContext.broadcast((held_by_all.hashes, held_by_all.bounds, held_by_all.ids))  # at most ``head`` units
    del held_by_all
    docs = docs.drop(out, *([round_trip] if round_trip else []))
    check = round_trip is not None and total <= head
    at = docs.columns.index(text_col)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = Cutter(pairs, prefix), Dictionary(*sent.value)
        names, text_of_ids = pa.array(written_as(model), pa.binary()), decoder(model)

        def gives_back(texts: list[str | None], ids: np.ndarray, bounds: np.ndarray) -> list[bool]:
            _, ends, joined = names.take(pa.array(ids)).buffers()
            joined, at = joined.to_pybytes() if joined else b"", np.frombuffer(ends, np.int32)[bounds].tolist()
            wanted = [normalised(t, prefix).replace(MARK, " ").encode("utf-8") if t else b"" for t in texts]
            # bytes that differ are compared as text: they may be no UTF-8
            return [joined[a:b] == w or text_of_ids(ids[i:j]) == (t or "").replace(MARK, " ")
                    for a, b, i, j, w, t in zip(at, at[1:], bounds, bounds[1:], wanted, texts, strict=False)]

        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                units, firsts = cut(texts)
                ids, before, lost = known.get(units)
                bounds = before[firsts]
                more = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                if check:
                    more.append(pa.array(gives_back(texts, ids, bounds), pa.bool_()))
                elif total > head:
                    gaps = np.concatenate([[0], np.cumsum(lost)])[firsts]
                    more.append(pa.ListArray.from_arrays(pa.array(gaps, pa.int32()), units.filter(pa.array(lost))))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, out, "__more"][: len(part.columns) + len(more)])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    if check:
        return docs.mapInArrow(look_up, schema.add("__more", "boolean")).withColumnRenamed("__more", round_trip)
    if total <= head:
        return docs.mapInArrow(look_up, schema)

    # the rare units: joined by unit, gathered by text, put into the gaps in order
    held = written(docs.mapInArrow(look_up, schema.add("__more", T.ArrayType(T.StringType()))).withColumn("__row", F.monotonically_increasing_id()), "pieces_held")
    gaps = held.select("__row", F.posexplode("__more").alias("at", "unit"))
    fills = (gaps.join(encoded.select("unit", F.col("ids").alias("found")), "unit").groupBy("__row")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "found"))), lambda x: x["found"]).alias("__fill")))

    def fill(ids: pd.Series, fills: pd.Series) -> pd.Series:
        def one(row: np.ndarray, more) -> np.ndarray:
            parts = np.split(row, np.flatnonzero(row == -1))
            return np.concatenate([parts[0], *[np.concatenate([m, p[1:]]) for m, p in zip(more, parts[1:], strict=True)]]) if more is not None else row

        return pd.Series([one(a, b) for a, b in zip(ids, fills, strict=True)])

    filled = held.join(fills, "__row", "left")
    filled = filled.withColumn(out, F.pandas_udf(fill, "array<int>")(out, "__fill")).drop("__more", "__row", "__fill")
    if round_trip is None:
        return filled
    back = decode(filled, model, out, "__back")
    return back.withColumn(round_trip, F.col("__back") == F.regexp_replace(text_of(text_col), MARK, " ")).drop("__back")


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids."""
    def texts(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = decoder(model)
        for batch in ids:
            yield pd.Series([text(x) if x is not None else "" for x in batch], dtype=object)

    return rows.withColumn(out, F.pandas_udf(texts, "string")(F.col(ids_col)))


def tokenise(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, and ``round_trip``: whether decoding gives the text back."""
    return encode(docs, Model.load(model_path), round_trip="round_trip").withColumn("n_tokens", F.size("ids").cast("long"))
