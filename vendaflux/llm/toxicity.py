"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability from a linear model over hashed words and the
letter sequences of all of each word; the document's is their noisy-or, ``1 - prod(1 - p)``.  Only documents are labelled: the gradient of the
document's likelihood decides which sentences are to blame, so the trained model also locates them.

The model is fitted on at most ``MAX_PER_CLASS`` labelled documents of each class, chosen by a hash of their ids; all
documents are scored.

Cases: a null or empty text, or one without words, has no sentence and score 0.  Rows with a null label, or whose
document is missing, are not learnt from; of repeated labels the highest counts.  Without labels of both classes all
scores are those of an untrained model (near 0).  Repeated rows get the same score.  Extra columns are ignored.  No
rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each class that the model is fitted on: a bound for what the driver holds.
MAX_PER_CLASS = 4000
DIMENSIONS = 1 << 18
GRAMS = (5, 6)
START = -6.0
EPOCHS, BATCH, RATE, FLOOR, SMOOTHING = 12, 256, 0.5, 0.01, 5.0
#: Words whose weight a task remembers at once.
CACHE = 200_000

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> tuple[int, ...]:
    """The word, and all runs of ``GRAMS`` letters of it with its ends marked, which inflected and compound forms share."""
    marked = f"^{word}$"
    parts = {word} | {marked[i: i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in sorted(parts))


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """Start, end and lower-case words of each sentence that has words."""
    for m in SENTENCE.finditer(text):
        if words := LETTERS.findall(m[0].lower()):
            yield m.start(), m.end(), words


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        """Logit of a list of words, with a bounded memory of word weights."""
        weights, held, bias = self.weights, {}, self.bias

        def logit(words: list[str]) -> float:
            total = bias
            for w in words:
                v = held.get(w)
                if v is None:
                    if len(held) >= CACHE:
                        held.clear()
                    v = held[w] = float(sum(weights[i] for i in features(w)))
                total += v
            return total

        return logit


def noisy_or(logits: np.ndarray) -> float:
    """``1 - prod(1 - sigmoid(z))``, without loss for small values."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum()))


def _word_print(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _bags(texts: DataFrame) -> DataFrame:
    """``label`` and, packed, a print of each word of a document and the number of words of each sentence."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label in zip(batch.text, batch.label, strict=True):
                said = [words for _, _, words in sentences(text or "")]
                prints = np.fromiter((_word_print(w) for words in said for w in words), np.uint32)
                rows.append((int(label), prints.tobytes(), np.fromiter(map(len, said), np.int32, len(said)).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "words", "sizes"])

    return texts.mapInPandas(pack, "label int, words binary, sizes binary")


def _vocabulary(texts: DataFrame) -> DataFrame:
    """Each word of the documents once, many in a row: packed, their prints, how many features each has, and these."""
    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: set[str] = set()
        for batch in batches:
            new = {w for text in batch.text for _, _, words in sentences(text or "") for w in words} - known
            known |= new
            yield pd.DataFrame([(_word_print(w), np.array(features(w), np.int32).tobytes()) for w in new], columns=["word", "ids"])

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"words": [b.word.to_numpy().astype(np.uint32).tobytes()], "counts": [(b.ids.str.len() // 4).to_numpy().astype(np.uint32).tobytes()],
                                "ids": [b"".join(b.ids)]})

    words = texts.select("text").mapInPandas(spell, "word long, ids binary").groupBy("word").agg(F.min("ids").alias("ids"))
    return words.mapInPandas(packed, "words binary, counts binary, ids binary")


def fit(bags: list[tuple[int, bytes, bytes]], vocabulary: list[tuple[bytes, bytes, bytes]], seed: int = 0) -> Model:
    """Stochastic gradient of the noisy-or likelihood with AdaGrad.

    Each feature is scaled by its smoothed log-odds over documents, so one that a single document happens to have
    learns slowly and one that many toxic documents share learns fast."""
    prints, counts, spelt = (np.concatenate([np.zeros(0, kind), *[np.frombuffer(v[i], kind) for v in vocabulary]])
                             for i, kind in enumerate((np.uint32, np.uint32, np.int32)))
    order = np.argsort(prints, kind="stable")
    counts = counts.astype(np.int64)
    begin = (np.cumsum(counts) - counts)[order]
    prints, counts = prints[order], counts[order]
    spelt = spelt[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    offsets = np.concatenate([[0], np.cumsum(counts)])

    def features_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of words (places in the vocabulary) one after the other, and where those of each begin."""
        n = counts[words]
        begin = np.cumsum(n) - n
        return spelt[np.repeat(offsets[words] - begin, n) + np.arange(n.sum())], begin

    bags = [(y, np.searchsorted(prints, np.frombuffer(w, np.uint32)).astype(np.int32), np.frombuffer(s, np.int32)) for y, w, s in bags]
    bags = sorted((b for b in bags if len(b[2])), key=lambda b: (b[0], len(b[1]), b[1].tobytes()))
    weights, bias, square, square_bias = np.zeros(DIMENSIONS), START, np.full(DIMENSIONS, FLOOR), FLOOR
    seen = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
    for y, words, _ in bags:
        seen[y][np.unique(features_of(np.unique(words))[0])] += 1
    n = [sum(y == c for y, _, _ in bags) for c in (0, 1)]
    if not min(n):
        return Model(weights, bias)
    prior = [SMOOTHING * c / len(bags) for c in n]
    scale = np.log((seen[1] + prior[1]) / (seen[0] + prior[0]) * n[0] / n[1])
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for some in np.array_split(order.permutation(len(bags)), max(1, len(bags) // BATCH)):
            batch = [bags[i] for i in some]
            y = np.array([b[0] for b in batch], float)
            sizes = np.concatenate([b[2] for b in batch])
            words, place = np.unique(np.concatenate([b[1] for b in batch]), return_inverse=True)
            ids, begin = features_of(words)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            per_doc = np.array([len(b[2]) for b in batch])
            doc_starts = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
            of_word = np.add.reduceat((weights * scale)[ids], begin)
            z = bias + np.add.reduceat(of_word[place], starts)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            miss = np.exp(-np.add.reduceat(np.logaddexp(0.0, z), doc_starts))  # probability of no toxic sentence
            pull = np.where(y == 1, -miss / np.maximum(1 - miss, 1e-9), 1.0)
            grad_z = p * np.repeat(pull, per_doc) / len(batch)
            grad_word = np.bincount(place, weights=np.repeat(grad_z, sizes), minlength=len(words))
            grad = np.bincount(ids, weights=np.repeat(grad_word, counts[words]), minlength=DIMENSIONS) * scale
            square += grad * grad
            weights -= RATE * grad / np.sqrt(square)
            square_bias += grad_z.sum() ** 2
            bias -= 0.1 * RATE * grad_z.sum() / np.sqrt(square_bias)
    return Model((weights * scale).astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on at most ``max_per_class`` documents of each class of ``labels``."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    pick = [one.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # 2 * max_per_class rows
    # words go to the driver as prints of four bytes, each distinct one once more with its features
    return fit([tuple(r) for r in _bags(texts.select("text", "label")).limit(4 * max_per_class).collect()], [tuple(r) for r in _vocabulary(texts).collect()])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of each text being toxic."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # a megabyte, whatever the input

    @F.pandas_udf("double")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        logit = Model(*sent.value).scorer()
        for batch in texts:
            yield pd.Series([noisy_or(np.array([logit(w) for _, _, w in sentences(t)])) if t else 0.0 for t in batch], dtype=float)

    return docs.withColumn(out, toxic(F.col(text_col)))


def toxic_sentences(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The sentences to blame: ``id, start, end, sentence, p``, where ``p`` is at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logit = Model(*sent.value).scorer()
        for batch in batches:
            rows = []
            for i, text in zip(batch.id, batch.text, strict=True):
                for a, b, words in sentences(text or ""):
                    p = noisy_or(np.array([logit(words)]))
                    if p >= least:
                        rows.append((i, a, b, text[a:b], p))
            yield pd.DataFrame(rows, columns=["id", "start", "end", "sentence", "p"])

    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(ids.dtypes)["id"]
    return ids.where("id IS NOT NULL").mapInPandas(locate, f"id {kind}, start int, end int, sentence string, p double")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: all columns of ``docs``, ``held_out``, ``score`` and ``predicted``."""
    model = train(docs, labels.where(~held_out()))
    return (score(docs, model).withColumn("held_out", held_out())
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
