"""The registered queries of this subpackage, and SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendaflux.llm import (
    conversation_trie,
    exact_dedup,
    fingerprint,
    html_extract,
    jaccard_join,
    line_frequency,
    mixing,
    pii,
    sentencepiece_lattice,
    spelling_variants,
    toxicity,
    url_filter,
    warc,
)
from vendaflux.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_lattice.tokenise(docs).select("doc_id", "ids", "n_tokens", "round_trip")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), width=4, percent=85)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    number = dict(pages.dtypes)["page_id"]
    digest = F.coalesce("payload_sha256", "digest")
    return warc.archive(pages).select(
        F.col("id").cast(number).alias("page_id"), F.col("stated_bytes").alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", F.col("refers_to").cast(number).alias("refers_to"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuilt(table(spark, sf_dir, "conversations"))).drop("node")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_html_extract": op7_html_extract,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_ngram_jaccard": jaccard_join.SQL,
    "op9_warc": warc.SQL,
    "op11_prefix_trie": conversation_trie.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
    "op13_quality_rules": line_frequency.SQL,
}
