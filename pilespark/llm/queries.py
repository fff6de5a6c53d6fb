"""The opN_ queries: each applies its operator to its whole table, with the parameters used in production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, embedding_dedup, fingerprints, jaccard_join, line_dedup, packing, secret_scan, suffix_dedup, token_output, toxicity
from .pretoken import tokenizer_path
from .scratch import Scratch

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files written."""
    path = Scratch(spark, "tokens").path("ids")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(WORD), END_ID)
    return token_output.digests(token_output.read_tokens(spark, path))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE), END_ID, 1024)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers), kept_sha256 of the text that stays (null text: null)."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_candidates, n_secrets, findings (at, n_chars, sha256, score), masked_sha256 of the text with secrets replaced (null text: null)."""
    out = secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_candidates", "n_secrets", "findings", F.sha2("text", 256).alias("masked_sha256"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept at cosine 0.95."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of 200 bytes."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 200)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digest(table(spark, sf_dir, "documents"), tokenizer_path(WORD))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id at five words and a similarity of 0.8."""
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_output, op2_packing, op3_line_dedup, op4_secret_scan, op5_embedding_dedup, op6_suffix_dedup, op7_toxicity, op8_bpe_automaton, op9_jaccard_join, op10_fingerprints)}
ORACLE_SQL: dict[str, str] = {}
