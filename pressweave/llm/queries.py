"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fertility, hilbert, jaccard, language_id, licenses, manifest, mixing, pieces, recipes, sharding, spelling, suffixes
from .common import read


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(read(spark, sf_dir, "documents"), words=3, percent=90)


def op2_quality_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op5_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(read(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = chat.link(chat.as_tool_messages(read(spark, sf_dir, "conversations")), chat.REPLY_SCHEMAS)
    return linked.select("conv_id", "turn", "call_id", "level", "status", "n_results", "result_turn", "valid", F.sha2("canonical", 256).alias("canonical_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(read(spark, sf_dir, "documents"), manifest.lowered_text())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.deduplicate(read(spark, sf_dir, "documents")).drop("n_chunks")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_quality_fertility, op3_suffix_dedup, op4_language_id, op5_hilbert_search, op6_mixing, op7_chat_tool_calls, op8_license_scan, op9_pieces, op10_sharding, op11_merkle_manifest, op12_spelling_variants, op13_chunk_recipes)
}

ORACLES: dict[str, str] = {
    "op13_chunk_recipes": """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t)""",
}
