"""A training corpus in five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.llm import jaccard, language_id, mixing, pieces, suffixes
from pressweave.llm.common import materialise, read
from pressweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with ``row``, a key that no two rows share, in the order of doc_id: doc_id itself where it is one."""
    often = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1")
    if often.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    # the hash deals the rows of one doc_id over several ranges
    return materialise(docs.orderBy("doc_id", F.xxhash64(*COLUMNS)).withColumn("row", F.monotonically_increasing_id()))


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows without a letter (und) or between two languages go; the others keep their columns, whatever other rows of their doc_id or of none do."""
    found = language_id.identify(docs, keep=("lang", "source", "n_chars")).where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return found.select("doc_id", "text", "row.lang", "row.source", "row.n_chars")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 over shingles of 5 words, linked from 0.8: of each group of linked rows, one of the smallest doc_id stays.

    Rows that repeat a doc_id are linked by their texts as any others. As in
    the operator, rows of null doc_id link with nothing, so that all of them stay.
    """
    rows = numbered(docs)
    known = rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("of"), "lang", "source", "n_chars", F.col("text").isNull().alias("bare")).where("of IS NOT NULL")
    kept = jaccard.first_of_each(known, 5, 80, ("of", "lang", "source", "n_chars", "bare"))
    text = F.when(~F.col("row.bare"), F.col("text")).alias("text")
    return kept.select(F.col("row.of").alias("doc_id"), text, "row.lang", "row.source", "row.n_chars").union(docs.where("doc_id IS NULL").select(COLUMNS))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: strings of 50 bytes that an earlier row has go; a row with no word left goes.

    Earlier is a smaller doc_id; rows of one doc_id are in the order of a hash. As in
    the operator, rows of null doc_id are compared with nothing and keep their text.
    """
    rows, word = numbered(docs), F.col("text").rlike(r"[^\x20\x09-\x0D]")
    known = rows.select(F.col("row").alias("doc_id"), "text", F.col("doc_id").alias("of"), "lang", "source").where("of IS NOT NULL")
    rest = suffixes.deduplicate(known, keep_text=True, keep=("of", "lang", "source"))
    kept = rest.select(F.col("row.of").alias("doc_id"), F.col("kept_text").alias("text"), "row.lang", "row.source").unionByName(rows.where("doc_id IS NULL").select("doc_id", "text", "lang", "source"))
    return kept.where(word).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each row, of null doc_id or not, as many times as the mix takes its words: whole copies, and the first words of one that is cut."""
    keyed = numbered(docs)
    taken = mixing.mix(keyed, keep=("row",)).select("row", "size", "taken").where("taken > 0")
    rows = keyed.join(taken, "row").withColumn("part", F.col("taken") % F.col("size"))
    times = F.floor(F.col("taken") / F.col("size"))
    copies = F.concat(
        F.when(times > 0, F.transform(F.sequence(F.lit(1), F.greatest(times, F.lit(1))), lambda _: F.lit(False))).otherwise(F.array().cast("array<boolean>")),
        F.when(F.col("part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")),
    )
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("part").cast("int"))
    exploded = rows.withColumn("cut", F.explode(copies)).withColumn("text", F.when(F.col("cut"), F.array_join(words, "")).otherwise(F.col("text")))
    return exploded.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: ids of every document, with the text decoded from them."""
    return pieces.encode_documents(docs, tokenizer_path(), keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Learned classifiers, hash-random orders and piece ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
