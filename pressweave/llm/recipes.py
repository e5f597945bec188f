"""Operator 13: exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 48 bytes says so, so that equal
passages give equal chunks wherever they stand. Each distinct chunk travels
once for each task that has it and is compared byte by byte with the others of
its digest, which makes the digest a verified identifier. A text is then its
list of identifiers, some 8 bytes for a kilobyte, and texts are equal exactly
if these lists are: whole texts never move.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, Hashes, as_bytes
from .common import bounded_batches, discard, materialise

#: Bytes that a cut looks back on, least and most bytes of a chunk, and the share of places that may be cuts (one in so many).
WINDOW, LEAST, MOST, ONE_IN = 48, 256, 8192, 1024
#: Bytes of a digest, and how many chunks may share their digest with another one before longer digests are taken.
DIGEST, MOST_CLASHES = 8, 10_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def places(data: bytes) -> list[int]:
    """Where cuts may be: after each window whose hash is 0 modulo ONE_IN, found a block at a time."""
    found = []
    for first in range(0, max(len(data) - WINDOW + 1, 0), BLOCK_BYTES):
        part = np.frombuffer(data, dtype=np.uint8)[first : first + BLOCK_BYTES + WINDOW - 1]
        found += (np.flatnonzero(Hashes(part).fixed(WINDOW) % np.uint64(ONE_IN) == 0) + first + WINDOW).tolist()
    return found


def chunks_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text; none of an empty one. They depend on the text alone, not on its neighbours."""
    data = b"".join(texts)
    may, end = places(data), 0
    for text in texts:
        start, end, out = end, end + len(text), []
        while end - start > LEAST:
            k = bisect_left(may, start + LEAST)
            cut = min(may[k] if k < len(may) else end, start + MOST)
            if cut >= end:
                break
            out.append(data[start:cut])
            start = cut
        if end > start:
            out.append(data[start:end])
        yield out


def _lowered(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x.translate(LOWER) for x in as_bytes(batch.column(column))]


def _chunks(digest: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {c for text in chunks_of(_lowered(batch, 0)) for c in text}
        yield pa.RecordBatch.from_arrays([pa.array([blake2b(c, digest_size=digest).digest() for c in seen], pa.binary()), pa.array(list(seen), pa.binary())], names=["id", "chunk"])


def _recipes(digest: int, clashes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers are digests; where two chunks share one, all but the first also carry their rank among these."""
    rank = clashes.value
    for batch in batches:
        texts, recipes, ranks = _lowered(batch, 0), [], []
        for chunks in chunks_of(texts):
            recipes.append(b"".join(blake2b(c, digest_size=digest).digest() for c in chunks))
            ranks.append(",".join(f"{k}:{rank[c]}" for k, c in enumerate(chunks) if c in rank) if rank else "")
        own = [pa.array(recipes, pa.binary()), pa.array(ranks, pa.string()), pa.array([sha256(t).hexdigest() for t in texts], pa.string())]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns[1:]], names=["recipe", "ranks", "text_sha256", *batch.schema.names[1:]])


def verified(docs: DataFrame, digest: int = DIGEST) -> tuple[int, dict[bytes, int]]:
    """Length of digests, and the rank of each chunk that isn't the first of its digest.

    The distinct chunks of docs (text) meet by digest and content. Digests of
    8 bytes clash for a few chunks in 10**11; where over MOST_CLASHES do,
    digests twice as long are taken, so what reaches the driver stays bounded.
    """
    while True:
        apart = docs.select("text").mapInArrow(partial(_chunks, digest), "id binary, chunk binary").distinct()
        twice = materialise(apart.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
        n = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if n and (n <= MOST_CLASHES or digest >= 64):
            rows = apart.join(F.broadcast(twice.select("id")), "id", "left_semi").collect()
        discard(twice)
        if not n:
            return digest, {}
        if n <= MOST_CLASHES or digest >= 64:
            held: dict[bytes, list[bytes]] = {}
            for r in rows:
                held.setdefault(bytes(r.id), []).append(bytes(r.chunk))
            return digest, {c: k for of in held.values() for k, c in enumerate(sorted(of)) if k}
        digest *= 2


def deduplicate(docs: DataFrame, digest: int = DIGEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chunks, and the columns that keep names.

    Texts are equal if they are identical after lower-casing A-Z; null counts
    as empty, and an empty text has an empty recipe. Of equal texts the row of
    the largest doc_id is kept; null doc_ids are below all others, and of rows
    that repeat a doc_id one is kept. keep_id is the kept row's doc_id, null if
    all of the group are. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    digest, ranks = verified(docs, digest)
    slim = docs.select("text", "doc_id", *([F.struct(*keep).alias("row")] if keep else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[1:])
    listed = slim.mapInArrow(partial(_recipes, digest, spark.sparkContext.broadcast(ranks)), f"recipe binary, ranks string, text_sha256 string, {fields}")
    listed = materialise(listed.withColumn("at", F.monotonically_increasing_id()))
    groups = listed.groupBy("recipe", "ranks").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "at")).alias("last"))
    # written, so that the join deals both sides anew and a group of very many copies can be split
    groups = materialise(groups.where("group_size > 1").select(F.col("recipe").alias("of"), F.col("ranks").alias("of_ranks"), "group_size", "last"))
    joined = listed.join(groups, (F.col("recipe") == F.col("of")) & (F.col("ranks") == F.col("of_ranks")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("of").isNull() | (F.col("last.at") == F.col("at"))).alias("kept"),
        "text_sha256",
        (F.octet_length("recipe") / digest).cast("long").alias("n_chunks"),
        *[F.col(f"row.{c}") for c in keep],
    )
