"""Whole texts in packed batches, and document frequencies of their tokens.

A batch holds the texts of some documents as one compressed value, so that a
text travels at a fraction of its size and a few hundred rows stand for
hundreds of thousands. Tokens are 44-bit hashes. Each batch sends its distinct
tokens once, as gaps of four bytes, to the parts of the token space; a part adds
up the documents over all batches and answers with one byte for each token. The
answer costs no join on tokens, and a token of very many documents costs a
row for each batch, not for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, as_bytes, blocks, runs
from .common import bounded_batches, materialise

#: Bytes of text in a batch (one longer text makes a batch of its own), and bytes of text for each part of the token space.
BATCH_BYTES, PART_BYTES, TOKEN_BITS = 2 << 20, 8 << 20, 44


class Batch:
    """The texts of one packed row, and where each lies in their joined bytes."""

    def __init__(self, batch: int, ids: pa.Array, sizes: np.ndarray, texts: bytes):
        self.batch, self.ids = batch, ids
        self.data = zstandard.ZstdDecompressor().decompress(texts)
        self.ends = np.cumsum(sizes.astype(np.int64))
        self.starts = self.ends - sizes

    def texts(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())]

    def blocks(self) -> Iterator[Block]:
        return blocks(self.texts())


def unpacked(rows: pa.RecordBatch) -> Iterator[Batch]:
    """The batches of rows whose first columns are batch, ids, sizes and texts."""
    for i in range(rows.num_rows):
        yield Batch(rows.column(0)[i].as_py(), rows.column(1)[i].values, np.asarray(rows.column(2)[i].values), rows.column(3)[i].as_py())


def compressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def decompressed(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k, held, size = TaskContext.get().partitionId() << 32, [], 0

    def row(slices: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([s.column(c) for s in slices]) for c in range(slices[0].num_columns)]
        texts = as_bytes(columns[1])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        joined = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        values = [pa.array([k]), one(columns[0]), one(pa.array([len(t) for t in texts], pa.int32())), pa.array([joined], pa.binary()), *map(one, columns[2:])]
        return pa.RecordBatch.from_arrays(values, names=["batch", "ids", "sizes", "texts", "rows"][: len(values)])

    for batch in batches:
        first = 0
        for i, n in enumerate(len(t) for t in as_bytes(batch.column(1))):
            if size and size + n > BATCH_BYTES:
                yield row([*held, batch.slice(first, i - first)])
                k, held, size, first = k + 1, [], 0, i
            size += n + 1
        held.append(batch.slice(first))
    if size:
        yield row(held)


def pack(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Materialised rows (batch, ids, sizes, texts) of docs (doc_id, text), null texts as empty; with keep also an array of structs ``rows`` of those columns."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*keep).alias("row")] if keep else []))
    schema = T._parse_datatype_string("batch long, ids array<long>, sizes array<int>, texts binary")
    if keep:
        schema = schema.add("rows", T.ArrayType(slim.schema["row"].dataType))
    return materialise(slim.mapInArrow(_pack, schema), "none")


def _edges(tokens: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's share of sorted tokens starts, with the end."""
    return np.searchsorted(tokens, np.array([(p << TOKEN_BITS) // parts for p in range(parts)] + [1 << TOKEN_BITS], dtype=np.uint64))


def _gaps(tokens: np.ndarray, low: int) -> bytes:
    """Sorted tokens as differences from low on, four bytes each, or six where one doesn't fit."""
    gaps = np.diff(tokens, prepend=np.uint64(low)).astype("<u8")
    return gaps.view(np.uint8).reshape(-1, 8)[:, : 4 if gaps.max() < 1 << 32 else 6].tobytes()


def _from_gaps(x: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, : len(x) // n] = np.frombuffer(x, dtype=np.uint8).reshape(n, -1)
    return np.cumsum(wide.view("<u8").ravel())


def _by_part(tokens_of: Callable, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for batch in unpacked(rows):
            tokens, n = tokens_of(batch)
            at = _edges(tokens, parts)
            some = np.flatnonzero(np.diff(at)).tolist()
            values = [[_gaps(tokens[at[p] : at[p + 1]], (p << TOKEN_BITS) // parts) for p in some], [compressed(n[at[p] : at[p + 1]].astype("<u4")) for p in some]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch.batch] * len(some), pa.int64()), *(pa.array(v, pa.binary()) for v in values)], names=["part", "batch", "tokens", "counts"])


def code_of(n: np.ndarray) -> np.ndarray:
    """A number of documents in one byte, rising with it: itself below 128, then eight steps for each doubling, 255 at most."""
    return np.where(n < 128, n, np.minimum(255, 128 + np.floor(8 * np.log2(np.maximum(n, 128) / 128)))).astype(np.uint8)


def _count(part: pa.Table) -> pa.Table:
    counts = [decompressed(x, "<u4") for x in part["counts"].to_pylist()]
    sizes, n = [len(x) for x in counts], np.concatenate(counts).astype(np.int64)
    tokens = np.concatenate([_from_gaps(x, k) for x, k in zip(part["tokens"].to_pylist(), sizes)])
    order = np.argsort(tokens, kind="stable")
    at = runs(tokens[order])
    del tokens
    codes = np.empty(len(order), dtype=np.uint8)
    codes[order] = np.repeat(code_of(np.add.reduceat(n[order], at[:-1])), np.diff(at)) if len(order) else 0
    out = [compressed(x) for x in np.split(codes, np.cumsum(sizes)[:-1])]
    return pa.table({"batch": part["batch"], "part": part["part"], "codes": pa.array(out, pa.binary())})


def frequencies(packed: DataFrame, tokens_of: Callable[[Batch], tuple[np.ndarray, np.ndarray]], parts: int) -> DataFrame:
    """(batch, parts): for each batch, one byte (code_of) for each of its distinct tokens: the number of documents of all batches that have it.

    tokens_of gives a batch's distinct tokens, sorted, and how many of its
    documents have each; codes() puts the bytes back beside them.
    """
    sent = packed.select("batch", "ids", "sizes", "texts").mapInArrow(partial(_by_part, tokens_of, parts), "part int, batch long, tokens binary, counts binary")
    answered = sent.groupBy("part").applyInArrow(_count, "batch long, part int, codes binary")
    return answered.groupBy("batch").agg(F.collect_list(F.struct("part", "codes")).alias("parts"))


def codes(tokens: np.ndarray, answers: list[dict] | None, parts: int) -> np.ndarray:
    """The byte of each of a batch's distinct sorted tokens."""
    at, out = _edges(tokens, parts), np.zeros(len(tokens), dtype=np.uint8)
    for x in answers or ():
        out[at[x["part"]] : at[x["part"] + 1]] = decompressed(x["codes"], np.uint8)
    return out


def total_bytes(packed: DataFrame) -> int:
    return packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
