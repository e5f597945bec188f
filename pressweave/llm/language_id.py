"""Operator 4: language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary classifier over
hashed byte n-grams (log-odds of the languages with the bit set against the
others) gives a margin; a language's loss is the sum of its bits' logistic
losses, each weighted by how far its classifier gets rows right that it hasn't seen. The
language of least loss wins; a small lead over the next one is flagged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER_KEYS, Block, Hashes, as_bytes, blocks
from .common import bounded_batches, materialise

#: Rows of each language and bytes of a row that training takes at most: the bound of the training sample.
TRAIN_ROWS, TRAIN_BYTES = 800, 20_000
GRAMS, BUCKET_BITS, SMOOTHING, SHARPNESS, LEAST_LEAD = (2, 3, 4), 15, 0.5, 6.0, 0.02
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = True


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: all distinct splits for up to 6 languages, else seeded random bits, 12 for each doubling."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        splits = [(1, *x) for x in product((1, -1), repeat=n - 1)][1:]
        return np.array(splits, dtype=float).T
    bits = np.random.default_rng(4).integers(0, 2, (n, 12 * int(np.ceil(np.log2(n))))) * 2.0 - 1
    return bits[:, np.abs(bits.sum(axis=0)) < n]


def features(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the n-grams inside a block's documents, for each n."""
    h = Hashes(b.bytes, LOWER_KEYS)
    doc = np.searchsorted(b.ends, np.arange(len(b.bytes)))
    for k, n in enumerate(GRAMS):
        bucket = (h.fixed(n) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (k << BUCKET_BITS)
        last = np.minimum(doc[: len(bucket)], len(b.ends) - 1)
        inside = np.arange(len(bucket)) + n <= b.ends[last]
        yield bucket[inside], last[inside]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    log_odds: np.ndarray  # bucket x bit
    bit_weights: np.ndarray

    def margins(self, b: Block) -> np.ndarray:
        """Mean log-odds of the n-grams of each document, for each bit."""
        n = b.last - b.first
        total, count = np.zeros((n, self.log_odds.shape[1])), np.zeros(n)
        for bucket, doc in features(b):
            count += np.bincount(doc, minlength=n)
            for bit in range(total.shape[1]):
                total[:, bit] += np.bincount(doc, weights=self.log_odds[:, bit][bucket], minlength=n)
        return total / np.maximum(count, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of the decoded weight, and its lead over the next."""
        agree = margins[:, None, :] * self.codes[None, :, :] * SHARPNESS
        loss = (np.logaddexp(0, -agree) * self.bit_weights).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ordered = np.sort(share, axis=1)
        return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)


def held_out():
    """Whether a row is held out: crc32 of doc_id as text, modulo 4, is 2; a null doc_id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(lang, text): about train_rows different labelled texts of each language whose rows aren't held out.

    Languages and their rows are counted over all of docs. Texts of at most
    train_bytes bytes are drawn by a hash of their own, so that null or repeated
    doc_ids change nothing, and each once; a language of which none is drawn is
    learned from its shortest text, whole.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", (F.octet_length("text") <= train_bytes).alias("short"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count_if("short").alias("n")).collect()}
    if not counts:
        return usable.select("lang", "text")
    share = F.create_map(*[x for k in sorted(counts) for x in (F.lit(k), F.lit(min(1.0, train_rows / max(1, counts[k]))))])[F.col("lang")]
    drawn = materialise(usable.where(F.col("short") & (F.xxhash64("text", F.lit(4)).cast("double") / 2.0**64 + 0.5 < share)).select("lang", "text").distinct())
    missing = sorted(set(counts) - {r["lang"] for r in drawn.select("lang").distinct().collect()})
    if missing:
        left = usable.where(F.col("lang").isin(missing)).groupBy("lang").agg(F.min_by("text", F.struct(F.octet_length("text"), "text")).alias("text"))
        drawn = drawn.unionByName(left)
    return drawn


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on sample(docs): what reaches the driver is bounded by languages * (train_rows * train_bytes + one text).

    A bit's weight is the log-odds of its accuracy on the half of the sample
    that its classifier wasn't fitted on; the final classifiers are fitted on
    both halves.
    """
    drawn = sample(docs, train_rows, train_bytes)
    rows = drawn.select("lang", F.col("text").cast("binary").alias("text")).toArrow().sort_by("lang")
    names = sorted(set(rows["lang"].to_pylist()))
    codes = codewords(len(names))
    n_bits, n_buckets = codes.shape[1], len(GRAMS) << BUCKET_BITS
    if not names:
        return Model([], codes, np.zeros((n_buckets, 1)), np.ones(1))
    langs = np.array([names.index(x) for x in rows["lang"].to_pylist()], dtype=np.int64)
    texts = rows["text"].to_pylist()
    # two folds by text, so that equal texts are in one
    fold = np.array([zlib.crc32(x) & 1 for x in texts], dtype=np.int64)
    folds = [[[texts[i] for i in np.flatnonzero(fold == f)], langs[fold == f]] for f in (0, 1)]
    counted = [_count(*x, len(names)) for x in folds]
    right = np.zeros(n_bits)
    for (fold_texts, fold_langs), others in zip(folds, counted[::-1]):
        model = Model(names, codes, _log_odds(others, codes), np.ones(n_bits))
        for b in blocks(fold_texts):
            right += (model.margins(b) * codes[fold_langs[b.first : b.last]] > 0).sum(axis=0)
    accuracy = np.maximum((right + 1) / (len(texts) + 2), 0.5)
    weights = np.log(accuracy / (1 - accuracy))
    weights = weights / weights.sum() * n_bits if weights.sum() > 0 else np.ones(n_bits)
    return Model(names, codes, _log_odds(sum(counted), codes), weights)


def _count(texts: list[bytes], langs: np.ndarray, n: int) -> np.ndarray:
    """N-grams by language and bucket."""
    counted = np.zeros((n, len(GRAMS) << BUCKET_BITS))
    for b in blocks(texts):
        for bucket, doc in features(b):
            np.add.at(counted, (langs[b.first : b.last][doc], bucket), 1)
    return counted


def _log_odds(counted: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log-odds of each bucket for each bit; every language counts alike, however many rows it has."""
    p = counted + SMOOTHING
    p /= p.sum(axis=1, keepdims=True)
    set_, clear = (codes > 0).astype(float), (codes < 0).astype(float)
    odds = np.log(np.maximum(set_.T @ p / np.maximum(set_.sum(0), 1)[:, None], 1e-12)) - np.log(
        np.maximum(clear.T @ p / np.maximum(clear.sum(0), 1)[:, None], 1e-12)
    )
    return np.ascontiguousarray((odds if len(codes) > 1 else np.ones_like(odds)).T)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def predict(docs: DataFrame, model: Model, least_lead: float = LEAST_LEAD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, lang_pred, score, ambiguous, and with keep
    also text and a struct ``row`` of the columns that keep names.

    A null text, or one without a letter of any script, is ``und`` with score 0,
    and so is every text if nothing could be learned. score is the best
    language's share of the decoded weight; ambiguous marks a lead below
    least_lead. Texts are read whole. Repeated rows each give a row, empty
    tables none; extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = as_bytes(batch.column(2))
            names, scores, flags = [], [], []
            for b in blocks(texts):
                letters = np.concatenate([[0], np.cumsum(LETTERS[b.bytes])])
                found = letters[b.ends] > letters[b.starts]
                best, share, lead = m.decode(m.margins(b)) if m.languages else (None, None, None)
                for i in range(b.last - b.first):
                    if best is None or not (found[i] or any(c.isalpha() for c in texts[b.first + i].decode("utf-8", "replace"))):
                        names.append("und"), scores.append(0.0), flags.append(False)
                    else:
                        names.append(m.languages[best[i]]), scores.append(float(share[i])), flags.append(bool(lead[i] < least_lead))
            schema = pa.schema([*SCHEMA, *list(batch.schema)[2:]]) if keep else SCHEMA
            kept = batch.columns[2:] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_()), *kept], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", *([F.struct(*keep).alias("row")] if keep else []))
    also = f", text string, row {rows.schema['row'].dataType.simpleString()}" if keep else ""
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean" + also)


def identify(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Train on docs (doc_id, text, lang) and predict all of them."""
    return predict(docs, train(docs), keep=keep)
