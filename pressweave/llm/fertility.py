"""Operator 2: quality rules from tokeniser fertility.

A public piece vocabulary measures every text: characters per token, share of
tokens that are single bytes, and the entropy of its tokens. Texts outside the
band of their language (or, without one, of their main script) are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER_KEYS, SPACE, BYTE_KEYS, Block, Hashes, as_bytes, blocks, mix, runs
from .common import bounded_batches
from .pieces import process_pieces, vocabulary

#: Bands of languages and scripts: least and most characters per
#: token, most share of byte tokens, least entropy as a share of log2(tokens).
BANDS = {
    "en": (1.9, 6.5, 0.10, 0.45),
    "de": (1.9, 6.0, 0.10, 0.45),
    "es": (1.9, 6.0, 0.10, 0.45),
    "fr": (1.7, 6.0, 0.10, 0.45),
    "latin": (1.2, 6.5, 0.20, 0.40),
    "cyrillic": (1.0, 5.0, 0.25, 0.40),
    "other": (0.3, 6.5, 0.95, 0.30),
}
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LEAST_WORDS, WINDOW = 20, 8


def base_counts(b: Block) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a block's documents, one row each."""
    n = b.last - b.first
    start, end, doc = b.words()
    out = np.zeros((n, 5), dtype=np.int64)
    out[:, 0] = np.bincount(doc, minlength=n)
    # code points: bytes that don't continue one
    points = np.concatenate([[0], np.cumsum((b.bytes & 0xC0) != 0x80)])
    out[:, 1] = np.bincount(doc, weights=points[end] - points[start], minlength=n)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[b.bytes])])
    out[:, 2] = symbols[b.ends] - symbols[b.starts]
    h = Hashes(b.bytes, BYTE_KEYS)
    # lines end at newlines; the block has one after each document
    line_end = np.flatnonzero(b.bytes == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    filled = np.concatenate([[0], np.cumsum(~SPACE[b.bytes])])
    with_word = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = np.searchsorted(b.ends, line_start, side="right")
    key = mix(h.of(line_start, line_end) + line_doc.astype(np.uint64))
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[at] = False
    out[:, 3] = np.bincount(line_doc[again], minlength=n)
    if len(doc) >= WINDOW:
        w = h.of(start, end)
        key = doc[: 1 - WINDOW].astype(np.uint64)
        for i in range(WINDOW):
            key = mix(key + w[i : len(w) - WINDOW + 1 + i])
        whole = np.flatnonzero(doc[: 1 - WINDOW] == doc[WINDOW - 1 :])
        order = np.argsort(key[whole], kind="stable")
        edges = runs(key[whole][order])
        repeated = np.repeat(np.diff(edges) > 1, np.diff(edges))
        at = whole[order][repeated]
        cover = np.zeros(len(doc) + 1, dtype=np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        out[:, 4] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return out


def entropy_share(ids: np.ndarray) -> float:
    """Entropy of the tokens in bits over that of as many different ones; 1 for fewer than two tokens."""
    if len(ids) < 2:
        return 1.0
    ids = np.sort(ids)
    p = np.diff(runs(ids)) / len(ids)
    return float(-(p * np.log2(p)).sum() / np.log2(len(ids)))


def band_of(lang: str | None, text: str) -> str:
    """The language if it has a band, else the script of most letters among the first of each script's ranges."""
    if lang in BANDS:
        return lang
    letters = [c for c in text if c.isalpha()]
    if not letters:
        return "other"
    latin = sum(c < "ɐ" for c in letters)
    cyrillic = sum("Ѐ" <= c < "԰" for c in letters)
    return "latin" if 2 * latin >= len(letters) else "cyrillic" if 2 * cyrillic >= len(letters) else "other"


SCHEMA = pa.schema(
    [(x, pa.int64()) for x in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("band", pa.string()), ("n_tokens", pa.int64())]
    + [(x, pa.float64()) for x in ("chars_per_token", "byte_share", "entropy_share")]
)
SQL_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, band string, n_tokens long, chars_per_token double, byte_share double, entropy_share double"


def quality(docs: DataFrame, model_path: str, bands: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text and, if there is one, lang) with the base counts and the verdict.

    base_failed: fewer than 20 words, or over 30 % of words in 8-word windows
    that the text has twice or more. Null and empty texts have no words, so
    they fail; their ratios are 0 and their entropy share 1. Texts are measured
    whole. Repeated rows each give a row, empty tables none; extra columns are
    ignored. No row depends on another.
    """
    bounded_batches(docs.sparkSession)
    bands = BANDS if bands is None else bands
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = process_pieces(shared.value)
        for batch in batches:
            ids, langs, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(1))
            for b in blocks(texts):
                counts = base_counts(b)
                rows = []
                for i, (n_words, chars, symbols, lines, repeat) in enumerate(counts.tolist(), b.first):
                    text = texts[i].decode("utf-8", "replace")
                    parts = p.encode_parts(text)
                    tokens = np.frombuffer(b"".join([x[0] for x in parts]), dtype="<u4")
                    n = len(tokens)
                    name = band_of(langs[i], text)
                    least, most, bytes_most, entropy_least = bands[name]
                    per = len(text) / n if n else 0.0
                    # newlines and tabs have no pieces of their own and aren't held against a text
                    plain = text.count("\n") + text.count("\t") + text.count("\r")
                    share = max(0, sum([x[2] for x in parts]) - plain) / n if n else 0.0
                    entropy = entropy_share(tokens)
                    failed = n_words < LEAST_WORDS or 100 * repeat > 30 * n_words
                    ok = not failed and least <= per <= most and share <= bytes_most and entropy >= entropy_least
                    rows.append((ids[i], n_words, chars, symbols, lines, repeat, failed, ok, name, n, per, share, entropy))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, SQL_SCHEMA)
