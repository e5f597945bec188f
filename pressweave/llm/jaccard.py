"""Operator 1: n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed shingles of w words under one global order: by
the number of documents that have a shingle, then by its hash. Two sets of
similarity p share at least l shingles of their prefixes, of n - ceil(p n) + l
shingles each. Every document starts with l = 1; where the lists of its prefix
name many possible partners, its prefix is lengthened and as many more shared
shingles are asked for before a pair is verified.

Shingles of one document only come first in the order and have no partner, so
only the others of a prefix are posted. Equal sets are one class from the
start. Neighbours in the prefix lists are verified first and joined; after
that only pairs of different components are looked at, so that a group of n
near copies never becomes n * n pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, LOWER_KEYS, Block, Hashes, as_bytes, blocks, mix, runs
from .common import discard, materialise
from .components import components
from .packs import PART_BYTES, TOKEN_BITS, Batch, codes, frequencies, pack, total_bytes, unpacked

#: Operator 1's words of a shingle and percent of shared shingles that links; longest match count; partners above which l goes to 2, 3 and 4.
WORDS, PERCENT, MOST_MATCHES, COSTS = 3, 90, 4, (16, 64, 256)
#: Words of 64 parity bits of a set; rows of a list before a row among which its neighbour is chosen; posted shingles of a document before one
#: that a row of the second look carries, so that a pair is told by the first lists that it shares and not by all of them.
PARITY_WORDS, LOOK_BACK, CONTEXT = 8, 16, 8
UNSIGNED_SHIFT = np.uint64(64 - TOKEN_BITS)


def shingles(b: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the distinct n-word shingles of a block's documents, in order of both."""
    start, end, doc = b.words()
    w = Hashes(b.bytes, LOWER_KEYS).of(start, end)
    size = np.bincount(doc, minlength=b.last - b.first)
    parts, owners = [], []
    if len(w) >= n:
        key = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            key = mix(key * np.uint64(3) + w[i : len(w) - n + 1 + i])
        whole = doc[: len(key)] == doc[n - 1 :]
        parts.append(key[whole]), owners.append(doc[: len(key)][whole])
    # shorter documents: the whole sequence as one shingle
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    for d in np.flatnonzero((size > 0) & (size < n)):
        key = np.full(1, size[d], dtype=np.uint64)
        for x in w[first[d] : first[d] + size[d]]:
            key = mix(key * np.uint64(3) + x)
        parts.append(key), owners.append(np.array([d]))
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], g[new]


def _sums(values: np.ndarray, owner: np.ndarray, n: int, how=np.add) -> np.ndarray:
    out = np.zeros(n, dtype=values.dtype)
    at = runs(owner)[:-1] if len(owner) else np.zeros(0, dtype=np.int64)
    if len(at):
        out[owner[at]] = how.reduceat(values, at)
    return out


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent % of n)."""
    return -(-percent * n // 100)


def _tokens_of(words: int, batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """A batch's distinct shingles as tokens, and how many of its documents have each."""
    return np.unique(np.concatenate([shingles(b, words)[1] >> UNSIGNED_SHIFT for b in batch.blocks()]), return_counts=True)


PREFIXES = "batch long, doc_id long, n long, h1 long, h2 long, parity binary, tokens array<long>, places array<int>, packed binary"


def _prefixes(words: int, percent: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document: set size n, 128 bits of set hash and PARITY_WORDS of parity bits, those prefix shingles for MOST_MATCHES that
    other documents have, with their places in the global order, and, if there are any, the compressed text."""
    pack_text = zstandard.ZstdCompressor(level=3).compress
    for rows in batches:
        for r, batch in enumerate(unpacked(rows)):
            k, found = len(batch.ends), [(owner + b.first, g) for b in batch.blocks() for owner, g in [shingles(b, words)]]
            owner, g = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            token = g >> UNSIGNED_SHIFT
            every, of = np.unique(token, return_inverse=True)
            often = codes(every, rows.column(4)[r].as_py(), parts)[of]
            n = np.bincount(owner, minlength=k)
            sums = [_sums(mix(g), owner, k), _sums(mix(g ^ np.uint64(0x5851F42D4C957F2D)), owner, k)]
            # how often each parity bit is hit, to its last bit
            hit = np.bincount(owner * 64 * PARITY_WORDS + (g & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=k * 64 * PARITY_WORDS) & 1
            parity = np.packbits(hit.astype(np.uint8).reshape(k, -1), axis=1).tobytes()
            parity = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * PARITY_WORDS), k, [None, pa.py_buffer(parity)]).cast(pa.binary())
            # only shingles of several documents need an order of their own: those of one document stand before them
            kept = np.flatnonzero(often > 1)
            kept = kept[np.lexsort((g[kept], often[kept], owner[kept]))]
            who = owner[kept]
            shared = np.bincount(who, minlength=k)
            place = np.arange(len(kept)) - (np.cumsum(shared) - shared)[who] + (n - shared)[who]
            inside = place < (n - _least(n, percent) + MOST_MATCHES)[who]
            kept, who, place = kept[inside], who[inside], place[inside]
            count = np.bincount(who, minlength=k)
            at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
            texts = [pack_text(batch.data[x:y]) if c else None for x, y, c in zip(batch.starts.tolist(), batch.ends.tolist(), count.tolist())]
            values = [pa.array(np.full(k, batch.batch)), batch.ids, _long(n), *map(_long, sums), parity, pa.ListArray.from_arrays(at, _long(g[kept])), pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32))), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in PREFIXES.split(", ")])


def _set_sizes(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n of each text."""
    for batch in batches:
        for b in blocks(as_bytes(batch.column(0))):
            yield pa.RecordBatch.from_arrays([_long(np.bincount(shingles(b, words)[0], minlength=b.last - b.first))], names=["n"])


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole lists (runs of one token) of sorted batches, several at a time, without lists of one row."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            rest.append(batch)
            token = np.asarray(batch.column(0))
            if token[0] == token[-1]:
                continue
            cut = int(np.flatnonzero(token != token[-1])[-1]) + 1
            ready, rest = [*rest[:-1], batch.slice(0, cut)], [batch.slice(cut)]
        else:
            ready = rest
        if not ready:
            continue
        table = pa.Table.from_batches(ready)
        found = {c: np.asarray(table[c]) for c in columns if c not in ("parity", "context")}
        found["parity"] = np.frombuffer(b"".join(table["parity"].to_pylist()), dtype=np.uint64).reshape(-1, PARITY_WORDS)
        if "context" in columns:
            found["context"] = np.asarray(table["context"].combine_chunks().flatten()).reshape(-1, CONTEXT)
        at = runs(found["token"])
        many = np.repeat(np.diff(at) > 1, np.diff(at))
        if many.any():
            yield {c: x[many] for c, x in found.items()}


def _may_link(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether sizes, parity bits and places allow a link (never wrongly no), and the parity distance.

    Behind a shared shingle both sets share no more than the shorter rest holds;
    before it nothing, if it is the first one shared, else what stands there.
    """
    n, m = x["n"][i], x["n"][j]
    apart = sum(np.bitwise_count(x["parity"][i, k] ^ x["parity"][j, k]).astype(np.int64) for k in range(PARITY_WORDS))
    need = -(-percent * (n + m) // (100 + percent))
    p, q = x["place"][i].astype(np.int64), x["place"][j].astype(np.int64)
    most = np.where(first, 0, np.minimum(p, q)) + 1 + np.minimum(n - p - 1, m - q - 1)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= n + m - 2 * need) & (most >= need), apart


def _spans(start: np.ndarray, stop: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of each row i with the rows j of [start, stop), in chunks."""
    count = np.maximum(0, stop - start)
    total, n, a = np.cumsum(count), len(count), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        c = count[a:b]
        i = np.repeat(np.arange(a, b), c)
        if len(i):
            yield i, np.repeat(start[a:b] - np.cumsum(c) + c, c) + np.arange(len(i))
        a = b


def _window(x: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's list, and the first and the end of the rows of its list whose sizes allow a link; lists are in order of size."""
    at = runs(x["token"])
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bound = 2**31 - 1
    key = of.astype(np.float64) * 2.0**31
    sizes = key + np.minimum(x["n"], bound)
    first = np.searchsorted(sizes, key + np.minimum(_least(x["n"], percent), bound), side="left")
    return of, first, np.searchsorted(sizes, key + np.minimum(x["n"] * 100 // percent, bound), side="right")


def _common(context: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many shingles the contexts of rows i and j have in common; 0 stands for none."""
    common = np.zeros(len(i), dtype=np.int64)
    for k in range(context.shape[1]):
        one = context[i, k]
        common += (one != 0) & (one[:, None] == context[j]).any(axis=1)
    return common


COLUMNS = ["token", "doc_id", "n", "place", "parity", "component"]


def _first_look(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, partners, near, apart): for each row of a list with possible partners, how many its size allows, and the closest of another component among the few rows before it."""
    for x in _lists(batches, COLUMNS):
        _, first, end = _window(x, percent)
        partners = end - first - 1
        near, close = np.full(len(partners), -1), np.full(len(partners), 1 << 20)
        for back in range(1, min(LOOK_BACK, len(partners) - 1) + 1):
            j = np.arange(back, len(partners))
            i = j - back
            ok, apart = _may_link(x, i, j, percent, np.array(False))
            ok &= (x["token"][i] == x["token"][j]) & (apart < close[j]) & (x["component"][i] != x["component"][j])
            close[j[ok]], near[j[ok]] = apart[ok], x["doc_id"][i[ok]]
        some = partners > 0
        yield pa.RecordBatch.from_arrays([_long(v[some]) for v in (x["doc_id"], partners, near, close)], names=["doc_id", "partners", "near", "apart"])


def _second_look(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, asked): pairs of a list that may link and lie in different components, with how many lists they must share.

    A list leaves out a pair of whose lists before it as many as asked for are known: of these lists, the first ones give it.
    """
    for x in _lists(batches, [*COLUMNS, "matches", "context"]):
        of, _, end = _window(x, percent)
        later = end - np.arange(len(of)) - 1
        # lists of few components: all pairs of different ones; else all pairs that sizes allow
        order = np.lexsort((x["component"], of))
        edge = runs(of[order] + np.where(np.concatenate([[False], x["component"][order][1:] != x["component"][order][:-1]]), 0.5, 0).cumsum())
        beyond = np.repeat(edge[1:], np.diff(edge))
        list_end = np.repeat(np.cumsum(np.bincount(of)), np.bincount(of))
        fewer = np.bincount(of, weights=list_end - beyond) < np.bincount(of, weights=later)
        rows = np.arange(len(of))
        plans = [(rows, np.where(fewer[of], 0, rows + 1), np.where(fewer[of], 0, end)), (order, np.where(fewer[of], beyond, 0), np.where(fewer[of], list_end, 0))]
        for at, start, stop in plans:
            for i, j in _spans(start, stop):
                i, j = at[i], at[j]
                other = x["component"][i] != x["component"][j]
                i, j = i[other], j[other]
                asked = np.minimum(x["matches"][i], x["matches"][j])
                ok, _ = _may_link(x, i, j, percent, asked == 1)
                i, j, asked = i[ok], j[ok], asked[ok]
                new = _common(x["context"], i, j) < asked
                i, j, asked = i[new], j[new], asked[new]
                a, b = np.minimum(x["doc_id"][i], x["doc_id"][j]), np.maximum(x["doc_id"][i], x["doc_id"][j])
                yield pa.RecordBatch.from_arrays([_long(v) for v in (a, b, asked)], names=["a", "b", "asked"])


def _similar(words: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, packed_a, packed_b) whose sets' similarity reaches the threshold."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        first = 0
        while first < len(a):
            texts, size, last = [], 0, first
            while last < len(a) and (last == first or size < BLOCK_BYTES):
                two = [unpack(batch.column(c)[last].as_py()) for c in (2, 3)]
                texts += two
                size, last = size + len(two[0]) + len(two[1]), last + 1
            owner, g = shingles(Block(0, texts), words)
            n = np.bincount(owner, minlength=len(texts))
            pair = owner // 2
            order = np.lexsort((g, pair))
            g, pair = g[order], pair[order]
            shared = np.bincount(pair[1:][(g[1:] == g[:-1]) & (pair[1:] == pair[:-1])], minlength=last - first)
            close = 100 * shared >= percent * (n[0::2] + n[1::2] - shared)
            yield pa.RecordBatch.from_arrays([_long(a[first:last][close]), _long(b[first:last][close])], names=["a", "b"])
            first = last


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' similarity reaches the threshold."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("packed_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("packed_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "packed_a", "packed_b").mapInArrow(partial(_similar, words, percent), "a long, b long")


def _look(rows: DataFrame, fn, schema: str) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token", "n", "doc_id").mapInArrow(fn, schema)


def _with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _neighbours(lists: DataFrame, percent: int) -> DataFrame:
    """(doc_id, partners, near): over all lists of a document, its possible partners and its closest neighbour of another component."""
    looked = _look(lists.select(COLUMNS), partial(_first_look, percent), "doc_id long, partners long, near long, apart long")
    closest = F.min(F.when(F.col("near") >= 0, F.struct("apart", "near")))["near"]
    return materialise(looked.groupBy("doc_id").agg(F.sum("partners").alias("partners"), closest.alias("near")))


def _near_links(seen: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    near = seen.where("near IS NOT NULL").select(F.least("doc_id", "near").alias("a"), F.greatest("doc_id", "near").alias("b")).distinct()
    return materialise(_verified(near, texts, words, percent))


def _linked(packed: DataFrame, words: int, percent: int, part_bytes: int) -> DataFrame:
    """(batch, doc_id, n_shingles, component_id) of the documents of a packed table."""
    parts = max(1, total_bytes(packed) // part_bytes)
    told = packed.join(frequencies(packed, partial(_tokens_of, words), parts), "batch", "left").select("batch", "ids", "sizes", "texts", "parts")
    prefixes = materialise(told.mapInArrow(partial(_prefixes, words, percent, parts), PREFIXES))
    signed = prefixes.select("batch", "doc_id", "n", "h1", "h2")
    classes = materialise(signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    firsts = classes.select(F.col("first").alias("doc_id"))
    # one row for each class that shares a prefix shingle with any document
    posting = materialise(prefixes.where("packed IS NOT NULL").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]).drop("batch", "h1", "h2"))
    base = F.col("n") - F.ceil(F.col("n") * percent / 100)
    lists = posting.select("doc_id", "n", "parity", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select(F.col("x.tokens").alias("token"), "doc_id", "n", F.col("x.places").alias("place"), "parity")
    before = F.concat(F.array_repeat(F.lit(0).cast("long"), CONTEXT), "tokens")
    contexts = F.transform("tokens", lambda token, k: F.struct(token.alias("token"), F.get("places", k).alias("place"), F.slice(before, k + 1, F.lit(CONTEXT)).alias("context")))
    with_context = posting.select("doc_id", "n", "parity", F.explode(contexts).alias("x")).select("x.token", "doc_id", "n", "x.place", "parity", "x.context")
    seen = _neighbours(lists.where(F.col("place") < base + 1).withColumn("component", F.col("doc_id")), percent)
    links = _near_links(seen, posting, words, percent)
    joined = components(links)
    # once more, between components, so that hardly any pair of one group is left for the second look
    again = _neighbours(_with_component(lists.where(F.col("place") < base + 1), joined), percent)
    links = links.union(_near_links(again, posting, words, percent))
    joined = components(links)
    matches = F.lit(1) + sum((F.col("partners") > c).cast("int") for c in COSTS)
    open_ = (
        _with_component(with_context.join(seen.select("doc_id", "partners"), "doc_id"), joined)
        .withColumn("matches", F.least(matches, F.ceil(F.col("n") * percent / 100)).cast("long"))
        .where(F.col("place") < base + F.col("matches"))
    )
    pairs = (
        _look(open_.select(*COLUMNS, "matches", "context"), partial(_second_look, percent), "a long, b long, asked long")
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.first("asked").alias("asked"))
        .where("shared >= asked")
        .select("a", "b")
    )
    more = materialise(_verified(pairs, posting, words, percent))
    found = joined if more.isEmpty() else components(links.union(more))
    for table in (posting, seen, again, more):
        discard(table)
    of_class = classes.join(found, F.col("first") == F.col("node"), "left").where("component IS NOT NULL OR first < last")
    of_class = of_class.select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("component", "first").alias("component"))
    same = (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2"))
    return signed.join(of_class, same, "left").select("batch", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Sets of shingles of so many words link where they share percent of their
    union or more; a text of fewer words is one shingle. Null texts and texts without words have no shingles, link with nothing and
    are their own component. Rows that repeat a doc_id should repeat its text;
    each gives a row. Rows of null doc_id keep a null component. Empty tables
    give no rows; extra columns are ignored. Shingles are compared by 64-bit
    hashes, whole sets by their size and 128 bits.
    """
    packed = pack(docs.where("doc_id IS NOT NULL"))
    out = _linked(packed, words, percent, part_bytes).drop("batch")
    discard(packed)
    nameless, none = docs.where("doc_id IS NULL").select("text"), F.lit(None).cast("long")
    return out.union(nameless.mapInArrow(partial(_set_sizes, words), "n long").select(none, F.col("n"), none)) if not nameless.isEmpty() else out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each batch but those listed: doc_id, text and row."""
    for rows in batches:
        for r, batch in enumerate(unpacked(rows)):
            keep = ~np.isin(np.asarray(batch.ids), rows.column(4)[r].as_py() or [])
            texts = pa.array([t.decode() for t, k in zip(batch.texts(), keep) if k], pa.string())
            yield pa.RecordBatch.from_arrays([batch.ids.filter(pa.array(keep)), texts, rows.column(5)[r].values.filter(pa.array(keep))], names=["doc_id", "text", "row"])


def first_of_each(docs: DataFrame, words: int, percent: int, keep: tuple[str, ...], part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text (null as empty) and a struct ``row`` of the columns that keep names, of the document of smallest doc_id in each component of link().

    doc_id must tell all rows apart; rows of null doc_id are left out. Texts travel in packed batches; only the identifiers of documents that go are sent to them.
    """
    packed = pack(docs.where("doc_id IS NOT NULL"), keep)
    linked = _linked(packed, words, percent, part_bytes)
    gone = linked.where(F.col("component_id") != F.col("doc_id")).groupBy("batch").agg(F.collect_list("doc_id").alias("gone"))
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("row", packed.schema["rows"].dataType.elementType)
    return packed.join(gone, "batch", "left").select("batch", "ids", "sizes", "texts", "gone", "rows").mapInArrow(_without, schema)
