"""Operator 3: removal of repeated substrings with suffix arrays.

A byte goes if a SIZE-byte string that covers it also starts in a document of
smaller doc_id. Three steps share the work out:

1. Texts are packed in batches. Every SIZE-byte string is named by the smallest
   hash of the K-byte strings in it, so equal ones have equal names. Batches
   learn how many documents have each of their names.
2. Runs of strings whose name two documents have travel as fragments to the
   group of their name; of equal fragments a batch sends one, with the smallest
   doc_id, and the places of that document. Names only deal the work out.
3. In a group, a two-stage suffix array puts equal strings of all fragments
   side by side: only suffixes smaller than their successors are sorted, the
   others are induced by bucket scans. Common prefixes of neighbours give the
   sets of equal strings and each set's smallest doc_id, and with it what goes.

Each batch then gets the removed ranges of its own texts back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Block, Hashes, mix, runs
from .packs import PART_BYTES, TOKEN_BITS, Batch, codes, compressed, decompressed, frequencies, pack, total_bytes, unpacked

SIZE, K, GROUP_BYTES = 50, 16, 4 << 20


def suffix_array(text: np.ndarray, depth: int = SIZE, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of a byte array in the order of their suffixes' first depth bytes (shorter first), by two-stage sorting.

    wanted marks the positions to be ordered; those they are induced from come along.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # a suffix is smaller than its successor if its next different byte is larger
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = np.concatenate([text[change + 1] > text[change], [False]])
    small = np.repeat(rises, np.diff(change, prepend=-1, append=n - 1))
    if wanted is None:
        needed = np.ones(n, dtype=bool)
    else:
        # a larger suffix is induced from its successor, and so on up to a smaller one or the end
        place = np.arange(n, dtype=np.int32)
        last = np.maximum.accumulate(np.where(wanted, place, np.int32(-1)))
        since = np.maximum.accumulate(np.where(small, place, np.int32(-1)))
        needed = last >= 0
        needed[1:] &= since[:-1] < last[1:]
        needed |= wanted
        del place, last, since
    direct = np.flatnonzero(small & needed)
    if len(direct):
        direct = _sorted(direct, _words(text, depth), depth)
    edges = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(ranked: np.ndarray, c: int) -> None:
        """Hand the predecessors of a sorted bucket on to the larger buckets they start with."""
        before = ranked[ranked > 0] - 1
        first = text[before]
        up = (first > c) & needed[before]
        before, first = before[up], first[up]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        at = runs(first)
        for a, b in zip(at[:-1], at[1:]):
            waiting[first[a]].append(before[a:b])

    induce(np.array([n]), -1)
    for c in range(256):
        larger = [np.concatenate(waiting[c])] if waiting[c] else []
        while larger and len(larger[-1]):
            before = larger[-1][larger[-1] > 0] - 1
            larger.append(before[(text[before] == c) & needed[before]])
        bucket = np.concatenate([*larger, direct[edges[c] : edges[c + 1]]])
        if len(bucket):
            bucket = bucket.astype(np.int64)
            out.append(bucket)
            induce(bucket, c)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    w = np.zeros(len(text) + depth, dtype=np.uint64)
    for i in range(8):
        w <<= np.uint64(8)
        w |= padded[i : i + len(w)]
    return w


def _offsets(depth: int) -> list[int]:
    """Where the words of depth bytes start; the last may overlap the one before."""
    return [*range(0, depth - 8, 8), depth - 8]


def _sorted(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their depth bytes: by the first word, then ties alone by the next ones."""
    at = at[np.argsort(w[at])]
    new = np.ones(len(at), dtype=bool)
    new[1:] = w[at[1:]] != w[at[:-1]]
    for offset in _offsets(depth)[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        i = np.flatnonzero(tied)
        if not len(i):
            break
        some, group = at[i], np.cumsum(new)[i]
        key = w[some + offset]
        order = np.lexsort((key, group))
        at[i], key = some[order], key[order]
        # groups keep their places; only ties between equal words stay
        new[i[1:]] |= key[1:] != key[:-1]
    return at


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int = SIZE) -> np.ndarray:
    """Length of the prefix that each suffix of an array shares with the one before it, up to depth; 0 for the first."""
    w, out, open_ = _words(text, depth), np.zeros(len(sa), dtype=np.int64), np.arange(1, len(sa))
    for offset in _offsets(depth):
        differ = w[sa[open_] + offset] ^ w[sa[open_ - 1] + offset]
        # leading zero bytes of the difference; frexp gives the bits in use of a number below 2**53
        high = differ >> np.uint64(32)
        part = np.where(high > 0, high, differ).astype(np.float64)
        bits = np.frexp(part)[1] + np.where(high > 0, 32, 0)
        out[open_] = np.where(differ == 0, offset + 8, np.maximum(out[open_], offset + (64 - bits) // 8))
        open_ = open_[differ == 0]
    return out


def repeated(fragments: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fragment, start, end) of the runs of fragments' strings that also start in a fragment of a smaller document."""
    text = np.frombuffer(b"\0".join(fragments) + b"\0", dtype=np.uint8)
    sizes = np.array([len(f) for f in fragments], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    first = ends - sizes
    room = np.repeat(ends.astype(np.int32), sizes + 1) - np.arange(len(text), dtype=np.int32)
    sa = suffix_array(text, SIZE, room >= SIZE)
    sa = sa[room[sa] >= SIZE]
    if not len(sa):
        return sa, sa, sa
    owner = np.searchsorted(ends, sa)
    groups = np.flatnonzero(common_prefixes(text, sa) < SIZE)
    doc = docs[owner]
    least = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, len(sa))))
    gone = least < doc
    if not gone.any():
        return sa[:0], sa[:0], sa[:0]
    at, who = sa[gone], owner[gone]
    order = np.argsort(at)
    at, who = at[order], who[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (who[1:] != who[:-1])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    return who[a], (at - first[who])[a], (at - first[who])[b] + SIZE


def window_names(b: Block, h: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a SIZE-byte string inside a document of the block: the start and the string's name."""
    low = h.fixed(K)
    span, width = SIZE - K + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:]) if len(low) > width else low[:0]
        width *= 2
    if span > width:
        rest = span - width
        low = np.minimum(low[:-rest], low[rest:]) if len(low) > rest else low[:0]
    at = np.arange(len(low))
    doc = np.searchsorted(b.ends, at)
    inside = at + SIZE <= b.ends[np.minimum(doc, len(b.ends) - 1)]
    return at[inside], low[inside]


def _runs(batch: Batch) -> Iterator[tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a batch: first and last start of the runs of neighbouring strings of one name in one document, the name as a token, and the document's place in the batch."""
    for b in batch.blocks():
        at, name = window_names(b, Hashes(b.bytes))
        doc = np.searchsorted(b.ends, at)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(at)) - 1 if len(a) else a
        # scrambled once more: the smallest of many hashes are small
        yield b, at[a], at[z], mix(name[a] ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - TOKEN_BITS), doc[a] + b.first


def _names(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names, sorted, and the number of documents of each; documents come in rising order."""
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = token[1:] != token[:-1]
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    a = np.flatnonzero(new)
    return token[a], np.add.reduceat(other.astype(np.int64), a) if len(a) else a


def _names_of(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    found = [(token, doc) for _, _, _, token, doc in _runs(batch)]
    return _names(np.concatenate([t for t, _ in found]), np.concatenate([d for _, d in found]))


FRAGMENTS = ["bucket", "batch", "sizes", "docs", "bytes", "holders", "places"]


def _fragments(parts: int, groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a batch has fragments for: the distinct fragments with their smallest document, and that document's places in the batch.

    Copies in larger documents of the batch go at once; their ranges pass through the group of bucket -1 - (batch modulo groups).
    """
    for rows in batches:
        for k, batch in enumerate(unpacked(rows)):
            found = list(_runs(batch))
            names = np.unique(np.concatenate([x[3] for x in found]))
            often = codes(names, rows.column(4)[k].as_py(), parts) > 1
            ids = np.asarray(batch.ids)
            fragments, place, doc, token = [], [], [], []
            for b, a, z, t, d in found:
                kept = often[np.searchsorted(names, t)]
                a, size, d = a[kept], (z - a)[kept] + SIZE, d[kept]
                ends = np.cumsum(size)
                text = b.bytes[np.repeat((a - ends + size).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)]
                fragments.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(text)]))
                place.append(a - b.starts[d - b.first] + batch.starts[d]), doc.append(ids[d]), token.append(t[kept])
            of = pa.concat_arrays(fragments).dictionary_encode()
            code, place, doc, token = np.asarray(of.indices), np.concatenate(place), np.concatenate(doc), np.concatenate(token)
            if not len(code):
                continue
            least = np.full(len(of.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(least, code, doc)
            bucket = np.zeros(len(least), dtype=np.int64)
            bucket[code] = (token % np.uint64(groups)).astype(np.int64)
            values, lengths = of.dictionary, np.diff(np.frombuffer(of.dictionary.buffers()[1], dtype=np.int32, count=len(least) + 1))
            first = doc == least[code]
            order = np.argsort(bucket, kind="stable")
            number = np.empty(len(order), dtype=np.int64)
            held_order = np.argsort(bucket[code[first]], kind="stable")
            held, held_place = code[first][held_order], place[first][held_order]
            at, held_at = runs(bucket[order]), runs(bucket[held])
            out = [[] for _ in FRAGMENTS]
            for x, y, u, v in zip(at[:-1], at[1:], held_at[:-1], held_at[1:]):
                mine = order[x:y]
                number[mine] = np.arange(len(mine))
                text = b"".join(values.take(pa.array(mine)).to_pylist())
                row = bucket[mine[0]], batch.batch, compressed(lengths[mine]), compressed(least[mine]), compressed(np.frombuffer(text, dtype=np.uint8)), compressed(number[held[u:v]].astype(np.int32)), compressed(held_place[u:v].astype(np.int64))
                for column, value in zip(out, row):
                    column.append(value)
            if not first.all():
                copies = place[~first], lengths[code[~first]]
                for column, value in zip(out, (-1 - batch.batch % groups, batch.batch, None, None, None, None, compressed(np.stack([copies[0], copies[0] + copies[1]])))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, [pa.int64(), pa.int64(), *[pa.binary()] * 5])], names=FRAGMENTS)


def _settle(group: pa.Table) -> pa.Table:
    """(batch, ranges) of the strings of a group's fragments that go."""
    if group["bucket"][0].as_py() < 0:
        return pa.table({"batch": group["batch"], "ranges": group["places"]})
    sizes = [decompressed(x, np.int32) for x in group["sizes"].to_pylist()]
    docs = np.concatenate([decompressed(x, np.int64) for x in group["docs"].to_pylist()])
    text = np.concatenate([decompressed(x, np.uint8) for x in group["bytes"].to_pylist()])
    length = np.concatenate(sizes).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(length)])
    of = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
    code = np.asarray(of.indices)
    least = np.full(len(of.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, code, docs)
    # the array holds each distinct fragment once, for the smallest of its documents; in the others all its strings are repeated
    who, start, end = repeated(of.dictionary.to_pylist(), least)
    edges = np.searchsorted(who, np.arange(len(least) + 1))
    out, base = [], 0
    for n, holders, places in zip(map(len, sizes), group["holders"].to_pylist(), group["places"].to_pylist()):
        mine = decompressed(holders, np.int32) + base
        place, c = decompressed(places, np.int64), code[mine]
        whole = docs[mine] > least[c]
        count = np.where(whole, 0, edges[c + 1] - edges[c])
        k = np.repeat(edges[c] - np.cumsum(count) + count, count) + np.arange(count.sum())
        at = np.repeat(place, count)
        a, b = np.concatenate([place[whole], at + start[k]]), np.concatenate([(place + length[mine])[whole], at + end[k]])
        out.append(compressed(np.stack([a, b])) if len(a) else None)
        base += n
    some = pa.array([x is not None for x in out])
    return pa.table({"batch": group["batch"].combine_chunks().filter(some), "ranges": pa.array([x for x in out if x is not None], pa.binary())})


def _finish(keep_text: bool, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for k, batch in enumerate(unpacked(rows)):
            a, b = np.concatenate([np.zeros((2, 0), dtype=np.int64), *(decompressed(x, np.int64).reshape(2, -1) for x in rows.column(4)[k].as_py() or ())], axis=1)
            # narrow arrays and no running sums besides one: a batch's bytes stand in memory a few times only
            edge = np.zeros(len(batch.data) + 1, dtype=np.int32)
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
            gone = np.cumsum(edge, out=edge)[:-1] > 0
            at, size = np.flatnonzero(gone), batch.ends - batch.starts
            removed = np.searchsorted(at, batch.ends) - np.searchsorted(at, batch.starts)
            begins = np.ones(len(at), dtype=bool)
            begins[1:] = at[1:] != at[:-1] + 1
            # a run also begins where a document does
            own = np.searchsorted(at, batch.starts)
            begins[own[own < len(at)]] = True
            rises = at[begins]
            spans = np.searchsorted(rises, batch.ends) - np.searchsorted(rises, batch.starts)
            data = np.frombuffer(batch.data, dtype=np.uint8)[~gone].tobytes()
            ends = np.cumsum(size - removed)
            rest = [data[a:b] for a, b in zip((ends - size + removed).tolist(), ends.tolist())]
            columns = [batch.ids, *(pa.array(x, pa.int64()) for x in (size, removed, spans))]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string()), pa.array([x.decode("utf-8", "ignore") if keep_text else None for x in rest], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([*columns, *([rows.column(5)[k].values] if keep else [])], names=[*names, *(["row"] if keep else [])])


def deduplicate(docs: DataFrame, keep_text: bool = False, keep: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, with keep_text kept_text, and with keep a struct ``row`` of the columns it names.

    Null and empty texts, and those shorter than SIZE bytes, lose nothing; a
    null text counts as empty. Rows that repeat a doc_id are one document of
    equal strings to each other and each give a row. Rows of null doc_id are
    compared with nothing and kept. Empty tables give no rows; extra columns
    are ignored. Where a cut falls inside a character, kept_text leaves that
    character's other bytes out. Strings are compared byte by byte; hashes
    only decide which ones meet.
    """
    packed = pack(docs.where("doc_id IS NOT NULL"), keep)
    total = total_bytes(packed)
    parts, groups = max(1, total // part_bytes), max(1, total // group_bytes)
    # the filter, which inner joins would add, makes both joins read one exchange
    dealt = packed.where("batch IS NOT NULL").repartition("batch")
    listed = dealt.join(frequencies(packed, _names_of, parts), "batch").select("batch", "ids", "sizes", "texts", "parts")
    kinds = "bucket long, batch long, sizes binary, docs binary, bytes binary, holders binary, places binary"
    found = listed.mapInArrow(partial(_fragments, parts, groups), kinds).groupBy("bucket").applyInArrow(_settle, "batch long, ranges binary")
    ranges = found.groupBy("batch").agg(F.collect_list("ranges").alias("ranges"))
    last = ["rows"] if keep else []
    done = dealt.join(ranges, "batch", "left").select("batch", "ids", "sizes", "texts", "ranges", *last)
    nameless = docs.where("doc_id IS NULL")
    if not nameless.isEmpty():
        done = done.union(pack(nameless, keep).withColumn("ranges", F.lit(None).cast("array<binary>")).select("batch", "ids", "sizes", "texts", "ranges", *last))
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    if keep:
        schema = schema.add("row", packed.schema["rows"].dataType.elementType)
    out = done.mapInArrow(partial(_finish, keep_text, bool(keep)), schema)
    return out if keep_text else out.drop("kept_text")
