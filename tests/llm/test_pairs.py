"""Operators 1 and 3 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as holds
from hypothesis import settings
from hypothesis import strategies as st

import corpus_pipeline
from pressweave.llm import components, jaccard, suffixes

from . import fixtures

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_sets(rows):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        out[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    return out


def linked(rows):
    sets = shingle_sets(rows)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("which", ["hand", "given", "frequent"])
def test_links_are_those_of_all_pairs(spark, which):
    if which == "frequent":  # every shingle is frequent, and near copies form chains
        r = random.Random(5)
        rows, text = [], fixtures.prose(60, 4, 9)
        for i in range(150):
            text = fixtures.swapped(text, r.randrange(20, 59)) if i % 10 else fixtures.prose(60, i, 9)
            rows.append((i, text))
    else:
        rows = fixtures.texts() if which == "hand" else fixtures.given(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(fixtures.documents(spark, rows)).collect()}
    assert got.pop(None) == (2, None) if None in got else True
    assert got == linked(rows)


def parted(rows, n, percent):
    """The component of each document, by all pairs of sets of n-word shingles."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    part = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and part[a] != part[b] and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((part[a], part[b]))
                part = {d: x if c == y else c for d, c in part.items()}
    return {d: (len(sets[d]), part[d]) for d in sets}


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 60)])
def test_links_of_other_shingles_are_those_of_all_pairs(spark, words, percent):
    base = fixtures.prose(300, 11)
    rows = fixtures.texts() + [(200 + k, base + " " + fixtures.prose(n, 12 + k)) for k, n in enumerate((0, 30, 36, 60, 72, 75, 78, 90))]
    rows += [(300 + k, fixtures.swapped(fixtures.prose(400, 40), k)) for k in (20, 35, 45, 50, 60, 90, 300)] + [(1000 + d, t) for d, t in fixtures.given(spark)[:150]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(fixtures.documents(spark, rows), words, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == parted(rows, words, percent)


def test_stage_drops_near_copies_from_a_similarity_of_08(spark):
    base = fixtures.prose(1000, 21, 5000)
    rows = [(1, base), (2, base + " " + fixtures.prose(200, 22, 5000)), (3, fixtures.swapped(base, 52)), (4, base + " " + fixtures.prose(300, 23, 5000))]
    want = [d for d, (_, part) in parted(rows, 5, 80).items() if d == part]
    kept = corpus_pipeline.one_of_each_group(spark, fixtures.documents(spark, rows, repeat=False), fixtures.SF).collect()
    assert sorted(r.doc_id for r in kept) == want == [1, 4]


def test_a_pair_is_told_by_as_many_lists_as_it_must_share():
    # two documents share 30 of 40 shingles; those before a shingle of one of them stand in its context
    rows, size = [], jaccard.CONTEXT
    for doc in (1, 2):
        tokens = [t if t % 4 else 100 * t + doc for t in range(1, 41)]
        before = [0] * size + tokens
        rows += [{"token": t, "doc_id": doc, "n": 300, "place": k, "parity": bytes(8 * jaccard.PARITY_WORDS), "component": doc, "matches": 3, "context": before[k : k + size]} for k, t in enumerate(tokens)]
    rows = pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: (r["token"], r["doc_id"])))
    told = [r for batch in jaccard._second_look(80, iter([rows])) for r in batch.to_pylist()]
    assert told == [{"a": 1, "b": 2, "asked": 3}] * 3


def test_jaccard_of_nothing(spark):
    assert jaccard.link(fixtures.empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 100: 90}


def removed(rows, size=50):
    least = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            least[s] = min(doc, least.get(s, doc))
    out = {}
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - size + 1):
            if least[b[i : i + size]] < doc:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        out[doc] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("which, group_bytes", [("hand", suffixes.GROUP_BYTES), ("hand", 3_000), ("given", suffixes.GROUP_BYTES), ("given", 20_000)])
def test_removed_bytes_are_those_of_a_table_of_all_strings(spark, which, group_bytes):
    rows = fixtures.texts() if which == "hand" else fixtures.given(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.deduplicate(fixtures.documents(spark, rows, repeat=False), group_bytes=group_bytes, part_bytes=group_bytes).collect()}
    assert got == removed(rows)


def test_repeated_rows_and_no_rows(spark):
    got = suffixes.deduplicate(fixtures.documents(spark), keep_text=True)
    assert got.where("doc_id = 21").count() == 2 and got.where("doc_id IS NULL").first().n_removed == 0
    assert suffixes.deduplicate(fixtures.empty(spark)).count() == 0


@holds(st.binary(max_size=300), st.integers(9, 60))
@settings(max_examples=60, deadline=None)
def test_suffix_array_is_the_sorted_one(data, depth):
    text = np.frombuffer(bytes(b % 4 for b in data), dtype=np.uint8)
    got = suffixes.suffix_array(text, depth)
    assert sorted(got) == list(range(len(text)))
    keys = [text[i : i + depth].tobytes() for i in got]
    assert keys == sorted(keys)
