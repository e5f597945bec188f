"""Operators 5, 6, 7 and 10, and the pipeline."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pressweave.llm import chat, hilbert, language_id, mixing, sharding

from . import fixtures

VECTORS = "vec_id long, embedding array<double>, label int, query_id long, score double, block int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0.0, 0) for i, v in rows], VECTORS)


def brute(rows, query, nearest=20):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    score = m @ m[list(ids).index(query)]
    order = [k for k in np.lexsort((ids, -score)) if ids[k] != query][:nearest]
    return [(int(ids[k]), float(score[k])) for k in order]


def isotropic(spark, tmp_path, n, size=64):
    """Unit vectors without any nearness to find, the hardest case of a curve."""
    v = np.random.default_rng(7).normal(size=(n, size)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), size).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), f"{tmp_path}/v.parquet", row_group_size=n // 8)
    return spark.read.parquet(f"{tmp_path}/v.parquet").repartition(8), v.astype(np.float64)


@pytest.mark.parametrize("folder, window, range_rows", [("sf0.01", 64, 100), ("sf0.1", 512, 600), (None, hilbert.WINDOW, 3_000)])
def test_search_recall_and_scores(spark, tmp_path, folder, window, range_rows):
    given = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet") if folder else isotropic(spark, tmp_path, 10_000)[0]
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in given.collect()]
    found = defaultdict(list)
    for r in hilbert.search(given, window=window, range_rows=range_rows).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    hits, by = 0, dict(rows)
    for q, got in found.items():
        hits += len({i for i, _ in got} & {i for i, _ in brute(rows, q)})
        assert len(got) == 20 and [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        assert all(s == pytest.approx(float(np.dot(by[q], by[i])), rel=1e-12) for i, s in got)
    assert hits / (20 * len(found)) >= 0.9


def test_search_recall_beyond_twenty_windows_as_registered(spark, tmp_path):
    given, v = isotropic(spark, tmp_path, 20 * 2 * hilbert.WINDOW + 5_000)
    found = defaultdict(set)
    for r in hilbert.search(given, modulus=400).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, len(v), 400):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argpartition(score, -20)[-20:].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_search_of_clustered_vectors_keeps_its_window(spark):
    r = np.random.default_rng(11)
    centres = r.normal(size=(60, 8)) * 9
    rows = [(i, (centres[i % 60] + r.normal(size=8) * 0.1).tolist()) for i in range(3_000)]
    found = defaultdict(set)
    for x in hilbert.search(vectors(spark, rows), window=60, range_rows=200).collect():
        found[x.query_id].add(x.vec_id)
    hits = sum(len(found[q] & {i for i, _ in brute(rows, q)}) for q in range(0, 3_000, 20))
    assert hits / (20 * 150) >= 0.9


def test_search_with_a_very_common_vector_and_unequal_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else (r.normal(size=3) * r.uniform(0.1, 4)).tolist()) for i in range(900)]
    found = defaultdict(list)
    for x in hilbert.search(vectors(spark, rows), range_rows=150).orderBy("query_id", "rank").collect():
        found[x.query_id].append(x.vec_id)
    assert all(found[q] == [i for i, _ in brute(rows, q)] for q in range(0, 900, 20))


def test_search_edges(spark):
    rows = [(20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (40, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [3.0, 1.0]), (20, [1.0, 2.0]), (None, [1.0, 1.0]), (8, [])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in hilbert.search(vectors(spark, rows)).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 5.0), (20, 2, 2, 5.0), (20, 3, 7, 5.0)]
    assert hilbert.search(vectors(spark, [])).count() == 0
    assert hilbert.search(vectors(spark, [(20, [1.0])])).count() == 0


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Shares by weight; those above twice their source stop there, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("which", ["hand", "given"])
def test_mix_meets_targets(spark, which):
    docs = fixtures.documents(spark) if which == "hand" else spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    rows = mixing.mix(docs, range_rows=7).collect()
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in docs.select("source", "text").collect():
        sizes[r.source] += words(r.text)
    want = targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(3), range_rows=7).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in rows) == sorted((r.doc_id or -1, r.taken) for r in again)
    assert mixing.mix(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("which", ["hand", "given", "one text"])
def test_shards(spark, which):
    docs = {
        "hand": lambda: fixtures.documents(spark),
        "given": lambda: spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
        "one text": lambda: spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('text ', id)) AS text"),
    }[which]()
    rows = sharding.shard(docs).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    known = {(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == known
    load, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(40))
    if which != "hand":  # as near as single rows allow
        mean, largest = sum(load.values()) / 40, max(r.size for r in rows)
        assert len(load) == 40 and max(load.values()) <= 1.1 * mean + largest
    assert sharding.shard(fixtures.empty(spark)).count() == 0


MESSAGES = f"conv_id long, turn long, text string, tool_calls {chat.CALLS}, tool_call_id string, level string, at string"
SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}}, "required": ["a"], "additionalProperties": False}}


def test_tool_calls(spark):
    call = lambda i, args, needs=None, name="add": (i, name, args, needs)
    rows = [
        (1, 1, "hi", [call("x", '{ "a": 1 }'), call("y", '{"a":-1}', ["x", None])], None),
        (1, 2, "one", None, "x"), (1, 3, "uno", None, "x"), (1, 4, "lost", [], "z"),
        (2, 1, None, [call("p", '{"a":1}', ["q"]), call("q", '{"a":2,"b":3}', ["r"]), call("r", "{}")], None),
        (3, 1, None, [call("m", '{"a":1}', ["n"]), call("n", '{"a":1}', ["m"]), call("k", "no json", ["unknown"], "none")], None),
        (4, 1, None, [call(None, '{"a":1}'), call("d", '{"a":1}'), call("d", '{"a":1}')], None), (None, 1, "é", None, "x"), (5, None, None, None, None),
    ]
    table = spark.createDataFrame([(*r, "x", "x") for r in rows], MESSAGES)
    got = {(r.conv_id, r.call_id, r.nth): r for r in chat.link(table, SCHEMAS).collect()}
    x, y = got[1, "x", 0], got[1, "y", 1]
    assert (x.status, x.n_results, x.result_turn, x.valid, x.errors) == ("linked", 2, 2, True, [])
    assert x.canonical == '{"arguments":{"a":1},"id":"x","name":"add","needs":[],"result":"one"}'
    assert (y.status, y.valid, y.errors) == ("no_result", False, ["$.a: below minimum"])
    assert got[1, "z", None].status == "no_call" and got[None, "x", None].status == "no_call"
    assert [got[2, k, n].level for k, n in (("r", 2), ("q", 1), ("p", 0))] == [0, 1, 2]
    assert got[2, "q", 1].errors == ["$.b: unknown"] and got[2, "r", 2].errors == ["$.a: missing"]
    assert got[3, "m", 0].status == got[3, "n", 1].status == "cyclic" and got[3, "k", 2].errors == ["arguments: no JSON", "needs unknown: unknown"]
    assert got[4, None, 0].errors == ["id: missing"] and got[4, "d", 1].errors == got[4, "d", 2].errors == ["id: repeated"]
    assert chat.link(table.limit(0), SCHEMAS).count() == 0


def test_every_user_turn_is_a_call(spark):
    given = spark.read.parquet(f"{fixtures.SF}/conversations.parquet")
    rows = {(r.conv_id, r.turn): r for r in chat.link(chat.as_tool_messages(given), chat.REPLY_SCHEMAS).where("turn IS NOT NULL").collect()}
    turns = {(r.conv_id, r.turn): r for r in given.collect()}
    assert set(rows) == {k for k, r in turns.items() if r.role == "user"}
    for (conv, turn), r in rows.items():
        answer = turns.get((conv, turn + 1))
        assert r.result_turn == (turn + 1 if answer and answer.role == "assistant" else None)
        text, asks = turns[conv, turn].text, bool(re.search(r"\?\s*$", turns[conv, turn].text or ""))
        arguments = json.loads(r.canonical)["arguments"]
        assert (r.name, arguments["question" if asks else "statement"]) == ("ask" if asks else "tell", text)
        # needs point two turns back, so a call's level is the number of user turns that lead up to it without a gap
        assert r.level == (rows[conv, turn - 2].level + 1 if (conv, turn - 2) in rows else 0)
        assert r.valid == (2 <= len(text) <= 2000 if asks else 1 <= len(text) <= 20000)


def test_levels_are_longest_chains(spark):
    """Both ways of ordering against a search of every chain, with cycles, repeated and unknown needs."""
    rng = random.Random(7)
    needs = {(conv, c): [rng.randrange(12) for _ in range(rng.randrange(3))] if conv % 3 else [x for x in range(c) if rng.random() < 0.3] for conv in range(30) for c in range(10)}

    def level(conv, c, above=()):
        if c in above:
            return None
        below = [level(conv, n, (*above, c)) for n in needs[conv, c] if n < 10]
        return None if None in below else 1 + max(below, default=-1)

    expected = {k: level(*k) for k in needs}
    rows = [(conv, c, None, [(str(c), "add", '{"a":1}', [str(x) for x in n])], None, "x", "x") for (conv, c), n in needs.items()]
    table = spark.createDataFrame(rows, MESSAGES)
    ways = []
    for group_edges in (4, 1000):
        got = {(r.conv_id, int(r.call_id)): (r.level, r.status) for r in chat.link(table, SCHEMAS, group_edges).collect()}
        for (conv, c), want in expected.items():
            top = max((expected[conv, x] for x in range(10) if expected[conv, x] is not None), default=0)
            assert got[conv, c] == ((want, "no_result") if want is not None else (top + 1, "cyclic"))
        ways.append(got)
    assert ways[0] == ways[1] and len({x for x in expected.values()}) > 3


def test_hostile_arguments_are_errors_of_their_row(spark):
    hostile = {"s": '{"a":"\\ud800"}', "n": '{"a":NaN}', "i": '{"a":1e999}', "d": '{"a":' + "[" * 200_000 + "]" * 200_000 + "}", "f": '{"a":1}'}
    table = spark.createDataFrame([(1, 1, None, [(k, "add", v, None) for k, v in hostile.items()], None, "x", "x")], MESSAGES)
    got = {r.call_id: r for r in chat.link(table, SCHEMAS).collect()}
    assert got["s"].errors == ["arguments: no Unicode text"] and got["n"].errors == got["i"].errors == ["arguments: no JSON"]
    assert got["d"].errors == ["arguments: nested too deeply"] and got["f"].valid and not any(got[k].valid for k in "snid")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, fixtures.SF))
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append(docs.collect())
    sure = language_id.identify(spark.read.parquet(f"{fixtures.SF}/documents.parquet")).where("lang_pred <> 'und' AND NOT ambiguous").collect()
    assert {r.doc_id for r in kept[0]} == {r.doc_id for r in sure} and len(kept[0]) > 0.9 * len(before)
    assert len({r.doc_id for r in kept[1]}) == len(kept[1]) <= len(kept[0])
    size = lambda rows: sum(len(r.text) for r in rows)
    assert size(kept[2]) < size(kept[1]) and all(r.n_chars == len(r.text) for rows in kept[2:] for r in rows)
    mixed, source = sum(words(r.text) for r in kept[3]), sum(words(r.text) for r in kept[2])
    assert mixed == pytest.approx(1.5 * source, rel=0.001)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, fixtures.SF)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.decoded) for r in last.collect()} == texts


def test_pipeline_stages_keep_each_row_once(spark):
    a, b, c, d, e = (fixtures.prose(60, 700 + k, 5000) for k in range(5))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, c), (4, c), (5, "1 2 3"), (5, d), (6, None), (None, a), (None, e), (None, "4 5")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    seen = lambda df: sorted(((r.doc_id, r.text) for r in df.select(corpus_pipeline.COLUMNS).collect()), key=repr)
    # all rows with a letter, and no other of their identifier
    docs = corpus_pipeline.materialise(corpus_pipeline.identify_languages(spark, docs, fixtures.SF))
    assert seen(docs) == sorted([(i, t) for i, t in rows if t and re.search("[a-z]", t)], key=repr)
    assert {(r.lang, r.source, r.n_chars == len(r.text)) for r in docs.collect()} == {("en", "s", True)}
    # one row of each group, those without identifier as they are
    one = [(1, a), (3, b), (3, c), (5, d), (None, a), (None, e)]
    assert seen(corpus_pipeline.one_of_each_group(spark, docs, fixtures.SF)) == sorted(one, key=repr)
    # of equal texts the first row's stays
    rest = corpus_pipeline.materialise(corpus_pipeline.remove_repeated_passages(spark, docs, fixtures.SF))
    assert seen(rest) == sorted(one, key=repr)
    # 1.5 times the words, each row once or twice and at most one cut
    mixed = [(r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, fixtures.SF).collect()]
    given = seen(docs)
    assert sum(words(t) for _, t in mixed) == 1.5 * sum(words(t) for _, t in given)
    whole = [x for x in mixed if x in given]
    assert len(mixed) - len(whole) <= 1 and all(given.count(x) <= whole.count(x) <= 2 * given.count(x) for x in given)


def test_pipeline_keeps_the_edge_rows_that_operators_keep(spark, tmp_path):
    fixtures.documents(spark).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    nameless, twice = "a row without identifier", {i: t for i, t in fixtures.texts() if i in (21, 100)}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialise(stage(spark, docs, fixtures.SF))
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert 1 <= sum(i is None and nameless.startswith(t.rstrip()) for i, t in got) <= (1 if name != "mixing" else 2), name
        if name == "language_id":
            assert all(got.count((i, t)) == 2 for i, t in twice.items())
        elif name != "mixing":
            assert len({i for i, _ in got}) == len(got) and 21 not in {i for i, _ in got} and 100 in {i for i, _ in got}


def test_pipeline_of_edge_rows(spark, tmp_path):
    fixtures.documents(spark).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    fixtures.empty(spark).select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
