"""Operators 11, 12 and 13: manifest, spelling variants and chunk recipes, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pressweave.llm import manifest, queries, recipes, spelling

from . import fixtures

LOWER = {c: c + 32 for c in range(65, 91)}


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    enc = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i // 16 * 16
                proofs[k].append((nodes[run:i], nodes[i + 1 : run + 16]))
                at[k] = i // 16
            nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], proofs

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, enc(r)))
        trees[s] = climb([enc(r) for r in by[s]])
    root, upper = climb([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, upper):
        for r, proof in zip(by[s], trees[s][1]):
            proof, leaf = proof + above, enc(r)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = enc((*r[:4], r[4].translate(LOWER))) if changed else leaf
            for a, b in proof:
                h = H(*a, h, *b)
            out.append((r[0], leaf, trees[s][0], root, H(*(x for a, b in proof for x in (*a, *b))), h, h == root))
    return out


def manifest_rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def same_manifest(spark, docs, **how):
    got = manifest.manifest(docs, manifest.lowered_text(), **how).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, plain_manifest(manifest_rows(docs))))
    return got


@pytest.mark.parametrize("most", [manifest.TOP, 6, 1])
def test_manifest_of_hand_made_rows(spark, most):
    got = same_manifest(spark, fixtures.documents(spark), most=most, proofs=True)
    for r in got:
        assert r.folded_root == (r.root if r.verified else r.folded_root) and manifest.fold(r.leaf, [tuple(x) for x in r.proof]) == r.root
    assert any(not r.verified for r in got)


@pytest.mark.parametrize("most", [manifest.TOP, 3])
def test_manifest_of_large_and_of_many_sources(spark, most):
    docs = spark.range(0, 9_500).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 9_000, "big").when(F.col("id") < 9_400, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text")).repartition(5)
    same_manifest(spark, docs, most=most)


def test_manifest_of_given_and_of_no_rows(spark):
    same_manifest(spark, spark.read.parquet(f"{fixtures.SF}/documents.parquet"))
    one = fixtures.documents(spark, [(7, "Lone")], repeat=False).select("doc_id", "text", "lang", "source", "n_chars")
    (r,) = manifest.manifest(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H() and r.verified
    assert manifest.manifest(fixtures.empty(spark), manifest.lowered_text()).count() == 0


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + (len(a) > len(b)) :] == b[k + (len(b) > len(a)) :]


def plain_variants(n):
    near_of = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in near_of.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near_of[w]), n[form[w]] if form[w] else None))
    return out


def similar_words(seed, count):
    """Words that are often one edit apart, some beyond ASCII, some with letters that repeat."""
    r, out = random.Random(seed), []
    letters = "aabbcçé÷ÿ"
    while len(out) < count:
        w = "".join(r.choice(letters) for _ in range(r.choice([6, 6, 7, 7, 8, 12])))
        out += [w, w[:3] + r.choice(letters) + w[3:], w[:5] + r.choice(letters) + w[6:], r.choice(letters) + w, w + w[-1]]
    return out


@pytest.mark.parametrize("group_bytes", [spelling.GROUP_BYTES, 2_000])
def test_variants_of_similar_words(spark, group_bytes):
    r = random.Random(5)
    words = similar_words(1, 300) + ["prefix" + x for x in similar_words(2, 200)] + ["q" * 3000, "q" * 1500 + "r" + "q" * 1499, "q" * 2999]
    rows = [(k, " ".join(" ".join([w] * r.choice([3, 5, 6, 30, 200])) + ("\n" if k % 3 else "; ") for w in words[k : k + 4])) for k in range(0, len(words), 4)]
    rows += [(None, "receive " * 30), (1_000, "recieve " * 6), (1_001, "Recieve RECEIVE receivE"), (1_002, None), (1_003, "")]
    docs = fixtures.documents(spark, rows, repeat=False)
    n = plain_words(rows)
    got = spelling.variants(docs, group_bytes=group_bytes).collect()
    assert {tuple(x) for x in got} == plain_variants(n) and len(got) == len(n)
    assert any(x.root not in (x.word, x.form) for x in got) or any(x.form for x in got)


def test_variants_of_given_and_of_no_rows(spark):
    rows = fixtures.given(spark)
    got = {tuple(x) for x in spelling.variants(spark.read.parquet(f"{fixtures.SF}/documents.parquet")).collect()}
    assert got == plain_variants(plain_words(rows))
    assert spelling.variants(fixtures.empty(spark)).count() == 0
    assert spelling.variants(fixtures.documents(spark, [(1, "one"), (2, None)], repeat=False)).count() == 0


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, docs in groups.items():
        docs.sort(key=lambda d: (d is not None, d or 0))
        out += [(d, docs[-1], len(docs), k == len(docs) - 1, H(text)) for k, d in enumerate(docs)]
    return sorted(map(str, out))


@pytest.mark.parametrize("digest", [recipes.DIGEST, 1])
def test_recipes_of_hand_made_rows(spark, digest, monkeypatch):
    docs = fixtures.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(500 + k, fixtures.prose(3_000, k % 9) + (" END" if k % 2 else " end")) for k in range(27)]
    docs = docs.select("doc_id", "text", "size", "key").union(spark.createDataFrame([(*r, "x", "x") for r in rows[-27:]], "doc_id long, text string, size string, key string"))
    got = recipes.deduplicate(docs, digest, keep=("size",)).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == plain_dedup(rows)
    assert max(r.n_chunks for r in got) > 10 and {r.size for r in got} == {"x"}


def test_recipes_with_longer_digests_where_many_clash(spark, monkeypatch):
    monkeypatch.setattr(recipes, "MOST_CLASHES", 3)
    rows = [(k, fixtures.prose(4_000, k % 5)) for k in range(12)]
    docs = fixtures.documents(spark, rows, repeat=False)
    digest, ranks = recipes.verified(docs, 1)
    assert digest > 1 and len(ranks) <= 3
    assert sorted(str(tuple(r)[:5]) for r in recipes.deduplicate(docs, 1).collect()) == plain_dedup(rows)


def test_chunks_stay_where_text_is_inserted():
    text = fixtures.prose(30_000, 4).encode()
    a, b = recipes.chunks_of([text, text[:50_000] + b"inserted" + text[50_000:]])
    assert b"".join(a) == text and len(set(a) - set(b)) <= 3
    assert all(recipes.LEAST <= len(c) <= recipes.MOST for c in a[:-1])
    assert list(recipes.chunks_of([b"", b"x"])) == [[], [b"x"]]


def test_recipes_of_given_and_of_no_rows(spark):
    rows = fixtures.given(spark)
    assert sorted(str(tuple(r)) for r in queries.op13_chunk_recipes(spark, fixtures.SF).collect()) == plain_dedup(rows)
    assert recipes.deduplicate(fixtures.empty(spark)).count() == 0
