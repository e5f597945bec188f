"""Grouping, greedy choice of texts, and similar sets against plain Python."""

from __future__ import annotations

import re

import duckdb
import pandas as pd
import pytest

from pressweave.functions import text as T
from pressweave.operators.grouping import group_cycle
from pressweave.operators.similar import keep_first
from pressweave.plans import registry

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def shingles(text):
    words = [re.sub("['’]s$", "", w) for w in re.findall(T.TOKEN, (text or "").lower())]
    words = [w for w in words if len(w) > 2 and w not in T.STOP]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def test_distinct_by_text(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    kept, want = [], set()
    for doc, text in sorted(docs, key=lambda r: (-len(r[1] or ""), r[0])):
        s = shingles(text)
        if not s or all(2 * len(s & k) < len(s | k) for k in kept):
            want.add(doc)
            kept += [s] if s else []
    assert {r.doc_id for r in rows_of(spark, "distinct_by_text") if r.kept} == want
    assert len(want) < len(docs)


def test_keep_first_of_a_chain(spark):
    """Not connected components: what a beaten node resembles stays."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (4, 5)], "earlier long, later long")
    assert {r.id for r in keep_first(edges).collect()} == {2, 4, 5}
    assert keep_first(edges.limit(0)).count() == 0


def article(doc, words, names=()):
    terms = words.split()
    return {"doc_id": doc, "terms": terms, "weights": [max(len(terms), 1) ** -0.5] * len(terms), "keys": terms[:6] + list(names), "names": list(names)}


@pytest.mark.parametrize(
    ("articles", "want"),
    [
        ([article(1, "a b c d"), article(2, "a b c d"), article(3, "a b c d")], [1, 1, 1]),
        # half of the words, under 0.52: a shared name decides
        ([article(1, "a b c d", ["x"]), article(2, "a b e f", ["x"])], [1, 1]),
        ([article(1, "a b c d", ["x"]), article(2, "a b e f", ["y"])], [1, 2]),
        # one word in common leaves nothing without it
        ([article(1, "a b c", ["x"]), article(2, "a d e", ["x"])], [1, 2]),
        # 0.18 passes for one member (0.16) and not for two (0.20)
        ([article(1, "a b c d e f g h i j k", ["x"]), article(2, "a b m n o p q r s t u", ["x"])], [1, 1]),
        ([article(1, "a b c d e f g h i j k", ["x"]), article(2, "a b c d e f g h i j k", ["x"]), article(3, "a b m n o p q r s t u", ["x"])], [1, 1, 3]),
        ([article(7, ""), article(8, "")], [7, 8]),
    ],
)
def test_grouping_pass(articles, want):
    got = group_cycle(pd.DataFrame(articles[::-1]))
    assert [f"c_{w}" for w in want] == got["cluster_id"].tolist()


def test_clusters_of_every_document(spark):
    rows = rows_of(spark, "clusters_greedy")
    assert len(rows) == len({r.doc_id for r in rows}) == duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster_id, []).append(r.doc_id)
    assert all(c == f"c_{min(docs)}" and len({d // 192 for d in docs}) == 1 for c, docs in groups.items())
    assert any(len(docs) > 1 for docs in groups.values())
