"""Work that has to follow the rows in and out: how many rows the joins of a plan make."""

from __future__ import annotations

import random

import pytest

from pressweave.operators import geo, upkeep


def joined(df) -> int:
    """The most rows that a join of df made; df is collected for that."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        left += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        left += [node.children().apply(k) for k in range(node.children().length())]
    return most


def test_typed_labels_meet_one_place_of_each_name(spark):
    places = spark.range(400).selectExpr("id AS place_id", "concat('Own ', id) AS name", "'Town' AS label", "double(id % 200) AS population")
    labels = spark.range(300).selectExpr("id AS reader", "id AS pos", "if(id % 3 = 0, ' own 7', 'TOWN') AS label")
    held = spark.range(300).selectExpr("id AS reader", "if(id = 5, 9, 1000) AS place_id")
    found = upkeep.typed(labels, places, held)
    # the larger place, of two as large the smaller place_id; reader 5 has a place of that label
    assert {(r.reader, r.place_id) for r in found.collect()} == {(k, 7 if k % 3 == 0 else 199) for k in range(300) if k != 5}
    assert joined(found) <= 1000


def plain_ring(held, places, below, limit):
    """geo.around() by its words: reader -> places in order."""
    at, out = {p[0]: p for p in places}, {}
    for reader in {r for r, _ in held}:
        own = [at[p] for r, p in held if r == reader and p in at]
        under = {i for root, i in below for p in own if p[0] == root}
        ring = [p for p in places if p[1] is not None and p[1] in {o[1] for o in own} and p[0] not in under]
        near = {o[2] for o in own} - {None}
        out[reader] = [p[0] for p in sorted(ring, key=lambda p: (p[2] not in near, p[3] is None, -(p[3] or 0), p[0]))][:limit]
    return {r: ids for r, ids in out.items() if ids}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ring_by_its_words(spark, seed):
    r = random.Random(seed)
    places = [(i, 4 if i > 140 else r.choice([1, 2, 3, None]), r.choice([10, 11, 12, None]), r.choice([None, 5.0, 7.0, float(i)])) for i in range(150)]
    # everything is below itself, and much of it below three others
    below = [(i, i) for i in range(150)] + [(root, i) for root in (0, 1, 2) for i in range(3, 150) if r.random() < 0.4]
    held = [(reader, r.randrange(160)) for reader in range(25) for _ in range(r.randrange(1, 4))] + [(None, 7), (None, 0), (90, 0), (91, 1), (91, 2), (92, 145)]
    found = geo.around(spark.createDataFrame(held, "reader long, place_id long"), spark.createDataFrame(places, "place_id long, country long, admin1_id long, population double"), spark.createDataFrame(below, "root long, id long"), 12)
    got = {}
    for x in sorted(found.collect(), key=lambda x: x.position):
        got.setdefault(x.reader, []).append(x.place_id)
        assert x.position == len(got[x.reader])
    assert got == plain_ring(held, places, below, 12) and any(len(x) < 12 for x in got.values())


def test_ring_meets_the_first_places_only(spark):
    places = spark.range(3000).selectExpr("id AS place_id", "id % 2 AS country", "if(id % 9 > 0, id % 4, NULL) AS admin1_id", "double(id % 500) AS population")
    held = spark.range(600).selectExpr("id AS reader", "id AS place_id")
    found = geo.around(held, places, places.selectExpr("place_id AS root", "place_id AS id"), 10)
    assert joined(found) <= 600 * 4 * 10 and found.count() == 6000
