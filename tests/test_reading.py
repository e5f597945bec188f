"""Feeds, JSON, prompts, places and rising labels: hand-made cases against plain Python."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressweave.functions import json as J
from pressweave.operators import geo, prompts
from pressweave.operators.trends import velocity
from pressweave.plans import stories
from pressweave.sources import feeds

from .test_stories import SHARED, START, article, shingles, story

AS_OF = datetime(2024, 3, 5, 12)
RSS = '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>F</title>{}</channel></rss>'


def item(title="T", link="http://x/a", date="Tue, 05 Mar 2024 10:00:00 +0000", more=""):
    return f"<item><title>{title}</title><link>{link}</link>{f'<pubDate>{date}</pubDate>' if date else ''}{more}</item>"


def read(spark, *xml):
    rows = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(xml)], "source_id string, xml string")
    return feeds.items(rows, F.lit(AS_OF)).collect()


def test_items_dates_and_images(spark):
    images = ['<enclosure url="http://i/1.jpg"/><media:content url="http://i/2.jpg"/>', '<media:content url="http://i/2.jpg"/><media:thumbnail url="http://i/3.jpg"/>', '<media:thumbnail url="http://i/3.jpg"/>', "<content:encoded><![CDATA[<p>x</p><IMG class='a' src='http://i/4.jpg'>]]></content:encoded>", ""]
    got = read(spark, RSS.format("".join(item(f"T{k}", more=x) for k, x in enumerate(images))))
    assert [(r.title, r.image) for r in sorted(got, key=lambda r: r.title)] == [("T0", "http://i/1.jpg"), ("T1", "http://i/2.jpg"), ("T2", "http://i/3.jpg"), ("T3", "http://i/4.jpg"), ("T4", None)]
    dates = {"Tue, 05 Mar 2024 10:00:00 GMT": datetime(2024, 3, 5, 10), "5 Mar 2024 10:00:00 +0530": datetime(2024, 3, 5, 4, 30), "2024-03-05T10:00:00Z": datetime(2024, 3, 5, 10), "2024-03-05T10:00:00.250+01:00": datetime(2024, 3, 5, 9, 0, 0, 250000), "no date": AS_OF, "": AS_OF}
    got = read(spark, RSS.format("".join(item(f"T{k}", date=d) for k, d in enumerate(dates))))
    assert {r.title: r.published_at for r in got} == {f"T{k}": at for k, at in enumerate(dates.values())}


def test_items_without_title_or_link_and_old_ones_are_left_out(spark):
    old = "Sat, 02 Mar 2024 11:59:59 +0000"
    got = read(spark, RSS.format(item("") + item(link="") + item("old", date=old) + item("edge", date="Sat, 02 Mar 2024 12:00:00 +0000") + item("A &amp; B", more="<description>one\n  &lt;b&gt;two&lt;/b&gt;  three</description>")))
    assert sorted((r.title, r.lead) for r in got) == [("A & B", "one two three"), ("edge", "")]


def test_a_broken_feed_stops_no_other(spark):
    got = read(spark, RSS.format(item("fine")), RSS.format(item("cut"))[:-9], "no xml at all", None, RSS.format(""))
    assert sorted((r.source_id, r.title or "", r.broken) for r in got) == [("s0", "fine", False), ("s1", "", True), ("s2", "", True), ("s3", "", True)]


def test_titles_by_pattern(spark):
    df = spark.createDataFrame([("<rss><title>Daily</title><item>\n <title> Big Storm </title></item><item><title>X</title></item></rss>",)], "xml string")
    assert df.select(feeds.titles(F.col("xml")).alias("t")).first().t == ["big storm", "x"]


def test_lists_of_strings(spark):
    cases = {'["a", "b"]': ["a", "b"], '["a", 1, null, {"x": 1}, ["c"], true, "d"]': ["a", "d"], "[]": [], "{}": [], '"a"': [], "junk": [], "": [], "null": [], None: []}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", J.strings(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases


def test_rescued_objects(spark):
    cases = {'{"a": 1}': {"a": 1}, 'Sure!\n```json\n{"a": {"b": 2}}\n``` bye': {"a": {"b": 2}}, '{"type": "object", "properties": {"a": 3}}': {"a": 3}, '{"type": "object", "properties": 4}': {"type": "object", "properties": 4}, '{"type": "other", "properties": {"a": 3}}': {"type": "other", "properties": {"a": 3}}, "{a}": None, "} {": None, "": None, None: None, '{"a": 1': None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.to_json(J.rescued(F.col("t"))).alias("v")).collect()
    assert {r.t: r.v and json.loads(r.v) for r in rows} == cases


def test_summaries(spark):
    long = "The harbour strike entered its second week. Talks resume on Monday after"
    cases = {json.dumps({"headline": "H", "crux": long}): ("ok", "H", "The harbour strike entered its second week."), json.dumps({"headline": "H", "crux": "Too short."}): ("unusable", None, None), json.dumps({"headline": " ", "crux": long}): ("unusable", None, None), json.dumps({"headline": 5, "crux": long}): ("unusable", None, None), json.dumps({"crux": long}): ("unusable", None, None), "so sorry": ("bad_json", None, None), "  ": ("empty", None, None), None: ("empty", None, None)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", J.summary(F.col("t")).alias("s")).collect()
    assert {r.t: tuple(r.s) for r in rows} == cases


def plain_prompt(rows, topics):
    first = {}
    for r in sorted(rows, key=lambda r: (-len(r[4] or ""), r[8], r[0])):
        first.setdefault(r[1], r)
    kept, picked = [], []
    for r in sorted(first.values(), key=lambda r: (-len(r[4] or ""), r[0])):
        s = shingles(f"{r[2]} {r[4] if r[4] is not None else r[3] or ''}")
        if not s or all(2 * len(s & k) < len(s | k) for k in kept):
            kept += [s] if s else []
            picked.append(r)
    picked = sorted(picked, key=lambda r: (-len(r[4] or ""), r[8], r[0]))[:6]
    bias = lambda r: {"s0": "left", "s1": "right"}.get(r[1])
    framed = any(bias(r) for r in picked)
    pieces = ["<article n=\"{}\" source=\"{}\"{}>\n<title>{}</title>\n{}\n</article>".format(k + 1, r[1].upper(), f' lean="{bias(r)}"' if framed and bias(r) else "", r[2], (r[4] if r[4] is not None else r[3] or "")[:1800]) for k, r in enumerate(picked)]
    return f"Recent topics: {'; '.join(topics)}\n\n{len(rows)} articles cover this one event. Here are {len(picked)} of them.\n\n" + "\n\n".join(pieces)


def test_prompts(spark):
    rows = [article(i, f"Title {i}", f"lead {i}", (story(i % 5, i, 60 + i) if i % 4 else None), f"s{i % 9}", i, cluster=f"c{i % 2}") for i in range(30)]
    rows += [article(40 + i, "Wire", "", SHARED * 3 + " " * i, f"w{i}", i, cluster="wire") for i in range(3)]
    df = spark.createDataFrame(rows, stories.cycles.ARTICLE).withColumn("name", F.upper("source_id")).withColumn("bias", F.when(F.col("source_id") == "s0", "left").when(F.col("source_id") == "s1", "right"))
    got = {r.cluster_id: r for r in prompts.assemble(df, ["Ports", "Fruit"]).collect()}
    for c in ("c0", "c1", "wire"):
        assert got[c].prompt == plain_prompt([r for r in rows if r[9] == c], ["Ports", "Fruit"])
    assert got["wire"].picked == 1 and got["wire"].articles == 3 and "lean=" in got["c0"].prompt
    assert {r.cluster_id: r.picked for r in prompts.assemble(df, distinct=False).collect()}["wire"] == 3


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.RADIUS * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("reach", [150.0, 900.0, 6_000.0])
def test_nearest_near_poles_and_date_line(spark, reach):
    r = random.Random(int(reach))
    edge = [(lat, lon) for lat in (-90.0, -89.95, -60.0, 0.0, 45.0, 89.0, 89.9, 90.0) for lon in (-180.0, -179.9, -90.0, 0.0, 179.95, 180.0)]
    some = lambda n: [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(n)]
    points, places = edge + some(150), [(a + r.uniform(-0.5, 0.5), b + r.uniform(-0.9, 0.9)) for a, b in edge + some(150)]
    places = [(max(-90.0, min(90.0, a)), max(-180.0, min(180.0, b))) for a, b in places]
    kinds = [r.choice(["city", "admin1", None]) for _ in places]
    got = geo.nearest(spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(999, None, 1.0), (998, math.nan, 0.0)], "id long, lat double, lon double"), spark.createDataFrame([(i, k, *p) for i, (k, p) in enumerate(zip(kinds, places))] + [(777, "city", None, None)], "place_id long, kind string, lat double, lon double"), reach)
    want = {}
    for i, p in enumerate(points):
        near = min(((kinds[j] != "city", km(p, q), j) for j, q in enumerate(places) if km(p, q) <= reach), default=None)
        if near:
            want[i] = near
    found = {x.id: x for x in got.collect()}
    assert set(found) == set(want) and len(want) > 40
    for i, (_, d, j) in want.items():
        assert found[i].km == pytest.approx(d, abs=1e-6) and (found[i].place_id == j or km(points[i], places[found[i].place_id]) == pytest.approx(d, abs=1e-9))


def test_closure_of_any_depth(spark):
    r = random.Random(4)
    parent = {i: (r.randrange(max(0, i - 3), i) if i % 10 else None) for i in range(1, 60)} | {0: None, 77: 1_000}
    got = {(x.root, x.id): x.depth for x in geo.closure(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()}
    want = {}
    for i in parent:
        at, depth = i, 0
        while at is not None and at in parent:
            want[(at, i)] = depth
            at, depth = parent[at], depth + 1
    assert got == want and max(want.values()) > 4
    with pytest.raises(ValueError):
        geo.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_ring_leaves_out_what_lies_below(spark):
    places = [("n:in", "IN", None, None), ("a:ka", "IN", "a:ka", 60), ("c:blr", "IN", "a:ka", 12), ("c:mys", "IN", "a:ka", 1), ("c:del", "IN", "a:dl", 30), ("c:goa", "IN", None, 2), ("c:lhr", "PK", "a:pj", 11)]
    df = spark.createDataFrame(places, "place_id string, country string, admin1_id string, population long")
    below = geo.closure(spark.createDataFrame([("n:in", None), ("a:ka", "n:in"), ("c:blr", "a:ka"), ("c:mys", "a:ka"), ("c:del", "n:in"), ("c:goa", "n:in"), ("c:lhr", None)], "id string, parent string"))
    ring = lambda *held: {r.reader: r.ids for r in geo.around(spark.createDataFrame(held, "reader long, place_id string"), df, below).groupBy("reader").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "place_id"))), lambda x: x["place_id"]).alias("ids")).collect()}
    assert ring((1, "c:blr"), (2, "a:ka"), (3, "n:in"), (4, "unknown")) == {1: ["a:ka", "c:mys", "c:del", "c:goa", "n:in"], 2: ["c:del", "c:goa", "n:in"]}


def test_velocity_of_a_label_that_rises(spark):
    rows = [("steady", b, 1.0) for b in range(8)] + [("rising", b, 1.0) for b in (6, 7, 7)] + [("rare", 7, 9.0)]
    got = {(r.label, r.bucket): r.lift for r in velocity(spark.createDataFrame(rows, "label string, bucket long, weight double"), 8, 2).collect()}
    assert got[("rising", 7)] == pytest.approx((3 / 14) / (3 / 20)) and got[("steady", 7)] == pytest.approx((2 / 14) / (8 / 20))
    assert ("rare", 7) not in got and ("steady", 1) not in got
    assert START + timedelta(0) == START
