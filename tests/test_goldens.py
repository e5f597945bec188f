"""Cases whose outcome is known by the rules themselves."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pressweave.functions import text as T
from pressweave.functions.headlines import chore
from pressweave.operators import cycles, gazetteer, robots, selecting
from pressweave.operators.grouping import THRESHOLD, group_cycle
from pressweave.operators.vectors import alike
from pressweave.operators.world import Sub, Topic, bodies, pages, pills
from pressweave.plans import registry, selection

from .compare import of_duckdb, of_spark
from .test_grouping import article as words_of

START = datetime(2024, 1, 10)


def values(spark, expression, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.orderBy("k").select(expression(F.col("t"))).collect()]


def allowed(spark, text, *paths, status=200, agent="newsbot"):
    pages_ = spark.createDataFrame([(k, p if "://" in p else f"https://h{p}") for k, p in enumerate(paths)], "page_id int, url string")
    policies = spark.createDataFrame([("h", status, text)], "host string, status int, text string")
    return [(r.allowed, r.delay_ms) for r in robots.verdicts(pages_, policies, agent).orderBy("page_id").collect()]


def test_a_question_mark_in_a_rule_is_one(spark):
    assert allowed(spark, "User-agent: *\nDisallow: /*?", "/a", "/a?x", "/") == [(True, 0), (False, 0), (True, 0)]


def test_the_longest_rule_decides_and_allowing_wins_a_tie(spark):
    assert allowed(spark, "User-agent: *\nDisallow: /a/\nAllow: /a/\nDisallow: /a/b\nAllow: /c$\nDisallow: /c", "/a/x", "/a/b", "/c", "/cd") == [(True, 0), (False, 0), (True, 0), (False, 0)]


def test_the_first_group_that_names_us_counts(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: other\nUser-agent: News\nDisallow: /x # not here\nCrawl-delay: 90\n\nUser-agent: newsbot\nDisallow: /y"
    assert allowed(spark, text, "/", "/x", "/y") == [(True, 30_000), (False, 30_000), (True, 30_000)]
    assert allowed(spark, text, "/z", agent="somebody") == [(False, 0)]


@pytest.mark.parametrize(("status", "want"), [(503, False), (404, True), (None, True), (200, False)])
def test_hosts_that_answer_otherwise(spark, status, want):
    assert allowed(spark, "User-agent: *\nDisallow: /", "/a", status=status) == [(want, 0)]
    assert allowed(spark, "", "ftp://h/a", "no address")[0][0] is False


def test_social_images(spark):
    page = lambda *metas: "<head>" + "".join(f"<meta {m}>" for m in metas) + "</head>"
    html = [page("property='og:image' content='http://i/1.jpg'", 'name="twitter:image" content="http://i/2.jpg"'), page('content="/two.png" name="twitter:image"'), page("property=\"og:image\" content=\" \"", 'itemprop="image" content="//cdn/3.jpg"'), page('name="twitter:image:src" content="pic.jpg"'), page('property="og:image" content="data:image/png;base64,xx"'), "<p>none</p>"]
    assert values(spark, lambda t: robots.social_image(t, F.lit("https://x.org/a/b.html?q#f")), *html) == ["http://i/1.jpg", "https://x.org/two.png", "https://cdn/3.jpg", "https://x.org/a/pic.jpg", None, None]


def test_addresses_without_what_only_tracks(spark):
    urls = ["http://www.x.org/a/?traffic_source=rss", "https://x.org/a?utm_source=f&id=3&utm_medium=m#top", "https://x.org/?fbclid=1&ref=2", "not an address"]
    assert values(spark, selection.normalise_address, *urls) == ["http://x.org/a", "https://x.org/a?id=3", "https://x.org", "not an address"]


def test_routine_headlines(spark):
    routine = ["Quordle hints and answers for September 13", "HT Morning Brief September 12: Xi Jinping headed to India", "Zomato's Latest Fee, Weekly Funding Rundown & More", "Sonia Rovai Appointed Disney Italy VP of Original Production"]
    news = ["CIA releases dozens of presidential daily briefs on Bin Laden", "Trump-Appointed Judge Rules Against Tariffs", "A $110 million deal includes a school, water reclamation, and more", "Jane Roe Named CEO and President of Acme", "Aditya Thackeray named in Disha Salian case"]
    assert values(spark, chore, *routine, *news) == [True] * 4 + [False] * 5


def test_a_shape_recurs_on_three_days_not_on_two(spark):
    rows = [(k, s, f"Daily puzzle {k}: answers for {d}", START - timedelta(days=d)) for k, (s, d) in enumerate([("a", 0), ("a", 1), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("c", 0), ("c", 1), ("c", 8)])]
    articles = spark.createDataFrame(rows, "id int, source_id string, title string, published_at timestamp")
    assert {r.source_id for r in selecting.recurring(articles, F.lit(START)).collect()} == {"b"}
    left = selecting.without_routine(articles, selecting.recurring(articles, F.lit(START))).collect()
    assert {r.source_id for r in left} == {"a", "c"}


def queue(spark, rows, clusters, hot=(), allowance=(), **how):
    articles = spark.createDataFrame(rows, cycles.ARTICLE)
    state = spark.createDataFrame(clusters, "id string, written boolean, source_count int, attempts int")
    got = selecting.worth_writing(articles, state, spark.createDataFrame([(h,) for h in hot], "id long"), spark.createDataFrame(list(allowance), "source_id string, allowance long"), F.lit(START), **how)
    return [(r.id, r.hot, r.heat) for r in got.orderBy("position").collect()]


def test_the_queue_of_single_stories(spark):
    long = "text " * 200
    at = lambda i, source, title, hours, cluster=None, body=long: (i, source, title, "", body, "full", False, None, START - timedelta(hours=hours), cluster or f"c{i}")
    rows = [at(1, "a", "Harbour strike", 3), at(2, "b", "Quiet town fair", 4), at(3, "c", "Harbour fire", 5), at(4, "d", "Harbour talks", 30), at(5, "a", "Too new", 1), at(6, "a", "Too old", 7), at(7, "a", "Short", 3, body="x"), at(8, "a", "How to bake", 3), at(9, "b", "Comet passes", 2.5), at(10, "b", "Comet passes again", 2.2, "c9"), at(11, "e", "Written", 3), at(12, "e", "Given up", 3), at(13, "e", "Two sources", 3)]
    clusters = [(f"c{k}", False, 1, 0) for k in range(1, 11)] + [("c11", True, 1, 0), ("c12", False, 1, 3), ("c13", False, 2, 0)]
    # harbour is in three other outlets' headlines; the comet trends; one article stands for a story
    assert queue(spark, rows, clusters, hot=[9]) == [(9, True, 0), (1, False, 2), (3, False, 2), (2, False, 0)]
    assert queue(spark, rows, clusters, hot=[9], allowance=[("b", 1), ("a", 0)]) == [(9, True, 0), (3, False, 2)]
    assert queue(spark, rows, clusters, limit=1) == [(1, False, 2)]
    assert queue(spark, [], []) == []


def test_corroborated_stories_without_routine(spark):
    rows = [(k, "s", t, "", None, "full", False, None, START - timedelta(hours=h), c) for k, (t, h, c) in enumerate([("Quordle hints and answers", 5, "x"), ("Real news", 4, "x"), ("Storm nears", 5, "y"), ("Vote held", 5, "z")])]
    clusters = spark.createDataFrame([("x", False, 9, 9, 0), ("y", False, 2, 3, 0), ("z", False, 2, 4, 0), ("w", True, 5, 5, 0), ("v", False, 1, 1, 0), ("u", False, 3, 3, 3)], "id string, written boolean, source_count int, article_count int, attempts int")
    got = selecting.corroborated(clusters, spark.createDataFrame(rows, cycles.ARTICLE), F.lit(START), 10)
    assert [r.id for r in got.orderBy("position").collect()] == ["z", "y"]


@pytest.mark.parametrize(("word", "text", "want"), [("ed", "detained by ed", True), ("ed", "detained", False), ("ai", "he said", False), ("ai", "said: AI", True), ("fir", "first", False), ("1.5c", "a 1x5c", False), ("1.5c", "the 1.5C goal", True), ("all-rounder", "an all-rounder,", True)])
def test_words_of_a_lens_stand_alone(spark, word, text, want):
    sub = Sub("Lens", words=(word, "zzz"))
    assert values(spark, lambda t: sub.matches(t, F.lit("c"), F.lit(None).cast("string")), text) == [want]


def test_pills_of_labels_that_name_a_pill_or_a_scope(spark):
    topics = [Topic("sport", "Sport", ("Sport", "Games"), (Sub("Cricket", words=("wicket",)), Sub("Games", category="Games"))), Topic("law", "Law", ("Law",))]
    label = ["Cricket", "Cricket", "Local", "Local", "Local", "Cup final", "Cup final", "cup  final", None, "rare"]
    rows = [(k, "Games" if k == 8 else "Sport", "IN", k, START, t, "lost wicket" if k == 9 else "text", ["local"] if k == 0 else []) for k, t in enumerate(label)] + [(50, "Law", None, 1, START, None, "", [])]
    stories = spark.createDataFrame(rows, "id long, category string, country string, importance int, last_seen timestamp, topic string, text string, scopes array<string>")
    paged = pages(stories, topics, "IN", F.lit(1.0))
    got = {}
    for r in pills(paged, topics, ["Sport", "Games", "Law", "Other"]).orderBy("section", "pos").collect():
        got.setdefault(r.section, []).append((r.slug, r.name, r.n))
    assert got["sport"] == [("cup-final", "cup  final", 3), ("cricket", "Cricket", 3), ("games", "Games", 1)]
    assert got["top"] == [("local", "City", 1), ("sport", "Sport", 10), ("law", "Law", 1)] and "law" not in got
    assert {r.id for r in bodies(paged.withColumn("summarised_at", F.when(F.col("id") == 3, F.lit(START + timedelta(hours=2)))), topics, F.lit(START + timedelta(hours=1))).where("changed").collect()} == {3}


def test_one_rare_word_in_common_is_no_pair(spark):
    rare = [(1, "medicare", 0.99, False), (1, "x", 0.141, False), (2, "medicare", 0.99, False), (2, "y", 0.141, False)]
    both = [(3, "a", 0.7071, False), (3, "b", 0.7071, False), (4, "a", 0.7071, False), (4, "b", 0.7071, False), (5, "a", 0.7071, True), (5, "b", 0.7071, True), (6, "a", 0.7071, True), (6, "b", 0.7071, True)]
    v = spark.createDataFrame(rare + both, "id long, term string, w double, still boolean")
    assert {(r.a, r.b) for r in alike(v, 0.16, 0.04).collect()} == {(3, 4), (3, 5), (4, 5), (3, 6), (4, 6)}


def test_the_price_of_joining_a_group():
    import pandas as pd

    assert THRESHOLD == 0.16
    # similarity 2/11 = 0.18: enough for a group of one (0.16), not for one of two (0.20)
    one, other = "a b c d e f g h i j k", "a b m n o p q r s t u"
    two = [words_of(1, one, ["x"]), words_of(2, other, ["x"])]
    assert group_cycle(pd.DataFrame(two))["cluster_id"].nunique() == 1
    assert group_cycle(pd.DataFrame([*two[:1], words_of(3, one, ["x"]), words_of(4, other, ["x"])]))["cluster_id"].tolist() == ["c_1", "c_1", "c_4"]


def test_names_miss_short_ones(spark):
    assert values(spark, T.names, "Xi meets BRICS in New Delhi as The Hague waits") == [["new delhi", "the hague"]]


FILED = [("delhi", "IN", "c:del", "IN"), ("india", "", "n:in", "IN"), ("hyderabad", "", "c:hyd", "IN"), ("hyderabad", "IN", "c:hyd", "IN"), ("london", "GB", "c:lon", "GB"), ("london", "CA", "c:ldn", "CA"), ("sao paulo", "BR", "c:sp", "BR"), ("karnataka", "IN", "a:ka", "IN")]


def found(spark, *texts, ends=False):
    """Place and country of (said, given, prefer)."""
    aliases = spark.createDataFrame(FILED, "alias string, filed string, place string, country string")
    countries = spark.createDataFrame([("india", "IN")], "alias string, named string")
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "id int, said string, given string, prefer string")
    return [(r.place, r.country) for r in gazetteer.resolve(rows, aliases, countries, ends).orderBy("id").collect()]


def test_a_city_is_the_same_with_its_country_behind_it(spark):
    assert found(spark, ("Delhi", None, None), ("Delhi, India", None, None), ("New Town, Delhi, India", None, None)) == [("c:del", "IN")] * 3
    # the last part first, if the ends are asked
    assert found(spark, ("Delhi, India", None, None), ends=True) == [("n:in", "IN")]


def test_a_name_of_several_countries(spark):
    assert found(spark, ("Hyderabad", None, None), ("Hyderabad", "IN", None), ("Hyderabad", "PK", None)) == [("c:hyd", "IN"), ("c:hyd", "IN"), ("c:hyd", "PK")]
    assert found(spark, ("London", None, None), ("London", None, "CA"), ("London", "GB", "CA"), ("London", "FR", None)) == [(None, None), ("c:ldn", "CA"), ("c:lon", "GB"), (None, "FR")]
    assert found(spark, ("São  Paulo!", None, None), ("", "IN", None), (None, None, "IN"), (" , ", "GB", None)) == [("c:sp", "BR"), (None, "IN"), (None, None), (None, "GB")]


def test_countries_and_placeholders(spark):
    assert values(spark, gazetteer.iso, " uk", "in", "IND", "", None) == ["GB", "IN", None, None, None]
    aliases = spark.createDataFrame(FILED, "alias string, filed string, place string, country string")
    rows = [(1, "Delhi", "Karnataka", "London", None, "CA"), (2, "null", "Karnataka", "London", None, "CA"), (3, " N/A ", None, "London", None, "CA"), (4, "Nowhere", None, None, None, "CA"), (5, None, None, None, "FR", "CA")]
    got = gazetteer.cascade(spark.createDataFrame(rows, "id int, city string, region string, place string, given string, prefer string"), aliases, spark.createDataFrame([("india", "IN")], "alias string, named string"))
    assert [(r.place, r.country) for r in got.orderBy("id").collect()] == [("c:del", "IN"), ("a:ka", "IN"), ("c:ldn", "CA"), (None, "CA"), (None, "FR")]


def test_agreement_of_two_raters(spark):
    from pressweave.operators.upkeep import agreement

    rows = [("x", 1, 1), ("x", 2, 2), ("x", 1, 2), ("x", 3, 1), ("y", 4, 4), ("y", 4, 4), (None, 5, 1), ("x", None, 1)]
    got = {r.band: (r.n, r.exact, r.near, r.kappa) for r in agreement(spark.createDataFrame(rows, "band string, a int, b int")).collect()}
    # by hand: chance is (2*2 + 1*2 + 1*0) / 16 in x; in y all agree by chance alone
    assert got["x"] == (4, 0.5, 0.75, pytest.approx((0.5 - 0.375) / 0.625)) and got["y"] == (2, 1.0, 1.0, None)
    assert got[None][0] == 7 and got[None][1] == pytest.approx(4 / 7)


def test_changed_keys_of_all_days_without_those_gone_on_any_day(spark, tmp_path):
    days = [(1, "purchase", 0), (1, "purchase", 0), (2, "purchase", 29), (2, "error", 0), (3, "purchase", 29), (4, "view", 29), (5, "error", 29)]
    rows = [(k, START + timedelta(days=day), user, kind) for k, (user, kind, day) in enumerate(days)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = of_spark(selection.dirty_minus_buried(spark, str(tmp_path)))
    assert got[1] == {(1,): 1, (3,): 1}
    assert got == of_duckdb(registry.ORACLES["dirty_minus_buried"].replace("events", f"read_parquet('{tmp_path}/events.parquet/*.parquet')"), str(tmp_path))
