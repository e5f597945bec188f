"""Feeds, sections, facets and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import CANDIDATES, breadth, rank, recency
from ..sources.adapter import News
from .registry import query

PICKED, HOME = ["AUTOMOBILE", "BUILDING"], "ASIA"
#: Place ids a reader has picked, with all that lie inside; desks that weigh more or less; the lens of stories that move markets.
INSIDE, DESKS, MACRO = [8, 9, 12], {"MACHINERY": 2.0, "BUILDING": 2.0, "FURNITURE": 0.2}, ["nation_1", "nation_4", "nation_9"]
MACRO_PATTERN = f"(?:^|[^a-z0-9])(?:{'|'.join(MACRO)})(?:[^a-z0-9]|$)"
RANK = f"""0.5 ** (age_hours / 480) * (0.5 + 0.1 * importance) * CASE WHEN place_id IN {tuple(INSIDE)} THEN 1.15::DOUBLE ELSE
 greatest(CASE WHEN category IN {tuple(PICKED)} THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END, CASE WHEN country = '{HOME}' THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END) END
 * (1 + 0.5 * least(1.0::DOUBLE, prominence / 2.0::DOUBLE)) * CASE WHEN regexp_matches(lower(topic), '{MACRO_PATTERN}') THEN 1 + 0.25 * least(1.0::DOUBLE, source_count / 6.0::DOUBLE) ELSE 1 END
 * CASE category {" ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in DESKS.items())} ELSE 1 END"""
BREADTH = "(0.35::DOUBLE + 0.65::DOUBLE * least(1.0::DOUBLE, ln(1 + source_count) / ln(25)))"
POOL = "pool AS (SELECT * FROM live ORDER BY last_seen DESC, id LIMIT 150)"


def newest() -> list:
    """Latest first, ties by id; a function, as columns can't be made before there is a session."""
    return [F.desc("last_seen"), F.asc("id")]


@query(f", {POOL} SELECT id, category, round({RANK}, 6) AS score FROM pool")
def feed_rank(spark, sf_dir):
    """F1, O1: the ranked feed of the latest 150 live stories."""
    pool = News(spark, sf_dir).live().orderBy(*newest()).limit(CANDIDATES)
    return pool.select("id", "category", F.round(rank(PICKED, HOME, INSIDE, MACRO_PATTERN, DESKS), 6).alias("score")).orderBy(F.desc("score"), "id")


@query(f", {POOL} SELECT id, round({RANK} * {BREADTH}, 6) AS score FROM pool")
def feed_cold_start(spark, sf_dir):
    """rank times breadth, for readers without known categories."""
    pool = News(spark, sf_dir).live().orderBy(*newest()).limit(CANDIDATES)
    return pool.select("id", F.round(rank(PICKED, HOME, INSIDE, MACRO_PATTERN, DESKS) * breadth(F.col("source_count")), 6).alias("score"))


@query("SELECT id FROM live ORDER BY last_seen DESC, id LIMIT 150")
def feed_candidates_top150(spark, sf_dir):
    """O1: the candidate cut before scoring."""
    return News(spark, sf_dir).live().orderBy(*newest()).limit(CANDIDATES).select("id")


@query("SELECT id, CAST(importance AS BIGINT) AS importance FROM live WHERE category = 'BUILDING' ORDER BY importance DESC, last_seen DESC, id LIMIT 48")
def section_topic(spark, sf_dir):
    """A topic section."""
    return News(spark, sf_dir).live().where("category = 'BUILDING'").orderBy(F.desc("importance"), *newest()).limit(48).select("id", F.col("importance").cast("long").alias("importance"))


@query("SELECT id FROM live WHERE country = 'ASIA' ORDER BY importance DESC, last_seen DESC, id LIMIT 48")
def section_national(spark, sf_dir):
    return News(spark, sf_dir).live().where(F.col("country") == HOME).orderBy(F.desc("importance"), *newest()).limit(48).select("id")


@query("SELECT id FROM live WHERE country <> 'ASIA' ORDER BY last_seen DESC, importance DESC, id LIMIT 48")
def section_international(spark, sf_dir):
    return News(spark, sf_dir).live().where(F.col("country") != HOME).orderBy(F.desc("last_seen"), F.desc("importance"), "id").limit(48).select("id")


@query("SELECT id, category FROM live WHERE category NOT IN ('MACHINERY', 'FURNITURE')")
def section_hidden(spark, sf_dir):
    """Without hidden categories; an empty list hides nothing."""
    hidden = ["MACHINERY", "FURNITURE"]
    rows = News(spark, sf_dir).live()
    return (rows.where(~F.col("category").isin(hidden)) if hidden else rows).select("id", "category")


@query(f"SELECT id, article_count > 1 AS pictured, round(0.5 ** (age_hours / 480) * (0.5 + 0.1 * importance) * {BREADTH}, 6) AS score FROM live ORDER BY pictured DESC, score DESC, id LIMIT 60")
def reels(spark, sf_dir):
    """sixty stories, those with a picture (a second article here) first, then by decayed score."""
    score = recency(F.col("age_hours")) * (0.5 + 0.1 * F.col("importance")) * breadth(F.col("source_count"))
    rows = News(spark, sf_dir).live().select("id", (F.col("article_count") > 1).alias("pictured"), F.round(score, 6).alias("score"))
    return rows.orderBy(F.desc("pictured"), F.desc("score"), "id").limit(60)


@query("SELECT s.id, a.id AS article_id, a.name FROM live s JOIN full_articles a ON a.cluster_id = s.id WHERE s.source_count = 1 AND a.body_length > 800")
def single_reports(spark, sf_dir):
    """Stories of one outlet with a long article."""
    n = News(spark, sf_dir)
    return n.live().where("source_count = 1").select("id").join(n.full_articles().where("body_length > 800").select(F.col("id").alias("article_id"), "cluster_id", "name"), F.col("id") == F.col("cluster_id")).select("id", "article_id", "name")


@query("SELECT category, count(*) AS n, CAST(sum(source_count) AS BIGINT) AS sources FROM live GROUP BY category")
def facet_category(spark, sf_dir):
    """A11."""
    return News(spark, sf_dir).live().groupBy("category").agg(F.count("*").alias("n"), F.sum("source_count").alias("sources"))


@query("SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY importance DESC, source_count DESC, last_seen DESC, id) AS r FROM live) WHERE r = 1")
def facet_category_lead(spark, sf_dir):
    """The leading story of each category."""
    w = Window.partitionBy("category").orderBy(F.desc("importance"), F.desc("source_count"), *newest())
    return News(spark, sf_dir).live().withColumn("r", F.row_number().over(w)).where("r = 1").select("category", "id")


@query("SELECT topic, country, count(*) AS n FROM live GROUP BY topic, country ORDER BY n DESC, topic LIMIT 10")
def facet_place_topn(spark, sf_dir):
    """A12."""
    return News(spark, sf_dir).live().groupBy("topic", "country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query(""", o AS (SELECT cluster_id, name, min(id) AS first_id, min(published_at) AS first_at FROM full_articles GROUP BY cluster_id, name)
SELECT cluster_id, string_agg(name, ',' ORDER BY first_at, name) AS outlets, count(*) AS n FROM o GROUP BY cluster_id""")
def outlets_per_cluster(spark, sf_dir):
    """Outlets of each cluster in order of their first article."""
    first = News(spark, sf_dir).full_articles().groupBy("cluster_id", "name").agg(F.min("published_at").alias("first_at"))
    ordered = F.array_sort(F.collect_list(F.struct("first_at", "name")))
    return first.groupBy("cluster_id").agg(F.array_join(ordered["name"], ",").alias("outlets"), F.count("*").alias("n"))


@query(""", b AS (SELECT DISTINCT cluster_id, name, bias FROM full_articles),
corpus AS (SELECT count(*) FILTER (bias = 'left') AS c_left, count(*) FILTER (bias = 'centre') AS c_centre, count(*) FILTER (bias = 'right') AS c_right FROM sources WHERE tier <> 'title'),
n AS (SELECT cluster_id, count(*) FILTER (bias = 'left') AS n_left, count(*) FILTER (bias = 'centre') AS n_centre, count(*) FILTER (bias = 'right') AS n_right, count(*) AS rated FROM b GROUP BY cluster_id)
SELECT n.*, CASE WHEN rated < 5 THEN NULL WHEN n_left / rated >= 0.75 THEN 'left' WHEN n_centre / rated >= 0.75 THEN 'centre' WHEN n_right / rated >= 0.75 THEN 'right' END AS dominant,
 rated >= 5 AND n_left = 0 AND c_left >= 5 AS no_left, rated >= 5 AND n_centre = 0 AND c_centre >= 5 AS no_centre, rated >= 5 AND n_right = 0 AND c_right >= 5 AS no_right FROM n, corpus""")
def coverage_split(spark, sf_dir):
    """Outlets by side, the dominant side, and the sides that are silent though five and more outlets of theirs are read."""
    news = News(spark, sf_dir)
    outlets = news.full_articles().select("cluster_id", "name", "bias").distinct()
    sides = ["left", "centre", "right"]
    n = outlets.groupBy("cluster_id").agg(*[F.count(F.when(F.col("bias") == s, 1)).alias(f"n_{s}") for s in sides], F.count("*").alias("rated"))
    enough = F.col("rated") >= 5
    dominant = F.coalesce(*[F.when(enough & (F.col(f"n_{s}") / F.col("rated") >= 0.75), s) for s in sides])
    corpus = news.sources().where("tier <> 'title'").agg(*[F.count_if(F.col("bias") == s).alias(f"c_{s}") for s in sides])
    silent = {f"no_{s}": enough & (F.col(f"n_{s}") == 0) & (F.col(f"c_{s}") >= 5) for s in sides}
    return n.crossJoin(F.broadcast(corpus)).withColumns({"dominant": dominant} | silent).drop(*[f"c_{s}" for s in sides])


@query(""", v AS (SELECT cluster_id, source_country, count(*) AS n, min(id) AS first_id FROM full_articles GROUP BY 1, 2)
SELECT cluster_id, source_country FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_id, source_country) AS r FROM v) WHERE r = 1""")
def outlet_country_mode(spark, sf_dir):
    """Most frequent country of a cluster's outlets, the first seen among equals."""
    votes = News(spark, sf_dir).full_articles().groupBy("cluster_id", "source_country").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return votes.groupBy("cluster_id").agg(F.min_by("source_country", F.struct(-F.col("n"), "first_id", "source_country")).alias("source_country"))


@query(", lead AS (SELECT * FROM live ORDER BY last_seen DESC, id LIMIT 1) SELECT l.id FROM live l JOIN lead ON l.category = lead.category AND l.id <> lead.id ORDER BY l.last_seen DESC, l.id LIMIT 6")
def related_six(spark, sf_dir):
    """O9."""
    live = News(spark, sf_dir).live()
    lead = live.orderBy(*newest()).limit(1).select(F.col("category").alias("of"), F.col("id").alias("lead"))
    return live.join(F.broadcast(lead), (F.col("category") == F.col("of")) & (F.col("id") != F.col("lead"))).orderBy(*newest()).limit(6).select("id")


@query("SELECT id, lead(id) OVER (PARTITION BY category ORDER BY last_seen DESC, id) AS next_id FROM live")
def next_story(spark, sf_dir):
    """W7. A category's stories are sorted day by day, and the last of a day is followed by the first of the next day that has one, so that no task holds a category."""
    live = News(spark, sf_dir).live().select("id", "category", "last_seen", F.to_date("last_seen").alias("day"))
    inside = F.lead("id").over(Window.partitionBy("category", "day").orderBy(*newest()))
    firsts = live.groupBy("category", "day").agg(F.max_by("id", F.struct("last_seen", -F.col("id"))).alias("first"))
    # a row for each day of a category
    ahead = firsts.select("category", "day", F.lead("first").over(Window.partitionBy("category").orderBy(F.desc("day"))).alias("ahead"))
    return live.withColumn("inside", inside).join(ahead, ["category", "day"]).select("id", F.coalesce("inside", "ahead").alias("next_id"))


@query(""", s AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY importance DESC, last_seen DESC, id) AS pos FROM live),
n AS (SELECT id, 'national' AS category, row_number() OVER (ORDER BY importance DESC, last_seen DESC, id) AS pos FROM live WHERE country = 'ASIA')
SELECT id, min(category) AS section, count(*) AS n FROM (SELECT * FROM s WHERE pos <= 48 UNION ALL SELECT * FROM n WHERE pos <= 48) GROUP BY id""")
def world_bodies_dedup(spark, sf_dir):
    """The stories of all sections, once each."""
    live = News(spark, sf_dir).live()
    order = [F.desc("importance"), *newest()]
    topics = live.withColumn("pos", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where("pos <= 48").select("id", "category")
    home = live.where(F.col("country") == HOME).orderBy(*order).limit(48).select("id", F.lit("national").alias("category"))
    return topics.unionByName(home).groupBy("id").agg(F.min("category").alias("section"), F.count("*").alias("n"))


@query("SELECT id FROM live WHERE age_hours < 240")
def world_delta(spark, sf_dir):
    """bodies that changed after a stamp."""
    return News(spark, sf_dir).live().where("age_hours < 240").select("id")


@query("""SELECT id, CASE WHEN pos = 1 THEN 'lead' WHEN importance >= 3 THEN 'stack' ELSE 'row' END AS variant
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY last_seen DESC, id) AS pos FROM live)""")
def card_variant(spark, sf_dir):
    """P19. Only the first story of a category is looked for, by a partial aggregate; no category is sorted in one task."""
    live = News(spark, sf_dir).live().select("id", "category", "importance", "last_seen")
    first = live.groupBy(F.col("category").alias("of")).agg(F.max_by("id", F.struct("last_seen", -F.col("id"))).alias("lead"))
    variant = F.when(F.col("id") == F.col("lead"), "lead").when(F.col("importance") >= 3, "stack").otherwise("row")
    return live.join(first, F.col("category").eqNullSafe(F.col("of"))).select("id", variant.alias("variant"))


@query(""", n AS (SELECT topic, count(*) AS n, max(last_seen) AS latest FROM live GROUP BY topic) SELECT CASE WHEN n >= 2 THEN topic ELSE 'Also today' END AS band, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1""")
def bands(spark, sf_dir):
    """Bands of two stories and more, the rest together."""
    n = News(spark, sf_dir).live().groupBy("topic").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") >= 2, F.col("topic")).otherwise("Also today").alias("band")).agg(F.sum("n").alias("n"))


@query("SELECT count(*) || '-' || coalesce(max(epoch_ms(last_seen)), 0) AS stamp FROM live")
def story_stamp(spark, sf_dir):
    """A21."""
    return News(spark, sf_dir).live().agg(F.concat_ws("-", F.count("*"), F.coalesce(F.max(F.unix_millis(F.col("last_seen").cast("timestamp"))), F.lit(0))).alias("stamp"))


@query("SELECT (SELECT count(*) FROM articles) AS articles, (SELECT count(*) FROM clusters) AS clusters, (SELECT count(*) FROM clusters WHERE written) AS written, (SELECT count(*) FROM sources) AS outlets")
def stats_row(spark, sf_dir):
    """A20."""
    n = News(spark, sf_dir)
    a = n.articles().agg(F.count("*").alias("articles"))
    c = n.clusters().agg(F.count("*").alias("clusters"), F.count_if("written").alias("written"))
    return a.crossJoin(c).crossJoin(n.sources().agg(F.count("*").alias("outlets")))


@query("SELECT DISTINCT country FROM live")
def countries_with_news(spark, sf_dir):
    """A19."""
    return News(spark, sf_dir).live().select("country").distinct()


@query("SELECT id, list_aggregate(list_filter([CASE WHEN country = 'ASIA' THEN 'national' END, CASE WHEN country <> 'ASIA' THEN 'international' END, CASE WHEN place_id < 5 THEN 'local' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS scopes FROM live")
def scope_lenses(spark, sf_dir):
    """Overlapping scopes of a story."""
    found = F.array(F.when(F.col("country") == HOME, "national"), F.when(F.col("country") != HOME, "international"), F.when(F.col("place_id") < 5, "local"))
    return News(spark, sf_dir).live().select("id", F.array_join(F.filter(found, lambda x: x.isNotNull()), ",").alias("scopes"))


@query("SELECT topic, count(*) AS n FROM live GROUP BY topic HAVING count(*) >= 3 ORDER BY n DESC, topic LIMIT 5")
def dynamic_topic_pills(spark, sf_dir):
    """A17."""
    return News(spark, sf_dir).live().groupBy("topic").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "topic").limit(5)


@query("SELECT topic, count(*) AS n, max(epoch_ms(last_seen)) AS latest FROM live GROUP BY topic ORDER BY n DESC, latest DESC, topic LIMIT 40")
def recent_topics(spark, sf_dir):
    """A10."""
    return News(spark, sf_dir).live().groupBy("topic").agg(F.count("*").alias("n"), F.max(F.unix_millis(F.col("last_seen").cast("timestamp"))).alias("latest")).orderBy(F.desc("n"), F.desc("latest"), "topic").limit(40)


@query("SELECT id, source_count, article_count FROM stories WHERE NOT written AND source_count >= 2 ORDER BY source_count DESC, article_count DESC, id LIMIT 40")
def summary_queue(spark, sf_dir):
    """O4."""
    return News(spark, sf_dir).stories().where("NOT written AND source_count >= 2").orderBy(F.desc("source_count"), F.desc("article_count"), "id").limit(40).select("id", "source_count", "article_count")


@query("SELECT e.user_id, e.event_id AS cluster_id, s.category FROM events e JOIN stories s ON s.id = e.event_id WHERE e.event_type = 'purchase' AND s.written")
def saved_list(spark, sf_dir):
    """J6, F14."""
    n = News(spark, sf_dir)
    saved = n.table("events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("cluster_id"))
    return saved.join(n.clusters().where("written"), F.col("cluster_id") == F.col("id")).select("user_id", "cluster_id", "category")


@query("SELECT place_id, count(*) AS n FROM live GROUP BY place_id", True)
def local_feed_counts(spark, sf_dir):
    return News(spark, sf_dir).live().groupBy("place_id").agg(F.count("*").alias("n"))
