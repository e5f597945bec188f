"""Queues and checks of summaries, trends, and places beside a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.headlines import BRIEF, BUNDLE, CHORE
from ..operators import selecting
from ..operators.ranking import rank
from ..sources.adapter import News
from .feeds import DESKS as DESK_WEIGHT
from .feeds import HOME, INSIDE, MACRO_PATTERN, PICKED, RANK, newest
from .grouping import NAME_SQL
from .registry import query
from .stories import articles as story_articles
from .texts import TOKENS_SQL, documents, term_counts

#: Fixed value: words too common to say that two headlines share a subject.
FILLER = ["with", "from", "after", "over", "into", "about", "amid", "says", "their", "this", "that", "have", "will", "what", "when", "more", "than", "first", "new"]
#: A trend is what so many characters of an item of the benchmark say; an item stands for a line that trends elsewhere.
TREND_CHARS = 40
TREND_WORDS_SQL = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9''-]{{3,}}')), lambda x: x NOT IN (" + ", ".join(f"'{w}'" for w in FILLER) + "))"
#: What makes a headline a chore in RE2's terms, postings aside, which no first line here is.
CHORE_SQL = "|".join((CHORE, BRIEF, BUNDLE)).replace("'", "''")
#: Outlets' desks that are categories of their own; any other becomes Others.
DESKS = ["src0", "src1", "src2", "src3"]
LEAST_CRUX, LEAST_BODY, PER_SOURCE, QUEUE, RING, NEARBY = 40, 800, 3, 36, 60, 200


@query("WITH " + TOKENS_SQL + " SELECT doc_id, term, round(1 + ln(n), 6) AS weight FROM tf", False)
def term_freq(spark, sf_dir):
    """The damped frequency of each term of an article."""
    return term_counts(documents(spark, sf_dir)).select("doc_id", "term", F.round(1 + F.log("n"), 6).alias("weight"))


def trend_words(text: Column) -> Column:
    """Distinct lower-cased words of four characters and more that carry a topic."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'-]{3,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, FILLER)))


def trending(titles: DataFrame, trends: DataFrame) -> DataFrame:
    """(doc_id) of titles (doc_id, w: words) that share two words, or the only one, with one of trends (trend, w: words); they meet by word."""
    wanted = trends.select("trend", F.least(F.lit(2), F.size("w")).alias("need"), F.explode("w").alias("word"))
    met = titles.select("doc_id", F.explode("w").alias("word")).join(wanted, "word").groupBy("doc_id", "trend", "need").agg(F.count("*").alias("n"))
    return met.where("n >= need").select("doc_id").distinct()


@query(f"""WITH w AS (SELECT doc_id, {TREND_WORDS_SQL.format("left(split_part(coalesce(text, ''), chr(10), 1), 90)")} AS w FROM documents),
t AS (SELECT {TREND_WORDS_SQL.format(f"left(text, {TREND_CHARS})")} AS t FROM benchmark), hit AS (SELECT DISTINCT doc_id FROM w JOIN t ON len(t) > 0 AND len(list_intersect(w, t)) >= least(2, len(t)))
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, doc_id IN (SELECT doc_id FROM hit) AS trending FROM w""", False)
def trend_match(spark, sf_dir):
    """Headlines that share two words, or the only one, with what trends; null texts have no words."""
    title = F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(90))
    titles = documents(spark, sf_dir).select("doc_id", F.explode(F.array(trend_words(title))).alias("w"))
    trends = News(spark, sf_dir).table("benchmark").select(F.col("item_id").alias("trend"), F.explode(F.array(trend_words(F.left("text", F.lit(TREND_CHARS))))).alias("w"))
    hits = trending(titles, trends).withColumn("hit", F.lit(True))
    return titles.join(hits, "doc_id", "left").select("doc_id", F.size("w").cast("long").alias("words"), F.coalesce("hit", F.lit(False)).alias("trending"))


@query("""WITH c AS (SELECT l_orderkey AS id, l_suppkey AS source, l_shipdate, l_returnflag, min(l_shipdate) OVER (PARTITION BY l_orderkey) AS first_at FROM lineitem),
g AS (SELECT id, count(*) FILTER (WHERE l_returnflag = 'R') AS attempts, count(DISTINCT source) FILTER (WHERE l_shipdate <= first_at + INTERVAL 30 DAY) AS tried_with, count(DISTINCT source) AS sources FROM c GROUP BY id)
SELECT id, tried_with, sources, CASE WHEN sources > tried_with THEN 0 ELSE attempts END AS attempts FROM g""", False)
def attempt_reset(spark, sf_dir):
    """L1: a story that has more outlets than when it was last tried may be tried anew."""
    rows = News(spark, sf_dir).articles()
    first = F.min("published_at").over(Window.partitionBy("cluster_id"))
    early = F.col("published_at") <= F.col("first_at") + F.expr("INTERVAL 30 DAYS")
    seen = rows.withColumn("first_at", first).groupBy(F.col("cluster_id").alias("id"), "source_id").agg(
        F.count_if("prominent").alias("tries"), F.max(early).alias("early")
    )
    grown = seen.groupBy("id").agg(F.sum("tries").alias("attempts"), F.count_if("early").alias("tried_with"), F.count("*").alias("sources"))
    return grown.select("id", "tried_with", "sources", F.when(F.col("sources") > F.col("tried_with"), 0).otherwise(F.col("attempts")).alias("attempts"))


@query(rf"""WITH t AS (SELECT doc_id, source, trim(left(split_part(coalesce(text, ''), chr(10), 1), 90)) AS headline, left(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')), 600) AS lead FROM documents),
c AS (SELECT *, regexp_extract(lead, '(?s)^(.*[.!?])', 1) AS crux FROM t)
SELECT doc_id, headline <> '' AND length(crux) >= {LEAST_CRUX} AS valid, CASE WHEN source IN ({", ".join(f"'{x}'" for x in DESKS)}) THEN source ELSE 'Others' END AS category, CAST(length(crux) AS BIGINT) AS crux_length FROM c""", False)
def summary_validate(spark, sf_dir):
    """A summary needs a headline and whole sentences of 40 characters and more; an unknown or missing category becomes Others."""
    text = F.coalesce("text", F.lit(""))
    lead = F.left(F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b]+", " ")), F.lit(600))
    rows = documents(spark, sf_dir).select("doc_id", "source", F.trim(F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(90))).alias("headline"), F.regexp_extract(lead, "(?s)^(.*[.!?])", 1).alias("crux"))
    valid = (F.col("headline") != "") & (F.length("crux") >= LEAST_CRUX)
    return rows.select("doc_id", valid.alias("valid"), F.when(F.col("source").isin(DESKS), F.col("source")).otherwise("Others").alias("category"), F.length("crux").cast("long").alias("crux_length"))


@query(f""", one AS (SELECT cluster_id FROM full_articles JOIN clusters c ON cluster_id = c.id WHERE NOT written GROUP BY cluster_id HAVING count(DISTINCT source_id) = 1),
fit AS (SELECT id, cluster_id, source_id, published_at FROM full_articles JOIN one USING (cluster_id), as_of WHERE body_length > {LEAST_BODY} AND published_at >= t - INTERVAL 360 DAY AND published_at <= t - INTERVAL 120 DAY),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, id) AS r FROM fit),
quota AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id) AS k FROM best WHERE r = 1)
SELECT id, cluster_id, source_id FROM quota WHERE k <= {PER_SOURCE} ORDER BY published_at DESC, id LIMIT {QUEUE}""")
def single_queue(spark, sf_dir):
    """L3, O5, W5 without heat: unwritten stories of one outlet with a long body, settled but not old, newest first, three for each outlet and 36 in all (stretched from hours to days)."""
    news = News(spark, sf_dir)
    now = news.table("orders").agg(F.max("o_orderdate").alias("now"))
    unwritten = news.table("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("cluster_id"))
    rows = news.full_articles().join(unwritten, "cluster_id", "left_semi")
    one = rows.groupBy("cluster_id").agg(F.min("source_id").alias("a"), F.max("source_id").alias("b")).where("a = b").select("cluster_id")
    inside = F.col("published_at").between(F.col("now") - F.expr("INTERVAL 360 DAYS"), F.col("now") - F.expr("INTERVAL 120 DAYS"))
    fit = rows.where(F.col("body_length") > LEAST_BODY).crossJoin(F.broadcast(now)).where(inside).join(one, "cluster_id", "left_semi")
    order = [F.desc("published_at"), F.asc("id")]
    best = fit.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where("r = 1")
    quota = best.withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).where(F.col("k") <= PER_SOURCE)
    return quota.orderBy(*order).limit(QUEUE).select("id", "cluster_id", "source_id")


@query(f"""WITH p AS (SELECT c_custkey AS id, c_nationkey AS nation, n_regionkey AS region, c_acctbal AS size FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT root, id, place FROM (SELECT n_nationkey AS root, id, row_number() OVER (PARTITION BY n_nationkey ORDER BY size DESC, id) AS place FROM nation JOIN p ON n_regionkey = region AND n_nationkey <> nation) WHERE place <= {RING}""", False)
def place_adjacent(spark, sf_dir):
    """The 60 largest places of each nation's region outside that nation. Each nation's own 60 are found first, so that rings meet only those."""
    news = News(spark, sf_dir)
    nation = news.table("nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    largest = Window.partitionBy("nation").orderBy(F.desc("c_acctbal"), "c_custkey")
    places = news.table("customer").withColumnRenamed("c_nationkey", "nation").withColumn("r", F.row_number().over(largest)).where(F.col("r") <= RING)
    places = places.join(nation, "nation").select("region", "nation", F.col("c_custkey").alias("id"), "c_acctbal")
    ring = nation.select(F.col("nation").alias("root"), "region").join(places, "region").where("root <> nation")
    w = Window.partitionBy("root").orderBy(F.desc("c_acctbal"), "id")
    return ring.withColumn("place", F.row_number().over(w)).where(F.col("place") <= RING).select("root", "id", "place")


@query(""", votes AS (SELECT cluster_id, source_country AS country, count(*) AS n, min(id) AS first_id FROM full_articles GROUP BY 1, 2),
mode AS (SELECT cluster_id, country FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first_id, country) AS r FROM votes) WHERE r = 1),
placed AS (SELECT o_orderkey AS id, CASE WHEN c_acctbal >= 0 THEN n_name END AS country FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT p.id, coalesce(p.country, m.country) AS country FROM placed p LEFT JOIN mode m ON p.id = m.cluster_id""")
def country_backfill(spark, sf_dir):
    """A story's country from its place (customers in debt stand for stories without one), else the one most of its outlets are in, the first seen of equals, then the first by name."""
    news = News(spark, sf_dir)
    votes = news.full_articles().groupBy("cluster_id", "source_country").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    mode = votes.groupBy("cluster_id").agg(F.min_by("source_country", F.struct(-F.col("n"), "first_id", "source_country")).alias("outlets"))
    placed = news.table("customer").join(news.table("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("n_name")).alias("place"))
    rows = news.table("orders").join(placed, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "place")
    return rows.join(mode, F.col("id") == F.col("cluster_id"), "left").select("id", F.coalesce("place", "outlets").alias("country"))


@query(f", pool AS (SELECT * FROM live WHERE country = '{HOME}' ORDER BY last_seen DESC, id LIMIT {NEARBY}) SELECT id, round({RANK}, 6) AS score FROM pool")
def local_feed_subtree(spark, sf_dir):
    """the latest 200 live stories of all places under one root, ranked as feed_rank ranks them."""
    pool = News(spark, sf_dir).live().where(F.col("country") == HOME).orderBy(*newest()).limit(NEARBY)
    return pool.select("id", F.round(rank(PICKED, HOME, INSIDE, MACRO_PATTERN, DESK_WEIGHT), 6).alias("score")).orderBy(F.desc("score"), "id")


#: Hours of the queue of single stories over documents that come every ten minutes.
FRESH, SETTLED, HEAT, SHARE = 120, 12, 160, 5
SINGLES_SQL = rf"""arts AS (SELECT doc_id AS id, source, left(split_part(coalesce(text, ''), chr(10), 1), 90) AS title, CASE WHEN length(text) > 240 THEN left(text, 8000) END AS body, TIMESTAMP '2024-01-01' + to_minutes(doc_id * 10) AS t FROM documents),
now AS (SELECT max(t) AS t FROM arts), state AS (SELECT arts.id, coalesce(quality, 0) = 1 AS written, 3 * coalesce(toxic, 0) AS attempts FROM arts LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = arts.id),
shaped AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '{T.PERIODIC}', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS shape FROM arts),
shapes AS (SELECT source, shape FROM shaped, now WHERE shaped.t >= now.t - INTERVAL 7 DAY GROUP BY 1, 2 HAVING count(DISTINCT shaped.t::DATE) >= 3),
named AS (SELECT id, source, t, unnest({NAME_SQL.format("title")}) AS name FROM arts), outs AS (SELECT DISTINCT name, source FROM named, now WHERE named.t >= now.t - INTERVAL {HEAT} HOUR),
w AS (SELECT id, {TREND_WORDS_SQL.format("title")} AS w FROM arts), tr AS (SELECT {TREND_WORDS_SQL.format(f"left(text, {TREND_CHARS})")} AS t FROM benchmark),
hot AS (SELECT DISTINCT id FROM w JOIN tr ON len(t) > 0 AND len(list_intersect(w, t)) >= least(2, len(t))),
spent AS (SELECT source, count(*) AS n FROM arts JOIN state USING (id), now WHERE written AND arts.t >= now.t - INTERVAL 24 HOUR GROUP BY source),
cand AS (SELECT s.id, s.source, s.t, hot.id IS NOT NULL AS hot, coalesce((SELECT count(DISTINCT o.source) FROM named a JOIN outs o ON o.name = a.name WHERE a.id = s.id AND o.source <> s.source), 0) AS heat
 FROM shaped s JOIN state USING (id) JOIN now ON s.t >= now.t - INTERVAL {FRESH} HOUR AND s.t <= now.t - INTERVAL {SETTLED} HOUR LEFT JOIN hot ON hot.id = s.id
 WHERE NOT written AND attempts < 3 AND length(coalesce(body, '')) > 800 AND NOT regexp_matches(title, '{CHORE_SQL}') AND (source, shape) NOT IN (SELECT (source, shape) FROM shapes))"""


@query(f"""WITH {SINGLES_SQL}, r AS (SELECT cand.*, row_number() OVER (PARTITION BY cand.source ORDER BY hot DESC, heat DESC, t DESC, id) AS r, greatest(0, {SHARE} - coalesce(n, 0)) AS allowance FROM cand LEFT JOIN spent USING (source))
SELECT row_number() OVER (ORDER BY hot DESC, heat DESC, t DESC, id) AS position, id, source, hot, heat FROM r WHERE r <= allowance ORDER BY position LIMIT 36""", False)
def worth_writing_queue(spark, sf_dir):
    """Stories of one outlet to be written up next. Documents are stories of their own; labelled good ones are written, toxic ones were tried three times."""
    labels = News(spark, sf_dir).table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = story_articles(spark, sf_dir).withColumn("cluster_id", F.col("id").cast("string"))
    state = rows.select("id", "cluster_id", "source_id", "published_at").join(labels, F.col("id") == F.col("doc_id"), "left")
    clusters = state.select(F.col("cluster_id").alias("id"), (F.coalesce("quality", F.lit(0)) == 1).alias("written"), F.lit(1).alias("source_count"), (3 * F.coalesce("toxic", F.lit(0))).alias("attempts"))
    now = F.lit(rows.agg(F.max("published_at")).first()[0]).cast("timestamp")
    trends = News(spark, sf_dir).table("benchmark").select(F.col("item_id").alias("trend"), F.explode(F.array(trend_words(F.left("text", F.lit(TREND_CHARS))))).alias("w"))
    hot = trending(rows.select(F.col("id").alias("doc_id"), F.explode(F.array(trend_words(F.col("title")))).alias("w")), trends).withColumnRenamed("doc_id", "id")
    spent = state.where((F.col("quality") == 1) & selecting.ago(now, 24)).groupBy("source_id").agg(F.count("*").alias("n"))
    allowance = rows.select("source_id").distinct().join(spent, "source_id", "left").select("source_id", F.greatest(F.lit(0).cast("long"), SHARE - F.coalesce("n", F.lit(0))).alias("allowance"))
    queue = selecting.worth_writing(rows, clusters, hot, allowance, now, FRESH, SETTLED, HEAT)
    return queue.select("position", "id", F.col("source_id").alias("source"), "hot", "heat")
