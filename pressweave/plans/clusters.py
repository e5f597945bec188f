"""Recounts, incremental maintenance and selection over clusters and articles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.adapter import News
from .registry import query


@query("""SELECT s.id, CASE WHEN written THEN epoch_ms(last_seen) ELSE coalesce(epoch_ms(latest), 0) END AS seen, article_count, source_count, prominence
FROM stories s LEFT JOIN (SELECT cluster_id, max(published_at) AS latest FROM full_articles GROUP BY 1) a ON a.cluster_id = s.id""")
def recount_frozen(spark, sf_dir):
    """A5: counts move for all clusters, timestamps for unwritten ones only."""
    n = News(spark, sf_dir)
    seen = F.when(F.col("written"), F.unix_millis(F.col("last_seen").cast("timestamp"))).otherwise(F.coalesce(F.unix_millis(F.col("latest").cast("timestamp")), F.lit(0)))
    return n.stories().select("id", seen.alias("seen"), "article_count", "source_count", "prominence")


@query("SELECT id FROM clusters WHERE id NOT IN (SELECT cluster_id FROM articles)")
def empty_clusters_anti(spark, sf_dir):
    """J9."""
    n = News(spark, sf_dir)
    return n.clusters().select("id").join(n.articles().select(F.col("cluster_id").alias("id")), "id", "left_anti")


@query("SELECT DISTINCT source_id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = a.source_id AND s.tier = 'full')")
def orphans_not_exists(spark, sf_dir):
    """J10."""
    n = News(spark, sf_dir)
    return n.articles().select("source_id").distinct().join(n.sources().where("tier = 'full'").select(F.col("id").alias("source_id")), "source_id", "left_anti")


@query("SELECT id, category FROM clusters WHERE id IN (SELECT cluster_id FROM articles WHERE published_at >= TIMESTAMP '2001-06-01')")
def dirty_semi(spark, sf_dir):
    """Clusters that changed articles touch."""
    n = News(spark, sf_dir)
    dirty = n.articles().where("published_at >= timestamp '2001-06-01'").select(F.col("cluster_id").alias("id"))
    return n.clusters().join(dirty, "id", "left_semi").select("id", "category")


@query("SELECT cluster_id, id FROM articles WHERE (cluster_id, id) > (500, 5002) ORDER BY cluster_id, id LIMIT 400")
def keyset_page(spark, sf_dir):
    """One page after a composite key."""
    key = F.struct("cluster_id", "id") > F.struct(F.lit(500).cast("long"), F.lit(5002).cast("long"))
    return News(spark, sf_dir).articles().where(key).orderBy("cluster_id", "id").limit(400).select("cluster_id", "id")


@query(""", kept AS (SELECT * FROM articles WHERE published_at >= TIMESTAMP '2000-01-01') SELECT cluster_id, count(*) AS n, count(DISTINCT source_id) AS sources FROM kept GROUP BY cluster_id""")
def prune_retention(spark, sf_dir):
    """What is left after a retention cut, recounted."""
    kept = News(spark, sf_dir).articles().where("published_at >= timestamp '2000-01-01'")
    return kept.groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


@query(", gone AS (SELECT count(*) AS n FROM clusters WHERE id NOT IN (SELECT cluster_id FROM articles)) SELECT gone.n AS gone, (SELECT count(*) FROM clusters) AS total, gone.n * 10 > (SELECT count(*) FROM clusters) AS refused FROM gone")
def ghost_ratio_guard(spark, sf_dir):
    """Deletions of over a tenth are refused."""
    n = News(spark, sf_dir)
    marked = n.clusters().select("id").join(n.articles().select(F.col("cluster_id").alias("id")).distinct().withColumn("has", F.lit(1)), "id", "left")
    return marked.agg(F.count_if(F.col("has").isNull()).alias("gone"), F.count("*").alias("total")).withColumn("refused", F.col("gone") * 10 > F.col("total"))


@query("""SELECT content AS url, id, source_id FROM (SELECT a.*, row_number() OVER (PARTITION BY content ORDER BY CASE WHEN tier = 'full' THEN 0 ELSE 1 END, published_at, a.id) AS r
FROM articles a JOIN sources s ON s.id = a.source_id) WHERE r = 1""")
def tiered_url_dedupe(spark, sf_dir):
    """One article for each address, full outlets before front pages."""
    n = News(spark, sf_dir)
    tiers = n.sources().select(F.col("id").alias("of"), (F.col("tier") != "full").cast("int").alias("late"))
    w = Window.partitionBy("content").orderBy("late", "published_at", "id")
    return n.articles().join(tiers, F.col("source_id") == F.col("of")).withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("content").alias("url"), "id", "source_id")


@query("SELECT id FROM full_articles WHERE body_length <= 240 AND published_at < (SELECT max(published_at) FROM articles) ORDER BY published_at DESC, id LIMIT 200")
def retry_scan(spark, sf_dir):
    """S11."""
    n = News(spark, sf_dir)
    latest = n.articles().agg(F.max("published_at").alias("latest"))
    short = n.full_articles().where("body_length <= 240").crossJoin(F.broadcast(latest)).where("published_at < latest")
    return short.orderBy(F.desc("published_at"), "id").limit(200).select("id")


@query("SELECT cluster_id, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY body_length DESC, published_at, id) AS r FROM full_articles) WHERE r = 1")
def longest_per_source(spark, sf_dir):
    """The longest article of each outlet in a cluster."""
    w = Window.partitionBy("cluster_id", "source_id").orderBy(F.desc("body_length"), "published_at", "id")
    return News(spark, sf_dir).full_articles().withColumn("r", F.row_number().over(w)).where("r = 1").select("cluster_id", "id")


@query("SELECT cluster_id, arg_min(id, (published_at, id)) AS first_id FROM full_articles GROUP BY cluster_id")
def earliest_article(spark, sf_dir):
    """W8."""
    return News(spark, sf_dir).full_articles().groupBy("cluster_id").agg(F.min_by("id", F.struct("published_at", "id")).alias("first_id"))


@query(""", r AS (SELECT DISTINCT s.id, a.source_id, s.importance, s.age_hours FROM live s JOIN articles a ON a.cluster_id = s.id WHERE s.source_count = 1),
n AS (SELECT source_id, count(*) FILTER (age_hours <= 240) AS today, avg(importance) AS mean, count(*) AS n FROM r GROUP BY source_id)
SELECT source_id, today, greatest(0, CASE WHEN n >= 10 AND mean < 3 THEN 15 ELSE 30 END - today) AS allowance FROM n""")
def source_allowance(spark, sf_dir):
    """What is left of an outlet's 30 single stories a day (ten days here), or of 15 where ten and more of the last week (60 days) were rated below 3 on average."""
    n = News(spark, sf_dir)
    single = n.live().where("source_count = 1").select(F.col("id").alias("cluster_id"), "importance", "age_hours")
    rated = n.articles().select("cluster_id", "source_id").distinct().join(single, "cluster_id")
    per = rated.groupBy("source_id").agg(F.count_if(F.col("age_hours") <= 240).alias("today"), F.avg("importance").alias("mean"), F.count("*").alias("n"))
    share = F.when((F.col("n") >= 10) & (F.col("mean") < 3), 15).otherwise(30)
    return per.select("source_id", "today", F.greatest(F.lit(0).cast("long"), share - F.col("today")).alias("allowance"))


@query("""SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY prominent DESC, published_at DESC, id) AS r FROM full_articles WHERE body_length > 800) WHERE r <= 3""")
def quota_topk(spark, sf_dir):
    """Quotas in rank order."""
    w = Window.partitionBy("source_id").orderBy(F.desc("prominent"), F.desc("published_at"), "id")
    return News(spark, sf_dir).full_articles().where("body_length > 800").withColumn("r", F.row_number().over(w)).where("r <= 3").select("source_id", "id")


@query(""", old AS (SELECT id, category, importance FROM clusters, as_of WHERE last_seen < t - INTERVAL 30 DAY),
new AS (SELECT id, CASE WHEN written THEN category END AS category, importance FROM clusters, (SELECT min(o_orderdate) AS first FROM orders) WHERE last_seen >= first + INTERVAL 30 DAY)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'delete' ELSE 'update' END AS op FROM old a FULL JOIN new b ON a.id = b.id
WHERE a.id IS NULL OR b.id IS NULL OR a.category IS DISTINCT FROM b.category OR a.importance IS DISTINCT FROM b.importance""")
def changed_rows_nullsafe(spark, sf_dir):
    """The changed rows between the store of 30 days ago and today's, which has pruned its first 30 days and lost the categories of unwritten clusters; nulls compare as values."""
    from ..operators.sync import changes

    n = News(spark, sf_dir)
    c = n.clusters()
    first = n.table("orders").agg(F.min("o_orderdate").alias("first"))
    kept = c.crossJoin(F.broadcast(first)).where(F.col("last_seen") >= F.col("first") + F.expr("INTERVAL 30 DAYS"))
    old = c.where(F.col("last_seen") < n.as_of() - F.expr("INTERVAL 30 DAYS")).select("id", "category", "importance")
    return changes(old, kept.select("id", F.when(F.col("written"), F.col("category")).alias("category"), "importance"), ["id"]).select("id", "op")


@query(""", held AS (SELECT id, weight FROM clusters, as_of WHERE last_seen < t - INTERVAL 20 DAY),
delta AS (SELECT id, weight + 1 AS weight FROM clusters, as_of WHERE last_seen >= t - INTERVAL 30 DAY)
SELECT id, coalesce(d.weight, h.weight) AS weight FROM held h FULL JOIN delta d USING (id) JOIN (SELECT id FROM live) USING (id)""")
def delta_merge(spark, sf_dir):
    """Rows held since 20 days ago and a delta of the last 30, in which the delta wins; only ids that the orderings name, the live stories, stay."""
    n = News(spark, sf_dir)
    live = n.clusters().where("written").where(F.col("last_seen") >= n.as_of() - F.expr("INTERVAL 1440 HOURS")).select("id")
    c = n.clusters().select("id", "weight", "last_seen")
    held = c.where(F.col("last_seen") < n.as_of() - F.expr("INTERVAL 20 DAYS")).select("id", "weight")
    delta = c.where(F.col("last_seen") >= n.as_of() - F.expr("INTERVAL 30 DAYS")).select("id", (F.col("weight") + 1).alias("changed"))
    return held.join(delta, "id", "full_outer").join(live, "id", "left_semi").select("id", F.coalesce("changed", "weight").alias("weight"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY user_id", False)
def prefs_latest(spark, sf_dir):
    """the latest state of each reader."""
    return News(spark, sf_dir).table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("n"))


@query(""", n AS (SELECT count(*) AS n FROM labels), x AS (SELECT avg(CASE WHEN quality = 1 - toxic THEN 1.0::DOUBLE ELSE 0 END) AS agreed, avg(quality::DOUBLE) AS a, avg((1 - toxic)::DOUBLE) AS b FROM labels)
SELECT n.n, round(agreed, 6) AS agreed, round((agreed - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM x, n""")
def label_agreement(spark, sf_dir):
    """Exact agreement and Cohen's kappa of two labels."""
    l = News(spark, sf_dir).table("labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    x = l.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreed"), F.avg(F.col("a").cast("double")).alias("a"), F.avg(F.col("b").cast("double")).alias("b"))
    chance = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))
    return x.select("n", F.round("agreed", 6).alias("agreed"), F.round((F.col("agreed") - chance) / (1 - chance), 6).alias("kappa"))


@query("SELECT CAST(last_seen AS DATE) AS day, round(avg(CASE WHEN written THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share, count(*) AS n FROM clusters GROUP BY 1")
def summarised_share_by_day(spark, sf_dir):
    """M5."""
    return News(spark, sf_dir).clusters().groupBy(F.to_date("last_seen").alias("day")).agg(F.round(F.avg(F.col("written").cast("double")), 6).alias("share"), F.count("*").alias("n"))


@query("SELECT event_id, (hour(ts + INTERVAL 330 MINUTE) < 6 AND minute(ts + INTERVAL 330 MINUTE) >= 30) AS quiet FROM events", False)
def quiet_hours(spark, sf_dir):
    """M7: the quiet half hours of the night, five and a half hours east of UTC."""
    local = F.col("ts") + F.expr("INTERVAL 330 MINUTE")
    return News(spark, sf_dir).table("events").select("event_id", ((F.hour(local) < 6) & (F.minute(local) >= 30)).alias("quiet"))


@query("SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 40 ELSE greatest(0, least(40, floor((10000 - value * 30) / 6))) END AS BIGINT) AS lim FROM events", False)
def affordable(spark, sf_dir):
    """M9: how many summaries a budget still pays for; unknown spending leaves the limit."""
    spent = F.when(F.col("event_type") != "error", F.col("value") * 30)
    limit = F.greatest(F.lit(0), F.least(F.lit(40), F.floor((10000 - spent) / 6)))
    return News(spark, sf_dir).table("events").select("event_id", F.when(spent.isNull(), 40).otherwise(limit).cast("long").alias("lim"))
