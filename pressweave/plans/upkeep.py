"""Upkeep of stores, usage, horizons, and what a reader typed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upkeep
from ..operators.ranking import breadth, recency
from ..sources.adapter import News
from .feeds import BREADTH, newest
from .registry import query
from .world import WORLD_SQL, paged

#: What each kind of event may use a day, and articles' age in hours beyond which a missing body isn't asked for again (days here).
ALLOWED = {"view": 9_000.0, "click": 20_000.0, "purchase": 8_000.0}
RETRY_DAYS, RETRY_MOST = 60, 200


@query("""WITH r AS (SELECT s_suppkey AS id, 'https://feeds.example/' || s_nationkey || '/' || s_suppkey % 20 AS feed_url FROM supplier)
SELECT 'feed_url' AS kind, feed_url AS value, count(*) AS n FROM r GROUP BY feed_url HAVING count(*) > 1 UNION ALL SELECT 'id', id::VARCHAR, count(*) FROM r GROUP BY id HAVING count(*) > 1""", False)
def source_duplicates(spark, sf_dir):
    """Ids and addresses that two outlets of a registry share, for which it is refused."""
    address = F.concat(F.lit("https://feeds.example/"), "s_nationkey", F.lit("/"), F.col("s_suppkey") % 20)
    return upkeep.duplicates(News(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("id"), address.alias("feed_url")))


@query(", kept AS (SELECT id FROM clusters, as_of WHERE last_seen >= t - INTERVAL 500 DAY) SELECT CASE WHEN k.id IS NULL THEN 'released' ELSE 'held' END AS state, count(*) AS n, count(DISTINCT a.cluster_id) AS clusters FROM articles a LEFT JOIN kept k ON k.id = a.cluster_id GROUP BY 1")
def orphans_released(spark, sf_dir):
    """Articles of clusters that a store no longer has are released."""
    n = News(spark, sf_dir)
    kept = n.clusters().where(F.col("last_seen") >= n.as_of() - F.expr("INTERVAL 500 DAYS"))
    rows = n.articles().select("id", "cluster_id", F.col("cluster_id").alias("was"))
    after = upkeep.released(rows, kept)
    return after.groupBy(F.when(F.col("cluster_id").isNull(), "released").otherwise("held").alias("state")).agg(F.count("*").alias("n"), F.count_distinct("was").alias("clusters"))


@query("SELECT id, name, tier FROM sources WHERE id IN (SELECT source_id FROM articles WHERE id % 7 = 0) AND id % 2 = 1")
def missing_sources(spark, sf_dir):
    """Outlets that articles name and a store of every second outlet lacks."""
    n = News(spark, sf_dir)
    some = n.articles().where("id % 7 = 0")
    return upkeep.missing(some, "source_id", n.sources().where("id % 2 = 0"), n.sources()).select("id", "name", "tier")


@query(f"""WITH u AS (SELECT ts::DATE AS day, event_type AS kind, count(*) AS calls, sum(value) AS used FROM events GROUP BY 1, 2)
SELECT day, kind, calls, round(used, 4) AS used, round(used / a, 9) AS share, coalesce(used / a > 1, FALSE) AS over FROM (SELECT *, CASE kind {" ".join(f"WHEN '{k}' THEN {a}::DOUBLE" for k, a in ALLOWED.items())} END AS a FROM u)""", False)
def usage_totals(spark, sf_dir):
    """What each kind of event used a day, against what it may."""
    calls = News(spark, sf_dir).table("events").select("ts", F.col("event_type").alias("kind"), F.col("value").alias("used"))
    return upkeep.usage(calls, ALLOWED).select("day", "kind", "calls", F.round("used", 4).alias("used"), F.round("share", 9).alias("share"), "over")


@query("""SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d_%H-%M') AS run, count(*) AS n FROM events, (SELECT max(ts) AS latest FROM events) WHERE ts >= latest - INTERVAL 3 DAY GROUP BY 1""", False)
def run_names(spark, sf_dir):
    """Names of the runs of the last three days, by the wall clock five and a half hours east of UTC."""
    events = News(spark, sf_dir).table("events")
    latest = events.agg(F.max("ts").alias("latest"))
    kept = events.crossJoin(F.broadcast(latest)).where(F.col("ts") >= F.col("latest") - F.expr("INTERVAL 3 DAYS"))
    return kept.groupBy(upkeep.run_name(F.col("ts")).alias("run")).agg(F.count("*").alias("n"))


@query(""", h AS (SELECT a.id, list_filter([CASE WHEN published_at >= m - INTERVAL 1 DAY THEN 'feed' END, CASE WHEN published_at >= m - INTERVAL 2 DAY THEN 'sections' END, CASE WHEN published_at >= m - INTERVAL 3 DAY THEN 'ingest' END,
 CASE WHEN published_at >= m - INTERVAL 4 DAY THEN 'cluster' END, CASE WHEN published_at >= m - INTERVAL 5 DAY THEN 'hydrate' END], lambda x: x IS NOT NULL) AS seen FROM articles a, (SELECT max(published_at) AS m FROM articles)) SELECT array_to_string(seen, ',') AS seen_by, count(*) AS n FROM h GROUP BY 1""")
def nested_horizons(spark, sf_dir):
    """How many articles each step still looks at."""
    rows = News(spark, sf_dir).articles()
    latest = F.lit(rows.agg(F.max("published_at").cast("string")).first()[0]).cast(rows.schema["published_at"].dataType)
    return upkeep.horizons(rows, "published_at", latest).groupBy(F.array_join("seen_by", ",").alias("seen_by")).agg(F.count("*").alias("n"))


@query(f""", m AS (SELECT max(published_at) AS t FROM articles) SELECT a.id FROM articles a JOIN sources s ON s.id = a.source_id, m WHERE coalesce(tier, 'full') <> 'title' AND (CASE WHEN body_length > 240 THEN body_length END) IS NULL AND published_at >= t - INTERVAL {RETRY_DAYS} DAY AND published_at < t ORDER BY published_at DESC, a.id LIMIT {RETRY_MOST}""")
def retry_recent(spark, sf_dir):
    """The latest articles of outlets read in full that have no body, of a half-open range that ends now."""
    n = News(spark, sf_dir)
    tiers = n.sources().select(F.col("id").alias("of"), "tier")
    body = F.when(F.col("body_length") > 240, F.col("body_length"))
    now = n.articles().agg(F.max("published_at").alias("now"))
    rows = n.articles().where(body.isNull()).join(tiers, F.col("source_id") == F.col("of")).where(F.coalesce("tier", F.lit("full")) != "title")
    inside = rows.crossJoin(F.broadcast(now)).where((F.col("published_at") >= F.col("now") - F.expr(f"INTERVAL {RETRY_DAYS} DAYS")) & (F.col("published_at") < F.col("now")))
    return inside.orderBy(F.desc("published_at"), "id").limit(RETRY_MOST).select("id")


@query(""", p AS (SELECT c_custkey AS place_id, lower(c_name) AS name, 'town ' || c_custkey % 50 AS label, c_acctbal AS population FROM customer),
l AS (SELECT user_id AS reader, event_id AS pos, CASE event_id % 3 WHEN 0 THEN '  Town ' || event_id % 50 WHEN 1 THEN 'nowhere' ELSE (SELECT min(c_name) FROM customer) END AS label FROM events WHERE event_type = 'click'),
few AS (SELECT DISTINCT reader, lower(trim(label)) AS said FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY pos) AS r FROM l) WHERE r <= 12),
held AS (SELECT DISTINCT user_id AS reader, 1 + user_id % (SELECT count(*) FROM customer) AS place_id FROM events), n AS (SELECT place_id, population, name AS said FROM p UNION SELECT place_id, population, label FROM p),
open AS (SELECT * FROM few WHERE (reader, said) NOT IN (SELECT (held.reader, n.said) FROM held JOIN n USING (place_id)))
SELECT DISTINCT reader, place_id FROM (SELECT reader, said, arg_min(place_id, (-population, place_id)) AS place_id FROM open JOIN n USING (said) GROUP BY 1, 2)""")
def typed_labels(spark, sf_dir):
    """C14: places that readers typed by name or label, but for those whose names their own places have."""
    news = News(spark, sf_dir)
    places = news.table("customer").select(F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.concat(F.lit("Town "), F.col("c_custkey") % 50).alias("label"), F.col("c_acctbal").alias("population"))
    events, customers = news.table("events"), news.table("customer").agg(F.min("c_name").alias("least"), F.count("*").alias("n"))
    kind = F.col("event_id") % 3
    said = F.when(kind == 0, F.concat(F.lit("  Town "), F.col("event_id") % 50)).when(kind == 1, "nowhere").otherwise(F.col("least"))
    labels = events.where("event_type = 'click'").crossJoin(F.broadcast(customers)).select(F.col("user_id").alias("reader"), F.col("event_id").alias("pos"), said.alias("label"))
    held = events.crossJoin(F.broadcast(customers)).select(F.col("user_id").alias("reader"), (1 + F.col("user_id") % F.col("n")).alias("place_id")).distinct()
    return upkeep.typed(labels, places, held)


@query(f""", f AS (SELECT id, article_count > 1 AS pictured, last_seen, 0.5 ** (age_hours / 480) * (0.5 + 0.1 * importance) * {BREADTH} AS score FROM live), near AS (SELECT * FROM f ORDER BY pictured DESC, last_seen DESC, id LIMIT 100)
SELECT id, pictured, round(score, 6) AS score FROM near ORDER BY pictured DESC, round(score, 6) DESC, id LIMIT 20""")
def reels_refetched(spark, sf_dir):
    """Five times as many stories as are shown, those with a picture first and then the latest, ranked anew by score."""
    score = recency(F.col("age_hours")) * (0.5 + 0.1 * F.col("importance")) * breadth(F.col("source_count"))
    rows = News(spark, sf_dir).live().select("id", "last_seen", (F.col("article_count") > 1).alias("pictured"), F.round(score, 6).alias("score"))
    near = rows.orderBy(F.desc("pictured"), *newest()).limit(100)
    return near.orderBy(F.desc("pictured"), F.desc("score"), "id").limit(20).select("id", "pictured", "score")


@query(WORLD_SQL + """, have AS (SELECT DISTINCT id FROM pg, as_of WHERE last_seen < t - INTERVAL 20 DAY UNION SELECT DISTINCT id FROM pg, as_of WHERE last_seen > t - INTERVAL 10 DAY)
SELECT section, count(*) AS ids, count(have.id) AS bodies, count(*) > count(have.id) AS short FROM pg LEFT JOIN have USING (id) GROUP BY section""")
def sections_short(spark, sf_dir):
    """Which sections lack bodies for a reader who holds those of 20 days ago and was sent those of the last ten."""
    now = News(spark, sf_dir).as_of()
    pages = paged(spark, sf_dir)
    held = pages.where(F.col("last_seen") < now - F.expr("INTERVAL 20 DAYS")).select("id")
    delta = pages.where(F.col("last_seen") > now - F.expr("INTERVAL 10 DAYS")).select("id")
    have = held.union(delta).distinct().withColumn("has", F.lit(True))
    counts = pages.join(have, "id", "left").groupBy("section").agg(F.count("*").alias("ids"), F.count("has").alias("bodies"))
    return counts.select("section", "ids", "bodies", (F.col("ids") > F.col("bodies")).alias("short"))


@query(""", held AS (SELECT user_id AS reader, min(event_id) FILTER (event_type = 'signup') AS signed, min(event_id) FILTER (event_type = 'click') AS clicked FROM events GROUP BY user_id)
SELECT reader, coalesce(n.n_name || ', ' || r.r_name, CASE WHEN clicked IS NOT NULL THEN 'typed ' || clicked % 100 END, home.r_name) AS line FROM held LEFT JOIN nation n ON n.n_nationkey = signed % 40 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN region home ON home.r_regionkey = reader % 5""")
def place_line(spark, sf_dir):
    """What a reader's page says of where they are: their first place with its country, else what they typed, else their country."""
    news = News(spark, sf_dir)
    first = lambda kind, name: F.min(F.when(F.col("event_type") == kind, F.col("event_id"))).alias(name)
    held = news.table("events").groupBy(F.col("user_id").alias("reader")).agg(first("signup", "signed"), first("click", "clicked"))
    places = news.places().select(F.col("n_nationkey").alias("at"), F.concat_ws(", ", "n_name", "r_name").alias("named"))
    homes = news.table("region").select(F.col("r_regionkey").alias("home"), F.col("r_name").alias("country"))
    rows = held.join(places, F.col("signed") % 40 == F.col("at"), "left").join(homes, F.col("reader") % 5 == F.col("home"), "left")
    return rows.select("reader", F.coalesce("named", F.concat(F.lit("typed "), F.col("clicked") % 100), "country").alias("line"))


@query("""WITH r AS (SELECT o_orderstatus AS band, 6 - CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS a, least(5, 1 + CAST(floor(o_totalprice / 100000) AS BIGINT)) AS b FROM orders), x AS (SELECT * FROM r UNION ALL SELECT NULL, a, b FROM r),
t AS (SELECT band, count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (abs(a - b) <= 1) AS close FROM x GROUP BY band), pa AS (SELECT band, a AS v, count(*) AS n FROM x GROUP BY 1, 2), pb AS (SELECT band, b AS v, count(*) AS n FROM x GROUP BY 1, 2),
c AS (SELECT pa.band, sum(pa.n * pb.n)::DOUBLE AS met FROM pa JOIN pb ON pa.band IS NOT DISTINCT FROM pb.band AND pa.v = pb.v GROUP BY pa.band)
SELECT t.band, n, round(same / n, 6) AS exact, round(close / n, 6) AS near, round((same / n - coalesce(met, 0) / (n * n)) / (1 - coalesce(met, 0) / (n * n)), 6) AS kappa FROM t LEFT JOIN c ON t.band IS NOT DISTINCT FROM c.band""", False)
def rater_agreement(spark, sf_dir):
    """How a desk's priority and a story's size agree on a scale of five, by band and together."""
    orders = News(spark, sf_dir).table("orders")
    rows = orders.select(F.col("o_orderstatus").alias("band"), (6 - F.substring("o_orderpriority", 1, 1).cast("long")).alias("a"), F.least(F.lit(5).cast("long"), 1 + F.floor(F.col("o_totalprice") / 100000)).alias("b"))
    found = upkeep.agreement(rows)
    return found.select("band", "n", *[F.round(c, 6).alias(c) for c in ("exact", "near", "kappa")])
