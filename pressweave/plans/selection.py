"""Selection rules: addresses, titles, topics, lenses, scopes, images, claims and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.headlines import BRIEF, BUNDLE, CHORE, NOT_POSTING, POSTING
from ..sources.adapter import News
from .registry import query
from .texts import STOP_SQL, documents

#: Parameters of an address that only track its reader.
TRACKING = "utm_|fbclid|gclid|ref|cmp|at_|ito|smid|partner|traffic_source"
#: Letters with marks and what stands for them.
MARKED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
#: A lens's words; a story may be in several lenses.
LENSES = {"reports": ["thing", "thly", "tion"], "places": ["erin", "thea", "anea"], "matters": ["attion", "erble", "onth"]}
#: Typed terms, of places.
TYPED_TERMS = ["nation_1", "ion_7"]
SECTIONS = ["FURNITURE", "BUILDING", "HOUSEHOLD", "MACHINERY", "AUTOMOBILE"]
FEED_LINK = "url || '?utm_source=feed&id=' || page_id || CASE WHEN page_id % 3 = 0 THEN '&fbclid=x' ELSE '' END || '#top'"


def normalise_address(url: Column) -> Column:
    """T5: without fragment, tracking parameters, leading www. and one trailing slash; what is no address stays as it is."""
    plain = F.regexp_replace(url, "#.*$", "")
    plain = F.regexp_replace(plain, f"(?i)([?&])(?:{TRACKING})[^&]*", "$1")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "&&+", "&"), r"\?&", "?"), "[?&]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(https?://)www\.", "$1"), "/$", "")
    return F.when(url.rlike("^https?://[^/]"), plain).otherwise(url)


@query(f"""WITH l AS (SELECT page_id, {FEED_LINK} AS link FROM pages),
p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(link, '#.*$', ''), '([?&])(?:{TRACKING})[^&]*', '\\1', 'gi'), '&&+', '&', 'g'), '\\?&', '?', 'g'), '[?&]+$', '') AS u, link FROM l)
SELECT page_id, CASE WHEN regexp_matches(link, '^https?://[^/]') THEN regexp_replace(regexp_replace(u, '^(https?://)www\\.', '\\1'), '/$', '') ELSE link END AS url FROM p""", False)
def normalise_url(spark, sf_dir):
    """T5 over page addresses as a feed would link them."""
    return News(spark, sf_dir).table("pages").select("page_id", normalise_address(F.expr(FEED_LINK)).alias("url"))


@query("""SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) || ':' || right(translate(rtrim(base64(encode(url)), '='), '+/', '-_'), 24) AS id FROM pages""", False)
def article_ids(spark, sf_dir):
    """Outlet and the last 24 characters of the address in URL-safe base64."""
    safe = F.translate(F.regexp_replace(F.base64(F.col("url").cast("binary")), "[=\r\n]", ""), "+/", "-_")
    return News(spark, sf_dir).table("pages").select("page_id", F.concat(F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)), F.lit(":"), F.right(safe, F.lit(24))).alias("id"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS flat, left(split_part(coalesce(text, ''), chr(10), 1), 90) AS headline FROM documents)
SELECT doc_id, headline, left(flat, 600) AS lead, regexp_extract(left(flat, 600), '(?s)^(.*[.!?])', 1) AS whole, lower(headline || ' ' || left(flat, 600)) AS search_text FROM t""", False)
def article_texts(spark, sf_dir):
    """Headline, lead of 600 characters, the lead up to its last full sentence, and the text that searches look at."""
    flat = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r\f\x0b]+", " "))
    rows = documents(spark, sf_dir).select("doc_id", F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(90)).alias("headline"), F.left(flat, F.lit(600)).alias("lead"))
    return rows.select("doc_id", "headline", "lead", F.regexp_extract("lead", "(?s)^(.*[.!?])", 1).alias("whole"), F.lower(F.concat_ws(" ", "headline", "lead")).alias("search_text"))


@query(f"""SELECT doc_id, trim(regexp_replace(lower(translate(split_part(coalesce(text, ''), chr(10), 1), '{MARKED}', '{PLAIN}')), '[^a-z0-9]+', ' ', 'g')) AS alias FROM documents""", False)
def alias_normalise(spark, sf_dir):
    """Marks off, lower case, one space for whatever is no letter or digit."""
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return documents(spark, sf_dir).select("doc_id", F.trim(F.regexp_replace(F.lower(F.translate(title, MARKED, PLAIN)), "[^a-z0-9]+", " ")).alias("alias"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""WITH t AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents UNION ALL SELECT -p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'How to ' || p_name WHEN 1 THEN 'HT Morning Brief: ' || p_name
 WHEN 2 THEN p_name || ' & More' WHEN 3 THEN 'Ann Lee Appointed Acme VP of ' || p_name ELSE 'Ann Lee Named CEO and Director of ' || p_name END FROM part)
SELECT doc_id, regexp_matches(title, {_quoted(CHORE)}) OR regexp_matches(title, {_quoted(BRIEF)}) OR regexp_matches(title, {_quoted(BUNDLE)}) OR (regexp_matches(title, {_quoted(POSTING)}) AND NOT regexp_matches(title, {_quoted(NOT_POSTING)})) AS routine FROM t""", False)
def routine_predicate(spark, sf_dir):
    """P14 without the recurrent shapes, which routine_shapes finds: headlines of chores, briefs, bundles and postings."""
    news = News(spark, sf_dir)
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    name, kind = F.col("p_name"), F.col("p_partkey") % 5
    made = F.when(kind == 0, F.concat(F.lit("How to "), name)).when(kind == 1, F.concat(F.lit("HT Morning Brief: "), name)).when(kind == 2, F.concat(name, F.lit(" & More")))
    made = made.when(kind == 3, F.concat(F.lit("Ann Lee Appointed Acme VP of "), name)).otherwise(F.concat(F.lit("Ann Lee Named CEO and Director of "), name))
    titles = documents(spark, sf_dir).select("doc_id", title.alias("title")).union(news.table("part").select(-F.col("p_partkey"), made))
    t = F.col("title")
    return titles.select("doc_id", (t.rlike(CHORE) | t.rlike(BRIEF) | t.rlike(BUNDLE) | (t.rlike(POSTING) & ~t.rlike(NOT_POSTING))).alias("routine"))


@query(r"""WITH t AS (SELECT p_partkey, p_type, p_brand, trim(regexp_replace(regexp_replace(trim(regexp_replace(p_type || CASE p_partkey % 3 WHEN 0 THEN ' .' WHEN 1 THEN ':' ELSE '' END, ' +', ' ', 'g')), '[.:;,]+$', ''), ' +$', '')) AS topic FROM part)
SELECT p_partkey, CASE WHEN topic = '' OR length(topic) > 32 OR len(string_split(topic, ' ')) > 4 OR lower(topic) IN ('none', 'unknown', 'n/a', 'null', 'other') OR lower(topic) = lower(p_brand) THEN NULL ELSE topic END AS topic FROM t""", False)
def topic_clean(spark, sf_dir):
    """Topic labels without trailing stops; placeholders, categories, and labels of over 32 characters or four words become null."""
    raw = F.concat("p_type", F.when(F.col("p_partkey") % 3 == 0, " .").when(F.col("p_partkey") % 3 == 1, ":").otherwise(""))
    topic = F.trim(F.regexp_replace(F.trim(F.regexp_replace(raw, " +", " ")), "[.:;,]+$", ""))
    rows = News(spark, sf_dir).table("part").select("p_partkey", "p_brand", topic.alias("topic"))
    bad = (F.col("topic") == "") | (F.length("topic") > 32) | (F.size(F.split("topic", " ")) > 4) | F.lower("topic").isin("none", "unknown", "n/a", "null", "other") | (F.lower("topic") == F.lower("p_brand"))
    return rows.select("p_partkey", F.when(~bad, F.col("topic")).alias("topic"))


@query("""WITH c AS (SELECT n_nationkey, upper(trim(CASE n_nationkey % 4 WHEN 0 THEN 'uk ' WHEN 1 THEN left(n_name, 2) WHEN 2 THEN n_name ELSE '1' || left(n_name, 1) END)) AS code FROM nation)
SELECT n_nationkey, CASE WHEN code = 'UK' THEN 'GB' WHEN regexp_matches(code, '^[A-Z]{2}$') THEN code END AS country FROM c""", False)
def iso_countries(spark, sf_dir):
    """Two-letter country codes, UK as GB; anything else is null."""
    kind = F.col("n_nationkey") % 4
    raw = F.when(kind == 0, "uk ").when(kind == 1, F.left("n_name", F.lit(2))).when(kind == 2, F.col("n_name")).otherwise(F.concat(F.lit("1"), F.left("n_name", F.lit(1))))
    rows = News(spark, sf_dir).table("nation").select("n_nationkey", F.upper(F.trim(raw)).alias("code"))
    return rows.select("n_nationkey", F.when(F.col("code") == "UK", "GB").when(F.col("code").rlike("^[A-Z]{2}$"), F.col("code")).alias("country"))


def _lens(words: list[str]) -> str:
    return f"(?i)(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)"


@query(" UNION ALL ".join(f"SELECT '{name}' AS lens, count(*) AS n FROM documents WHERE regexp_matches(text, '{_lens(words)}') HAVING count(*) > 0" for name, words in LENSES.items()), False)
def keyword_lens_counts(spark, sf_dir):
    """Stories by lens; one scan looks through all lenses, and a story counts in each that it matches."""
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(_lens(words)), F.lit(name)) for name, words in LENSES.items()]), lambda x: x.isNotNull())
    return documents(spark, sf_dir).select(F.explode(hits).alias("lens")).groupBy("lens").agg(F.count("*").alias("n"))


@query(f"""SELECT category, n, list_position({SECTIONS}, category) AS position FROM (SELECT category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, category) AS r FROM live GROUP BY category) WHERE r <= 3""")
def scope_pills(spark, sf_dir):
    """The sections of most stories, back in their declared order."""
    counts = News(spark, sf_dir).live().groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(3)
    return counts.select("category", "n", F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("category")).cast("int").alias("position"))


@query("""SELECT id, list_filter([CASE WHEN country = 'ASIA' AND place_id IN (8, 9, 12) THEN 'local' END, CASE WHEN country = 'ASIA' THEN 'national' END, CASE WHEN country <> 'ASIA' OR source_count >= 6 THEN 'international' END], lambda x: x IS NOT NULL) AS scopes FROM live""")
def story_scopes(spark, sf_dir):
    """The scopes of a story, of which it may have several."""
    home = F.col("country") == "ASIA"
    scopes = F.array(F.when(home & F.col("place_id").isin(8, 9, 12), "local"), F.when(home, "national"), F.when(~home | (F.col("source_count") >= 6), "international"))
    return News(spark, sf_dir).live().select("id", F.filter(scopes, lambda x: x.isNotNull()).alias("scopes"))


IMAGE = "CASE l_linenumber % 3 WHEN 0 THEN 'http://img.example/' ELSE 'https://img.example/' END || l_partkey || CASE l_linenumber % 4 WHEN 1 THEN '-thumb.jpg' WHEN 2 THEN '.svg' WHEN 3 THEN '.gif' ELSE '.jpg' END || '?w=' || CAST(l_quantity * 60 AS BIGINT)"


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {IMAGE} AS image FROM lineitem),
s AS (SELECT *, least(24.0::DOUBLE, coalesce(TRY_CAST(regexp_extract(image, '[?&]w=([0-9]+)', 1) AS DOUBLE), 0) / 100) - CASE WHEN image LIKE '%thumb%' THEN 8 ELSE 0 END - CASE WHEN image LIKE '%.svg%' THEN 8 ELSE 0 END - CASE WHEN image LIKE '%.gif%' THEN 4 ELSE 0 END - CASE WHEN image LIKE 'https:%' THEN 0 ELSE 1 END AS score FROM i)
SELECT l_orderkey AS cluster_id, image, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, image DESC) AS r FROM s) WHERE r = 1""", False)
def image_score_best(spark, sf_dir):
    """Each cluster's best image by declared width and kind, the first of equals; a partial aggregate, no window."""
    rows = News(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", F.expr(IMAGE).alias("image"))
    width = F.least(F.lit(24.0), F.coalesce(F.expr("try_cast(regexp_extract(image, '[?&]w=([0-9]+)', 1) AS double)"), F.lit(0.0)) / 100)
    minus = lambda mark, n: F.when(F.col("image").contains(mark), n).otherwise(0)
    score = width - minus("thumb", 8) - minus(".svg", 8) - minus(".gif", 4) - F.when(F.col("image").startswith("https:"), 0).otherwise(1)
    best = rows.groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.max_by(F.struct("image", score.alias("score")), F.struct(score, -F.col("l_linenumber"), F.col("image"))).alias("best"))
    return best.select("cluster_id", "best.image", F.round("best.score", 4).alias("score"))


@query(r"""WITH n AS (SELECT DISTINCT doc_id, source, name FROM (SELECT doc_id, source, unnest(list_transform(regexp_extract_all(text, '\b([A-Z][a-z’''-]{2,}(?:\s+[A-Z][a-z’''-]{2,})*)\b', 1), lambda w: lower(w))) AS name FROM documents) WHERE name NOT IN """ + STOP_SQL + """)
SELECT d.doc_id, count(DISTINCT b.source) AS heat FROM documents d LEFT JOIN n a ON a.doc_id = d.doc_id LEFT JOIN n b ON a.name = b.name AND b.source <> d.source GROUP BY d.doc_id""", False)
def entity_heat(spark, sf_dir):
    """How many other outlets share a name with an article. Each name carries its set of outlets, so a frequent name joins once with each of its articles, not with each other."""
    names = documents(spark, sf_dir).select("doc_id", "source", F.explode_outer(T.names(F.col("text"))).alias("name"))
    outlets = names.where("name IS NOT NULL").groupBy("name").agg(F.collect_set("source").alias("outlets"))
    met = names.join(outlets, "name", "left").select("doc_id", "source", F.explode_outer("outlets").alias("other"))
    return met.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("other") != F.col("source"), F.col("other"))).alias("heat"))


@query("""WITH votes AS (SELECT l_orderkey AS cluster_id, l_suppkey AS wanted, count(*) AS votes FROM lineitem GROUP BY 1, 2), members AS (SELECT l_orderkey AS cluster_id, count(*) AS members FROM lineitem GROUP BY 1),
mine AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, wanted) AS r FROM votes JOIN members USING (cluster_id))
SELECT wanted, cluster_id, votes FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY votes DESC, members DESC, cluster_id) AS k FROM mine WHERE r = 1) WHERE k = 1""", False)
def id_claims(spark, sf_dir):
    """Each group wants the former id of most of its members; of several groups that want one id, the most votes, then the most members win."""
    rows = News(spark, sf_dir).articles()
    votes = rows.groupBy("cluster_id", F.col("source_id").alias("wanted")).agg(F.count("*").alias("votes"))
    wish = votes.groupBy("cluster_id").agg(F.sum("votes").alias("members"), F.max_by(F.struct("wanted", "votes"), F.struct("votes", -F.col("wanted"))).alias("x"))
    return wish.groupBy("x.wanted").agg(F.max_by(F.struct("cluster_id", "x.votes"), F.struct("x.votes", "members", -F.col("cluster_id"))).alias("y")).select("wanted", "y.cluster_id", "y.votes")


@query("""SELECT r_regionkey AS root, 'region' AS kind, r_regionkey AS id FROM region UNION ALL SELECT n_regionkey, 'nation', n_nationkey FROM nation UNION ALL SELECT n_regionkey, 'city', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey""", False)
def place_subtree(spark, sf_dir):
    """Every place under each root, itself included, by one equi join for each level."""
    news = News(spark, sf_dir)
    nation = news.table("nation").select("n_nationkey", "n_regionkey")
    top = news.table("region").select(F.col("r_regionkey").alias("root"), F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"))
    cities = news.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.lit("city"), F.col("c_custkey").cast("long"))
    return top.union(nation.select("n_regionkey", F.lit("nation"), F.col("n_nationkey").cast("long"))).union(cities)


CITY_AT = "(c_custkey * 37 % 1700) / 10.0 - 85", "(c_custkey * 91 % 3590) / 10.0 - 179.5"
NATION_AT = "(n_nationkey * 67 % 17) * 10.0 - 80", "(n_nationkey * 29 % 35) * 10.0 - 170"
APART = "2 * 6371 * asin(least(1.0, sqrt(power(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * power(sin(radians(b_lon - a_lon) / 2), 2))))"


@query(f"""WITH a AS (SELECT c_custkey, {CITY_AT[0]} AS a_lat, {CITY_AT[1]} AS a_lon FROM customer), b AS (SELECT n_nationkey, {NATION_AT[0]} AS b_lat, {NATION_AT[1]} AS b_lon FROM nation),
d AS (SELECT c_custkey, n_nationkey, {APART} AS km FROM a JOIN b ON abs(a_lat - b_lat) <= 14)
SELECT c_custkey, n_nationkey, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, n_nationkey) AS r FROM d WHERE km <= 1500) WHERE r = 1""", False)
def place_nearest(spark, sf_dir):
    """The nearest reference place within 1,500 km by the haversine distance. Places meet in bands of 14 degrees of latitude by an equi join, which is exact, as 1,500 km are under 14 degrees."""
    news = News(spark, sf_dir)
    a = news.table("customer").select("c_custkey", F.expr(CITY_AT[0]).cast("double").alias("a_lat"), F.expr(CITY_AT[1]).cast("double").alias("a_lon"))
    b = news.table("nation").select("n_nationkey", F.expr(NATION_AT[0]).cast("double").alias("b_lat"), F.expr(NATION_AT[1]).cast("double").alias("b_lon"))
    band = lambda c: F.floor(F.col(c) / 14)
    b = b.withColumn("band", F.explode(F.array(band("b_lat") - 1, band("b_lat"), band("b_lat") + 1)))
    near = a.withColumn("band", band("a_lat")).join(b, "band").withColumn("km", F.expr(APART)).where("km <= 1500")
    best = near.groupBy("c_custkey").agg(F.min(F.struct("km", "n_nationkey")).alias("x"))
    return best.select("c_custkey", "x.n_nationkey", F.round("x.km", 3).alias("km"))


@query("""WITH p AS (SELECT 0 AS kind, r_name AS name, 0.0 AS population FROM region UNION ALL SELECT 1, n_name, n_nationkey * 10.0 FROM nation UNION ALL SELECT 2, c_name, c_acctbal FROM customer)
SELECT name, kind FROM p WHERE lower(name) LIKE '%a%' ORDER BY kind, lower(name) LIKE 'a%' DESC, population DESC, name LIMIT 20""", False)
def place_search(spark, sf_dir):
    """The first twenty places for a search, by kind, prefix, population and name."""
    news = News(spark, sf_dir)
    places = news.table("region").select(F.lit(0).alias("kind"), F.col("r_name").alias("name"), F.lit(0.0).alias("population"))
    places = places.union(news.table("nation").select(F.lit(1), "n_name", F.col("n_nationkey") * 10.0)).union(news.table("customer").select(F.lit(2), "c_name", "c_acctbal"))
    found = places.where(F.lower("name").contains("a"))
    return found.orderBy("kind", F.desc(F.lower("name").startswith("a")), F.desc("population"), "name").limit(20).select("name", "kind")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, min(event_id) AS position FROM events GROUP BY user_id""", False)
def outlet_dedupe(spark, sf_dir):
    """of rows of one key, the last one's value at the first one's place."""
    return News(spark, sf_dir).table("events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min("event_id").alias("position"))


@query("""SELECT a.id FROM articles a LEFT JOIN clusters c ON a.cluster_id = c.id WHERE c.id IS NULL OR NOT c.written""")
def grouping_candidates(spark, sf_dir):
    """Articles without a cluster or in one that isn't written yet."""
    news = News(spark, sf_dir)
    c = news.table("orders").select(F.col("o_orderkey").alias("cluster_id"), (F.col("o_orderstatus") != "P").alias("written"))
    return news.articles().join(c, "cluster_id", "left").where("written IS NULL OR NOT written").select("id")


@query("""SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING max(l_shipdate) >= TIMESTAMP '1999-01-01' AND max(l_shipdate) <= TIMESTAMP '1999-03-01'""", False)
def settled_window(spark, sf_dir):
    """Clusters whose latest article lies in a closed range."""
    last = News(spark, sf_dir).articles().groupBy(F.col("cluster_id").alias("id")).agg(F.max("published_at").alias("t"))
    return last.where("t >= TIMESTAMP_NTZ '1999-01-01' AND t <= TIMESTAMP_NTZ '1999-03-01'").select("id")


@query("""SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem""", False)
def ghost_ids(spark, sf_dir):
    """Ids of one store that the other doesn't have."""
    news = News(spark, sf_dir)
    return news.table("orders").select(F.col("o_orderkey").alias("id")).distinct().join(news.table("lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""", False)
def dirty_minus_buried(spark, sf_dir):
    """Changed keys without those that are gone."""
    events = News(spark, sf_dir).table("events")
    return events.where("event_type = 'purchase'").select("user_id").distinct().join(events.where("event_type = 'error'"), "user_id", "left_anti")


@query("""SELECT pos, doc_id, length(text) AS n FROM (SELECT unnest(range(1, 21)) AS pos, unnest(list_transform(range(1, 21), lambda i: i * 7 % 50)) AS wanted) JOIN documents ON doc_id = wanted""", False)
def ordered_bodies(spark, sf_dir):
    """Bodies of a list of ids, each with its place in the list."""
    wanted = spark.range(1, 21).select(F.col("id").alias("pos"), (F.col("id") * 7 % 50).alias("doc_id"))
    return documents(spark, sf_dir).join(wanted, "doc_id").select("pos", "doc_id", F.length("text").cast("long").alias("n"))


@query("""SELECT id, CASE WHEN age_hours < 1 THEN CAST(round(age_hours * 60) AS BIGINT) || 'm' WHEN age_hours < 48 THEN CAST(round(age_hours) AS BIGINT) || 'h' ELSE CAST(round(age_hours / 24) AS BIGINT) || 'd' END AS label FROM live""")
def age_labels(spark, sf_dir):
    """M6: minutes, hours or days."""
    age = F.col("age_hours")
    label = F.when(age < 1, F.concat(F.round(age * 60).cast("long").cast("string"), F.lit("m"))).when(age < 48, F.concat(F.round(age).cast("long").cast("string"), F.lit("h")))
    return News(spark, sf_dir).live().select("id", label.otherwise(F.concat(F.round(age / 24).cast("long").cast("string"), F.lit("d"))).alias("label"))


@query("""SELECT l_orderkey AS id, CAST(greatest(1, least(5, coalesce(nullif(round(CASE WHEN min(l_linenumber) > 1 THEN NULL ELSE avg(l_discount) * 100 END), 0), 3))) AS BIGINT) AS importance, round(0.16 * (1 + 0.25 * log2(count(*))), 6) AS threshold FROM lineitem GROUP BY 1""", False)
def clamped_importance(spark, sf_dir):
    """M4, M8: importance from 1 to 5, with 3 for none or zero, and the threshold that grows with a group's size.

    Means of two places often end in a half, where the last bit of a sum decides,
    so discounts are added in the order of the table's rows, however it is read.
    """
    rows = News(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_discount", "_metadata.file_path", "_metadata.row_index")
    added = F.collect_list(F.when(F.col("l_discount").isNotNull(), F.struct("file_path", "row_index", "l_discount")))
    mean = F.try_divide(F.aggregate(F.sort_array(added), F.lit(0.0), lambda total, x: total + x["l_discount"]), F.count("l_discount"))
    raw = F.round(F.when(F.min("l_linenumber") <= 1, mean * 100))
    value = F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(F.when(raw != 0, raw), F.lit(3.0)))).cast("long")
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(value.alias("importance"), F.round(0.16 * (1 + 0.25 * F.log2(F.count("*"))), 6).alias("threshold"))


@query("SELECT id, topic FROM live WHERE " + " OR ".join(f"lower(topic) LIKE '%{w}%'" for w in TYPED_TERMS))
def typed_places(spark, sf_dir):
    """P5: stories whose place holds one of the typed terms, whatever their case."""
    either = reduce(lambda a, b: a | b, [F.lower("topic").contains(w) for w in TYPED_TERMS])
    return News(spark, sf_dir).live().where(either).select("id", "topic")
