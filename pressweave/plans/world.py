"""World, explore and drill-downs over live stories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.geo import closure
from ..operators.ranking import rank
from ..operators.world import Sub, Topic, bodies, pages, pills, scopes
from ..sources.adapter import News
from .feeds import DESKS, HOME, INSIDE, MACRO_PATTERN, PICKED, RANK, newest
from .registry import query

#: Sections over market segments; one segment has no section, and one folds into each of two others.
TOPICS = [
    Topic("vehicles", "Vehicles", ("AUTOMOBILE", "MACHINERY"), (Sub("Machinery", category="MACHINERY"), Sub("Early nations", words=("nation_1", "nation_2", "nation_3")), Sub("NATION_7", words=("no such word",)))),
    Topic("homes", "Homes", ("BUILDING", "FURNITURE"), (Sub("Furniture", category="FURNITURE"), Sub("Late nations", words=("nation_20", "nation_21", "nation_22", "nation_23")))),
]
CATEGORIES = ["AUTOMOBILE", "MACHINERY", "BUILDING", "FURNITURE", "HOUSEHOLD"]
SINCE_HOURS = 240
SLUG_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
CSLUG_SQL = "CASE WHEN category IN ('AUTOMOBILE', 'MACHINERY') THEN 'vehicles' WHEN category IN ('BUILDING', 'FURNITURE') THEN 'homes' ELSE 'household' END"
WORLD_SQL = f""", told AS (SELECT *, lower(topic || ' ' || category) AS text, last_seen + to_hours(CAST(id % 6 AS INT)) AS summarised_at, {SLUG_SQL.format("topic")} AS label, {CSLUG_SQL} AS cslug,
 list_filter([CASE WHEN place_id IN {tuple(INSIDE)} THEN 'local' END, CASE WHEN country = '{HOME}' THEN 'national' ELSE 'international' END], lambda x: x IS NOT NULL) AS scopes, round({RANK}, 9) AS score FROM live),
pg AS (SELECT * FROM (
 SELECT 'top' AS section, row_number() OVER (ORDER BY score DESC, last_seen DESC, id) AS pos, * FROM told
 UNION ALL SELECT 'national', row_number() OVER (ORDER BY importance DESC, last_seen DESC, id), * FROM told WHERE country = '{HOME}'
 UNION ALL SELECT 'international', row_number() OVER (ORDER BY last_seen DESC, importance DESC, id), * FROM told WHERE country <> '{HOME}'
 UNION ALL SELECT cslug, row_number() OVER (PARTITION BY cslug ORDER BY importance DESC, last_seen DESC, id), * FROM told WHERE cslug <> 'household') WHERE pos <= 48),
sub AS (SELECT section, id, pos, unnest(list_filter([CASE WHEN section = 'vehicles' AND category = 'MACHINERY' THEN 'machinery' END,
  CASE WHEN section = 'vehicles' AND (regexp_matches(text, '(?:^|[^a-z0-9])(?:nation_1|nation_2|nation_3)(?:[^a-z0-9]|$)') OR label = 'early-nations') THEN 'early-nations' END, CASE WHEN section = 'vehicles' AND label = 'nation-7' THEN 'nation-7' END,
  CASE WHEN section = 'homes' AND category = 'FURNITURE' THEN 'furniture' END, CASE WHEN section = 'homes' AND (regexp_matches(text, '(?:^|[^a-z0-9])(?:nation_20|nation_21|nation_22|nation_23)(?:[^a-z0-9]|$)') OR label = 'late-nations') THEN 'late-nations' END], lambda x: x IS NOT NULL)) AS slug FROM pg)"""


def told(spark, sf_dir):
    """Live stories with what the sections read: their text, scopes for a reader at home, and when they were written (some hours after they were seen last)."""
    live = News(spark, sf_dir).live()
    text = F.lower(F.concat_ws(" ", "topic", "category"))
    written = F.col("last_seen") + F.expr("make_dt_interval(0, CAST(id % 6 AS INT))")
    return live.withColumns({"text": text, "summarised_at": written, "scopes": scopes(F.col("country"), HOME, F.col("place_id").isin(INSIDE))})


def paged(spark, sf_dir):
    score = F.round(rank(PICKED, HOME, INSIDE, MACRO_PATTERN, DESKS), 9)
    return pages(told(spark, sf_dir), TOPICS, HOME, score)


@query(WORLD_SQL + " SELECT section, pos, id FROM pg")
def world_sections(spark, sf_dir):
    """The first 48 stories of every section, in one pass."""
    return paged(spark, sf_dir).select("section", "pos", "id")


@query(WORLD_SQL + """, dyn AS (SELECT section, label AS slug, count(*) AS n, arg_min(topic, pos) AS name FROM pg WHERE section IN ('vehicles', 'homes') AND NOT (section = 'vehicles' AND label = 'nation-7') GROUP BY 1, 2 HAVING count(*) >= 3),
cat AS (SELECT section, cslug AS slug, count(*) AS n, list_position(['vehicles', 'homes', 'household'], cslug) AS k FROM pg WHERE section IN ('top', 'national', 'international') GROUP BY 1, 2),
sc AS (SELECT section, s AS slug, count(*) AS n FROM (SELECT section, unnest(scopes) AS s FROM pg WHERE section = 'top') GROUP BY 1, 2),
al AS (SELECT section, 0 AS kind, r AS k, slug, name, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS r FROM dyn) WHERE r <= 5
 UNION ALL SELECT section, 1, list_position(['machinery', 'early-nations', 'nation-7', 'furniture', 'late-nations'], slug), slug, CASE slug WHEN 'machinery' THEN 'Machinery' WHEN 'early-nations' THEN 'Early nations' WHEN 'nation-7' THEN 'NATION_7' WHEN 'furniture' THEN 'Furniture' ELSE 'Late nations' END, count(*) FROM sub GROUP BY section, slug
 UNION ALL SELECT section, 2, list_position(['local', 'national', 'international'], slug), slug, CASE slug WHEN 'local' THEN 'City' WHEN 'national' THEN 'National' ELSE 'World' END, n FROM sc
 UNION ALL SELECT section, 3, k, slug, CASE slug WHEN 'vehicles' THEN 'Vehicles' WHEN 'homes' THEN 'Homes' ELSE slug END, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, k) AS r FROM cat) WHERE r <= 5)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY kind, k) AS pos, slug, name, n FROM al""")
def world_pills(spark, sf_dir):
    """The pills of every section with their counts: labels, folded categories and words; scopes and categories."""
    return pills(paged(spark, sf_dir), TOPICS, CATEGORIES)


@query(WORLD_SQL + f""", one AS (SELECT DISTINCT ON (id) * FROM pg), mine AS (SELECT id, list(DISTINCT slug) AS slugs FROM sub GROUP BY id)
SELECT one.id, cslug, array_to_string(list_sort(list_distinct(list_concat(scopes, CASE WHEN cslug <> 'household' THEN list_concat(coalesce(own, []), [label]) ELSE [] END))), ',') AS subs,
 last_seen > t - to_hours({SINCE_HOURS}) OR summarised_at > t - to_hours({SINCE_HOURS}) AS changed FROM one CROSS JOIN as_of LEFT JOIN (SELECT told.id, list_filter([CASE WHEN category = 'MACHINERY' THEN 'machinery' WHEN category = 'FURNITURE' THEN 'furniture' END,
 CASE WHEN cslug = 'vehicles' AND regexp_matches(text, '(?:^|[^a-z0-9])(?:nation_1|nation_2|nation_3)(?:[^a-z0-9]|$)') THEN 'early-nations' END, CASE WHEN cslug = 'homes' AND regexp_matches(text, '(?:^|[^a-z0-9])(?:nation_20|nation_21|nation_22|nation_23)(?:[^a-z0-9]|$)') THEN 'late-nations' END], lambda x: x IS NOT NULL) AS own FROM told) m ON m.id = one.id""")
def world_bodies(spark, sf_dir):
    """The stories of all sections once each, their section, the pills they are behind, and whether a reader of ten days ago lacks them, by either of their clocks."""
    since = News(spark, sf_dir).as_of() - F.expr(f"INTERVAL {SINCE_HOURS} HOURS")
    rows = bodies(paged(spark, sf_dir), TOPICS, since)
    return rows.select("id", "cslug", F.array_join(F.array_sort("subs"), ",").alias("subs"), "changed")


@query(WORLD_SQL + """, n AS (SELECT section, slug, count(*) AS n FROM sub GROUP BY 1, 2 UNION ALL SELECT section, slug, n FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, name) AS r FROM (SELECT section, label AS slug, count(*) AS n, arg_min(topic, pos) AS name FROM pg
 WHERE section IN ('vehicles', 'homes') AND NOT (section = 'vehicles' AND label = 'nation-7') GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE r <= 5)
SELECT section, slug, n, row_number() OVER (ORDER BY n DESC, section, slug) AS pos FROM n""")
def explore_subjects(spark, sf_dir):
    """F16: the pills of all topic sections as tiles, those of most stories first."""
    found = pills(paged(spark, sf_dir), TOPICS, CATEGORIES).where(F.col("section").isin([t.slug for t in TOPICS]))
    # a few pills of each section
    tiles = found.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "section", "slug"))), lambda x, i: F.struct(x["section"].alias("section"), x["slug"].alias("slug"), (-x["less"]).alias("n"), (i + 1).alias("pos"))).alias("t"))
    return tiles.select(F.explode("t").alias("t")).select("t.section", "t.slug", "t.n", "t.pos")


HERE = [3, 90]


@query(f""", f AS (SELECT place_id, count(*) AS n FROM live GROUP BY place_id), here AS (SELECT unnest({HERE}) AS place_id, unnest(range(0, {len(HERE)})) AS k),
rest AS (SELECT place_id, n, row_number() OVER (ORDER BY n DESC, place_id) AS k FROM f WHERE place_id NOT IN (SELECT place_id FROM here))
SELECT place_id, n, row_number() OVER (ORDER BY grp, k) AS pos FROM (SELECT h.place_id, coalesce(n, 0) AS n, 0 AS grp, k FROM here h LEFT JOIN f USING (place_id) UNION ALL SELECT place_id, n, 1, k FROM rest WHERE k <= 10)""")
def explore_places(spark, sf_dir):
    """Place tiles, where the reader's own lead even without a story, then the ten of most stories."""
    facets = News(spark, sf_dir).live().groupBy("place_id").agg(F.count("*").alias("n"))
    here = spark.createDataFrame([(p, k) for k, p in enumerate(HERE)], "place_id int, k long")
    lead = here.join(facets, "place_id", "left").select("place_id", F.coalesce("n", F.lit(0)).alias("n"), F.struct(F.lit(0).alias("group"), "k", F.lit(0).cast("int").alias("by")).alias("at"))
    rest = facets.join(here, "place_id", "left_anti").orderBy(F.desc("n"), "place_id").limit(10).select("place_id", "n", F.struct(F.lit(1).alias("group"), (-F.col("n")).alias("k"), F.col("place_id").alias("by")).alias("at"))
    tiles = lead.union(rest).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "place_id", "n"))), lambda x, i: F.struct(x["place_id"].alias("place_id"), x["n"].alias("n"), (i + 1).alias("pos"))).alias("t"))
    return tiles.select(F.explode("t").alias("t")).select("t.*")


@query(", r AS (SELECT category, country, id, row_number() OVER (PARTITION BY category ORDER BY importance DESC, last_seen DESC, id) AS by_category, row_number() OVER (PARTITION BY country ORDER BY importance DESC, last_seen DESC, id) AS by_country FROM live) SELECT 'category' AS kind, category AS value, by_category AS pos, id FROM r WHERE by_category <= 40 UNION ALL SELECT 'country', country, by_country, id FROM r WHERE by_country <= 40")
def drill_down(spark, sf_dir):
    """F8: the forty stories behind each tile of a category or a country, as the sections order them."""
    live = News(spark, sf_dir).live()
    tiles = F.explode(F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")), F.struct(F.lit("country").alias("kind"), F.col("country").alias("value")))).alias("tile")
    rows = live.select("id", "importance", "last_seen", tiles)
    order = Window.partitionBy("tile").orderBy(F.desc("importance"), *newest())
    return rows.withColumn("pos", F.row_number().over(order)).where("pos <= 40").select("tile.kind", "tile.value", "pos", "id")


@query(""", up AS (SELECT n_nationkey AS id, 'r' || n_regionkey AS root FROM nation UNION ALL SELECT n_nationkey, 'n' || n_nationkey FROM nation)
SELECT root, pos, id FROM (SELECT root, s.id, row_number() OVER (PARTITION BY root ORDER BY last_seen DESC, s.id) AS pos FROM live s JOIN up ON up.id = s.place_id) WHERE pos <= 40""")
def drill_down_place(spark, sf_dir):
    """The forty latest stories in each place or below it."""
    news = News(spark, sf_dir)
    tree = news.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")).union(news.table("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    held = news.live().select(F.concat(F.lit("n"), "place_id").alias("at"), F.col("id").alias("story"), "last_seen")
    rows = closure(tree).join(held, F.col("id") == F.col("at"))
    order = Window.partitionBy("root").orderBy(F.desc("last_seen"), "story")
    return rows.withColumn("pos", F.row_number().over(order)).where("pos <= 40").select("root", "pos", F.col("story").alias("id"))
