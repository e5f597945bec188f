"""Which place a text means, and which side's account of a story stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.gazetteer import cascade, resolve
from ..sources.adapter import News
from .registry import query

#: What stories say of their place, the country given beside it, and where their outlet is from, read from suppliers.
SAID_SQL = """said AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'Old Quarter, ' || n_name || ', ' || r_name WHEN 2 THEN 'P ' || n_nationkey % 10 WHEN 3 THEN 'p-' || n_nationkey % 10 || ' , ' || r_name WHEN 4 THEN r_name END AS said,
 CASE WHEN s_suppkey % 7 = 0 THEN r_name END AS given, CASE WHEN s_suppkey % 2 = 0 THEN r_name END AS prefer FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
NORMAL_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
#: Aliases under their country, or under none: nations by name and by a short name that several share, and regions.
ALIASES_SQL = """aliases AS (SELECT 'nation ' || n_nationkey AS alias, CASE WHEN n_nationkey < 10 THEN '' ELSE r_name END AS filed, 'N' || n_nationkey AS place, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'p ' || n_nationkey % 10, r_name, 'N' || n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT lower(r_name), '', 'R' || r_regionkey, r_name FROM region)"""


def filed(news):
    """Aliases as ALIASES_SQL has them."""
    places, region, nation = news.places(), F.col("r_name"), F.col("n_nationkey")
    name = F.concat(F.lit("N"), nation)
    return (
        places.select(F.concat(F.lit("nation "), nation).alias("alias"), F.when(nation < 10, "").otherwise(region).alias("filed"), name.alias("place"), region.alias("country"))
        .union(places.select(F.concat(F.lit("p "), nation % 10), region, name, region))
        .union(news.table("region").select(F.lower(region), F.lit(""), F.concat(F.lit("R"), F.col("r_regionkey")), region))
    )


@query(f"""WITH {SAID_SQL}, {ALIASES_SQL},
parts AS (SELECT *, list_filter(list_transform(string_split(said, ','), lambda x: trim(x)), lambda x: x <> '') AS segments FROM said WHERE trim(coalesce(said, '')) <> ''),
hint AS (SELECT p.*, coalesce(given, CASE WHEN len(segments) > 1 THEN r_name END) AS hinted FROM parts p LEFT JOIN region ON lower(segments[-1]) = lower(r_name)),
cand AS (SELECT id, hinted, prefer, unnest(range(0, len(c))) AS pos, unnest(c) AS c FROM (SELECT *, CASE WHEN len(segments) > 1 THEN list_prepend(said, segments) ELSE [said] END AS c FROM hint)),
hits AS (SELECT id, pos, place, country, hinted, prefer, min(CASE WHEN filed = hinted THEN 0 WHEN filed = '' THEN 1 END) AS scope FROM cand JOIN aliases ON alias = {NORMAL_SQL.format("c")} GROUP BY ALL),
scoped AS (SELECT id, arg_min((place, country), (pos, scope, place)) AS hit FROM hits WHERE scope IS NOT NULL GROUP BY id),
open AS (SELECT id, pos, CASE WHEN count(*) = 1 THEN min((place, country)) WHEN count(*) FILTER (country = prefer) = 1 THEN min((place, country)) FILTER (country = prefer) END AS hit FROM hits GROUP BY id, pos),
other AS (SELECT id, arg_min(hit, pos) AS hit FROM open WHERE hit IS NOT NULL GROUP BY id)
SELECT s.id, coalesce(scoped.hit, other.hit)[1] AS place, CASE WHEN coalesce(scoped.hit, other.hit) IS NULL THEN s.given ELSE coalesce(hint.hinted, coalesce(scoped.hit, other.hit)[2]) END AS country
FROM said s LEFT JOIN hint ON hint.id = s.id LEFT JOIN scoped ON scoped.id = s.id LEFT JOIN other ON other.id = s.id""", False)
def place_resolve(spark, sf_dir):
    """The place that a text means: the whole of it, then its parts, under the country given or named last, then under none;
    else a name of one place only; else the one place of that name in the outlet's country. A country without a place stays as given. Aliases meet texts by an equi join."""
    news = News(spark, sf_dir)
    places = news.places()
    region, nation = F.col("r_name"), F.col("n_nationkey")
    aliases = filed(news)
    kind = F.col("s_suppkey") % 6
    short = (nation % 10).cast("string")
    said = F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("Old Quarter, "), "n_name", F.lit(", "), region)).when(kind == 2, F.concat(F.lit("P "), short))
    said = said.when(kind == 3, F.concat(F.lit("p-"), short, F.lit(" , "), region)).when(kind == 4, region)
    stories = news.table("supplier").join(places, F.col("s_nationkey") == nation).select(
        F.col("s_suppkey").alias("id"), said.alias("said"), F.when(F.col("s_suppkey") % 7 == 0, region).alias("given"), F.when(F.col("s_suppkey") % 2 == 0, region).alias("prefer")
    )
    countries = news.table("region").select(F.lower(region).alias("alias"), region.alias("named"))
    return resolve(stories, aliases, countries)


@query(f"""WITH {ALIASES_SQL}, c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'Nation ' || c_nationkey END AS city, CASE WHEN c_custkey % 3 = 0 THEN 'p-' || c_nationkey % 10 END AS region, CASE WHEN c_custkey % 5 < 2 THEN 'Somewhere' ELSE r_name END AS place,
 CASE WHEN c_custkey % 7 = 0 THEN r_name END AS given, CASE WHEN c_custkey % 2 = 0 THEN r_name END AS prefer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cand AS (SELECT id, given, prefer, k, {NORMAL_SQL.format("x")} AS alias FROM (SELECT id, given, prefer, unnest([0, 1, 2]) AS k, unnest([city, region, place]) AS x FROM c) WHERE x IS NOT NULL AND x <> 'null'),
hits AS (SELECT id, k, place, country, given, prefer, min(CASE WHEN filed = given THEN 0 WHEN filed = '' THEN 1 END) AS scope FROM cand JOIN aliases USING (alias) GROUP BY ALL),
per AS (SELECT id, k, arg_min((place, country), (scope, place)) FILTER (scope IS NOT NULL) AS scoped, CASE WHEN count(*) = 1 THEN min((place, country)) WHEN count(*) FILTER (country = prefer) = 1 THEN min((place, country)) FILTER (country = prefer) END AS rest FROM hits GROUP BY id, k),
best AS (SELECT id, arg_min(coalesce(scoped, rest), k) AS hit FROM per WHERE coalesce(scoped, rest) IS NOT NULL GROUP BY id)
SELECT c.id, hit[1] AS place, coalesce(given, hit[2], prefer) AS country FROM c LEFT JOIN best USING (id)""", False)
def place_cascade(spark, sf_dir):
    """The place of a story by its city, else its region, else its place, under the country given or the outlets' own; without any, the outlets' country."""
    news = News(spark, sf_dir)
    key, region = F.col("c_custkey"), F.col("r_name")
    city = F.when(key % 4 == 0, "null").when(key % 4 == 1, F.concat(F.lit("Nation "), "c_nationkey"))
    rows = news.table("customer").join(news.places(), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("id"), city.alias("city"), F.when(key % 3 == 0, F.concat(F.lit("p-"), F.col("c_nationkey") % 10)).alias("region"), F.when(key % 5 < 2, "Somewhere").otherwise(region).alias("place"),
        F.when(key % 7 == 0, region).alias("given"), F.when(key % 2 == 0, region).alias("prefer"),
    )
    countries = news.table("region").select(F.lower(region).alias("alias"), region.alias("named"))
    return cascade(rows, filed(news), countries)


@query(""", sides AS (SELECT cluster_id, count(DISTINCT bias) AS n, bool_or(bias = 'left') AS l, bool_or(bias = 'centre') AS c, bool_or(bias = 'right') AS r FROM full_articles GROUP BY cluster_id),
f AS (SELECT id, CASE WHEN importance > 2 THEN topic || ' as the left tells it' END AS fl, CASE WHEN importance > 3 THEN topic || ' as the centre has it' END AS fc, CASE WHEN importance < 5 THEN topic END AS fr FROM live),
k AS (SELECT id, CASE WHEN length(trim(fl)) > 15 THEN trim(fl) END AS fl, CASE WHEN length(trim(fc)) > 15 THEN trim(fc) END AS fc, CASE WHEN length(trim(fr)) > 15 THEN trim(fr) END AS fr FROM f)
SELECT id, CASE WHEN l THEN CASE WHEN n = 1 THEN coalesce(fl, fc, fr) ELSE fl END END AS framing_left, CASE WHEN c THEN CASE WHEN n = 1 THEN coalesce(fc, fl, fr) ELSE fc END END AS framing_centre,
 CASE WHEN r THEN CASE WHEN n = 1 THEN coalesce(fr, fc, fl) ELSE fr END END AS framing_right FROM k LEFT JOIN sides ON id = cluster_id""")
def framing_keep(spark, sf_dir):
    """A side's account of over 15 characters stays if the side has an outlet on the story; where only one side has, any account is that side's."""
    news = News(spark, sf_dir)
    sides = ["left", "centre", "right"]
    told = {"left": F.when(F.col("importance") > 2, F.concat("topic", F.lit(" as the left tells it"))), "centre": F.when(F.col("importance") > 3, F.concat("topic", F.lit(" as the centre has it"))), "right": F.when(F.col("importance") < 5, F.col("topic"))}
    live = news.live().select("id", *[F.when(F.length(F.trim(told[s])) > 15, F.trim(told[s])).alias(s) for s in sides])
    present = news.full_articles().join(live.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").groupBy("cluster_id").agg(*[F.max(F.col("bias") == s).alias(f"has_{s}") for s in sides])
    one = sum((F.col(f"has_{s}").cast("int") for s in sides), F.lit(0)) == 1

    def kept(side: str):
        others = [s for s in ("centre", "left", "right") if s != side]
        return F.when(F.col(f"has_{side}"), F.when(one, F.coalesce(side, *others)).otherwise(F.col(side))).alias(f"framing_{side}")

    return live.join(present, F.col("id") == F.col("cluster_id"), "left").select("id", *map(kept, sides))
