"""Which place a text means, against aliases filed under countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headlines import placeholder

#: Letters with marks and what stands for them, as decomposition would leave them.
MARKED, PLAIN = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normal(alias: Column) -> Column:
    """Marks off, lower case, one space for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.translate(alias, MARKED, PLAIN)), "[^a-z0-9]+", " "))


def iso(country: Column) -> Column:
    """A two-letter code, UK as GB; null if it is none."""
    code = F.upper(F.trim(country))
    return F.when(code == "UK", "GB").when(code.rlike("^[A-Z]{2}$"), code)


def resolve(texts: DataFrame, aliases: DataFrame, countries: DataFrame, ends: bool = False) -> DataFrame:
    """(id, place, country) of texts (id, said, given, prefer): one row for each id.

    C9, J7: tried are the whole text and then its parts between commas, in order
    (with ends, C10: the whole, the last and the first). aliases (alias, filed,
    place, country) are normalised names filed under a country, or under '' for
    any; countries (alias, named) says which names are a country's. The given
    country, or the one that the last part names, comes before ''. Else a name
    of one place in all, or of one place in the country that the outlets
    prefer. A country without a place is as given; one that was given or named
    stays, though its place may lie elsewhere. Texts meet aliases by an equi join.
    """
    segments = F.filter(F.transform(F.split("said", ","), lambda x: F.trim(x)), lambda x: x != "")
    parts = texts.where(F.trim("said") != "").withColumn("segments", segments)
    several = F.size("segments") > 1
    named = countries.select(F.col("alias").alias("last"), "named")
    hinted = parts.withColumn("last", F.when(several, normal(F.element_at("segments", -1)))).join(named, "last", "left").withColumn("hinted", F.coalesce("given", "named"))
    whole = F.array(F.trim("said"))
    rest = F.array(F.element_at("segments", -1), F.element_at("segments", 1)) if ends else F.col("segments")
    tried = hinted.select("id", "hinted", "prefer", F.posexplode(F.when(several, F.concat(whole, rest)).otherwise(whole)).alias("pos", "c")).withColumn("alias", normal(F.col("c")))
    scope = F.when(F.col("filed") == F.col("hinted"), 0).when(F.col("filed") == "", 1)
    hits = tried.join(aliases, "alias").groupBy("id", "pos", "place", "country", "prefer").agg(F.min(scope).alias("scope"))
    hit, own = F.struct("place", "country"), F.col("country") == F.col("prefer")
    by_part = hits.groupBy("id", "pos").agg(
        F.min(F.when(F.col("scope").isNotNull(), F.struct("scope", "place", "country"))).alias("scoped"),
        F.count("*").alias("n"), F.min(hit).alias("only"), F.count_if(own).alias("n_own"), F.min(F.when(own, hit)).alias("own"),
    )
    left = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_own") == 1, F.col("own"))
    found = by_part.withColumn("left", left).groupBy("id").agg(
        F.min_by("scoped", F.when(F.col("scoped").isNotNull(), F.col("pos"))).alias("scoped"), F.min_by("left", F.when(F.col("left").isNotNull(), F.col("pos"))).alias("left")
    )
    place, country = F.coalesce("scoped.place", "left.place"), F.coalesce("scoped.country", "left.country")
    rows = texts.join(hinted.select("id", "hinted"), "id", "left").join(found, "id", "left")
    return rows.select("id", place.alias("place"), F.when(place.isNull(), F.col("given")).otherwise(F.coalesce("hinted", country)).alias("country"))


def cascade(stories: DataFrame, aliases: DataFrame, countries: DataFrame) -> DataFrame:
    """(id, place, country) of stories (id, city, region, place, given, prefer): C11: what the city means, else the region, else the place; a story without any country reads as its outlets' (prefer). Placeholders are no names."""
    named = [F.when(~placeholder(F.col(c)), F.trim(c)) for c in ("city", "region", "place")]
    rows = stories.select(F.col("id").alias("of"), "given", "prefer", F.posexplode(F.array(*named)).alias("k", "said")).where("said IS NOT NULL")
    found = resolve(rows.select(F.struct("of", "k").alias("id"), "said", "given", "prefer"), aliases, countries)
    best = found.groupBy(F.col("id.of").alias("of")).agg(F.min_by(F.struct("place", "country"), F.struct(F.col("place").isNull(), F.col("id.k"))).alias("x"))
    joined = stories.join(best, F.col("id") == F.col("of"), "left")
    return joined.select("id", F.col("x.place").alias("place"), F.coalesce("x.country", "given", "prefer").alias("country"))
