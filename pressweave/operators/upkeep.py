"""What keeps a store sound: its registry of outlets, links to rows that are gone, horizons, and what was used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days that each step looks back on, from the shortest; each lies inside the next.
HORIZONS = {"feed": 1, "sections": 2, "ingest": 3, "cluster": 4, "hydrate": 5}
#: Typed places that are looked up for a reader.
TYPED = 12


def duplicates(registry: DataFrame) -> DataFrame:
    """(kind, value, n): ids and addresses that more than one entry of registry (id, feed_url) has. Nulls don't count."""
    both = F.explode(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("value")), F.struct(F.lit("feed_url").alias("kind"), F.col("feed_url").alias("value"))))
    return registry.select(both.alias("x")).where("x.value IS NOT NULL").groupBy("x.kind", "x.value").agg(F.count("*").alias("n")).where("n > 1").select("kind", "value", "n")


def checked(registry: DataFrame) -> DataFrame:
    """Registry, unless two entries share an id or an address."""
    found = duplicates(registry).orderBy("kind", "value").limit(5).collect()
    if found:
        raise ValueError("duplicate " + ", ".join(f"{r.kind} {r.value}" for r in found))
    return registry


def released(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Articles, of which those whose cluster isn't among clusters (id) are in none, so that the next cycle files them again."""
    known = clusters.select(F.col("id").alias("cluster_id"), F.lit(True).alias("known")).distinct()
    rows = articles.join(known, "cluster_id", "left")
    return rows.withColumn("cluster_id", F.when(F.col("known"), F.col("cluster_id"))).select(articles.columns)


def missing(articles: DataFrame, key: str, parents: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Rows of everywhere (id, ...) that articles name by key but parents (id) lack."""
    wanted = articles.select(F.col(key).alias("id")).where("id IS NOT NULL").distinct().join(parents.select("id"), "id", "left_anti")
    return everywhere.join(wanted, "id", "left_semi")


def horizons(rows: DataFrame, time: str, as_of: Column) -> DataFrame:
    """Rows with the steps that still look at them, the shortest first; a row beyond all of them has none. Whatever one step sees, those of longer horizons see."""
    days = sorted(HORIZONS.items(), key=lambda x: x[1])
    return rows.withColumn("seen_by", F.filter(F.array(*[F.when(F.col(time) >= as_of - F.expr(f"INTERVAL {n} DAYS"), F.lit(step)) for step, n in days]), lambda x: x.isNotNull()))


def usage(calls: DataFrame, allowances: dict[str, float]) -> DataFrame:
    """(day, kind, calls, used, share, over) of calls (ts, kind, used): A23, A26: totals of each day and kind against a day's allowance; no allowance, no share."""
    per = calls.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count("*").alias("calls"), F.sum("used").alias("used"))
    allowed = F.coalesce(*[F.when(F.col("kind") == k, F.lit(float(a))) for k, a in allowances.items()], F.lit(None).cast("double"))
    return per.withColumn("share", F.col("used") / allowed).withColumn("over", F.coalesce(F.col("share") > 1, F.lit(False)))


def run_name(at: Column, zone: str = "Asia/Kolkata") -> Column:
    """A run's name by the wall clock of a zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd_HH-mm")


def typed(labels: DataFrame, places: DataFrame, held: DataFrame) -> DataFrame:
    """(reader, place_id) of labels (reader, pos, label): C14: places of this very name or label, whatever its case, the largest of several; names that a reader's places (reader, place_id) already have are left out, and so is what comes after TYPED labels."""
    same = F.lower(F.trim("label"))
    few = labels.withColumn("r", F.row_number().over(Window.partitionBy("reader").orderBy("pos"))).where(F.col("r") <= TYPED).select("reader", same.alias("said")).where("said <> ''").distinct()
    names = places.select("place_id", "population", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("label")))).alias("said"))
    covered = held.join(names.select("place_id", "said"), "place_id").select("reader", "said").distinct()
    # which place a name means is the same for every reader
    meant = names.groupBy("said").agg(F.min_by("place_id", F.struct(-F.coalesce("population", F.lit(0)), "place_id")).alias("place_id"))
    return few.join(covered, ["reader", "said"], "left_anti").join(meant, "said").select("reader", "place_id").distinct()


def agreement(ratings: DataFrame) -> DataFrame:
    """(band, n, exact, near, kappa) of ratings (band, a, b) on a scale of whole numbers, band null for all together.

    A24: the shares of equal ratings and of those at most one apart, and Cohen's
    kappa, null where chance alone agrees. Ratings that lack a side don't count;
    they meet as counts of (band, a, b), not as rows.
    """
    rated = ratings.where("a IS NOT NULL AND b IS NOT NULL")
    each = F.explode(F.array(F.col("band").cast("string"), F.lit(None).cast("string"))).alias("band")
    pairs = rated.where("band IS NOT NULL").select(each, "a", "b").union(rated.where("band IS NULL").select(F.lit(None).cast("string"), "a", "b")).groupBy("band", "a", "b").agg(F.count("*").alias("n"))
    total = pairs.groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, F.col("n")).otherwise(0)).alias("close"))
    by = lambda side: pairs.groupBy("band", F.col(side).alias("value")).agg(F.sum("n").alias(f"n_{side}"))
    of_b = by("b").select(F.col("band").alias("band_b"), F.col("value").alias("value_b"), "n_b")
    chance = by("a").join(of_b, F.col("band").eqNullSafe(F.col("band_b")) & (F.col("value") == F.col("value_b"))).groupBy(F.col("band").alias("of")).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("met"))
    rows = total.join(chance, F.col("band").eqNullSafe(F.col("of")), "left")
    exact, expected = F.col("same") / F.col("n"), F.coalesce("met", F.lit(0)) / (F.col("n") * F.col("n"))
    return rows.select("band", "n", exact.alias("exact"), (F.col("close") / F.col("n")).alias("near"), F.when(expected < 1, (exact - expected) / (1 - expected)).alias("kappa"))
