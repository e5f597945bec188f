"""Which stories are written up next: corroborated ones first, then the best of those that one outlet has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.headlines import chore

#: Days on which a shape recurs and over how many it is looked for, hours of heat, and between which ages a story of one outlet is written up.
SHAPE_DAYS, SHAPE_SPAN, HEAT_HOURS, FRESH_HOURS, SETTLED_HOURS = 3, 7, 48, 6, 2
#: Tries, characters of a body, stories of one outlet a day, and of one outlet in a run.
MOST_TRIES, LEAST_BODY, PER_SOURCE, SINGLES = 3, 800, 30, 36


def ago(as_of: Column, hours: float) -> Column:
    return F.col("published_at") >= as_of - F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600})")


def recurring(articles: DataFrame, as_of: Column, span: int = SHAPE_SPAN) -> DataFrame:
    """(source_id, shape) of headlines whose shape an outlet had on three days and more of the last seven."""
    recent = articles.where(ago(as_of, 24 * span)).select("source_id", F.to_date("published_at").alias("day"), T.signature(F.coalesce("title", F.lit(""))).alias("shape"))
    return recent.groupBy("source_id", "shape").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= SHAPE_DAYS).select("source_id", "shape")


def without_routine(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    """Rows (source_id, title) that are neither a chore by their words nor an instalment of a recurring shape."""
    title = F.coalesce("title", F.lit(""))
    plain = rows.where(~chore(title)).withColumn("shape", T.signature(title))
    return plain.join(shapes, ["source_id", "shape"], "left_anti").drop("shape")


def heat(rows: DataFrame, articles: DataFrame, as_of: Column, hours: float = HEAT_HOURS) -> DataFrame:
    """(id, heat) of rows (id, source_id, title): how many other outlets had one of the headline's names in theirs. A name meets its outlets, not its articles."""
    named = lambda df: df.select("source_id", *([c for c in ("id",) if c in df.columns]), F.explode(T.names(F.coalesce("title", F.lit("")))).alias("name"))
    outlets = named(articles.where(ago(as_of, hours)).select("source_id", "title")).distinct().withColumnRenamed("source_id", "other")
    met = named(rows.select("id", "source_id", "title")).join(outlets, "name").where("other <> source_id")
    return met.groupBy("id").agg(F.count_distinct("other").alias("heat"))


def worth_writing(articles: DataFrame, clusters: DataFrame, hot: DataFrame, allowance: DataFrame, as_of: Column, fresh: float = FRESH_HOURS, settled: float = SETTLED_HOURS, heat_hours: float = HEAT_HOURS, limit: int = SINGLES) -> DataFrame:
    """(position, id, cluster_id, source_id, hot, heat): L3, O5, W5: stories of one outlet to be written up, in order.

    articles (id, cluster_id, source_id, title, body, published_at), clusters
    (id, written, source_count, attempts), hot (id) of articles about what
    trends, allowance (source_id, allowance). Unwritten, tried fewer than three
    times, of a long body, neither too new nor old, no routine; those that trend
    first, then by heat, time and id; one article for each story, then each
    outlet's allowance (PER_SOURCE where none is given), then limit.
    """
    open_ = clusters.where((~F.col("written")) & (F.col("source_count") == 1) & (F.col("attempts") < MOST_TRIES)).select(F.col("id").alias("cluster_id"))
    young = ago(as_of, fresh) & (F.col("published_at") <= as_of - F.expr(f"make_dt_interval(0, 0, 0, {settled * 3600})"))
    rows = articles.where(young & (F.length(F.coalesce("body", F.lit(""))) > LEAST_BODY)).select("id", "cluster_id", "source_id", "title", "published_at").join(open_, "cluster_id", "left_semi")
    rows = without_routine(rows, recurring(articles, as_of))
    scored = rows.join(heat(rows, articles, as_of, heat_hours), "id", "left").join(hot.select("id", F.lit(True).alias("hot")), "id", "left")
    scored = scored.select("id", "cluster_id", "source_id", "published_at", F.coalesce("hot", F.lit(False)).alias("hot"), F.coalesce("heat", F.lit(0)).alias("heat"))
    order = [F.desc("hot"), F.desc("heat"), F.desc("published_at"), F.asc("id")]
    one = scored.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))).where("r = 1").drop("r")
    left = one.join(allowance, "source_id", "left").withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    best = left.where(F.col("r") <= F.coalesce("allowance", F.lit(PER_SOURCE))).orderBy(*order).limit(limit)
    # at most limit rows are left to be numbered
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "id", "cluster_id", "source_id", "hot", "heat")


def corroborated(clusters: DataFrame, articles: DataFrame, as_of: Column, limit: int, least_sources: int = 2) -> DataFrame:
    """(position, id): L2, O4, W8: unwritten clusters (id, written, source_count, article_count, attempts) of two newsrooms and more, the most first, ties by id; of these limit those whose first article is no routine."""
    due = clusters.where((~F.col("written")) & (F.col("source_count") >= least_sources) & (F.col("attempts") < MOST_TRIES))
    order = [F.desc("source_count"), F.desc("article_count"), F.asc("id")]
    top = due.orderBy(*order).limit(limit)
    first = articles.join(top.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.min_by(F.struct("source_id", "title"), F.struct("published_at", "id")).alias("x"))
    rows = top.join(first, F.col("id") == F.col("cluster_id"), "left").select("id", "source_count", "article_count", "x.source_id", "x.title")
    kept = without_routine(rows, recurring(articles, as_of))
    return kept.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("position", "id")
