"""How many newsrooms reported a story themselves: outlets that carry one text count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .similar import classes, close_pairs, keep_first
from .tables import written

#: Fixed value: a body of so many characters or fewer isn't compared.
SHORT = 240


def longest(articles: DataFrame, cluster: str) -> DataFrame:
    """articles with ``size``, of each outlet of a cluster the one of the longest body, ties by time and id."""
    first = Window.partitionBy(cluster, "source_id").orderBy(F.desc("size"), F.col("published_at").asc_nulls_last(), "id")
    sized = articles.withColumn("size", F.length(F.coalesce("body", F.lit(""))))
    return sized.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(id) of texts (cluster, id, size, text) that stay: in each cluster from the largest size on, ties by id, each that is under half alike to every one kept before.

    C6 inside clusters: shingles are named with their cluster, so only texts of
    one cluster meet. A text without words is like no other and stays.
    """
    words = texts.select("cluster", F.col("id").alias("doc_id"), "size", F.explode(F.array(T.tokens(F.col("text")))).alias("w"))
    named = F.array_sort(F.transform(T.shingles(F.col("w")), lambda x: F.xxhash64(F.col("cluster"), x)))
    sets = written(words.select("doc_id", "size", F.explode(F.array(named)).alias("s")).withColumn("n", F.size("s")))
    different = classes(sets)
    sizes = different.select("doc_id", "size")
    pairs = close_pairs(different).select("a", "b").join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    first = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    lost = keep_first(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later")))
    # of equal sets only the first one is in a class
    kept = different.select("doc_id").join(lost.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").union(sets.where("n = 0").select("doc_id"))
    return kept.withColumnRenamed("doc_id", "id")


def independent(articles: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """(cluster, outlets, source_count) of articles (id, cluster, source_id, tier, body, published_at).

    A4: front-page listings (tier ``title``) don't count. Each outlet has its
    longest body. Of bodies over SHORT characters those that distinct_texts()
    keeps count; the others count each. A null tier is a full one.
    """
    full = articles.where(F.coalesce("tier", F.lit("full")) != "title").where(F.col(cluster).isNotNull())
    one = written(longest(full, cluster).select(F.col(cluster).alias("cluster"), "id", "size", F.when(F.col("size") > SHORT, F.col("body")).alias("body")))
    kept = distinct_texts(one.where("body IS NOT NULL").withColumnRenamed("body", "text")).withColumn("kept", F.lit(True))
    counts = F.col("body").isNull() | F.col("kept").isNotNull()
    return one.join(kept, "id", "left").groupBy("cluster").agg(F.count("*").alias("outlets"), F.count_if(counts).alias("source_count")).withColumnRenamed("cluster", cluster)


def recount(articles: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows of clusters whose numbers changed: id, article_count, source_count, prominence, first_seen, last_seen.

    A5: articles (id, cluster_id, source_id, tier, prominent, body,
    content_hash, published_at) are all that the clusters (id, written and the
    numbers) hold. Written clusters keep their times; clusters without articles
    are left to the caller. Nulls compare as values.
    """
    of = articles.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    full = F.coalesce("tier", F.lit("full")) != "title"
    seen = of.groupBy("cluster_id").agg(
        F.count_distinct(F.when(full, F.coalesce("content_hash", F.col("id").cast("string")))).alias("article_count_now"),
        F.count_distinct(F.when(F.col("prominent"), F.col("source_id"))).alias("prominence_now"),
        F.min("published_at").alias("first_now"), F.max("published_at").alias("last_now"),
    )
    now = seen.join(independent(of).select("cluster_id", F.col("source_count").alias("source_count_now")), "cluster_id", "left").withColumnRenamed("cluster_id", "id")
    rows = clusters.join(now, "id").select(
        "id", F.struct("article_count", "source_count", "prominence", "first_seen", "last_seen").alias("was"),
        F.struct(
            F.col("article_count_now").alias("article_count"), F.coalesce("source_count_now", F.lit(0)).cast("long").alias("source_count"), F.col("prominence_now").alias("prominence"),
            F.when(F.col("written"), F.col("first_seen")).otherwise(F.col("first_now")).alias("first_seen"), F.when(F.col("written"), F.col("last_seen")).otherwise(F.col("last_now")).alias("last_seen"),
        ).alias("now"),
    )
    return rows.where(~F.col("was").eqNullSafe(F.col("now"))).select("id", "now.*")
