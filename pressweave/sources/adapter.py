"""Views that read star-schema tables as news: orders as clusters, line items as articles, suppliers as outlets."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class News:
    """The views over one data folder. All are lazy; ages count from the latest cluster, never from the clock."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)

    def clusters(self) -> DataFrame:
        customers = self.table("customer").join(F.broadcast(self.places()), F.col("c_nationkey") == F.col("n_nationkey"))
        return self.table("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("category"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("importance"),
            F.col("o_orderdate").alias("last_seen"), F.col("r_name").alias("country"), F.col("n_name").alias("topic"), F.col("n_nationkey").alias("place_id"),
            (F.col("o_orderstatus") != "P").alias("written"), F.col("o_totalprice").alias("weight"),
        )

    def articles(self) -> DataFrame:
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source_id"),
            F.col("l_shipdate").alias("published_at"), (F.col("l_returnflag") == "R").alias("prominent"), (F.col("l_quantity") * 40).cast("long").alias("body_length"), F.col("l_partkey").alias("content"),
        )

    def sources(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))
        kind = F.col("s_suppkey") % 3
        return self.table("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "country",
            F.when(kind == 0, "left").when(kind == 1, "centre").otherwise("right").alias("bias"), F.when(F.col("s_suppkey") % 10 == 0, "title").otherwise("full").alias("tier"),
        )

    def full_articles(self) -> DataFrame:
        """Articles of outlets that are read in full; front-page outlets are left out."""
        outlets = self.sources().where("tier <> 'title'").select(F.col("id").alias("of"), "name", "bias", F.col("country").alias("source_country"))
        return self.articles().join(outlets, F.col("source_id") == F.col("of")).drop("of")

    def counts(self, of: DataFrame | None = None) -> DataFrame:
        """Distinct texts, outlets and front-page outlets of each cluster, or of the clusters in of only, in one pass over the articles."""
        outlets = self.sources().select(F.col("id").alias("of"), (F.col("tier") != "title").alias("full"))
        rows = self.articles()
        if of is not None:
            rows = rows.join(of.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
        rows = rows.join(outlets, F.col("source_id") == F.col("of"), "left")
        return rows.groupBy("cluster_id").agg(
            F.count_distinct(F.when(F.col("full"), F.col("content"))).alias("article_count"),
            F.count_distinct(F.when(F.col("full"), F.col("source_id"))).alias("source_count"),
            F.count_distinct(F.when(F.col("prominent"), F.col("source_id"))).alias("prominence"),
            F.max(F.when(F.col("full"), F.col("published_at"))).alias("latest"),
        )

    def as_of(self) -> Column:
        """The latest cluster's time as a literal, so that filters on ages reach the scan; null if there is no cluster. Read once."""
        return self._latest

    @cached_property
    def _latest(self) -> Column:
        orders = self.table("orders")
        latest = orders.agg(F.max("o_orderdate").cast("string")).first()[0]
        return F.lit(latest).cast(orders.schema["o_orderdate"].dataType)

    def _counted(self, clusters: DataFrame, counts: DataFrame) -> DataFrame:
        rows = clusters.join(counts, clusters.id == counts.cluster_id, "left").drop("cluster_id").fillna(0, ["article_count", "source_count", "prominence"])
        return rows.withColumn("age_hours", F.timestamp_diff("SECOND", F.col("last_seen"), self.as_of()) / 3600)

    def stories(self) -> DataFrame:
        """Clusters with their counts and their age in hours."""
        return self._counted(self.clusters(), self.counts())

    def live(self) -> DataFrame:
        """Written stories of the last 60 days; only their articles are counted."""
        recent = F.col("last_seen") >= self.as_of() - F.expr("INTERVAL 1440 HOURS")
        clusters = self.clusters().where("written").where(recent)
        ids = self.table("orders").where((F.col("o_orderstatus") != "P") & (F.col("o_orderdate") >= self.as_of() - F.expr("INTERVAL 1440 HOURS"))).select(F.col("o_orderkey").alias("id"))
        return self._counted(clusters, self.counts(ids))
