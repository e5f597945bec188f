"""Written stories that tell the same event under two headlines become one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import merge_in_order
from .grouping import RESIDUAL
from .tables import written
from .vectors import alike, unit

#: How alike the headlines of twins are, and for how many days a story may have been seen last.
TWIN, TWIN_DAYS = 0.5, 2


def twin_pairs(stories: DataFrame, df: DataFrame) -> DataFrame:
    """(a, b, sim, residual), a < b: stories (id, headline, still) whose headlines are alike and share a name; not both still. df (term, df, total) weighs terms."""
    text = F.coalesce("headline", F.lit(""))
    rows = stories.select("id", "still", text.alias("headline"))
    tf = rows.select("id", F.explode(T.tokens(F.col("headline"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))
    v = unit(tf, df).join(rows.select("id", "still"), "id")
    pairs = alike(written(v), TWIN, RESIDUAL)
    named = rows.select("id", T.names(F.col("headline")).alias("names"))
    both = pairs.join(named.toDF("a", "names_a"), "a").join(named.toDF("b", "names_b"), "b")
    return both.where(F.arrays_overlap("names_a", "names_b")).select("a", "b", "sim", "residual")


def merge_twins(clusters: DataFrame, df: DataFrame, since: datetime, as_of: datetime) -> DataFrame:
    """(loser, keeper) of written clusters (id, headline, source_count, first_seen, last_seen, summarised_at) that are twins; keepers stay.

    C8: clusters summarised at since or later, in the order of (first_seen, id),
    each look for the most alike other one that is still there, ties the later
    row; the one of more newsrooms stays, then the older one, else the one that
    was found. Stories last seen over TWIN_DAYS before as_of have no part in it.
    """
    live = clusters.where("headline IS NOT NULL").where(F.col("last_seen") >= F.lit(as_of) - F.expr(f"INTERVAL {TWIN_DAYS} DAYS"))
    fresh = F.coalesce(F.col("summarised_at") >= F.lit(since), F.lit(False))
    pairs = written(twin_pairs(live.select("id", "headline", (~fresh).alias("still")), df).select("a", "b", "sim"))
    edges = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    order = F.struct("first_seen", "id")
    nodes = live.join(edges.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("id", F.when(fresh, order).alias("turn"), order.alias("place"), F.struct("source_count", (-F.unix_micros("first_seen")).alias("age")).alias("strength"))
    if pairs.isEmpty():
        kind = clusters.schema["id"].dataType.simpleString()
        return clusters.sparkSession.createDataFrame([], f"loser {kind}, keeper {kind}")
    merged = merge_in_order(nodes, edges)
    # who kept another one may lose in its own turn
    while not (again := merged.select("loser", F.col("keeper").alias("through")).join(merged.select(F.col("loser").alias("through"), F.col("keeper").alias("at")), "through")).isEmpty():
        merged = written(merged.join(again.select("loser", "at"), "loser", "left").select("loser", F.coalesce("at", "keeper").alias("keeper")))
    return merged
