"""Connected components and ordered matching on graphs of stories, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .tables import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): the smallest id that each can reach.

    Each round a node takes the smallest label around it, and then its label's own label.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    moved = True
    while moved:
        around = both.join(at, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("around"))
        near = at.join(around, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "around").alias("to"))
        jump = at.select(F.col("id").alias("to"), F.col("component").alias("far"))
        count = Observation()
        new = written(near.join(jump, "to", "left").select("id", F.least("to", "far").alias("component"), "was").observe(count, F.count_if(F.col("component") != F.col("was")).alias("moved")))
        moved = count.get["moved"] > 0
        dropped(at)
        at = new.drop("was")
    dropped(both)
    return at


def merge_in_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(loser, keeper) of nodes that merge in turn, for nodes (id, turn, strength) and edges (a, b, sim) in both directions.

    Nodes with a turn, in its order, each take the most similar neighbour that
    is still there, ties the one of the largest place; of the two the one of
    greater strength keeps, the taken one on a tie. strength and place are
    compared as they are, so structs will do. A round lets all those act that
    are first among those with a turn that could still touch them or a
    neighbour of theirs, which gives the rows of acting one after the other.
    nodes also has ``place``.
    """
    nodes = written(nodes)
    turns = nodes.where("turn IS NOT NULL").select("id", "turn")
    merged, held_tables = None, []
    while not turns.isEmpty():
        near = edges.select("a", "b")
        closed = near.join(turns, F.col("b") == F.col("id")).select("a", "turn").union(turns.select(F.col("id").alias("a"), "turn"))
        first = closed.groupBy("a").agg(F.min("turn").alias("first"))
        # a node acts if it is the first one at itself and at each neighbour
        held = near.join(turns, F.col("a") == F.col("id")).select("id", "turn", F.col("b").alias("at")).union(turns.select("id", "turn", F.col("id").alias("at")))
        ready = written(held.join(first, F.col("at") == F.col("a")).groupBy("id", "turn").agg(F.min(F.col("turn") <= F.col("first")).alias("all")).where("all").select("id"))
        twins = edges.join(ready, F.col("a") == F.col("id")).join(nodes.select(F.col("id").alias("b"), "place"), "b").groupBy("a").agg(F.max_by("b", F.struct("sim", "place")).alias("twin"))
        of_a, of_b = nodes.select(F.col("id").alias("a"), F.col("strength").alias("sa")), nodes.select(F.col("id").alias("twin"), F.col("strength").alias("sb"))
        keeps = F.col("sa") > F.col("sb")
        now = written(twins.join(of_a, "a").join(of_b, "twin").select(F.when(keeps, F.col("twin")).otherwise(F.col("a")).alias("loser"), F.when(keeps, F.col("a")).otherwise(F.col("twin")).alias("keeper")))
        merged = now if merged is None else merged.union(now)
        lost = now.select(F.col("loser").alias("id"))
        turns_left = written(turns.join(ready, "id", "left_anti").join(lost, "id", "left_anti"))
        edges_left = written(edges.join(lost.toDF("a"), "a", "left_anti").join(lost.toDF("b"), "b", "left_anti").select("a", "b", "sim"))
        for old in (*held_tables, ready):
            dropped(old)
        held_tables = turns, edges = turns_left, edges_left
    return nodes.sparkSession.createDataFrame([], "loser long, keeper long").select(*(F.col(c).cast(nodes.schema["id"].dataType) for c in ("loser", "keeper"))) if merged is None else merged
