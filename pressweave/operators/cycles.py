"""Stories kept over cycles: state in, state out.

A cycle reads the articles of its last four days, groups those of unwritten
stories beside the written ones, lets groups claim the ids their articles had,
and says what changed: articles that moved, clusters whose numbers changed, and
clusters that are gone. It never changes a table in place.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .graph import components
from .grouping import RESIDUAL, THRESHOLD, group_rows
from .newsrooms import recount
from .tables import written
from .twins import merge_twins
from .vectors import alike, document_frequencies, unit

#: Days that a cycle regroups, days that weights and aliases come from, and what makes two names stand for each other.
CANDIDATE_DAYS, CORPUS_DAYS, ALIAS_SOURCES, ALIAS_CLUSTERS, MOST_NAMES, LEAST_COMMON, COMMON, KEYS = 4, 30, 3, 2, 12, 3, 0.02, 6
ARTICLE = "id long, source_id string, title string, lead string, body string, tier string, prominent boolean, content_hash string, published_at timestamp, cluster_id string"
CLUSTER = "id string, written boolean, headline string, summarised_at timestamp, article_count long, source_count long, prominence long, first_seen timestamp, last_seen timestamp"


@dataclass
class Changes:
    """What a cycle changed: (id, cluster_id) of moved articles, whole rows of changed and new clusters, and ids of clusters that are gone."""

    moved: DataFrame
    clusters: DataFrame
    gone: DataFrame


def since(as_of: datetime, days: int):
    return (F.col("published_at") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("published_at") <= F.lit(as_of))


def aliases(articles: DataFrame, clusters: DataFrame, as_of: datetime) -> DataFrame:
    """(name, alias), both ways: names that are together in two and more of the stories that three newsrooms have, neither of them common, in no story of over 12 such names."""
    sure = clusters.where(F.col("source_count") >= ALIAS_SOURCES).select(F.col("id").alias("cluster_id"))
    held = articles.where(since(as_of, CORPUS_DAYS)).join(sure, "cluster_id", "left_semi")
    named = held.select("cluster_id", F.explode(T.names(F.coalesce("title", F.lit("")))).alias("name")).distinct()
    # stories without a name count too
    total = held.agg(F.count_distinct("cluster_id").alias("total"))
    often = named.groupBy("name").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    rare = often.where(F.col("n") <= F.greatest(F.lit(float(LEAST_COMMON)), F.col("total") * COMMON)).select("name")
    few = named.join(rare, "name")
    small = few.groupBy("cluster_id").agg(F.count("*").alias("names")).where(F.col("names") <= MOST_NAMES).select("cluster_id")
    few = few.join(small, "cluster_id", "left_semi")
    pairs = few.join(few.withColumnRenamed("name", "alias"), "cluster_id").where("name <> alias").groupBy("name", "alias").agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= ALIAS_CLUSTERS).select("name", "alias")


def counted(docs: DataFrame) -> DataFrame:
    """(id, term, n) of docs (id, text)."""
    return docs.select("id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def corpus(articles: DataFrame, as_of: datetime) -> DataFrame:
    """(term, df, total) over the titles and leads of the last 30 days."""
    docs = articles.where(since(as_of, CORPUS_DAYS)).select("id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("lead", F.lit(""))).alias("text"))
    return document_frequencies(counted(docs), docs.agg(F.count("*").alias("total")))


def batch(articles: DataFrame, clusters: DataFrame, as_of: datetime) -> DataFrame:
    """Rows (id, turn, frozen, terms, weights, keys, names, also, was) of the articles that a cycle reads; frozen is the written story that an anchor is in.

    Weights come from the titles and leads of the last 30 days, aliases from their stories.
    """
    stories = clusters.select(F.col("id").alias("cluster_id"), "written")
    read = articles.where(since(as_of, CANDIDATE_DAYS)).join(stories, "cluster_id", "left")
    title = F.coalesce("title", F.lit(""))
    read = read.select("id", F.col("published_at").alias("turn"), F.when(F.coalesce("written", F.lit(False)), F.col("cluster_id")).alias("frozen"), F.col("cluster_id").alias("was"), title.alias("title"), F.concat_ws(" ", title, title, title, F.coalesce("lead", F.lit(""))).alias("text"))
    v = unit(counted(read), corpus(articles, as_of))
    # equal weights by term, to nine places, so that no summing order shows
    heavy = F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("less"), "term", "w")))
    vectors = v.groupBy("id").agg(heavy.alias("v"))
    named = written(read.select("id", "turn", "frozen", "was", F.explode(F.array(T.names(F.col("title")))).alias("names")))
    also = named.select("id", F.explode("names").alias("name")).join(aliases(articles, clusters, as_of), "name").groupBy("id").agg(F.collect_set("alias").alias("also"))
    none = F.array().cast("array<string>")
    top = F.coalesce(F.slice("v.term", 1, KEYS), none)
    rows = named.join(vectors, "id", "left").join(also, "id", "left")
    return rows.select("id", "turn", "frozen", "was", F.coalesce("v.term", none).alias("terms"), F.coalesce("v.w", F.array().cast("array<double>")).alias("weights"), F.concat(top, "names").alias("keys"), "names", F.coalesce("also", none).alias("also"))


def grouped(rows: DataFrame, whole: bool = False) -> DataFrame:
    """(id, founder, place, size, frozen) of the candidates among the rows of batch().

    An article joins a group only by a pair of cosine THRESHOLD and more of which
    RESIDUAL is left, so what no chain of such pairs connects never meets, and
    each connected component is a task of its own with the same groups as one
    pass over all rows (whole). Written stories stay in one piece. Articles
    without such a pair are groups of one.
    """
    schema = f"id {rows.schema['id'].dataType.simpleString()}, founder {rows.schema['id'].dataType.simpleString()}, place int, size int, frozen string"
    given = rows.drop("was")
    if whole:
        return given.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda group: group_rows(group), schema)
    v = rows.select("id", F.col("frozen").isNotNull().alias("still"), F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("id", "still", F.col("x.terms").alias("term"), F.col("x.weights").alias("w"))
    pairs = alike(written(v), THRESHOLD * (1 - 1e-9), RESIDUAL * (1 - 1e-9)).select("a", "b")
    anchors = rows.where("frozen IS NOT NULL").select("id", "frozen")
    first = anchors.groupBy("frozen").agg(F.min("id").alias("first"))
    of_one_story = anchors.join(first, "frozen").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    at = components(pairs.union(of_one_story))
    open_at = at.join(rows.where("frozen IS NULL").select("id"), "id", "left_semi").select("component").distinct()
    found = given.join(at.join(open_at, "component", "left_semi"), "id").groupBy("component").applyInPandas(lambda group: group_rows(group), schema)
    alone = rows.where("frozen IS NULL").join(at, "id", "left_anti")
    return found.union(alone.select("id", F.col("id").alias("founder"), F.lit(0), F.lit(1), F.lit(None).cast("string")))


def claimed(groups: DataFrame, rows: DataFrame, as_of: datetime) -> DataFrame:
    """(id, cluster_id, was): each group with the id it may keep.

    W4: a group wants the id that most of its articles had, ties the one met
    first; a written story keeps its own. Of several groups the one of most such
    articles, then of most articles, then the older one, has the id; the others
    get new ids of their founders, marked with the cycle where that id is in use.
    """
    members = groups.join(rows.select("id", "was", "turn"), "id")
    votes = members.where("was IS NOT NULL AND frozen IS NULL").groupBy("founder", "was").agg(F.count("*").alias("votes"), F.min("place").alias("place"))
    wants = votes.groupBy("founder").agg(F.min_by(F.struct("was", "votes"), F.struct(-F.col("votes"), "place")).alias("want"))
    began = members.where("frozen IS NULL").groupBy("founder").agg(F.first("size").alias("size"), F.min_by("turn", "place").alias("turn"))
    best = Window.partitionBy("want.was").orderBy(F.desc("want.votes"), F.desc("size"), "turn", "founder")
    # a written story's id is never up for claims: its articles are no candidates
    wins = began.join(wants, "founder").withColumn("r", F.row_number().over(best)).where("r = 1").select("founder", F.col("want.was").alias("wins"))
    plain = F.concat(F.lit("c_"), F.col("founder").cast("string"))
    used = rows.where("was IS NOT NULL").select(F.col("was").alias("used")).distinct()
    named = began.join(wins, "founder", "left").join(used, plain == F.col("used"), "left")
    fresh = F.when(F.col("used").isNotNull(), F.concat(plain, F.lit(f".{int(as_of.timestamp())}"))).otherwise(plain)
    ids = named.select("founder", F.coalesce("wins", fresh).alias("cluster_id"))
    return members.join(ids, "founder", "left").select("id", F.coalesce("frozen", "cluster_id").alias("cluster_id"), "was")


def cycle(articles: DataFrame, clusters: DataFrame, as_of: datetime) -> Changes:
    """One cycle over articles (ARTICLE) and clusters (CLUSTER) as they are at as_of.

    C7 with U2, C4, W4, A5 and X5. Articles published after as_of are not read;
    those of null time, title or text are never regrouped or have no terms. Each
    candidate is in one cluster afterwards; written clusters only grow.
    """
    rows = written(batch(articles, clusters, as_of))
    now = written(claimed(written(grouped(rows)), rows, as_of))
    moved = now.where(~F.col("cluster_id").eqNullSafe(F.col("was")))
    ids = moved.select("cluster_id").union(moved.select(F.col("was").alias("cluster_id"))).where("cluster_id IS NOT NULL").distinct()
    known = clusters.select("id")
    fresh = now.select(F.col("cluster_id").alias("id")).distinct().join(known, "id", "left_anti")
    new = fresh.select("id", F.lit(False).alias("written"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in CLUSTER.split(", ")[2:])])
    after = applied(articles, moved)
    touched = written(clusters.select(new.columns).union(new).join(ids.withColumnRenamed("cluster_id", "id"), "id", "left_semi"))
    held = after.join(ids, "cluster_id", "left_semi")
    changed = recount(held, touched).join(touched.select("id", "written", "headline", "summarised_at"), "id").select(new.columns)
    gone = touched.select("id").join(held.select(F.col("cluster_id").alias("id")), "id", "left_anti")
    return Changes(moved.select("id", "cluster_id"), written(changed), gone)


def applied(articles: DataFrame, moved: DataFrame) -> DataFrame:
    """articles with the cluster ids of those that moved."""
    return articles.withColumnRenamed("cluster_id", "held").join(moved.select("id", "cluster_id"), "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "held")).select(articles.columns)


def after(articles: DataFrame, clusters: DataFrame, changes: Changes) -> tuple[DataFrame, DataFrame]:
    """The state after a cycle."""
    changed = changes.clusters.select(clusters.columns)
    kept = clusters.join(changed.select("id").union(changes.gone.select("id")), "id", "left_anti").select(clusters.columns)
    return written(applied(articles, changes.moved)), written(kept.union(changed))


def write_up(articles: DataFrame, clusters: DataFrame, as_of: datetime, least_sources: int = 2) -> DataFrame:
    """clusters, of which those that so many newsrooms have are written from now on, under the title of their first article."""
    due = (~F.col("written")) & (F.col("source_count") >= least_sources)
    ids = clusters.where(due).select(F.col("id").alias("cluster_id"))
    title = articles.join(ids, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.min_by("title", F.struct("published_at", "id")).alias("title"))
    rows = clusters.join(title, F.col("id") == F.col("cluster_id"), "left")
    return written(rows.select("id", (F.col("written") | due).alias("written"), F.when(due, F.coalesce("title", F.lit(""))).otherwise(F.col("headline")).alias("headline"), F.when(due, F.lit(as_of)).otherwise(F.col("summarised_at")).alias("summarised_at"), *clusters.columns[4:]))


def advance(articles: DataFrame, clusters: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State (articles, clusters) after a cycle, its writing up and the merging of written twins, and the ids (id) of clusters that are gone."""
    changes = cycle(articles, clusters, as_of)
    articles, clusters = after(articles, clusters, changes)
    clusters = write_up(articles, clusters, as_of)
    merged = merge_twins(clusters, corpus(articles, as_of), as_of, as_of)
    if merged.isEmpty():
        return articles, clusters, changes.gone
    lost = merged.select(F.col("loser").alias("id"))
    moved = articles.join(merged, F.col("cluster_id") == F.col("loser")).select("id", F.col("keeper").alias("cluster_id"))
    articles = written(applied(articles, moved))
    keepers = clusters.join(merged.select(F.col("keeper").alias("id")).distinct(), "id", "left_semi")
    changed = recount(articles, keepers).join(keepers.select("id", "written", "headline", "summarised_at"), "id").select(clusters.columns)
    return articles, after(articles, clusters, Changes(moved.limit(0), changed, lost))[1], changes.gone.union(lost)
