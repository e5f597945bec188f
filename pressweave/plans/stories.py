"""Stories over cycles, their newsrooms, and written twins, over documents read as articles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cycles, newsrooms, replay, twins
from ..operators.tables import written
from ..sources.adapter import News
from .grouping import CYCLE, CYCLE_SQL, NAME_SQL, TOKENS_SQL, cycle, cycle_vectors, leads
from .registry import query

#: A cycle starts every three days and looks back on four.
HOP = timedelta(days=3)
#: Seconds between articles of story_cycles.
EVERY = 600
BODY_SQL = """arts AS (SELECT doc_id AS id, doc_id // {cycle} AS cluster_id, source AS source_id, coalesce(regexp_matches(source, '9$'), FALSE) AS front, CASE WHEN length(text) > 240 THEN left(text, 8000) END AS body FROM documents)"""


def articles(spark, sf_dir) -> DataFrame:
    """Documents as articles of cycles.ARTICLE: one every ten minutes; outlets whose names end in 9 are front pages, whose listings are prominent."""
    docs = News(spark, sf_dir).table("documents")
    text = F.coalesce("text", F.lit(""))
    title = F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(90))
    front = F.coalesce(F.col("source").rlike("9$"), F.lit(False))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), title.alias("title"), F.left(F.trim(F.regexp_replace(text, "[ \t\n\r\f\x0b]+", " ")), F.lit(600)).alias("lead"),
        F.when(F.length("text") > newsrooms.SHORT, F.left("text", F.lit(8000))).alias("body"), F.when(front, "title").otherwise("full").alias("tier"), front.alias("prominent"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * EVERY).alias("published_at"), F.lit(None).cast("string").alias("cluster_id"),
    )
    return rows.withColumn("content_hash", T.fingerprint(T.tokens(F.col("title")))).select([f.split(" ")[0] for f in cycles.ARTICLE.split(", ")])


def history(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Articles, clusters and the ids that are gone after all cycles of the documents' time, the cycles all at once."""
    held = written(articles(spark, sf_dir))
    first, last = held.agg(F.min("published_at"), F.max("published_at")).first()
    if first is None:
        return held, spark.createDataFrame([], cycles.CLUSTER), None
    times = [min(first + HOP, last)]
    while times[-1] < last:
        times.append(min(times[-1] + HOP, last))
    return replay.history(held, times, HOP)


@query()
def story_cycles(spark, sf_dir):
    """Each article's story after all cycles, chained: windows of four days every three days, stories of two newsrooms and more written up and frozen between them, written twins merged."""
    held, clusters, _ = history(spark, sf_dir)
    numbers = clusters.select(F.col("id").alias("cluster_id"), "written", "article_count", "source_count", "prominence")
    return held.select(F.col("id").alias("doc_id"), "cluster_id").join(numbers, "cluster_id", "left")


@query(f"""WITH {BODY_SQL.format(cycle=CYCLE)}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY length(coalesce(body, '')) DESC, id) AS r FROM arts WHERE NOT front) WHERE r = 1),
{TOKENS_SQL.split("tf AS")[0].replace("FROM documents", "FROM (SELECT id AS doc_id, source_id AS source, body AS text FROM one WHERE length(body) > 240)").strip().rstrip(",")},
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM toks),
e AS (SELECT doc_id, cluster_id, unnest(s) AS g FROM s JOIN one ON one.id = s.doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.g = b.g AND a.cluster_id = b.cluster_id AND a.doc_id <> b.doc_id GROUP BY 1, 2),
q AS (SELECT cluster_id, s.doc_id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(body) DESC, s.doc_id) AS k FROM s JOIN one ON one.id = s.doc_id),
near AS (SELECT b AS doc_id, list(a) AS before FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b JOIN q i ON i.doc_id = a JOIN q j ON j.doc_id = b WHERE 2 * shared >= len(x.s) + len(y.s) - shared AND i.k < j.k GROUP BY b),
step AS (SELECT q.*, coalesce(before, []) AS before FROM q LEFT JOIN near USING (doc_id)),
kept AS (WITH RECURSIVE walk AS (SELECT cluster_id, 0 AS k, []::BIGINT[] AS ids FROM (SELECT DISTINCT cluster_id FROM step)
 UNION ALL SELECT w.cluster_id, s.k, CASE WHEN len(list_intersect(w.ids, s.before)) > 0 THEN w.ids ELSE list_append(w.ids, s.doc_id) END FROM walk w JOIN step s ON s.cluster_id = w.cluster_id AND s.k = w.k + 1)
 SELECT cluster_id, max(len(ids)) AS n FROM walk GROUP BY 1)
SELECT cluster_id, count(*) AS outlets, count(*) FILTER (body IS NULL) + coalesce(any_value(kept.n), 0) AS source_count FROM one LEFT JOIN kept USING (cluster_id) GROUP BY cluster_id""", False)
def independent_sources(spark, sf_dir):
    """A4: outlets and independent newsrooms of what came in each four days."""
    return newsrooms.independent(articles(spark, sf_dir).withColumn("cluster_id", cycle("id")))


@query(f"""WITH {CYCLE_SQL}, head AS (SELECT doc_id, {NAME_SQL.format("title")} AS names FROM leads),
{TOKENS_SQL.split("tf AS")[0].replace("toks AS", "htoks AS").replace("FROM documents", "FROM (SELECT doc_id, source, title AS text FROM leads)").strip()} htf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM htoks) GROUP BY 1, 2),
hraw AS (SELECT doc_id, htf.term, (1 + ln(htf.n)) * ln((total.n + 1) / (df.df + 0.5)) AS w FROM htf JOIN df ON df.term = htf.term AND df.c = htf.doc_id // {CYCLE} JOIN total ON total.c = df.c),
hvec AS (SELECT hraw.doc_id, term, w / l2 AS w FROM hraw JOIN (SELECT doc_id, sqrt(sum(w * w)) AS l2 FROM hraw WHERE w > 0 GROUP BY doc_id) n ON n.doc_id = hraw.doc_id WHERE w > 0),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS sim, max(a.w * b.w) AS top FROM hvec a JOIN hvec b ON a.term = b.term AND a.doc_id // {CYCLE} = b.doc_id // {CYCLE} AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT a, b, round(sim, 6) AS sim FROM p JOIN head x ON x.doc_id = a JOIN head y ON y.doc_id = b WHERE round(sim, 9) >= 0.5 AND round(sim - top, 9) >= 0.04 AND len(list_intersect(x.names, y.names)) > 0""", False)
def twin_pairs(spark, sf_dir):
    """Pairs of headlines of one cycle that are alike and share a name. A term meets itself inside a cycle only, and of a headline only its rarer terms are looked up."""
    docs = leads(spark, sf_dir)
    v = cycle_vectors(docs, F.col("title")).select("cycle", F.col("doc_id").alias("id"), F.concat_ws(" ", "cycle", "term").alias("term"), "w", F.lit(False).alias("still"))
    pairs = twins.alike(v, twins.TWIN, twins.RESIDUAL)
    named = docs.select("doc_id", F.explode(F.array(T.names(F.col("title")))).alias("names"))
    both = pairs.join(named.toDF("a", "names_a"), "a").join(named.toDF("b", "names_b"), "b").where(F.arrays_overlap("names_a", "names_b"))
    return both.select("a", "b", F.round("sim", 6).alias("sim"))


@query()
def twin_merge(spark, sf_dir):
    """Of the written stories of the last two days (documents here, with as many newsrooms as have their headline), those of the last day look for a twin: which is folded into which."""
    rows = articles(spark, sf_dir)
    carried = rows.groupBy(F.col("title").alias("headline")).agg(F.count_distinct("source_id").alias("source_count"))
    at = F.col("published_at")
    stories = rows.select("id", F.col("title").alias("headline"), at.alias("first_seen"), at.alias("last_seen"), at.alias("summarised_at")).join(carried, "headline")
    now = rows.agg(F.max("published_at")).first()[0]
    if now is None:
        return spark.createDataFrame([], "loser long, keeper long")
    return twins.merge_twins(stories, cycles.corpus(rows, now), now - timedelta(days=1), now)
