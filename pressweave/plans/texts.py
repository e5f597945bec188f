"""Text statistics, vectors and near-duplicates over documents read as articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.adapter import News
from .registry import query

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP) + ")"
TOKENS_SQL = f"""toks AS (SELECT doc_id, source, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z''’-]{{2,}}'), lambda w: regexp_replace(w, '[''’]s$', '')), lambda w: length(w) > 2 AND w NOT IN {STOP_SQL}) AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM toks) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), total AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT doc_id, tf.term, (1 + ln(tf.n)) * ln((total.n + 1) / (df.df + 0.5)) AS w FROM tf JOIN df USING (term), total),
pos AS (SELECT * FROM raw WHERE w > 0), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS l2 FROM pos GROUP BY doc_id),
vec AS (SELECT pos.doc_id, term, w / l2 AS w FROM pos JOIN norm ON pos.doc_id = norm.doc_id)"""


def term_counts(docs: DataFrame) -> DataFrame:
    # exploded in the one select that makes the tokens: a named column would be computed again by an inferred size filter
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def weights(docs: DataFrame) -> DataFrame:
    """(doc_id, term, w): TF-IDF weights; terms of idf 0 and less are left out."""
    tf = term_counts(docs)
    # counts n, so that both sides of the join read the same exchange: without n the texts would be counted twice
    df = tf.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    return tf.join(df, "term").crossJoin(F.broadcast(total)).select("doc_id", "term", ((1 + F.log("n")) * T.idf(F.col("total"), F.col("df"))).alias("w")).where("w > 0")


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, term, w): weights of unit length."""
    # a window over one document's terms, which are no more than its words
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return weights(docs).select("doc_id", "term", (F.col("w") / length).alias("w"))


def documents(spark, sf_dir) -> DataFrame:
    return News(spark, sf_dir).table("documents")


@query("WITH " + TOKENS_SQL + " SELECT doc_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM toks", False)
def tokenise_counts(spark, sf_dir):
    """T1."""
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array(T.tokens(F.col("text")))).alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("WITH " + TOKENS_SQL + " SELECT term, df, round(ln((total.n + 1) / (df + 0.5)), 6) AS idf FROM df, total", False)
def doc_freq_idf(spark, sf_dir):
    """A1."""
    docs = documents(spark, sf_dir)
    df = term_counts(docs).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total")))).select("term", "df", F.round(T.idf(F.col("total"), F.col("df")), 6).alias("idf"))


@query("WITH " + TOKENS_SQL + " SELECT doc_id, count(*) AS terms, round(max(w), 6) AS heaviest FROM vec GROUP BY doc_id", False)
def tfidf_norms(spark, sf_dir):
    """T2, T3."""
    longest = F.max("w") / F.sqrt(F.sum(F.col("w") * F.col("w")))
    return weights(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(longest, 6).alias("heaviest"))


@query("WITH " + TOKENS_SQL + " SELECT doc_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS r FROM vec) WHERE r <= 6", False)
def tfidf_top_keys(spark, sf_dir):
    """The six heaviest terms of each article, its blocking keys."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("w", 9)), "term")
    return vectors(documents(spark, sf_dir)).withColumn("r", F.row_number().over(w)).where("r <= 6").select("doc_id", "term")


@query(r"""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\b([A-Z][a-z’''-]{2,}(?:\s+[A-Z][a-z’''-]{2,})*)\b', 1), lambda w: lower(w))) AS names FROM documents)
SELECT name, count(*) AS n FROM (SELECT doc_id, unnest(names) AS name FROM n) WHERE name NOT IN """ + STOP_SQL + " GROUP BY name", False)
def entity_counts(spark, sf_dir):
    """Names by number of articles."""
    names = documents(spark, sf_dir).select(F.explode(T.names(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents", False)
def slugify(spark, sf_dir):
    """T8 over first lines."""
    return documents(spark, sf_dir).select("doc_id", T.slug(F.split("text", "\n", 2)[0]).alias("slug"))


@query("WITH " + TOKENS_SQL + " SELECT doc_id, array_to_string(list_sort(w)[1:12], '.') AS fingerprint FROM toks", False)
def title_fingerprint(spark, sf_dir):
    """T6."""
    return documents(spark, sf_dir).select("doc_id", T.fingerprint(T.tokens(F.col("text"))).alias("fingerprint"))


@query(f"""WITH s AS (SELECT source, date_trunc('day', TIMESTAMP '2024-01-01' + to_minutes(doc_id * 30)) AS day, trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '{T.PERIODIC}', ' ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS shape FROM documents)
SELECT source, shape, count(DISTINCT day) AS days FROM s GROUP BY 1, 2 HAVING count(DISTINCT day) >= 3""", False)
def routine_shapes(spark, sf_dir):
    """Shapes of first lines that an outlet repeats on three days and more."""
    day = F.to_date(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1800))
    shapes = documents(spark, sf_dir).select("source", day.alias("day"), T.signature(F.split("text", "\n", 2)[0]).alias("shape"))
    return shapes.groupBy("source", "shape").agg(F.count_distinct("day").alias("days")).where("days >= 3")
