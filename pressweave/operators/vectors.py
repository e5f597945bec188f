"""Unit vectors of term weights, and pairs of them that are alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def unit(tf: DataFrame, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, term, w) for tf (*by, id, term, n) and df (*by, term, df, total): weights of unit length; terms of idf 0 and less are left out."""
    raw = tf.join(df, [*by, "term"]).withColumn("w", (1 + F.log("n")) * T.idf(F.col("total"), F.col("df"))).where("w > 0")
    length = raw.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, [*by, "id"]).select(*by, "id", "term", (F.col("w") / F.col("length")).alias("w"))


def document_frequencies(tf: DataFrame, total: DataFrame) -> DataFrame:
    """(term, df, total) of tf (id, term, n) and total (total), the number of documents."""
    return tf.groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df")).crossJoin(F.broadcast(total))


def alike(v: DataFrame, least: float, residual: float) -> DataFrame:
    """(a, b, sim, residual) of pairs a < b of unit vectors v (id, term, w, still) of cosine least and more, of which residual is left without the best term.

    Pairs of which both are ``still`` don't count. With terms from rare to
    common, the last ones of a vector, whose length is under least, can't make
    a pair by themselves, so only the ones before are looked up; what two
    vectors have in common is then added up over all terms.
    """
    often = v.groupBy("term").agg(F.count("*").alias("often")).where("often > 1")
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id").orderBy(F.desc("often"), "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a little below the bound, as sums of squares are rounded
    posted = v.join(often, "term").withColumn("rest", rest).where(F.col("rest") >= least * least * (1 - 1e-9)).select("term", "id", "still")
    near = posted.toDF("term", "a", "still_a").join(posted.toDF("term", "b", "still_b"), "term").where("a < b AND NOT (still_a AND still_b)").select("a", "b").distinct()
    of_a, of_b = v.select(F.col("id").alias("a"), "term", F.col("w").alias("wa")), v.select(F.col("id").alias("b"), "term", F.col("w").alias("wb"))
    product = F.col("wa") * F.col("wb")
    pairs = near.join(of_a, "a").join(of_b, ["b", "term"]).groupBy("a", "b").agg(F.sum(product).alias("sim"), F.max(product).alias("top"))
    return pairs.select("a", "b", "sim", (F.col("sim") - F.col("top")).alias("residual")).where((F.col("sim") >= least) & (F.col("residual") >= residual))
