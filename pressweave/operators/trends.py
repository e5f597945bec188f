"""Which labels rise: their share of late against their share over a longer time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def velocity(labels: DataFrame, span: int, late: int, least: int = 3) -> DataFrame:
    """(label, bucket, stories, lift) of labels (label, bucket, weight), one row for each story that has a label in a bucket of time (a whole number).

    A25: lift is a label's share of all weight in the last ``late`` buckets over
    its share in the last ``span``, both up to the bucket; labels of fewer than
    least stories in the span are left out. Frames run over totals of label and
    bucket, so that a label of very many stories is a few rows.
    """
    per = labels.groupBy("label", "bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("stories"))
    of_all = labels.groupBy("bucket").agg(F.sum("weight").alias("weight"))
    last = lambda n, by: Window.partitionBy(*by).orderBy("bucket").rangeBetween(-(n - 1), 0)
    # one row for each bucket of time
    base = of_all.select("bucket", F.sum("weight").over(last(late, [])).alias("late_all"), F.sum("weight").over(last(span, [])).alias("span_all"))
    own = per.select("label", "bucket", F.sum("weight").over(last(late, ["label"])).alias("late"), F.sum("weight").over(last(span, ["label"])).alias("span"), F.sum("stories").over(last(span, ["label"])).alias("stories"))
    lift = (F.col("late") / F.col("late_all")) / (F.col("span") / F.col("span_all"))
    return own.join(base, "bucket").where(F.col("stories") >= least).select("label", "bucket", "stories", lift.alias("lift"))
