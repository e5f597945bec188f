"""Operator 6: mixing sources to target weights.

Every row gets a hash-random key; within its source rows are put in ranges of
equal key width and sorted there; prefix sums run over the ranges' totals and
then inside each range, so that no task ever holds a whole source. A source's
order is cut at its exact word budget, after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, materialise, n_words

WEIGHTS, SHARE, MOST_EPOCHS, RANGE_ROWS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20_000, 6


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (source, source_size, n_rows): one row for each source.

    Sources in code-point order, null last, take the weights in turn. Targets
    are min(most * source_size, level * weight), where the level is the one at
    which they add up to share * all sizes: with sources ordered by the level
    at which they fill up, it is the largest level found by counting a prefix
    of them as full.
    """
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    full = F.col("source_size") * F.lit(float(most))
    before = Window.orderBy("fills_at", "position").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumn("position", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(w, (F.col("position") % len(weights) + 1).cast("int")))
        .withColumn("fills_at", full / F.col("weight"))
    )
    level = (F.sum("source_size").over(everywhere) * F.lit(float(share)) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return ranked.withColumn("level", level).withColumn(
        "target", F.least(full, F.max("level").over(everywhere) * F.col("weight"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED, range_rows: int = RANGE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs (doc_id, source, text): doc_id, source, size, source_size, target, taken, and the columns that keep names.

    Null or empty texts have size 0 and take 0 words. A null source is a
    source of its own. Rows that repeat a doc_id count each on their own; rows
    equal in all columns share a tie in any order. Extra columns are ignored.
    An empty table gives no rows. Reruns agree: keys depend on doc_id and seed.
    """
    slim = materialise(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("key"), *keep))
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = materialise(
        source_targets(sources, weights, share, most).select(
            F.col("source").alias("of"), "source_size", "target", F.ceil(F.col("n_rows") / range_rows).alias("n_ranges")
        )
    )
    place = F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("n_ranges"))
    rows = slim.join(bounded_broadcast(targets, targets.count()), F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "range", F.least(place, F.col("n_ranges") - 1)
    ).drop("of", "n_ranges")
    ahead = Window.partitionBy("of").orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(F.col("source").alias("of"), F.col("range").alias("of_range"))
        .agg(F.sum("size").alias("range_size"))
        .select("of", "of_range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return (
        rows.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
        .withColumn("start", start)
        .select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"), *keep)
    )
