"""Operator 10: sharding by sampled splitters.

Records are ordered by (hash of the text, hash of doc_id), so equal texts lie
together. A size-weighted sample of text keys gives quantile boundaries of
many small ranges; every record is put in its range, overfull ranges (one key
that repeats) are subdivided by the second hash, and consecutive ranges fill
the shards up to equal sizes. Slots count through a shard's ranges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, materialise

SHARDS, RANGES_PER_SHARD, SAMPLE_PER_RANGE, RANGE_BYTES, OVERHEAD, SEED = 40, 100, 16, 256 << 20, 16, 10


def splitters(rows: DataFrame, ranges: int, per_range: int = SAMPLE_PER_RANGE, seed: int = SEED) -> np.ndarray:
    """Up to ranges - 1 increasing keys, quantiles of rows (key, doc_id, size) by size.

    A row is drawn if its hash falls below size / step, and then counts for
    max(size, step): about ranges * per_range draws, whatever the table's size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    step = max(1.0, total / (ranges * per_range))
    draw = F.xxhash64("key", "doc_id", F.lit(seed)).cast("double") / 2.0**64 + 0.5
    drawn = rows.where(draw * step < F.col("size")).select("key", F.greatest("size", F.lit(step)).alias("weight"))
    sample = drawn.toPandas().sort_values("key", kind="stable")
    if sample.empty:
        return np.zeros(0, dtype=np.int64)
    reach = sample["weight"].cumsum().to_numpy()
    at = np.searchsorted(reach, reach[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["key"].to_numpy()[np.minimum(at, len(reach) - 1)])


def shard(docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, range_bytes: int = RANGE_BYTES, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 16. A null text has size 16, a null
    text_crc32 of 0 (that of no bytes) and the key of an empty text. Rows that
    repeat a doc_id each get a slot of their own. Empty tables give no rows;
    extra columns are ignored. Equal texts lie in one shard or, where a shard's
    end falls among them, in neighbouring ones.
    """
    text = F.coalesce("text", F.lit(""))
    slim = materialise(
        docs.select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")
        )
    )
    total = slim.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards * ranges_per_shard, -(-total // range_bytes))
    cuts = slim.sparkSession.sparkContext.broadcast(splitters(slim, ranges, seed=seed))

    @F.pandas_udf("long")
    def range_of(key: pd.Series) -> pd.Series:
        # side="left": a splitter ends its range, so a key that repeats fills one range alone with its near neighbours
        return pd.Series(np.searchsorted(cuts.value, key.to_numpy(), side="left"))

    placed = materialise(slim.withColumn("range", range_of("key")).withColumn("second", F.xxhash64("doc_id", F.lit(seed + 1))))
    fill = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    parts = materialise(
        fill.select(F.col("range").alias("of"), F.greatest(F.lit(1), F.ceil(F.col("bytes") * 2.0 * ranges / max(total, 1) / 3)).alias("n_parts"))
    )
    part = F.least(F.floor((F.col("second").cast("double") / 2.0**64 + 0.5) * F.col("n_parts")), F.col("n_parts") - 1)
    rows = placed.join(bounded_broadcast(parts, parts.count()), F.col("range") == F.col("of")).withColumn("part", part).drop("of", "n_parts")
    upto = Window.orderBy("of", "of_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("shard").orderBy("of", "of_part").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.sum("bytes").over(upto) - F.col("bytes") / 2
    ends = materialise(
        rows.groupBy(F.col("range").alias("of"), F.col("part").alias("of_part"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        .withColumn("shard", F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int"))
        .withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .select("of", "of_part", "shard", "offset")
    )
    inside = Window.partitionBy("range", "part").orderBy("key", "second", "doc_id", "size")
    return rows.join(bounded_broadcast(ends, ends.count()), (F.col("range") == F.col("of")) & (F.col("part") == F.col("of_part"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
