"""Operator 5: approximate nearest neighbours on shifted space-filling curves.

Vectors are projected on random orthonormal axes, once for each order, made
uniform along every axis, shifted and put in Hilbert order. Each order is cut
into ranges at sampled keys whose ranks are counted over all rows. A range also
gets the rows of its neighbours that stand within a window of the cut, so a
query meets its window, so many rows to either side by rank, in the one task of
its range. The best of all windows are merged; scores are exact inner products.

How wide a window must be depends on the vectors: where they spread evenly in
many dimensions, a fixed one loses neighbours as the table grows. So the true
neighbours of PROBES queries are found over all rows, their ranks in every
order are counted, and the window is the least one that holds the share RECALL
of them in one order at least. Largest inner products are nearest points once
vectors get one more component that brings them to equal length, which is what
the curves see. Equal vectors are one point with their smallest identifiers, so
ties are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

ORDERS, AXES, BITS, WINDOW, RANGE_ROWS, NEAREST, QUERY_MODULUS, SEED = 16, 8, 6, 2048, 16_384, 20, 20, 5
#: Rows that the axes' distributions are fitted on, and keys of all orders that cuts are taken from: the bounds of what reaches the driver.
FIT_ROWS, KEY_SAMPLE, TIE_BITS = 5_000, 400_000, 15
#: Queries whose neighbours are found over all rows, and the share of these that the window is to hold; it is WINDOW at least.
PROBES, RECALL = 48, 0.96
#: Products that a task holds at once.
MEET_CELLS = 8 << 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of small non-negative integers, by the transpose method of Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """The orders' projections, distributions and shifts for vectors of one length, fitted on a sample."""

    def __init__(self, sample: np.ndarray, longest: float, orders: int = ORDERS, axes: int = AXES, seed: int = SEED):
        rng, size = np.random.default_rng(seed), sample.shape[1] + 1
        self.longest, self.axes = longest, min(axes, size)
        self.maps = [np.linalg.qr(rng.normal(size=(size, self.axes)))[0] for _ in range(orders)]
        self.shifts = rng.uniform(0, 1, (orders, self.axes))
        self.steps = np.linspace(0, 1, 257)
        self.knots = [np.quantile(self._points(sample, False) @ m, self.steps, axis=0) for m in self.maps]

    def _points(self, vectors: np.ndarray, asked: bool) -> np.ndarray:
        """Points of equal length, so that the largest inner product is the nearest point."""
        square = np.einsum("ij,ij->i", vectors, vectors)
        if asked:
            return np.column_stack([vectors * (self.longest / np.sqrt(square))[:, None], np.zeros(len(vectors))])
        return np.column_stack([vectors, np.sqrt(np.maximum(0, self.longest**2 - square))])

    def keys(self, order: int, vectors: np.ndarray, ids: np.ndarray, asked: bool = False) -> np.ndarray:
        """Keys of an order; the low bits are a hash of the identifier, so that rows of one cell still spread over ranges."""
        at = self._points(vectors, asked) @ self.maps[order]
        even = np.column_stack([np.interp(at[:, k], self.knots[order][:, k], self.steps) for k in range(self.axes)])
        cell = np.minimum(((even + self.shifts[order]) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        low = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TIE_BITS)).astype(np.int64)
        return (hilbert_keys(cell, BITS) << TIE_BITS) | low


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part: identifier and vector not null, not empty or zero, and all components finite numbers."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & nonzero
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list or binary column in double precision."""
    if pa.types.is_binary(column.type):
        data = b"".join(column.to_pylist())
        return np.frombuffer(data, dtype=np.float32 if len(data) == 4 * size * len(column) else np.float64).astype(np.float64).reshape(-1, size)
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, size)


def _products(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same bits for the same two vectors whatever else is in the block."""
    return np.einsum("j,ij->i", query, vectors)


HITS = "array<struct<minus: double, vec_id: bigint>>"


def _meet(size: int, nearest: int, window: int):
    """For each query of a range: the nearest + 1 best rows of its window, as (minus score, vec_id)."""

    def meet(there: pa.Table) -> pa.Table:
        there = there.combine_chunks()
        asked = np.asarray(there["asked"].to_numpy()).astype(bool)
        key = there["key"].to_numpy()
        rows = np.flatnonzero(~asked)
        rows = rows[np.argsort(key[rows], kind="stable")]
        queries = np.flatnonzero(asked)
        queries = queries[np.argsort(key[queries], kind="stable")]
        ids, at = there["ids"].chunk(0).take(pa.array(rows)) if len(rows) else None, np.searchsorted(key[rows], key[queries])
        out = {"h1": [], "h2": [], "hits": []}
        if len(rows) and len(queries):
            v = _matrix(there["vector"].chunk(0).take(pa.array(rows)), size)
            q = _matrix(there["vector"].chunk(0).take(pa.array(queries)), size)
            edges, flat = np.asarray(ids.offsets), np.asarray(ids.flatten())
            edges = edges - edges[0]
            step = max(1, min(64, MEET_CELLS // (2 * window + 1)))
            for first in range(0, len(queries), step):
                some = slice(first, first + step)
                low, high = max(0, at[some].min() - window), min(len(rows), at[some].max() + window)
                # a quick product chooses, with some to spare; the exact one ranks
                for x, rough in zip(q[some], q[some] @ v[low:high].T):
                    k = nearest + 1
                    near = np.arange(len(rough)) if len(rough) <= k else np.flatnonzero(rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max()))
                    near += low
                    score = np.repeat(_products(x, v[near]), edges[near + 1] - edges[near])
                    found = np.concatenate([flat[edges[i] : edges[i + 1]] for i in near])
                    order = np.lexsort((found, -score))[:k]
                    out["hits"].append([{"minus": -s, "vec_id": i} for s, i in zip(score[order].tolist(), found[order].tolist())])
            out["h1"], out["h2"] = (there[h].to_numpy()[queries] for h in ("h1", "h2"))
        kinds = {"h1": pa.int64(), "h2": pa.int64(), "hits": pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))}
        return pa.table({n: pa.array(out[n], t) for n, t in kinds.items()})

    return meet


def _top(rough: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, or all."""
    return np.arange(len(rough)) if len(rough) <= k else np.argpartition(rough, len(rough) - k)[len(rough) - k :]


def neighbour_keys(points: DataFrame, probes: np.ndarray, shared, size: int, orders: int, nearest: int) -> np.ndarray:
    """(probe, neighbour, order) keys of the nearest points of each probe, itself left out, found over all points; missing ones are -1."""
    spark = points.sparkSession
    asked = spark.sparkContext.broadcast(probes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, orders), dtype=np.int64))] * len(asked.value)
        for batch in batches:
            v, ids = _matrix(batch.column(0), size), np.asarray(batch.column(1))
            products = asked.value @ v.T
            same = np.stack([(v == q).all(axis=1) for q in asked.value])
            products[same] = -np.inf
            near = [_top(x, nearest) for x in products]
            some = np.unique(np.concatenate(near)) if near else np.zeros(0, dtype=np.int64)
            keys = np.stack([shared.value.keys(k, v[some], ids[some]) for k in range(orders)], axis=1) if len(some) else np.zeros((0, orders), dtype=np.int64)
            for p, (score, held) in enumerate(best):
                score = np.concatenate([score, products[p][near[p]]])
                held = np.concatenate([held, keys[np.searchsorted(some, near[p])]])
                keep = _top(score, nearest)
                best[p] = score[keep], held[keep]
        for p, (score, held) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), p, dtype=np.int32)), pa.array(-score), pa.array(list(held), pa.list_(pa.int64()))], names=["probe", "minus", "keys"])

    found = points.select("embedding", F.col("ids")[0].alias("id")).mapInArrow(look, "probe int, minus double, keys array<long>")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy("minus", F.col("keys")[0]))
    rows = found.where("minus < double('Infinity')").withColumn("nth", nth).where(F.col("nth") <= nearest).collect()
    out = np.full((len(probes), nearest, orders), -1, dtype=np.int64)
    for r in rows:
        out[r["probe"], r["nth"] - 1] = r["keys"]
    return out


def counted_ranks(points: DataFrame, marks: list[np.ndarray], shared, size: int, orders: int) -> list[np.ndarray]:
    """For each order, how many points have a key below each of its sorted marks: one pass over all points, added up by order and mark."""
    given = points.sparkSession.sparkContext.broadcast(marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(m) + 1, dtype=np.int64) for m in given.value]
        for batch in batches:
            v, ids = _matrix(batch.column(0), size), np.asarray(batch.column(1))
            for k in range(orders):
                n[k] += np.bincount(np.searchsorted(given.value[k], shared.value.keys(k, v, ids), side="right"), minlength=len(n[k]))
        for k, x in enumerate(n):
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(x[some])], names=["curve", "mark", "n"])

    rows = points.select("embedding", F.col("ids")[0].alias("id")).mapInArrow(count, "curve int, mark int, n long").groupBy("curve", "mark").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for k, m in enumerate(marks):
        n = np.zeros(len(m) + 1, dtype=np.int64)
        mine = rows[rows["curve"] == k]
        n[mine["mark"].to_numpy()] = mine["n"].to_numpy()
        out.append(np.cumsum(n)[:-1])
    return out


def search(vectors: DataFrame, nearest: int = NEAREST, modulus: int = QUERY_MODULUS, window: int = WINDOW, range_rows: int = RANGE_ROWS, orders: int = ORDERS, recall: float | None = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each vector whose vec_id is divisible by modulus.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than most. Rows that repeat a
    vec_id should repeat its vector; each identifier takes part once. With
    fewer candidates than nearest, all come. Empty tables give no rows; extra
    columns are ignored. window is the least one; with recall it is widened
    until it holds that share of the probes' true neighbours. A range has at
    least as many rows as the window, so a row goes to three ranges of an order
    at most, and a task holds three windows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = materialise(usable(vectors).dropDuplicates(["vec_id"]).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64("embedding", F.lit(SEED))))
    length = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if length is None:
        return spark.createDataFrame([], schema)
    size = length[0]
    rows = rows.where(F.size("embedding") == size)
    # equal vectors are one point; their smallest identifiers are all that can be among the nearest
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    equal = rows.withColumn("nth", nth).where(F.col("nth") <= nearest + 1).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % modulus == 0).select("h1", "h2", F.lit(True).alias("asked")).distinct()
    points = materialise(equal.join(asked, ["h1", "h2"], "left"))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    total, longest = points.agg(F.count("*"), F.sqrt(F.max(square))).first()
    draw = lambda seed: F.xxhash64("h1", "h2", F.lit(seed)).cast("double") / 2.0**64 + 0.5
    fit = points.where(draw(SEED) < FIT_ROWS / total).select("embedding").toArrow()["embedding"].combine_chunks()
    fit = fit if len(fit) else points.select("embedding").limit(FIT_ROWS).toArrow()["embedding"].combine_chunks()
    curves = Curves(_matrix(fit.chunk(0) if isinstance(fit, pa.ChunkedArray) else fit, size), longest, orders)
    shared = spark.sparkContext.broadcast(curves)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, ids = _matrix(batch.column(0), size), np.asarray(batch.column(1))
            for k in range(orders):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k, dtype=np.int32)), pa.array(shared.value.keys(k, v, ids))], names=["curve", "key"])

    cuts: dict[int, np.ndarray] = {}
    if total > 2 * window or total > range_rows:
        drawn = points.where(draw(SEED + 1) < KEY_SAMPLE / orders / total).select("embedding", F.col("ids")[0].alias("id")).mapInArrow(sampled, "curve int, key long").toPandas()
        keys = [np.unique(drawn["key"][drawn["curve"] == k].to_numpy()) for k in range(orders)]
        probes, near = np.zeros((0, size)), np.zeros((0, nearest, orders), dtype=np.int64)
        if recall and total > 2 * window:
            few = points.where("asked").orderBy(draw(SEED + 2), "h1", "h2").limit(PROBES).select("embedding", F.col("ids")[0].alias("id")).toPandas()
            probes, probe_ids = np.array([np.asarray(x, dtype=np.float64) for x in few["embedding"]]).reshape(-1, size), few["id"].to_numpy()
        if len(probes):
            near = neighbour_keys(points, probes, shared, size, orders, nearest)
            own = np.stack([curves.keys(k, probes, probe_ids, True) for k in range(orders)], axis=1)
            keys = [np.unique(np.concatenate([x, own[:, k], near[:, :, k].ravel()])) for k, x in enumerate(keys)]
        ranks = counted_ranks(points, keys, shared, size, orders)
        if len(probes):
            rank_of = lambda k, x: ranks[k][np.searchsorted(keys[k], x)]
            apart = np.min([np.abs(rank_of(k, near[:, :, k]) - rank_of(k, own[:, k])[:, None]) for k in range(orders)], axis=0)
            needed = np.quantile(apart[near[:, :, 0] >= 0], recall, method="higher") if (near >= 0).any() else 0
            window = max(window, int(needed) + 1)
        # a tenth more than a window, as cuts lie at marks: no window reaches beyond the next range
        n_ranges = max(1, min(int(total // max(range_rows, 1.1 * window)), min(map(len, keys)) // 4))
        if n_ranges > 1:
            for k in range(orders):
                ends = np.unique(np.searchsorted(ranks[k], total * np.arange(1, n_ranges) // n_ranges, side="left").clip(0, len(ranks[k]) - 1))
                # by counted ranks: at least a window of rows lies between these keys and the cut
                before = np.searchsorted(ranks[k], ranks[k][ends] - window, side="right") - 1
                behind = np.searchsorted(ranks[k], ranks[k][ends] + window, side="left")
                low = np.where(before >= 0, keys[k][before.clip(0)], np.iinfo(np.int64).min)
                high = np.where(behind < len(keys[k]), keys[k][behind.clip(0, len(keys[k]) - 1)], np.iinfo(np.int64).max)
                cuts[k] = np.stack([low, keys[k][ends], high])
    cut = spark.sparkContext.broadcast(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "range", "key", "asked", "h1", "h2", "ids", "vector"]
        for batch in batches:
            h1, h2, ids = (batch.column(k) for k in (0, 1, 3))
            v, first = _matrix(batch.column(2), size), np.asarray(pc.list_element(ids, 0))
            kind = np.float32 if pa.types.is_float32(batch.column(2).type.value_type) else np.float64
            vector = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size * kind().nbytes), len(v), [None, pa.py_buffer(v.astype(kind).tobytes())]).cast(pa.binary())
            ask = np.flatnonzero(np.asarray(batch.column(4).fill_null(False)))
            for k in range(orders):
                key = shared.value.keys(k, v, first)
                before, end, behind = cut.value.get(k, np.zeros((3, 0), dtype=np.int64))
                own = np.searchsorted(end, key, side="right")
                # near a cut, a row also goes to the range beyond it
                up = np.flatnonzero((own < len(end)) & (key >= np.append(before, 0)[np.minimum(own, len(end))])) if len(end) else ask[:0]
                down = np.flatnonzero((own > 0) & (key <= behind[np.maximum(own, 1) - 1])) if len(end) else ask[:0]
                mine = shared.value.keys(k, v[ask], first[ask], True)
                at = np.concatenate([np.arange(len(key)), up, down, ask])
                where = np.concatenate([own, own[up] + 1, own[down] - 1, np.searchsorted(end, mine, side="right")])
                is_query = np.arange(len(at)) >= len(at) - len(ask)
                index = pa.array(at)
                values = [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(where.astype(np.int32)), pa.array(np.concatenate([key[at[: len(at) - len(ask)]], mine])), pa.array(is_query), h1.take(index), h2.take(index), ids.take(index), vector.take(index)]
                yield pa.RecordBatch.from_arrays(values, names=names)

    spread = points.select("h1", "h2", "embedding", "ids", "asked").mapInArrow(dealt, "curve int, range int, key long, asked boolean, h1 long, h2 long, ids array<long>, vector binary")
    met = spread.groupBy("curve", "range").applyInArrow(_meet(size, nearest, window), f"h1 long, h2 long, hits {HITS}")
    # at most nearest + 1 rows for each order are gathered for a query's vector, and one of them may be the query itself
    best = met.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, nearest + 1).alias("best"))
    queries = rows.where(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, nearest)
    return queries.join(best, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score")
    )
