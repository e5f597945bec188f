"""Operator 11: Merkle manifest of a dataset, upper tree broadcast.

Rows are hashed to leaves in the JVM and ranked inside their source by one
range sort and counted offsets. Executors fold large blocks of 16**3
consecutive leaves to one node each; while more nodes are left than TOP, blocks
of these are folded again. The driver builds the small top tree and broadcasts
its suffix paths, and executors finish each row's proof and fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import sha256
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, bounded_broadcast, discard, materialise

#: Nodes of a run, levels that one block folds, and the most nodes (and so suffix paths, of a few kB each) that the driver takes.
FAN, LEVELS, TOP = 16, 3, 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels until n nodes are one."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def tree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings before and after node i and each of its ancestors below the last level."""
    out = []
    for nodes in levels[:-1]:
        run = i // FAN * FAN
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + FAN])))
        i //= FAN
    return out


def fold(node: str, siblings) -> str:
    """The root that a node and its siblings give."""
    for before, after in siblings:
        node = digest(before, node, after)
    return node


def leaf_of(columns: dict[str, Column]) -> Column:
    """Leaf of a row: each field as its byte count, a colon and the value, or ``-`` for null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*said), 256))


def ranked(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """rows with ``pos`` (from 0 in their group, null a group of its own) and ``n`` (rows of the group), nulls first.

    Rows are sorted once by ranges of (group, order), so that a group of any size
    is dealt over many tasks; counts of each group in each range give the offsets.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    there = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    ranges = there.groupBy(F.col(group).alias("group_of"), F.shiftright("at", 33).alias("range_of")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    before = Window.partitionBy("group_of").orderBy("range_of").rowsBetween(Window.unboundedPreceding, -1)
    ranges = materialise(ranges.select("group_of", "range_of", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("offset"), F.sum("size").over(Window.partitionBy("group_of")).alias("n")))
    same = F.col(group).eqNullSafe(F.col("group_of")) & (F.shiftright("at", 33) == F.col("range_of"))
    return there.join(bounded_broadcast(ranges, ranges.count()), same).withColumn("pos", F.col("at") + F.col("offset")).drop("group_of", "range_of", "offset", "at")


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a block of consecutive nodes: its node after LEVELS levels, or fewer if its tree ends before, and the nodes with what they carry."""
    rows = rows.sort_by("pos")
    n = rows["n"][0].as_py()
    nodes = [x.hex() for x in rows["node"].to_pylist()]
    top = tree(nodes, min(LEVELS, depth(n)))[-1][0]
    packed = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in rows.schema.names[4:]], names=rows.schema.names[4:])
    values = [pa.array([key[0].as_py()], rows.schema.field("source").type), pa.array([key[1].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([bytes.fromhex(top)], pa.binary())]
    return pa.table([*values, pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed)], names=["source", "pos", "n", "node", "rows"])


def blocks(nodes: DataFrame) -> DataFrame:
    """Blocks (source, pos, n, node, rows) of nodes (source, pos, n, node and what each carries); n stays the number of nodes below."""
    carried = T.StructType([f for f in nodes.schema.fields if f.name not in ("source", "pos", "n")])
    ordered = nodes.select("source", F.floor(F.col("pos") / FAN**LEVELS).alias("block"), "pos", "n", *carried.names)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("rows", T.ArrayType(carried))])
    return materialise(ordered.groupBy("source", "block").applyInArrow(_block, schema))


def _descend(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each node below a block gets from the block's path: its own path (``path``), or proof and fold of each row (``row``), or both (``proof``)."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = {c: batch.column(c)[i] for c in batch.schema.names}
            rows, suffix = block["rows"].values, [(x["before"], x["after"]) for x in block["path"].as_py()]
            nodes = [x.hex() for x in rows.field("node").to_pylist()]
            levels = tree(nodes, min(LEVELS, depth(block["n"].as_py())))
            paths = [path(levels, k) + suffix for k in range(len(nodes))]
            subroot = pa.array([block["subroot"].as_py()] * len(nodes), pa.string())
            said = pa.array([[{"before": a, "after": b} for a, b in p] for p in paths] if kind != "row" else [None] * len(nodes), pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
            if kind == "path":
                first = block["pos"].as_py() * FAN**LEVELS
                yield pa.RecordBatch.from_arrays([pa.array([block["source"].as_py()] * len(nodes), pa.string()), pa.array(range(first, first + len(nodes)), pa.int64()), said, subroot], names=["source", "pos", "path", "subroot"])
                continue
            changed = [x and x.hex() for x in rows.field("changed").to_pylist()]
            folded = [fold(b or a, p) for a, b, p in zip(nodes, changed, paths)]
            proofs = [digest(*(s for level in p for s in level)) for p in paths]
            yield pa.RecordBatch.from_arrays([rows.field("doc_id"), pa.array(nodes), subroot, pa.array(proofs), pa.array(folded), said], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "proof"])


def _top(nodes: list, over_sources: bool) -> tuple[str, list[tuple]]:
    """Root, and (source, pos, path, subroot) of each of the few nodes that are left."""
    utf8 = lambda s: (s is not None, (s or "").encode())
    by: dict = {}
    for r in sorted(nodes, key=lambda r: (utf8(r.source), r.pos)):
        by.setdefault(r.source, []).append(bytes(r.node).hex())
    trees = {s: tree(x, depth(len(x))) for s, x in by.items()}
    if not over_sources:
        ((_, levels),) = trees.items()
        return levels[-1][0], [(None, k, path(levels, k), None) for k in range(len(levels[0]))]
    upper = tree([t[-1][0] for t in trees.values()], depth(len(trees)))
    return upper[-1][0], [(s, k, path(t, k) + path(upper, i), t[-1][0]) for i, (s, t) in enumerate(trees.items()) for k in range(len(t[0]))]


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, proofs: bool = False, most: int = TOP) -> DataFrame:
    """One row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; with proofs also ``proof``.

    tampered gives columns in place of a row's own, where its fold is to start
    from a changed row; null in all of them means unchanged. A null source is a
    source of its own, before the others; rows of null doc_id come first in
    their source. Rows that repeat a doc_id are in the order of their leaves,
    and equal rows each have a place. Empty tables give no rows; extra columns
    are ignored. proof is the list of siblings before and after, level by level.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = {c: F.col(c) for c in FIELDS}
    changed = F.lit(None).cast("binary")
    if tampered:
        changed = F.when(reduce(or_, [c.isNotNull() & ~c.eqNullSafe(own[k]) for k, c in tampered.items()]), leaf_of({k: F.coalesce(tampered.get(k, c), c) for k, c in own.items()}))
    leaves = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_of(own).alias("node"), changed.alias("changed")).withColumn("row", F.monotonically_increasing_id()))
    rounds = [blocks(ranked(leaves, "source", ("doc_id", "node", "row")).select("source", "pos", "n", "node", "doc_id", "changed"))]
    discard(leaves)
    after = lambda df: df.select("source", "pos", F.ceil(F.col("n") / FAN**LEVELS).alias("n"), "node")
    nodes, over_sources, joined_at = after(rounds[0]), True, None
    while (left := nodes.agg(F.count("*").alias("nodes"), F.max("n").alias("n")).first()).nodes > most:
        if left.n == 1 and over_sources:
            # one node for each of very many sources: their roots are the nodes of one more tree
            over_sources, joined_at = False, len(rounds)
            nodes = ranked(nodes.select(F.lit(None).cast("string").alias("all"), F.col("source").alias("of"), F.col("node")), "all", ("of",)).select(F.col("all").alias("source"), "pos", "n", "node", "of")
        rounds.append(blocks(nodes))
        nodes = after(rounds[-1])
    root, paths = _top(nodes.select("source", "pos", "node").collect(), over_sources) if left.nodes else ("", [])
    steps = spark.createDataFrame([(s, k, [{"before": a, "after": b} for a, b in p], r) for s, k, p, r in paths], f"source string, pos long, path {PATH}, subroot string")
    hint = F.broadcast
    for k in range(len(rounds) - 1, -1, -1):
        below = rounds[k].select("source", "pos", "n", "rows")
        step = hint(steps.select(F.col("source").alias("of"), F.col("pos").alias("at"), "path", "subroot"))
        joined = below.join(step, F.col("source").eqNullSafe(F.col("of")) & (F.col("pos") == F.col("at"))).drop("of", "at")
        if k:
            steps, hint = joined.mapInArrow(partial(_descend, "path"), f"source string, pos long, path {PATH}, subroot string"), lambda df: df
            if k == joined_at:
                # from the tree of all sources back to each source's own: its only node is its root
                own_root = rounds[k].select("pos", F.posexplode("rows").alias("k", "row")).select((F.col("pos") * FAN**LEVELS + F.col("k")).alias("place"), F.col("row.of").alias("source"), F.lower(F.hex("row.node")).alias("subroot"))
                steps = steps.select(F.col("pos").alias("to"), "path").join(own_root, F.col("to") == F.col("place")).select("source", F.lit(0).cast("long").alias("pos"), "path", "subroot")
            steps = materialise(steps)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, proof_sha256 string, folded_root string, proof {PATH}"
    done = joined.mapInArrow(partial(_descend, "proof" if proofs else "row"), schema).withColumn("root", F.lit(root)).withColumn("verified", F.col("folded_root") == F.col("root"))
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if proofs else []))


def lowered_text(every: int = 5) -> dict[str, Column]:
    """Tampering: where every divides the unsigned crc32 of the decimal doc_id, the text's A-Z are lower-cased."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"text": F.when(drawn, F.translate("text", UPPER, LOWER))}
