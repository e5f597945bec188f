"""Queries over small tables of odd rows, against their SQL."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from pressweave.plans import registry

from .compare import of_duckdb, of_spark


def differences(spark, name, folder):
    (columns, rows), (want_columns, want) = of_spark(registry.QUERIES[name](spark, str(folder))), of_duckdb(registry.ORACLES[name], str(folder))
    assert columns == want_columns and rows
    return list((rows - want).items())[:3], list((want - rows).items())[:3]


def test_titles_of_pages_may_hold_bare_signs_and_halves_of_entities(spark, tmp_path):
    titles = ["Plain", "Profit & Loss", "Cut short &am", "Ends in &", "Both &amp; and &lt;b&gt;", "Twice &amp;lt;", "Says &quot;so&quot;", 'Says "so"', "Unknown &nbsp; here", "1 > 0", "&#65; and &x;"]
    pages = [(k, f"http://{'ab'[k % 2]}.example/{k}?x=\"1\"&y=<2>", f"<html><head><title>{t}</title></head></html>") for k, t in enumerate(titles * 3, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet' (FORMAT parquet)")
    assert differences(spark, "feed_items", tmp_path) == ([], [])


def test_importance_adds_in_the_order_of_rows(spark, tmp_path):
    """Halves of discounts' means hang on the order of adding; on one thread the SQL adds row by row, while Spark reads parts."""
    r = random.Random(4)
    keys = [k for k in range(15_000) for _ in range(r.choice([2, 4, 4, 6, 8]))]
    r.shuffle(keys)
    rows = pa.table({"l_orderkey": pa.array(keys, pa.int64()), "l_linenumber": pa.array([r.choice([1, 1, 2]) for _ in keys], pa.int32()), "l_discount": pa.array([None if k < 5 or r.random() < 0.01 else r.randrange(11) / 100 for k in keys], pa.float64())})
    pq.write_table(rows, tmp_path / "lineitem.parquet", row_group_size=3000)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    want = set(con.execute(registry.ORACLES["clamped_importance"]).fetchall())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {tuple(x) for x in registry.QUERIES["clamped_importance"](spark, str(tmp_path)).select("id", "importance", "threshold").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(got) == 15_000
