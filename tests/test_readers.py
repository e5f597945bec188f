"""Feeds and actions of readers against plain Python."""

from __future__ import annotations

import duckdb
import pandas as pd

from pressweave.plans import readers, registry

SF = "/root/testdata/sf0.001"


def candidates(picked, strange, beside=()):
    rows = [(k, True, False, 1 + k % 2, 100.0 - k) for k in picked] + [(k, False, k in beside, 1, 100.0 - k) for k in strange]
    return pd.DataFrame(rows, columns=["id", "picked", "beside", "source_count", "score"]).assign(reader="r", broad=lambda d: d["score"])


def test_interleave_slots():
    got = readers.interleave(candidates(range(1, 21), range(30, 50), {40, 41}), 12)
    assert got["exploration"].tolist() == [None] * 3 + ["category"] + [None] * 3 + ["place"] + [None] * 3 + ["category"]
    # in turn the best, and the best that two outlets have
    assert got["id"].tolist() == [1, 3, 2, 30, 5, 4, 7, 40, 6, 9, 8, 31]


def test_interleave_without_known_or_enough():
    assert readers.interleave(candidates([], range(5)), 3)["id"].tolist() == [0, 1, 2]
    got = readers.interleave(candidates([1], range(30, 40)), 8)
    assert got["id"].tolist() == [1, *range(30, 37)] and got["exploration"].tolist() == [None, "category", "category"] + [None] * 5


def test_interleave_query(spark):
    rows = registry.QUERIES["feed_interleave"](spark, SF).toPandas()
    assert rows["reader"].nunique() in (0, 10)
    for _, feed in rows.groupby("reader"):
        assert feed["id"].is_unique and sorted(feed["position"]) == list(range(1, len(feed) + 1)) and feed["exploration"].notna().sum() <= 10


def test_last_interest_stays():
    state = {"picked": ["A"], "hidden": ["B"], "country": None}
    assert readers.act(state, "interest", "A", "US") == state and readers.act(state, "hide", "A", "US") == state
    assert readers.act(state, "interest", "B", "US") == {"picked": ["A", "B"], "hidden": [], "country": None}
    assert readers.act(state, "hide", "B", "US")["hidden"] == [] and readers.act(state, "country", "", "US")["country"] == "US"


def test_actions_fold(spark):
    got = {r.user_id: r for r in registry.QUERIES["actions_fold"](spark, SF).collect()}
    events = duckdb.sql(f"SELECT user_id, event_type, CAST(floor(value) AS BIGINT) FROM '{SF}/events.parquet' ORDER BY ts, event_id").fetchall()
    want = {}
    for user, kind, number in events:
        if kind not in readers.ACTIONS:
            continue
        w = want.setdefault(user, {"picked": list(readers.DEFAULT), "hidden": [], "country": None, "saved": set(), "actions": 0})
        section = readers.SECTIONS[number % 5]
        w["actions"] += kind != "purchase"
        if kind == "purchase":
            w["saved"] ^= {number}
        elif kind == "signup":
            w["country"] = ["US", "IN", "GB"][number % 3]
        elif kind == "click" and section not in w["picked"]:
            w["picked"].append(section)
            w["hidden"] = [s for s in w["hidden"] if s != section]
        elif kind == "click" and len(w["picked"]) > 1:
            w["picked"].remove(section)
        elif kind == "error" and section in w["hidden"]:
            w["hidden"].remove(section)
        elif kind == "error" and w["picked"] != [section]:
            w["hidden"].append(section)
            w["picked"] = [s for s in w["picked"] if s != section]
    assert got.keys() == want.keys()
    for user, w in want.items():
        r = got[user]
        assert (r.picked, r.hidden, r.country, r.saved, r.actions) == (",".join(w["picked"]), ",".join(w["hidden"]), w["country"], len(w["saved"]), w["actions"])
