"""Feeds of readers with interests of their own, and what readers do to those interests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators.ranking import CANDIDATES, breadth, rank
from ..sources.adapter import News
from .feeds import DESKS, HOME, INSIDE, MACRO_PATTERN, PICKED, RANK, newest
from .queues import NEARBY
from .registry import query
from .selection import SECTIONS

#: A feed's length, and the places whose stories count as beside a reader's own.
LENGTH, BESIDE = 40, [5, 6, 7]
#: Interests of a reader who has said nothing yet, typed places, and what an event stands for.
DEFAULT, TYPED = ["FURNITURE", "BUILDING", "HOUSEHOLD"], ["nation_1", "ation_7"]
ACTIONS = {"click": "interest", "error": "hide", "signup": "country", "purchase": "save"}


def interleave(rows: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """one reader's candidates in the order of their feed.

    Every fourth slot, for up to a quarter of the feed, goes in turn to what the reader hasn't picked
    and to what is near; the others go in turn to the best picked story and to the best that two outlets have.
    Where nothing is picked, all is by rank and breadth. Ties go to the smaller id.
    """
    by_rank, by_breadth = rows.sort_values(["score", "id"], ascending=[False, True]), rows.sort_values(["broad", "id"], ascending=[False, True])
    known, strange = by_rank[by_rank["picked"]], by_rank[~by_rank["picked"]]
    if known.empty:
        chosen = [(i, None) for i in by_breadth["id"][:length]]
    else:
        queues = {"known": known["id"], "many": by_breadth["id"][by_breadth["picked"] & (by_breadth["source_count"] >= 2)], "category": strange["id"], "place": strange["id"][strange["beside"]]}
        queues = {name: list(ids)[::-1] for name, ids in queues.items()}
        chosen, served, spent, turn = [], set(), 0, 0
        while len(chosen) < length:
            for ids in queues.values():
                while ids and ids[-1] in served:
                    ids.pop()
            reserve = spent < -(-length // 4)
            if len(chosen) % 4 == 3 and reserve and queues["category"]:
                kind = "place" if spent % 2 and queues["place"] else "category"
                source, spent = kind, spent + 1
            elif queues["known"]:
                source, kind = "many" if turn % 2 and queues["many"] else "known", None
                turn += 1
            elif queues["category"]:
                source, kind = "category", "category" if reserve else None
                spent += reserve
            else:
                break
            chosen.append((queues[source].pop(), kind))
            served.add(chosen[-1][0])
    out = pd.DataFrame(chosen, columns=["id", "exploration"])
    return out.assign(reader=rows["reader"].iloc[0], position=range(1, len(out) + 1))[["reader", "position", "id", "exploration"]]


@query()
def feed_interleave(spark, sf_dir):
    """A feed for each pair of a picked category and a home country; readers who picked alike share it. Each task interleaves at most 150 candidates."""
    news = News(spark, sf_dir)
    pool = news.live().orderBy(*newest()).limit(CANDIDATES)
    homes = [f"{section}/{country}" for section in SECTIONS for country in (HOME, "EUROPE")]
    wanted = F.explode(F.array(*map(F.lit, homes)))
    rows = pool.withColumn("reader", wanted).withColumn("picked", F.col("category") == F.split_part("reader", F.lit("/"), F.lit(1)))
    home = F.split_part("reader", F.lit("/"), F.lit(2))
    interest = F.when(F.col("place_id").isin(INSIDE), 1.15).otherwise(F.greatest(F.when(F.col("picked"), 1.0).otherwise(0.8), F.when(F.col("country") == home, 0.95).otherwise(0.0)))
    # the rank of a reader who picked nothing has an interest of 0.8 throughout
    plain = rank([], "", [], MACRO_PATTERN, DESKS) / 0.8
    scored = rows.withColumn("score", F.round(plain * interest, 9)).withColumn("broad", F.round(F.col("score") * breadth(F.col("source_count")), 9))
    columns = scored.select("reader", "id", "picked", F.col("place_id").isin(BESIDE).alias("beside"), "source_count", "score", "broad")
    return columns.groupBy("reader").applyInPandas(lambda group: interleave(group), "reader string, position int, id bigint, exploration string")


@query(f""", pool AS (SELECT * FROM live WHERE {" OR ".join(f"lower(topic) LIKE '%{w}%'" for w in TYPED)} ORDER BY last_seen DESC, id LIMIT {NEARBY}) SELECT id, round({RANK}, 6) AS score FROM pool""")
def local_feed_typed(spark, sf_dir):
    """The latest 200 live stories whose place holds a typed name, ranked, for readers whose places have no id."""
    typed = F.lit(False)
    for name in TYPED:
        typed = typed | F.lower("topic").contains(name)
    pool = News(spark, sf_dir).live().where(typed).orderBy(*newest()).limit(NEARBY)
    return pool.select("id", F.round(rank(PICKED, HOME, INSIDE, MACRO_PATTERN, DESKS), 6).alias("score")).orderBy(F.desc("score"), "id")


def act(state: dict, action: str, section: str, country: str) -> dict:
    """the interests after one action. The last interest can't be dropped, nor hidden away; picking a hidden section shows it again, and hiding a picked one drops it."""
    picked, hidden = state["picked"], state["hidden"]
    if action == "interest" and section in picked:
        return state if len(picked) == 1 else state | {"picked": [s for s in picked if s != section]}
    if action == "interest":
        return state | {"picked": [*picked, section], "hidden": [s for s in hidden if s != section]}
    if action == "hide" and section in hidden:
        return state | {"hidden": [s for s in hidden if s != section]}
    if action == "hide":
        rest = [s for s in picked if s != section]
        return state | {"picked": rest, "hidden": [*hidden, section]} if rest else state
    return state | {"country": country} if action == "country" else state


def fold(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One reader's actions, in order, a batch at a time; only the interests are held."""
    state, reader, n = {"picked": DEFAULT, "hidden": [], "country": None}, None, 0
    for rows in groups:
        for reader, action, section, country in rows[["user_id", "action", "section", "country"]].itertuples(index=False):
            state, n = act(state, action, section, country), n + 1
    yield pd.DataFrame([{"user_id": reader, "picked": ",".join(state["picked"]), "hidden": ",".join(state["hidden"]), "country": state["country"], "actions": n}])


@query()
def actions_fold(spark, sf_dir):
    """each reader's interests after all their actions, from the defaults, and how many stories they have saved (an even number of toggles saves none). Events without a reader are nobody's."""
    events = News(spark, sf_dir).table("events").where("user_id IS NOT NULL")
    number = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.pmod(number, F.lit(len(SECTIONS))) + 1).cast("int"))
    country = F.element_at(F.array(*map(F.lit, ["US", "IN", "GB"])), (F.pmod(number, F.lit(3)) + 1).cast("int"))
    action = F.coalesce(*[F.when(F.col("event_type") == e, a) for e, a in ACTIONS.items()])
    acted = events.select("user_id", "ts", "event_id", action.alias("action"), section.alias("section"), country.alias("country"), number.alias("story")).where("action IS NOT NULL")
    ordered = acted.where("action <> 'save'").drop("story").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    prefs = ordered.groupBy("user_id").applyInPandas(fold, "user_id bigint, picked string, hidden string, country string, actions bigint")
    toggles = acted.where("action = 'save'").groupBy("user_id", "story").agg(F.count("*").alias("n"))
    saved = toggles.groupBy("user_id").agg(F.count_if(F.col("n") % 2 == 1).alias("saved"))
    default = {"picked": ",".join(DEFAULT), "hidden": "", "actions": 0, "saved": 0}
    return prefs.join(saved, "user_id", "full_outer").fillna(default)
