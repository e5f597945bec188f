"""All cycles of a long time at once: what may ever meet is replayed, cycle by cycle, in a task of its own.

cycles.advance() takes one cycle after another, each some dozens of short jobs.
Here weights and pairs of all cycles come from one job each; the articles that
pairs of any cycle connect go through the cycles together. Two things reach
beyond such components, aliases and twins: both are worked out anew from what a
replay has found, and given to the next one, until they are those it was given.
A replay is right at least one cycle further than the one before it, so the
last one has what cycle after cycle gives.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import cycles
from .graph import components
from .grouping import RESIDUAL, THRESHOLD, Pass, group_rows
from .newsrooms import SHORT
from .tables import dropped, written
from .twins import TWIN, TWIN_DAYS
from .vectors import alike, unit

DAY = 86_400_000_000
#: Rows of a replay by kind: a article (id, cluster_id), c cluster, g gone cluster, l written story that looks for twins in a cycle, s article (id, cluster_id) of a story that gives a cycle its aliases.
FOUND = "kind string, component long, k int, id long, cluster_id string, written boolean, headline string, summarised long, article_count long, source_count long, prominence long, first long, last long, fresh boolean"


@dataclass
class Story:
    """A cluster; times in microseconds."""

    written: bool = False
    headline: str | None = None
    summarised: int | None = None
    numbers: tuple[int, int, int] = (0, 0, 0)
    first: int = 0
    last: int = 0


class Component:
    """The state of articles that may meet: cluster of each, clusters, and ids that are gone. articles have id, source_id, title, tier, prominent, content_hash, published, size and shingles."""

    def __init__(self, articles: pd.DataFrame):
        self.articles = {a.id: a for a in articles.itertuples(index=False)}
        self.sets = {i: frozenset(() if a.shingles is None else a.shingles) for i, a in self.articles.items()}
        self.at: dict[int, str] = {}
        self.members: dict[str, set[int]] = defaultdict(set)
        self.stories: dict[str, Story] = {}
        self.gone: list[str] = []

    def newsrooms(self, full: list) -> int:
        """As newsrooms.independent() counts them."""
        one: dict = {}
        for a in sorted(full, key=lambda a: (-a.size, a.published, a.id)):
            one.setdefault(a.source_id, a)
        kept, n = [], 0
        for a in sorted(one.values(), key=lambda a: (-a.size, a.id)):
            mine = self.sets[a.id]
            if a.size > SHORT and mine:
                if any(2 * (both := len(mine & other)) >= len(mine) + len(other) - both for other in kept):
                    continue
                kept.append(mine)
            n += 1
        return n

    def recount(self, cluster: str) -> None:
        """As newsrooms.recount()."""
        story, held = self.stories[cluster], [self.articles[i] for i in self.members[cluster]]
        full = [a for a in held if (a.tier or "full") != "title"]
        story.numbers = len({str(a.id) if a.content_hash is None else a.content_hash for a in full}), self.newsrooms(full), len({a.source_id for a in held if a.prominent and a.source_id is not None})
        if not story.written:
            story.first, story.last = min(a.published for a in held), max(a.published for a in held)

    def move(self, i: int, cluster: str) -> None:
        if i in self.at:
            self.members[self.at[i]].discard(i)
        self.at[i] = cluster
        self.members[cluster].add(i)

    def drop(self, cluster: str) -> None:
        self.gone.append(cluster)
        del self.stories[cluster], self.members[cluster]

    def claimed(self, groups: list[tuple], second: int) -> list[tuple[int, str]]:
        """(id, cluster) of groups' rows (id, founder, place, size, frozen), as cycles.claimed()."""
        votes: dict = defaultdict(lambda: defaultdict(lambda: [0, 1 << 60]))
        began = {}
        for i, founder, place, size, frozen in groups:
            if frozen is None:
                began[founder] = min(began.get(founder, (1 << 60,)), (place, size, self.articles[i].published))
                if i in self.at:
                    mine = votes[founder][self.at[i]]
                    mine[0], mine[1] = mine[0] + 1, min(mine[1], place)
        wants = {founder: min((-n, place, was) for was, (n, place) in of.items()) for founder, of in votes.items()}
        wins, taken = {}, set()
        for founder in sorted(wants, key=lambda f: (wants[f][0], -began[f][1], began[f][2], f)):
            if (was := wants[founder][2]) not in taken:
                taken.add(was)
                wins[founder] = was
        named = {f: wins.get(f) or (f"c_{f}.{second}" if f"c_{f}" in self.used else f"c_{f}") for f in began}
        return [(i, named[founder] if frozen is None else frozen) for i, founder, _, _, frozen in groups]

    def cycle(self, rows: pd.DataFrame, second: int) -> None:
        """As cycles.cycle(), for candidates (id, published, terms, weights, keys, names, also)."""
        was = [self.at.get(i) for i in rows["id"]]
        frozen = [c if c is not None and self.stories[c].written else None for c in was]
        self.used = {c for c in was if c is not None}
        if len(rows) == 1:
            groups = [] if frozen[0] else [(rows["id"].iloc[0], rows["id"].iloc[0], 0, 1, None)]
        elif all(frozen):
            groups = []
        else:
            found = group_rows(rows.assign(turn=rows["published"], frozen=pd.Series(frozen, index=rows.index, dtype=object)))
            groups = [(i, f, p, n, None if pd.isna(z) else z) for i, f, p, n, z in found.itertuples(index=False, name=None)]
        moved = [(int(i), c) for i, c in self.claimed(groups, second) if self.at.get(i) != c]
        touched = {c for _, c in moved} | {self.at[i] for i, _ in moved if i in self.at}
        for i, c in moved:
            self.stories.setdefault(c, Story())
            self.move(i, c)
        for c in touched:
            if self.members[c]:
                self.recount(c)
            else:
                self.drop(c)

    def write_up(self, as_of: int, least_sources: int = 2) -> None:
        """As cycles.write_up()."""
        for c, story in self.stories.items():
            if not story.written and story.numbers[1] >= least_sources:
                first = min((self.articles[i] for i in self.members[c]), key=lambda a: (a.published, a.id))
                story.written, story.headline, story.summarised = True, first.title or "", as_of

    def live(self, as_of: int) -> list[str]:
        """Written stories that have part in the merging of twins, in its order."""
        return sorted((c for c, s in self.stories.items() if s.written and s.headline is not None and s.last >= as_of - TWIN_DAYS * DAY), key=lambda c: (self.stories[c].first, c))

    def merge(self, live: list[str], edges: dict[tuple[str, str], float], as_of: int) -> None:
        """As twins.merge_twins(), for twins of this cycle and how alike they are."""
        place, near = {c: k for k, c in enumerate(live)}, defaultdict(list)
        for (a, b), sim in edges.items():
            if a in place and b in place:
                near[a].append((sim, place[b], b))
                near[b].append((sim, place[a], a))
        strength, lost = {c: (self.stories[c].numbers[1], -self.stories[c].first) for c in near}, {}
        for c in live:
            there = [x for x in near[c] if x[2] not in lost]
            if c in lost or not there or self.stories[c].summarised < as_of:
                continue
            other = max(there)[2]
            lose, keep = (other, c) if strength[c] > strength[other] else (c, other)
            lost[lose] = keep
        for lose, keep in lost.items():
            while keep in lost:
                keep = lost[keep]
            for i in list(self.members[lose]):
                self.move(i, keep)
        for keep in set(lost.values()) - set(lost):
            self.recount(keep)
        for lose in lost:
            self.drop(lose)


def close(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b) of the rows (id, terms, weights) of a cycle that may join a group by each other: its articles, some days' of them, are looked up one by one."""
    rows = rows.sort_values("id").reset_index(drop=True)
    none = [[]] * len(rows)
    ids, looks, found = rows["id"].to_numpy(), Pass(rows.assign(keys=none, names=none, also=none, frozen=None)), []
    for i in range(len(rows)):
        sims, rests = looks.similar(i)
        near = np.flatnonzero((sims[i + 1 :] >= THRESHOLD * (1 - 1e-9)) & (rests[i + 1 :] >= RESIDUAL * (1 - 1e-9))) + i + 1
        found += [(ids[i], ids[j]) for j in near]
    return pd.DataFrame(found, columns=["a", "b"])


def replay(times: list[tuple[int, int]], span: int):
    """A function for cogroups: candidates and articles of one component -> FOUND, for times (microseconds, seconds in names of new clusters)."""
    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def run(component: int, candidates: pd.DataFrame, state: Component, edges: dict) -> Iterator[dict]:
        by = dict(list(candidates.groupby("k")))
        for k in range(min(by), min(len(times), max(by) + span)):
            as_of, second = times[k]
            for c, story in state.stories.items():
                if story.numbers[1] >= cycles.ALIAS_SOURCES:
                    yield from ({"kind": "s", "k": k, "id": i, "cluster_id": c} for i in state.members[c] if as_of - cycles.CORPUS_DAYS * DAY <= state.articles[i].published <= as_of)
            if k in by:
                state.cycle(by[k].reset_index(drop=True), second)
                state.write_up(as_of)
            live = state.live(as_of)
            yield from ({"kind": "l", "k": k, "cluster_id": c, "headline": state.stories[c].headline, "fresh": state.stories[c].summarised >= as_of} for c in live)
            if k in edges:
                state.merge(live, edges[k], as_of)
        yield from ({"kind": "a", "id": i, "cluster_id": c} for i, c in state.at.items())
        yield from ({"kind": "g", "cluster_id": c} for c in state.gone)
        for c, s in state.stories.items():
            yield {"kind": "c", "cluster_id": c, "written": s.written, "headline": s.headline, "summarised": s.summarised, "article_count": s.numbers[0], "source_count": s.numbers[1], "prominence": s.numbers[2], "first": s.first, "last": s.last}

    def rows(candidates: pd.DataFrame, articles: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates):
            return pd.DataFrame(columns=names)
        edges: dict = defaultdict(dict)
        for given in articles["twins"]:
            for x in () if given is None else given:
                edges[x["k"]][x["a"], x["b"]] = x["sim"]
        component = int(articles["component"].iloc[0])
        found = pd.DataFrame(list(run(component, candidates, Component(articles), edges)), columns=names, dtype=object)
        return found.where(found.notna(), None).assign(component=component)

    return rows


class History:
    """What cycles at times read of articles (cycles.ARTICLE), for all of them at once; times are hop apart, the last one no further."""

    def __init__(self, articles: DataFrame, times: list[datetime], hop: timedelta):
        self.times, self.hop, spark = times, int(hop / timedelta(microseconds=1)), articles.sparkSession
        self.turns = spark.createDataFrame(list(enumerate(times)), "k int, as_of timestamp")
        self.micros = [r.m for r in self.turns.orderBy("k").select(F.unix_micros("as_of").alias("m")).collect()]
        title, lead = F.coalesce("title", F.lit("")), F.coalesce("lead", F.lit(""))
        recent = self.read(articles.select("id", "published_at", F.concat_ws(" ", title, lead).alias("text")), cycles.CORPUS_DAYS, "array")
        # articles that the same cycles read count together before each cycle's are added up
        terms = recent.select("ks", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("ks", "term").agg(F.count("*").alias("n"))
        total = recent.groupBy("ks").agg(F.count("*").alias("n")).select(F.explode("ks").alias("k"), "n").groupBy("k").agg(F.sum("n").alias("total"))
        self.corpus = written(terms.select(F.explode("ks").alias("k"), "term", "n").groupBy("k", "term").agg(F.sum("n").alias("df")).join(F.broadcast(total), "k"))
        read = self.read(articles.select("id", "published_at", title.alias("title"), F.concat_ws(" ", title, title, title, lead).alias("text")), cycles.CANDIDATE_DAYS, "rows")
        self.candidates = written(read.select("k", "id", F.explode(F.array(T.names(F.col("title")))).alias("names")))
        tf = read.select("k", "id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("k", "id", "term").agg(F.count("*").alias("n"))
        # equal weights by term, to nine places, so that no summing order shows
        heavy = F.array_sort(F.collect_list(F.struct((-F.round("w", 9)).alias("less"), "term", "w")))
        vectors = unit(tf, self.corpus, ("k",)).groupBy("k", "id").agg(heavy.alias("v"))
        self.vectors = written(vectors.select("k", "id", F.col("v.term").alias("terms"), F.col("v.w").alias("weights")))
        pairs = self.vectors.groupBy("k").applyInPandas(close, "a long, b long")
        self.components = components(pairs.select("a", "b").distinct())

    def read(self, rows: DataFrame, days: int, how: str) -> DataFrame:
        """rows with the cycles that read them, of so many days: an array ks, or a row for each k."""
        since = F.unix_micros("published_at") - self.micros[0]
        first, last = F.floor(since / self.hop) - 1, F.floor((since + days * DAY) / self.hop) + 2
        near = rows.where(F.unix_micros("published_at") <= self.micros[-1]).withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.lit(0), F.least(last, F.lit(len(self.times) - 1))))))
        near = near.join(F.broadcast(self.turns), "k").where((F.col("published_at") >= F.col("as_of") - F.expr(f"INTERVAL {days} DAYS")) & (F.col("published_at") <= F.col("as_of"))).drop("as_of")
        return near if how == "rows" else near.groupBy("id", "text").agg(F.array_sort(F.collect_list("k")).alias("ks"))

    def pairs(self, v: DataFrame, least: float, residual: float) -> DataFrame:
        """(k, a, b, sim) of alike() within each cycle, for v (k, id, term, w, still)."""
        apart = v.select(F.struct("k", "id").alias("id"), F.concat_ws(" ", "k", "term").alias("term"), "w", "still")
        return alike(written(apart), least, residual).select("a.k", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "sim")

    def aliases(self, sure: DataFrame, names: DataFrame) -> DataFrame:
        """(k, name, alias), as cycles.aliases() has them of each cycle, of the articles sure (k, id, cluster_id) and names (id, names)."""
        named = sure.join(names, "id").select("k", "cluster_id", F.explode("names").alias("name")).distinct()
        total = sure.groupBy("k").agg(F.count_distinct("cluster_id").alias("total"))
        rare = named.groupBy("k", "name").agg(F.count("*").alias("n")).join(F.broadcast(total), "k").where(F.col("n") <= F.greatest(F.lit(float(cycles.LEAST_COMMON)), F.col("total") * cycles.COMMON)).select("k", "name")
        few = named.join(rare, ["k", "name"])
        small = few.groupBy("k", "cluster_id").agg(F.count("*").alias("names")).where(F.col("names") <= cycles.MOST_NAMES).select("k", "cluster_id")
        few = few.join(small, ["k", "cluster_id"], "left_semi")
        both = few.join(few.withColumnRenamed("name", "alias"), ["k", "cluster_id"]).where("name <> alias").groupBy("k", "name", "alias").agg(F.count("*").alias("n"))
        return both.where(F.col("n") >= cycles.ALIAS_CLUSTERS).select("k", "name", "alias")

    def twins(self, live: DataFrame) -> DataFrame:
        """(k, a, b, sim, component_a, component_b) of stories live (component, k, cluster_id, headline, fresh), as twins.twin_pairs() has them of each cycle."""
        rows = live.select("component", "k", F.col("cluster_id").alias("id"), F.coalesce("headline", F.lit("")).alias("headline"), (~F.col("fresh")).alias("still"))
        tf = rows.select("k", "id", F.explode(T.tokens(F.col("headline"))).alias("term")).groupBy("k", "id", "term").agg(F.count("*").alias("n"))
        v = unit(tf, self.corpus, ("k",)).join(rows.select("k", "id", "still"), ["k", "id"])
        named = rows.select("k", F.col("id"), T.names(F.col("headline")).alias("names"), "component")
        both = self.pairs(v, TWIN, RESIDUAL).join(named.toDF("k", "a", "names_a", "component_a"), ["k", "a"]).join(named.toDF("k", "b", "names_b", "component_b"), ["k", "b"])
        return both.where(F.arrays_overlap("names_a", "names_b")).select("k", "a", "b", "sim", "component_a", "component_b")

    def run(self, articles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """State (articles, clusters) after all cycles, and ids (id) of clusters that are gone."""
        spark, kept = articles.sparkSession, ["source_id", "title", "tier", "prominent", "content_hash"]
        met = articles.join(self.components.select("id"), "id", "left_semi")
        # words in a column of their own, as a shingle would find them anew
        sized = met.select("id", *kept, F.unix_micros("published_at").alias("published"), F.length(F.coalesce("body", F.lit(""))).alias("size"), F.explode(F.array(F.when(F.length("body") > SHORT, T.tokens(F.col("body"))))).alias("w"))
        texts = written(sized.withColumn("shingles", F.transform(T.shingles(F.col("w")), lambda s: F.xxhash64(s))).drop("w"))
        none = F.array().cast("array<string>")
        rows = self.candidates.join(self.components.select("id"), "id", "left_semi").join(self.vectors, ["k", "id"], "left").withColumn("terms", F.coalesce("terms", none))
        rows = written(rows.select("k", "id", "terms", F.coalesce("weights", F.array().cast("array<double>")).alias("weights"), F.concat(F.slice("terms", 1, cycles.KEYS), "names").alias("keys"), "names"))
        names = rows.select("id", "names").distinct()
        at, known = self.components, spark.createDataFrame([], "k int, name string, alias string")
        edges = spark.createDataFrame([], "k int, a string, b string, sim double, component_a long, component_b long")
        span = int(cycles.CORPUS_DAYS * DAY / self.hop) + 3
        work = replay([(m, int(t.timestamp())) for m, t in zip(self.micros, self.times)], span)
        while True:
            also = rows.select("k", "id", F.explode("names").alias("name")).join(known, ["k", "name"]).groupBy("k", "id").agg(F.collect_set("alias").alias("also"))
            given = rows.join(at, "id").join(texts.select("id", "published"), "id").join(also, ["k", "id"], "left").withColumn("also", F.coalesce("also", none))
            # twins travel with the first article of their component
            told = edges.where("component_a = component_b").groupBy(F.col("component_a").alias("id")).agg(F.collect_list(F.struct("k", "a", "b", "sim")).alias("twins"))
            of = texts.join(at, "id").join(told, "id", "left")
            of = of.toDF(*of.columns)
            found = written(given.groupBy("component").cogroup(of.groupBy("component")).applyInPandas(lambda x, y: work(x, y), FOUND))
            alias, twins = written(self.aliases(found.where("kind = 's'").select("k", "id", "cluster_id"), names)), written(self.twins(found.where("kind = 'l'")))
            apart = twins.where("component_a <> component_b")
            if same(alias, known) and same(twins.select("k", "a", "b", F.round("sim", 9)), edges.select("k", "a", "b", F.round("sim", 9))) and apart.isEmpty():
                break
            if not apart.isEmpty():
                joined = components(apart.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct())
                at = written(at.join(joined.toDF("component", "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component")))
                to = lambda side: joined.toDF(f"component_{side}", f"to_{side}")
                twins = written(twins.join(to("a"), "component_a", "left").join(to("b"), "component_b", "left").select("k", "a", "b", "sim", F.coalesce("to_a", "component_a").alias("component_a"), F.coalesce("to_b", "component_b").alias("component_b")))
            dropped(found)
            known, edges = alias, twins
        return self.state(articles, found)

    def state(self, articles: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What run() returns, of the last replay and of the articles that never meet another."""
        full = (F.coalesce("tier", F.lit("full")) != "title").cast("long")
        own = F.concat(F.lit("c_"), F.col("id").cast("string"))
        alone = articles.join(self.candidates.select("id").distinct(), "id", "left_semi").join(self.components.select("id"), "id", "left_anti")
        prominent = F.coalesce(F.col("prominent") & F.col("source_id").isNotNull(), F.lit(False)).cast("long")
        single = alone.select(own.alias("id"), F.lit(False).alias("written"), F.lit(None).cast("string").alias("headline"), F.lit(None).cast("timestamp").alias("summarised_at"), full.alias("article_count"), full.alias("source_count"), prominent.alias("prominence"), F.col("published_at").alias("first_seen"), F.col("published_at").alias("last_seen"))
        at = lambda name: F.timestamp_micros(name)
        several = found.where("kind = 'c'").select(F.col("cluster_id").alias("id"), "written", "headline", at("summarised").alias("summarised_at"), "article_count", "source_count", "prominence", at("first").alias("first_seen"), at("last").alias("last_seen"))
        moved = found.where("kind = 'a'").select("id", "cluster_id").union(alone.select("id", own))
        return cycles.applied(articles, moved), several.union(single), found.where("kind = 'g'").select(F.col("cluster_id").alias("id"))


def same(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def history(articles: DataFrame, times: list[datetime], hop: timedelta) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State (articles, clusters) after cycles at times over articles (cycles.ARTICLE) that are in no cluster yet, and the ids (id) of clusters that are gone: what cycles.advance() gives in turn."""
    return History(articles, times, hop).run(articles)
