"""One grouping pass over the articles of one cycle, or of one connected component of it."""

from __future__ import annotations

from collections.abc import Iterable
from math import log2, sqrt

import numpy as np
import pandas as pd

#: The least similarity, its growth by log2 of a group's size, what must be left without the best term, the similarity that needs no shared name, the least similarity to a group's centre, and that of two groups.
THRESHOLD, GROWTH, RESIDUAL, NAMELESS, CENTRE, GROUP_CENTRE = 0.16, 0.25, 0.04, 0.52, 0.10, 0.30


class Group:
    """Articles in the order in which they joined, their names, and the sum of their vectors; frozen has the id of a written story, whose members never leave."""

    def __init__(self, frozen: str | None = None):
        self.frozen, self.members, self.names, self.sum = frozen, [], set(), {}

    def length(self) -> float:
        return sqrt(sum(w * w for w in self.sum.values())) or 1.0


class Pass:
    """Groups of rows (terms, weights, keys, names, also, frozen), in the order of the rows, written stories first.

    also has the names that stand for any of a row's own. Only what shares a
    key is compared, by postings of terms. Ties go to what is met first.
    """

    def __init__(self, rows: pd.DataFrame):
        self.vectors = [dict(zip(t, w)) for t, w in zip(rows["terms"], rows["weights"])]
        self.keys, self.names = [list(dict.fromkeys(k)) for k in rows["keys"]], [set(x) for x in rows["names"]]
        self.means = [mine | set(also) for mine, also in zip(self.names, rows["also"])]
        self.frozen = [None if pd.isna(x) else x for x in rows["frozen"]]
        postings: dict[str, tuple[list[int], list[float]]] = {}
        for i, vector in enumerate(self.vectors):
            for term, w in vector.items():
                where, weights = postings.setdefault(term, ([], []))
                where.append(i)
                weights.append(w)
        self.postings = {t: (np.array(where), np.array(weights)) for t, (where, weights) in postings.items() if len(where) > 1}
        self.groups: list[Group] = []
        self.by_key: dict[str, dict[int, None]] = {}

    def similar(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of article i to every article: similarity, and what is left of it without its best term."""
        total, best = np.zeros(len(self.vectors)), np.zeros(len(self.vectors))
        for term, w in self.vectors[i].items():
            if term in self.postings:
                where, weights = self.postings[term]
                product = w * weights
                total[where] += product
                best[where] = np.maximum(best[where], product)
        return total, total - best

    def met(self, articles: Iterable[int]) -> Iterable[int]:
        """Groups that share a key with one of the articles, each once."""
        return dict.fromkeys(g for i in articles for k in self.keys[i] for g in self.by_key.get(k, ()) if self.groups[g].members)

    def best_group(self, i: int, own: int = -1) -> int:
        """The group other than its own that article i fits best, or -1."""
        (sims, rests), best, most = self.similar(i), -1, 0.0
        for g in self.met([i]):
            group = self.groups[g]
            nearest = group.members[int(np.argmax(sims[group.members]))]
            sim = sims[nearest]
            if g == own or rests[nearest] < RESIDUAL or sim <= most or sim < THRESHOLD * (1 + GROWTH * log2(len(group.members))):
                continue
            if sim < NAMELESS and not self.means[i] & group.names:
                continue
            if sum(w * group.sum.get(t, 0.0) for t, w in self.vectors[i].items()) >= CENTRE * group.length():
                best, most = g, sim
        return best

    def best_neighbour(self, g: int) -> int:
        """The group, written or no smaller, that all of group g fits best, or -1."""
        mine, best, most = self.groups[g], -1, 0.0
        looks, means = [self.similar(i) for i in mine.members], set().union(*(self.means[i] for i in mine.members))
        for h in self.met(mine.members):
            other = self.groups[h]
            if h == g or (not other.frozen and len(other.members) < len(mine.members)) or not means & other.names:
                continue
            if sum(w * other.sum.get(t, 0.0) for t, w in mine.sum.items()) < GROUP_CENTRE * mine.length() * other.length():
                continue
            sim = max(s[other.members][r[other.members] >= RESIDUAL].max(initial=0.0) for s, r in looks)
            if sim >= THRESHOLD and sim > most:
                best, most = h, sim
        return best

    def join(self, i: int, g: int) -> None:
        group = self.groups[g]
        group.members.append(i)
        group.names |= self.names[i]
        for term, w in self.vectors[i].items():
            group.sum[term] = group.sum.get(term, 0.0) + w
        for key in self.keys[i]:
            self.by_key.setdefault(key, {})[g] = None

    def open(self, i: int, frozen: str | None = None) -> None:
        self.groups.append(Group(frozen))
        self.join(i, len(self.groups) - 1)

    def run(self) -> list[Group]:
        written: dict[str, int] = {}
        for i, frozen in enumerate(self.frozen):
            if frozen is not None and frozen in written:
                self.join(i, written[frozen])
            elif frozen is not None:
                written[frozen] = len(self.groups)
                self.open(i, frozen)
            elif (fits := self.best_group(i)) >= 0:
                self.join(i, fits)
            else:
                self.open(i)
        for g, group in enumerate(self.groups):
            # an article that came first may fit a group that formed after it
            if not group.frozen and len(group.members) == 1 and (fits := self.best_group(group.members[0], g)) >= 0:
                self.join(group.members[0], fits)
                group.members = []
        for g, group in enumerate(self.groups):
            if not group.frozen and group.members and (fits := self.best_neighbour(g)) >= 0:
                for i in group.members:
                    self.join(i, fits)
                group.members = []
        return [group for group in self.groups if group.members]


def group_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """(id, founder, place, size, frozen) of each row that is no anchor, for rows (id, turn, frozen, terms, weights, keys, names, also).

    Rows are taken by turn, anchors (rows with frozen) first. founder is the row
    that a group began with, place a row's number in its group.
    """
    rows = rows.assign(late=rows["frozen"].isna()).sort_values(["late", "turn", "id"]).reset_index(drop=True)
    ids, out = rows["id"].tolist(), []
    for group in Pass(rows).run():
        out += [(ids[i], ids[group.members[0]], k, len(group.members), group.frozen) for k, i in enumerate(group.members) if rows["late"][i]]
    return pd.DataFrame(out, columns=["id", "founder", "place", "size", "frozen"])


def group_cycle(rows: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, cluster_id) of one cycle's articles in the order of doc_id, without written stories and aliases; a group is named by its first member."""
    given = rows.rename(columns={"doc_id": "id"}).assign(turn=0, frozen=None)
    given["also"] = [[] for _ in range(len(given))]
    out = group_rows(given)
    first = out.groupby("founder")["id"].transform("min")
    return pd.DataFrame({"doc_id": out["id"], "cluster_id": "c_" + first.astype(str)}).sort_values("doc_id").reset_index(drop=True)
