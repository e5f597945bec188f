"""Operator 12: spelling variants by two-dimensional range reporting.

Words one edit apart share what is before the edited place and what is after
it. Words of one length are points (rank in forward order, rank in reverse
order); for each place of a word, the interval of its prefix in forward order and
that of its suffix in reverse order make a rectangle, and a wavelet matrix
reports the points in it. Either the prefix has half of the word or the suffix
has, so a word meets its neighbours in a group of its first half (for edits
behind it) and in one of its last half (for edits before).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialise

#: Fixed by the task: least code points and occurrences of a word, how much more often a form occurs, and one in how many runs loses a code point.
LEAST_CHARS, LEAST_COUNT, TIMES, ONE_IN = 6, 5, 5, 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words in a group (with 32 for each), and rectangles that are looked up at once.
GROUP_BYTES, AT_ONCE = 4 << 20, 1 << 18


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """(word, n) of docs (doc_id, text): maximal runs of Latin letters, A-Z lower-cased, some with a code point less; a null doc_id counts as an empty one."""
    run = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}"), F.lit(0)))
    runs = docs.select("doc_id", run.alias("run")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Order:
    """Equal-width byte strings in sorted order: where each stands, and the interval of those that share its first d bytes, counted over the targets only."""

    def __init__(self, strings: np.ndarray, is_target: np.ndarray):
        order = np.argsort(strings, kind="stable")
        self.at = np.empty(len(order), dtype=np.int64)
        self.at[order] = np.arange(len(order))
        width = strings.dtype.itemsize
        rows = strings[order].view(np.uint8).reshape(len(order), width)
        differ = rows[1:] != rows[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if len(order) > 1 else np.zeros(0, dtype=np.int64)
        self.targets_before = np.concatenate([[0], np.cumsum(is_target[order])])
        self.targets = order[is_target[order]]

    def interval(self, who: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.concatenate([[0], np.flatnonzero(self.common < d) + 1, [len(self.at)]])
        k = np.searchsorted(breaks, self.at[who], side="right")
        return self.targets_before[breaks[k - 1]], self.targets_before[breaks[k]]


class WaveletMatrix:
    """A permutation, level by level by the bits of its values from the top; zeros before each place answer rectangles."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one)])))
            values = np.concatenate([values[~one], values[one]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each value in [least, most) at a place in [lo, hi), for many rectangles at once."""
        of = np.flatnonzero((lo < hi) & (least < most))
        lo, hi, base = lo[of], hi[of], np.zeros(len(of), dtype=np.int64)
        for bit, zeros in self.levels:
            lo0, hi0, n0 = zeros[lo], zeros[hi], zeros[-1]
            of, base = np.concatenate([of, of]), np.concatenate([base, base + (1 << bit)])
            lo, hi = np.concatenate([lo0, n0 + lo - lo0]), np.concatenate([hi0, n0 + hi - hi0])
            some = (lo < hi) & (base < most[of]) & (base + (1 << bit) > least[of])
            of, base, lo, hi = of[some], base[some], lo[some], hi[some]
        return of, base


def near_pairs(words: list[bytes], is_target: np.ndarray, length: int, front: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, target) of words one edit apart: targets have the given length, queries that or one less; each pair once.

    With front, places from the middle on, whose prefixes the group shares; without, those before.
    """
    forward = Order(np.array(words, dtype=f"S{length}"), is_target)
    backward = Order(np.array([w[::-1] for w in words], dtype=f"S{length}"), is_target)
    rank = np.empty(len(words), dtype=np.int64)
    rank[backward.targets] = np.arange(len(backward.targets))
    points, queries = WaveletMatrix(rank[forward.targets]), np.flatnonzero(~is_target)
    letters = np.array(words, dtype=f"S{length}").view(np.uint8).reshape(len(words), length)
    middle, held, n = length // 2, [], 0

    def look() -> tuple[np.ndarray, np.ndarray]:
        place, who, lo, hi, least, most = map(np.concatenate, zip(*held))
        of, value = points.report(lo, hi, least, most)
        place, a, b = place[of], who[of], backward.targets[value]
        # not the word itself; an insertion beside its own letter has several places, of which the last one, where the words part, counts
        once = letters[a, place] != letters[b, place]
        return a[once], b[once]

    for i in range(middle, length) if front else range(middle):
        held.append((np.full(len(queries), i), queries, *forward.interval(queries, i), *backward.interval(queries, length - 1 - i)))
        n += len(queries)
        if n >= AT_ONCE:
            yield look()
            held, n = [], 0
    if held:
        yield look()


def _near(key: tuple, rows: pa.Table) -> pa.Table:
    """For each word of a group that has near words there: how many, and the one of largest n (ties: smallest)."""
    front, length = key[0].as_py(), key[1].as_py()
    words = [w.encode("latin-1") for w in rows["word"].to_pylist()]
    n, is_target = rows["n"].to_numpy(), np.asarray(rows["target"].to_numpy(zero_copy_only=False), dtype=bool)
    sizes, found = np.array([len(w) for w in words]), [np.zeros((2, 0), dtype=np.int64)]
    if is_target.any() and not is_target.all():
        for a, b in near_pairs(words, is_target, length, front):
            found.append(np.array([a, b]))
            # words of one length are queries of each other; a shorter one is the only query of its pair
            one_way = sizes[a] < length
            found.append(np.array([b[one_way], a[one_way]]))
    word, near = np.concatenate(found, axis=1)
    order = sorted(range(len(words)), key=words.__getitem__)
    name = np.empty(len(words), dtype=np.int64)
    # rows of one word (as target and as query) get one name, in code-point order
    k = -1
    for j, x in enumerate(order):
        k += j == 0 or words[x] != words[order[j - 1]]
        name[x] = k
    by = np.lexsort((name[near], -n[near], name[word]))
    word, near = word[by], near[by]
    start = np.flatnonzero(np.diff(name[word], prepend=-1))
    size = np.diff(np.append(start, len(word)))
    said = rows["word"].combine_chunks()
    return pa.table({"word": said.take(pa.array(word[start])), "n_near": pa.array(size, pa.int64()), "best_n": pa.array(n[near[start]], pa.int64()), "best": said.take(pa.array(near[start]))})


def nearest(words: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of each of words (word, n) that has words one edit apart."""
    size = F.length("word")
    roles = [(front, F.lit(0), target) for front in (True, False) for target in (True, False)] + [(front, F.lit(1), False) for front in (True, False)]
    role = F.explode(F.array(*[F.struct(F.lit(front).alias("front"), (size + more).alias("length"), F.lit(target).alias("target")) for front, more, target in roles]))
    half = F.when(F.col("front"), F.substring("word", F.lit(1), F.floor(F.col("length") / 2).cast("int"))).otherwise(F.expr("right(word, length - length div 2)"))
    cost = (F.length("word") + 32).cast("long")
    given = materialise(words.select("word", "n", role.alias("role")).select("word", "n", "role.*").withColumn("key", F.xxhash64(half)))
    sizes = given.groupBy("front", "length").agg(F.ceil(F.sum(cost) / group_bytes).alias("buckets"))
    sizes = materialise(sizes.select(F.col("front").alias("f"), F.col("length").alias("l"), "buckets"))
    dealt = given.join(bounded_broadcast(sizes, sizes.count()), (F.col("front") == F.col("f")) & (F.col("length") == F.col("l"))).withColumn("bucket", F.pmod("key", "buckets")).drop("f", "l", "buckets", "key")
    # a half that very many words share overfills its bucket: targets and queries are dealt in parts, and each pair of parts is a group
    full = dealt.groupBy("front", "length", "bucket").agg(F.sum(cost).alias("bytes")).where(F.col("bytes") > 3 * group_bytes)
    full = materialise(full.select(F.col("front").alias("f"), F.col("length").alias("l"), F.col("bucket").alias("b"), F.ceil(F.col("bytes") / group_bytes).alias("parts")))
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0).cast("long"), parts - 1)
    pairs = F.when(F.col("target"), F.transform(every, lambda x: F.struct(own.alias("of"), x.alias("by")))).otherwise(F.transform(every, lambda x: F.struct(x.alias("of"), own.alias("by"))))
    split = dealt.join(bounded_broadcast(full, full.count()), (F.col("front") == F.col("f")) & (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")), "left")
    grouped = split.select("word", "n", "target", "front", "length", "bucket", F.explode(pairs).alias("pair")).select("word", "n", "target", "front", "length", "bucket", "pair.of", "pair.by")
    found = grouped.groupBy("front", "length", "bucket", "of", "by").applyInArrow(_near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("m")).select("word", "n_near", (-F.col("m.less")).alias("best_n"), F.col("m.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), each followed to its end: every round follows twice as far, and as a form is TIMES as frequent, chains are short."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("of"), F.col("root").alias("next"))
        new = materialise(at.join(ahead, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = new.where("moved").isEmpty()
        discard(at)
        at = new.drop("moved")
        if done:
            return at


def variants(docs: DataFrame, times: int = TIMES, group_bytes: int = GROUP_BYTES, **runs) -> DataFrame:
    """One row for each word of docs (doc_id, text): word, form, root, n, n_near, form_n.

    Null and empty texts, and texts without a run of letters, have no words;
    repeated rows and rows of null doc_id count each. A word whose near words are
    all too rare has no form (null) and is its own root. Equal n: the smallest
    form in code-point order. Empty tables give no rows; other columns are ignored.
    """
    words = materialise(vocabulary(docs, **runs))
    near = nearest(words, group_bytes).select(F.col("word").alias("of"), "n_near", "best_n", "best")
    formed = F.col("best_n") >= times * F.col("n")
    rows = materialise(words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form IS NOT NULL")).select(F.col("word").alias("of"), "root")
    return rows.join(ends, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
