"""The sections of one answer: their orderings, their pills, and the stories' bodies once each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Stories of a section's page, stories that earn a label its pill, pills of labels, and pills of a scope section.
PAGE, TOPIC_LEAST, TOPIC_PILLS, SCOPE_PILLS = 48, 3, 5, 5
SCOPES = {"local": "City", "national": "National", "international": "World"}


@dataclass(frozen=True)
class Sub:
    """A pill of a topic section: a folded category, or words."""

    name: str
    category: str | None = None
    words: tuple[str, ...] = ()

    @property
    def slug(self) -> str:
        return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in self.name.lower()).split())

    def matches(self, text: Column, category: Column, label: Column) -> Column:
        """Of the folded category; else a whole word or words of the text, or a label of this very name."""
        if self.category:
            return category == self.category
        plain = "".join(f"\\{c}" if c in r".*+?^${}()|[]\\" else c for c in "\0".join(self.words)).replace("\0", "|")
        return text.rlike(f"(?i)(?:^|[^a-z0-9])(?:{plain})(?:[^a-z0-9]|$)") | F.coalesce(label == self.slug, F.lit(False))


@dataclass(frozen=True)
class Topic:
    """A section of its own category and those that fold into it."""

    slug: str
    name: str
    categories: tuple[str, ...]
    subs: tuple[Sub, ...] = field(default=())


def label_slug(label: Column) -> Column:
    """A label as a pill's slug; null if it has none or one of a scope."""
    found = T.slug(F.coalesce(label, F.lit("")))
    return F.when((found != "") & ~found.isin(list(SCOPES)), found)


def section_slug(category: Column, topics: list[Topic]) -> Column:
    """the topic section that a category reads under, else its own slug."""
    return F.coalesce(*[F.when(category.isin(list(t.categories)), t.slug) for t in topics], T.slug(category))


def scopes(country: Column, home: str, local: Column) -> Column:
    """A story's scopes, which overlap; without a country it is neither here nor abroad."""
    found = F.array(F.when(local, "local"), F.when(country == home, "national").when(country.isNotNull(), "international"))
    return F.filter(found, lambda x: x.isNotNull())


def pages(stories: DataFrame, topics: list[Topic], home: str, score: Column, page: int = PAGE) -> DataFrame:
    """(section, pos, and the columns of stories), pos from 1: pages of all sections in one pass over stories (id, category, country, importance, last_seen).

    ``top`` is by score, ``national`` (of home) and topics by importance and
    time, ``international`` by time and importance; ties by id.
    """
    seen, weight = F.unix_micros(F.col("last_seen").cast("timestamp")).cast("double"), F.col("importance").cast("double")
    place = lambda name, a, b: F.struct(F.lit(name).alias("section"), a.alias("first"), b.alias("second"))
    of = [place("top", score, seen), F.when(F.col("country") == home, place("national", weight, seen)), F.when(F.col("country") != home, place("international", seen, weight))]
    of += [F.when(F.col("category").isin(list(t.categories)), place(t.slug, weight, seen)) for t in topics]
    rows = stories.select("*", F.explode(F.filter(F.array(*of), lambda x: x.isNotNull())).alias("at"))
    order = Window.partitionBy("at.section").orderBy(F.desc("at.first"), F.desc("at.second"), "id")
    return rows.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= page).select(F.col("at.section").alias("section"), "pos", *stories.columns)


def pills(paged: DataFrame, topics: list[Topic], categories: list[str], unpilled: tuple[str, ...] = ()) -> DataFrame:
    """(section, pos, slug, name, n) of pages (section, pos, category, topic, text, scopes): the pills of each section in their order.

    A16 to A18. A topic section has the labels of three and more stories first,
    the five most frequent, then its own pills that have a story. A scope section
    has the five categories of most stories, in declared order; ``top`` has
    scopes before them. Every page is at most PAGE rows.
    """
    label = label_slug(F.col("topic"))
    own = {t.slug: t for t in topics}
    declared = list(dict.fromkeys(next((t.slug for t in topics if c in t.categories), "".join(c.lower().split())) for c in categories if c not in unpilled))
    named = {t.slug: t.name for t in topics}
    found = [F.when((F.col("section") == t.slug) & s.matches(F.col("text"), F.col("category"), label), F.struct(F.lit(1).alias("kind"), F.lit(k).alias("rank"), F.lit(s.slug).alias("slug"), F.lit(s.name).alias("name"))) for t in topics for k, s in enumerate(t.subs)]
    curated = F.coalesce(*[F.when(F.col("section") == t.slug, F.array(*[F.lit(s.slug) for s in t.subs]) if t.subs else F.array().cast("array<string>")) for t in topics], F.array().cast("array<string>"))
    dynamic = F.when(F.col("section").isin(list(own)) & label.isNotNull() & ~F.array_contains(curated, label), F.struct(F.lit(0).alias("kind"), F.lit(0).alias("rank"), label.alias("slug"), F.lit("").alias("name")))
    section = section_slug(F.col("category"), topics)
    position = F.array_position(F.array(*map(F.lit, declared)), section).cast("int")
    pill = F.when(~F.col("section").isin(list(own)) & ~F.col("category").isin(list(unpilled)) & (position > 0), F.struct(F.lit(3).alias("kind"), position.alias("rank"), section.alias("slug"), section.alias("name")))
    scope = [F.when((F.col("section") == "top") & F.array_contains("scopes", s), F.struct(F.lit(2).alias("kind"), F.lit(k).alias("rank"), F.lit(s).alias("slug"), F.lit(n).alias("name"))) for k, (s, n) in enumerate(SCOPES.items())]
    each = paged.select("section", "pos", "topic", F.explode(F.filter(F.array(*found, dynamic, pill, *scope), lambda x: x.isNotNull())).alias("p"))
    # a label's name is that of its first story
    counts = each.groupBy("section", "p.kind", "p.rank", "p.slug", "p.name").agg(F.count("*").alias("n"), F.min_by(F.trim("topic"), "pos").alias("label"))
    counts = counts.withColumn("name", F.when(F.col("kind") == 0, F.col("label")).when(F.col("kind") == 3, F.coalesce(*[F.when(F.col("slug") == s, n) for s, n in named.items()], F.col("slug"))).otherwise(F.col("name")))
    best = Window.partitionBy("section", "kind").orderBy(F.desc("n"), F.when(F.col("kind") == 0, F.col("name")), "rank")
    kept = counts.where((F.col("kind") != 0) | (F.col("n") >= TOPIC_LEAST)).withColumn("r", F.row_number().over(best)).where((F.col("kind").isin(1, 2)) | ((F.col("kind") == 0) & (F.col("r") <= TOPIC_PILLS)) | ((F.col("kind") == 3) & (F.col("r") <= SCOPE_PILLS)))
    # labels stay by frequency, all others in declared order
    order = Window.partitionBy("section").orderBy("kind", F.when(F.col("kind") == 0, F.col("r")).otherwise(F.col("rank")))
    return kept.withColumn("pos", F.row_number().over(order)).select("section", "pos", "slug", "name", "n")


def bodies(paged: DataFrame, topics: list[Topic], since: Column) -> DataFrame:
    """(id, cslug, subs, changed) of pages: each story once, its topic section, the pills it is behind, and whether it was seen or written after since."""
    label = label_slug(F.col("topic"))
    one = paged.dropDuplicates(["id"])
    cslug = section_slug(F.col("category"), topics)
    behind = [F.when((cslug == t.slug) & s.matches(F.col("text"), F.col("category"), label), s.slug) for t in topics for s in t.subs]
    in_topic = cslug.isin([t.slug for t in topics])
    # a category without a section has only its scopes
    subs = F.array_distinct(F.filter(F.concat("scopes", F.when(in_topic, F.array(*behind, label)).otherwise(F.array().cast("array<string>"))), lambda x: x.isNotNull()))
    changed = (F.col("last_seen") > since) | F.coalesce(F.col("summarised_at") > since, F.lit(False))
    return one.select("id", cslug.alias("cslug"), subs.alias("subs"), F.coalesce(changed, F.lit(False)).alias("changed"))
