"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP = """a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its
just like may me more most new no not of on one only or other our out over said say says she should so some such than that the their them then there
these they this those to up was we were what when where which who will with would you your years year news first two three before during under being""".split()
#: Fixed value: months and weekdays, which recur in headlines of one shape.
PERIODIC = r"\b(january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
#: A word's edge counting only ASCII letters, digits and the underscore as word characters, which Java's own doesn't.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: What a word and what a name is.
TOKEN, NAME = r"[a-z][a-z'’-]{2,}", rf"{EDGE}([A-Z][a-z’'-]{{2,}}(?:\s+[A-Z][a-z’'-]{{2,}})*){EDGE}"
HALF_SHINGLE, SHINGLE = 0.5, 5


def tokens(text: Column) -> Column:
    """Lower-cased words of three letters and more, without possessives and stop words, in order, with repeats."""
    bare = F.regexp_replace(F.lower(text), "['’]s(?![a-z'’-])", "")
    return F.filter(F.regexp_extract_all(bare, F.lit(TOKEN), F.lit(0)), lambda w: ~w.isin(STOP))


def names(text: Column) -> Column:
    """Distinct capitalised names, lower-cased, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(1)), F.lower)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP)))


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct windows of n words joined by spaces; fewer words give one, none give none."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) > 0, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def signature(title: Column) -> Column:
    """A headline's shape: without dates, digits and punctuation."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(title), PERIODIC, " "), "[^a-z ]+", " ")
    return F.trim(F.regexp_replace(plain, " +", " "))


def fingerprint(words: Column) -> Column:
    """The first twelve of the sorted words, joined by full stops."""
    return F.array_join(F.slice(F.array_sort(words), 1, 12), ".")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 0.5))
