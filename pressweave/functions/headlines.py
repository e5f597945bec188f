"""Headlines of chores, packages and trade postings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headline shapes of chores, briefs, bundles and trade postings, and what isn't a posting after all.
CHORE = r"(?i)^(how to|q&a|watch:|live updates|\d+ things)\b|\b(hints and answers|team of the week|daily quiz|horoscope)\b"
BRIEF = r"(?i)^.{0,24}\b(morning|evening|daily|weekly)\s+(brief|briefing|digest|wrap|rundown|roundup)\b"
BUNDLE = r"(?i)&\s*more\s*$"
POSTING = r"^[A-Z][\w.'’-]+(?:\s+[A-Z][\w.'’-]+){1,3}\s+(?:Appointed|Named|Promoted [Tt]o|Elevated [Tt]o|Joins [Aa]s)\s+[^:]{0,60}?\b(?:VP|SVP|EVP|Vice President|President|Managing Director|Director|Head|Editor|Chief|Partner|Officer)\b"
NOT_POSTING = r"\b(CEO|Chief Executive)\b"


def chore(title: Column) -> Column:
    """P14 but for the shapes that recur: a chore, a brief, a bundle, or a trade posting."""
    return title.rlike(CHORE) | title.rlike(BRIEF) | title.rlike(BUNDLE) | (title.rlike(POSTING) & ~title.rlike(NOT_POSTING))


#: Fixed value: what models write where they have nothing to say.
NOTHING = r"(?i)^(null|undefined|none|nil|n\/?a|unknown|-{1,2})$"


def placeholder(text: Column) -> Column:
    """Whether a field says nothing: null, blank, or a word that stands for nothing."""
    return F.coalesce((F.trim(text) == "") | F.trim(text).rlike(NOTHING), F.lit(True))
