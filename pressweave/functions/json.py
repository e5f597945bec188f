"""JSON that people and models wrote: what can be saved of it, as column expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the least characters of a summary's text.
LEAST_CRUX = 40


def kind(value: Column) -> Column:
    """Type of a variant as schema_of_variant names it; null for a null."""
    return F.schema_of_variant(value)


def strings(text: Column) -> Column:
    """The strings of a JSON array; anything else, and what is no JSON, gives none."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda x: kind(x) == "STRING"), lambda x: x.cast("string"))
    return F.coalesce(texts, F.array().cast("array<string>"))


def rescued(text: Column) -> Column:
    """The object between the outermost braces, as a variant; of an echoed schema what its properties hold; null where there is none."""
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((F.instr(text, "{") > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))
    found = F.try_parse_json(braces)
    inner = F.try_variant_get(found, "$.properties", "variant")
    echoed = (F.try_variant_get(found, "$.type", "string") == "object") & kind(inner).startswith("OBJECT")
    return F.when(F.coalesce(echoed, F.lit(False)), inner).otherwise(found)


def text_of(value: Column, name: str) -> Column:
    """A field that is a string; null if it is anything else."""
    held = F.try_variant_get(value, f"$.{name}", "variant")
    return F.when(kind(held) == "STRING", held.cast("string"))


def whole(text: Column) -> Column:
    """Up to the last sentence that ends; empty if none does."""
    plain = F.trim(text)
    return F.when(plain.rlike("[.!?][\"')’”]?$"), plain).otherwise(F.regexp_extract(plain, "(?s)^(.*[.!?])", 1))


def summary(text: Column) -> Column:
    """Struct (outcome, headline, crux) of a model's answer: ``empty``, ``bad_json``, ``unusable`` (no headline, or a text under LEAST_CRUX whole characters) or ``ok``."""
    value = rescued(text)
    headline, crux = text_of(value, "headline"), whole(text_of(value, "crux"))
    usable = (F.trim(headline) != "") & (F.length(crux) >= LEAST_CRUX)
    outcome = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(value.isNull(), "bad_json").when(F.coalesce(usable, F.lit(False)), "ok").otherwise("unusable")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", headline).alias("headline"), F.when(outcome == "ok", crux).alias("crux"))
