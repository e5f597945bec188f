"""Hand-made rows: nulls, empty and very long texts, ties, repeated rows and extra columns with clashing names."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string, key string, range string, node string, word string, token string"


def prose(n: int, seed: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def swapped(text: str, every: int) -> str:
    """The text with one word in so many replaced."""
    words = text.split(" ")
    for i in range(every, len(words), every):
        words[i] = f"x{i}"
    return " ".join(words)


def texts() -> list[tuple[int, str | None]]:
    base, long = prose(200, 1), prose(20_000, 2)
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  Two\n"), (7, "one two three")]
    rows += [(20 + i, base) for i in range(6)]
    rows += [(40 + i, swapped(base, 150 + i)) for i in range(8)]
    rows += [(60, swapped(base, 20)), (61, prose(200, 3) + " " + base), (62, base.upper())]
    rows += [(70, long), (71, long), (72, swapped(long, 900)), (73, "ж" * 3000), (74, "ж" * 2990), (75, "naïve café " * 40), (76, "a" * 49), (77, "a" * 50), (78, "a" * 120), (79, "a\0b " * 30), (80, "a\0b " * 31)]
    rows += [(-5, "Licensed under CC BY 4.0. All rights  reserved."), (90, "all rights reserved all rights reserved GNU General Public License version 2"), (91, "CC-BY cc by cc by-sa")]
    passage = prose(90, 9)
    return rows + [(100 + i, f"{prose(30 + i, 50 + i)} {passage} {prose(40, 90 + i)}") for i in range(12)]


def documents(spark, rows=None, repeat: bool = True):
    """texts() as a documents table; two of its rows twice, one row without doc_id."""
    rows = texts() if rows is None else rows
    data = [(i, t, None if (i or 0) % 7 == 0 else "en", None if (i or 0) % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in rows]
    if repeat:
        data += [r for r in data if r[0] in (21, 100)] + [(None, "a row without identifier", None, None, None)]
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in data], SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def given(spark) -> list[tuple[int, str | None]]:
    """(doc_id, text) of the smallest given table."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
