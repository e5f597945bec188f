"""Operator 8: license scans over a positional rare-token index, in built-in functions only.

Document frequencies of the templates' words over all files give IDFs, and a
template is indexed by the rarer half of its words. Every file posts the index
words it has with their positions; one of a template's highest-IDF words,
enough of which are looked up that no template is missed, nominates it. The
file's postings of nominated templates are intersected by relative position
(file position minus template position). A template whose words line up at one
offset holds if its mandatory key phrase stands at that very offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

#: The base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Label, passage of the license or of its notice in lower-case words, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "required by applicable law"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose"),
    ("lgpl", "gnu lesser general public license version", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copies or substantial portions"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unencumbered software"),
]
LEAST_SHARE = 0.6
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _place(text: str, phrase: str) -> int:
    """Where a phrase begins in a template, in words."""
    words, size = text.split(), len(phrase.split())
    return next(i for i in range(len(words)) if " ".join(words[i : i + size]) == phrase)


def _indexed(spark, df: DataFrame, n: int, least_share: float) -> DataFrame:
    """(template, label, word, place, n_places, looked_up): the rarer half of each template's words by df (word, df) over n files.

    A word that no file has is as rare as can be; ties go by word and place. Any
    places of a share of least_share are one of the looked-up ones: n_places
    less the least number of them, and one. As many rows as the templates have words.
    """
    rows = [(k, label, w, i, len(text.split())) for k, (label, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split())]
    given = spark.createDataFrame(rows, "template int, label string, word string, place int, size int")
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), "word", "place")
    ranked = given.join(F.broadcast(df), "word", "left").withColumn("idf", F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 0.5))).withColumn("r", F.row_number().over(rarest))
    half = F.ceil(F.col("size") / 2).cast("int")
    least = F.ceil(half * least_share - 1e-9)
    return ranked.where(F.col("r") <= half).select("template", "label", "word", "place", half.alias("n_places"), (F.col("r") <= half - least + 1).alias("looked_up"))


def scan(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII letters and digits and of any characters beyond
    ASCII, after lower-casing A-Z. A null text is an empty one: no words,
    first_word and last_word null, labels empty, score 0. score is the largest
    share of a holding template's indexed words that line up. To the index a
    file is its words, named by their sha256: rows of null or repeated doc_id
    have their own labels, and copies are looked up once. Empty tables give no
    rows; extra columns are ignored.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(BREAK), F.lit(" ")), F.lit(" "))
    # one space around each word; a text that starts or ends with a break gives two, which trim takes off
    padded = docs.select("doc_id", F.concat(F.lit(" "), F.trim(words), F.lit(" ")).alias("padded"))
    has = [F.col("padded").contains(f" {phrase} ") for phrase, _ in BASE]
    some = has[0] | has[1] | has[2]
    either = "|".join(phrase for phrase, _ in BASE)
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    places = [F.regexp_count("padded", F.lit(f" {phrase}(?= )")) for phrase, _ in BASE]
    head = F.substring(F.col("padded"), F.lit(1), F.regexp_instr("padded", F.lit(f" (?:{either})(?= )")) - 1)
    # (?s): words may hold U+0085, U+2028 and U+2029, at which a dot stops
    tail = F.regexp_extract("padded", f"(?s)^(.*) (?:{either}) ", 1)
    base = F.filter(F.array(*[F.when(h, F.lit(label)) for h, (_, label) in zip(has, BASE)]), lambda x: x.isNotNull())
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    # words before, between and after the places of each key phrase that the file has
    between = lambda key: F.transform(F.split("padded", f" {key}(?= )"), spaces)
    holds = [F.when(F.col("padded").contains(f" {key} "), F.struct(F.lit(k).alias("template"), F.lit(_place(text, key)).alias("at"), F.lit(len(key.split())).alias("size"), between(key).alias("words"))) for k, (_, text, key) in enumerate(TEMPLATES)]
    file = F.unhex(F.sha2("padded", 256)).alias("file")
    files = materialise(
        padded.select(
            "doc_id",
            file,
            F.when(F.col("padded") == "  ", 0).otherwise(spaces(F.col("padded")) - 1).cast("long").alias("n_words"),
            F.when(some, places[0] + places[1] + places[2]).otherwise(0).cast("long").alias("n_base"),
            F.when(some, spaces(head)).alias("first_word"),
            F.when(some, spaces(tail)).alias("last_word"),
            base.alias("base"),
            F.filter(F.array(*holds), lambda x: x.isNotNull()).alias("holds"),
            F.array_intersect(F.split(F.trim("padded"), " "), F.array(*map(F.lit, vocabulary))).alias("known"),
        )
    )
    df = files.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    indexed = materialise(_indexed(docs.sparkSession, df, files.count(), least_share))
    found = padded.select(file, F.posexplode(F.split(F.trim("padded"), " ")).alias("pos", "word")).join(F.broadcast(indexed.select("word").distinct()), "word", "left_semi")
    found = materialise(found.distinct())
    nominated = found.join(F.broadcast(indexed.where("looked_up").select("word", "template").distinct()), "word").select("file", "template").distinct()
    lined_up = (
        found.join(F.broadcast(indexed.drop("looked_up")), "word")
        .join(nominated, ["file", "template"], "left_semi")
        .groupBy("file", "template", "label", "n_places", (F.col("pos") - F.col("place")).alias("offset"))
        .agg((F.count_distinct("place") / F.col("n_places")).alias("share"))
        .where(F.col("share") >= least_share)
    )
    upto = Window.partitionBy("file", "template").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = files.select("file", F.explode("holds").alias("t")).select("file", "t.template", "t.at", "t.size", (F.size("t.words") - 1).alias("last"), F.posexplode("t.words").alias("i", "words")).distinct()
    stands = pieces.withColumn("before", F.sum("words").over(upto)).where("i < last").select("file", "template", (F.col("before") + F.col("i") * F.col("size") - F.col("at")).cast("int").alias("offset"))
    verified = lined_up.join(stands, ["file", "template", "offset"], "left_semi")
    # written, so that the join deals both sides anew and a file of very many copies can be split
    by_file = materialise(verified.groupBy(F.col("file").alias("of")).agg(F.collect_set("label").alias("more"), F.max("share").alias("score")))
    none = F.array().cast(T.ArrayType(T.StringType()))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return files.join(by_file, F.col("file") == F.col("of"), "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
