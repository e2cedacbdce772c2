"""License scans by diagonal voting.

Templates are short phrases (two-word grams) and whole notices (five-word
grams). Every gram of every text is hashed and joined to the template positions
with that hash (a broadcast table of a few hundred fixed rows; equal hashes are
checked by the words). A hit at word p for template position t votes for the
diagonal p - t; neighbouring diagonals of a notice (words put in or left out)
are merged; a span counts if enough of the template's grams voted for it, for a
phrase all of them, which is the phrase itself.

Only hits are shuffled, keyed by document, so a phrase in a third of all rows
meets in no single task.

Defined results: a null text is empty; a text without a span has null places,
empty labels and score 0; rows that repeat come out as often as they stand, each
with its own counts; rows that share an id but not the text are kept apart.
Words are matched in the lower case of the whole text, which differs from that
of A-Z alone in no word of a phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueweave.llm.common import null_safe

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE_GRAM, NOTICE_GRAM = 2, 5
#: Diagonals of a notice this near to each other are one; share of its grams that must vote.
SLACK, COVER = 12, 0.6

#: Phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: More phrases, which the base columns don't count.
OTHER_PHRASES = {
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by 4 0": "cc-by", "bsd license": "bsd", "mozilla public license": "mpl", "isc license": "isc",
}
#: Label -> wording of public licence notices.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files, to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions""",
    "apache": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def grams(of: Column, size: int) -> Column:
    """The ``size`` words from each word on (fewer at the end), space-joined."""
    return F.transform(of, lambda _, i: F.concat_ws(" ", F.slice(of, i + 1, size)))


def templates(
    spark: SparkSession, phrases: dict[str, str] = PHRASES, others: dict[str, str] = OTHER_PHRASES, notices: dict[str, str] = NOTICES
) -> DataFrame:
    """One row per template: ``template, label, base, size, slack, need, words``."""
    rows = [(p, label, True, PHRASE_GRAM, 0, 1.0) for p, label in phrases.items()]
    rows += [(p, label, False, PHRASE_GRAM, 0, 1.0) for p, label in others.items()]
    rows += [(n, label, False, NOTICE_GRAM, SLACK, COVER) for label, n in notices.items()]
    table = spark.createDataFrame(
        [(k, *r) for k, r in enumerate(rows)], "template int, wording string, label string, base boolean, size int, slack int, need double"
    )
    return table.withColumn("words", words(F.col("wording"))).drop("wording")


def positions(found: DataFrame, size: int) -> DataFrame:
    """Of the templates with grams of ``size`` words: ``hash, gram, at`` (template and place, all of them)."""
    each = found.where(F.col("size") == size).select("template", F.posexplode(grams(F.col("words"), size)).alias("place", "gram"), "words")
    full = each.where(F.col("place") <= F.size("words") - size)
    return full.groupBy(F.xxhash64("gram").alias("hash"), "gram").agg(F.collect_list(F.struct("template", "place")).alias("at"))


def hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text_key, template, diagonal, at_word``: every gram of a text that is a gram of a template."""
    body = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words"))
    each = body.select("doc_id", "text_key", F.posexplode(grams(F.col("words"), NOTICE_GRAM)).alias("at_word", "long"))
    each = each.withColumn("short", F.substring_index("long", " ", PHRASE_GRAM))
    for name, size in (("long", NOTICE_GRAM), ("short", PHRASE_GRAM)):
        table = positions(found, size).select(F.col("hash").alias(f"{name}_hash"), F.col("gram").alias(f"{name}_gram"), F.col("at").alias(f"{name}_at"))
        same = (F.xxhash64(name) == F.col(f"{name}_hash")) & (F.col(name) == F.col(f"{name}_gram"))
        each = each.join(F.broadcast(table), same, "left")
    none = F.array().cast("array<struct<template:int,place:int>>")
    at = F.concat(F.coalesce("long_at", none), F.coalesce("short_at", none))
    return each.where("long_at is not null or short_at is not null").select("doc_id", "text_key", "at_word", F.inline(at)).select(
        "doc_id", "text_key", "template", (F.col("at_word") - F.col("place")).alias("diagonal"), "at_word"
    ).distinct()


def spans(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_key, label, base, first_word, last_word`` (exclusive) ``, score``: verified spans, once per different text."""
    found = templates(docs.sparkSession) if found is None else found
    about = found.withColumn("grams", F.size("words") - F.col("size") + 1).drop("words")
    votes = hits(docs, found).groupBy("doc_id", "text_key", "template", "diagonal").agg(
        F.collect_set(F.col("at_word") - F.col("diagonal")).alias("places"), F.min("at_word").alias("low"), F.max("at_word").alias("high")
    ).join(F.broadcast(about), "template")
    one = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(one) > F.col("slack"), F.lit(True))
    runs = votes.withColumn("_new", apart.cast("int")).withColumn("run", F.sum("_new").over(one))
    whole = runs.groupBy("doc_id", "text_key", "template", "label", "base", "size", "need", "grams", "run").agg(
        F.min("low").alias("first_word"), (F.max("high")).alias("_high"),
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("voted"),
    )
    score = F.col("voted") / F.col("grams")
    return whole.where(score >= F.col("need")).select(
        "doc_id", "text_key", "label", "base", "first_word", (F.col("_high") + F.col("size")).alias("last_word"), score.alias("score")
    )


def scan(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Per document: words, base places, labels and the best span's score."""
    where_base = F.when(F.col("base"), F.col("first_word").cast("long"))
    names = lambda kept: F.array_join(F.sort_array(F.collect_set(kept)), ",")
    marked = spans(docs, found).groupBy("doc_id", "text_key").agg(
        F.count(where_base).alias("n_base"), F.min(where_base).alias("first_word"), F.max(where_base).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return null_safe(sized, marked, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
