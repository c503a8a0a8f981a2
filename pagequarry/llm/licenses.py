"""Operator 11, license scans by an exact set-similarity join, in DataFrame functions only.

A text is looked at in blocks: windows of ``2 * STEP`` words that start every ``STEP`` words,
so any passage of at most ``STEP + 1`` words lies whole in one. A template is a set of words
with a threshold: a block meets it if it contains at least that share of them, which is a
number of words, ``need``. Words are put in order of their frequency over all texts, rarest
first. Of n words of a block that templates know and t of a template's, the first
n - need + 1 and the first t - need + 1 must share one (prefix filter); a block needs
``need`` of them at all (length filter); and what follows the first shared word must still
suffice on both sides (positional filter). Blocks and templates meet by an equi-join on those
first words. A pair is taken at its first shared word alone, so it comes once, and its
containment is then counted exactly.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import table

#: Words from one block's start to the next one's; a block has twice as many.
STEP = 64
#: Distinct words of templates that are looked for in one pass; more templates take more passes.
PASS_WORDS = 4096
#: Copies of a row that one row is turned into at once.
COPIES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: every byte of ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label, the text that calls for it, the share of its distinct words that a block must contain, and whether they must stand one after another."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return split_words(self.text)

    @property
    def need(self) -> int:
        """The least number of distinct words that reaches the share."""
        return max(1, math.ceil(self.share * len(set(self.words)) - 1e-9))


#: The phrases whose places are counted.
PHRASES = [
    Template("cc-by", "cc by", 1.0, True), Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True)
]
#: Short statements count whole, notices from four fifths of their words on. None is longer than a block's step.
NOTICES = [
    Template("mit", "Released under the MIT License", 1.0),
    Template("mit", "Licensed under the MIT License", 1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl", "licensed under the GNU General Public License, version 3", 1.0),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", 1.0),
    Template(
        "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    Template(
        "apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at"
    ),
    Template(
        "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    Template(
        "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    Template(
        "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ),
    Template(
        "mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"
    ),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def split_words(text: str) -> list[str]:
    """The words of a template's text, as words_of() takes them."""
    out, word = [], ""
    for c in text + " ":
        c = LOWER[UPPER.index(c)] if c in UPPER else c
        if c.isascii() and not (c in LOWER or c in "0123456789"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def words_of(text: Column) -> Column:
    """Lower-cases A-Z and takes what is between other characters of ASCII; where a text begins or ends with one, the first or last is empty."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)


def literal(words: list[str]) -> Column:
    """``words``, which hold no space, as one constant."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def in_passes(templates: list[Template], most: int = PASS_WORDS) -> list[list[Template]]:
    """Templates in groups of at most ``most`` distinct words (one template at least)."""
    out: list[list[Template]] = []
    have: set[str] = set()
    for t in templates:
        if not out or len(have | set(t.words)) > most:
            out.append([])
            have = set()
        out[-1].append(t)
        have |= set(t.words)
    return out


def rarest_first(words: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words by the number of texts that hold them, then by themselves; the driver gets one count for each of these words."""
    known = sorted({w for t in templates for w in t.words})
    if not known:
        return []
    counted = words.select(F.explode(F.array_intersect("words", literal(known))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in counted}
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def prefixes(templates: list[Template], order: list[str]) -> list[tuple]:
    """(word, its place, template's number, label, need, its words in order, its words as written if it is a phrase) for the first words of each template."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for number, t in enumerate(templates):
        tokens = sorted(set(t.words), key=rank.__getitem__)
        for place, word in enumerate(tokens[: len(tokens) - t.need + 1]):
            out.append((word, place, number, t.label, t.need, tokens, t.words if t.phrase else []))
    return out


def index_of(words: DataFrame, rows: list[tuple]) -> DataFrame:
    """The prefixes as a table: a few rows for each template that the program names."""
    names = ["first", "j", "template", "label", "need", "wanted", "phrase"]
    kind = "array<struct<first string, j int, template int, label string, need int, wanted array<string>, phrase array<string>>>"
    whole = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return words.sparkSession.range(1).select(F.inline(F.from_json(F.lit(whole), kind)))


def met(texts: DataFrame, templates: list[Template], step: int, each: bool) -> DataFrame:
    """The blocks that meet a template: keys and n_words of the text, template, label, phrase, at, block, share.

    ``texts`` has its keys, n_words, lead (empty words before the first one) and words. With
    ``each`` every text also has a row of its own, without a template.
    """
    keys = [c for c in texts.columns if c not in ("words", "lead")]
    order = rarest_first(texts, templates)
    rows = prefixes(templates, order)
    firsts = literal(sorted({r[0] for r in rows}))
    least = min(r[4] for r in rows)
    starts = F.sequence(F.col("lead"), F.greatest(F.size("words") - 1, F.col("lead")), F.lit(step))
    blocks = F.transform(starts, lambda at: F.struct((at - F.col("lead")).alias("at"), F.slice("words", at + 1, F.lit(2 * step)).alias("block")))
    none = F.array(F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("block")))
    if not each:
        none = F.slice(none, 1, 0)
    # a text without any template's first words has no block to look at
    some = F.when(F.arrays_overlap("words", firsts), F.concat(none, blocks)).otherwise(none)
    one = texts.select(*keys, F.explode(some).alias("b")).select(*keys, "b.at", "b.block")
    own = F.col("at") < 0
    known = one.where(own | F.arrays_overlap("block", firsts)).withColumn("have", F.array_intersect(literal(order), "block"))
    heads = known.where(own | (F.size("have") >= least)).withColumn(
        "first", F.explode_outer(F.array_intersect(F.slice("have", F.lit(1), F.greatest(F.size("have") - least + 1, F.lit(0))), firsts))
    )
    near = heads.join(F.broadcast(index_of(texts, rows)), "first", "left").withColumn("i", F.array_position("have", F.col("first")) - 1)
    left, right = F.size("have") - F.col("i"), F.size("wanted") - F.col("j")
    length = F.size("have") >= F.col("need")
    prefix = F.col("i") <= F.size("have") - F.col("need")
    position = F.least(left, right) >= F.col("need")
    possible = near.where(own | (length & prefix & position)).withColumn("shared", F.array_intersect("have", "wanted"))
    exact = possible.where(own | ((F.size("shared") >= F.col("need")) & (F.get("shared", F.lit(0)) == F.col("first"))))
    return exact.select(*keys, "template", "label", "phrase", "at", "block", (F.size("shared") / F.size("wanted")).alias("share"))


def places(step: int) -> Column:
    """Where a phrase starts in a block's first ``step`` words, from 0 on; those further on are another block's."""
    last = F.least(F.lit(step), F.size("block") - F.size("phrase") + 1)
    starts = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice("block", i + 1, F.size("phrase")) == F.col("phrase"))


def scan(
    documents: DataFrame, phrases: list[Template] | None = None, notices: list[Template] | None = None, id_col: str = "doc_id",
    text_col: str = "text", step: int = STEP, pass_words: int = PASS_WORDS
) -> DataFrame:
    """Places of ``phrases`` and labels of ``notices`` in whole texts.

    One row per input row: doc_id, n_words, n_base (places of all phrases), first_word and
    last_word (their smallest and largest start in words from 0, else null), base_labels
    (phrases'), labels (both; distinct, sorted, comma-joined, empty if none) and score (the
    largest containment that meets its threshold, else 0). A null text is empty; a null id
    stays null; rows that repeat are rows of their own; an empty table gives no rows. Other
    columns are not read. A template longer than ``step`` + 1 words is an error, as no block
    need hold it. What is broadcast are the first words of the templates that the program
    names. Nothing but a text's own row holds its words, and each result row is grouped by
    its id and text alone.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    every = [*phrases, *notices]
    if any(not t.words or len(t.words) > step + 1 for t in every):
        raise ValueError("a template has a word at least, and no more than a block's step and one")
    id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    keys = ["doc_id", "one", "two"]
    split = documents.select(
        id_.alias("doc_id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two"), words_of(text).alias("words")
    )
    lead = (F.element_at("words", 1) == "").cast("int")
    last = ((F.size("words") > 1) & (F.element_at("words", -1) == "")).cast("int")
    texts = split.withColumn("lead", lead).withColumn("n_words", (F.size("words") - F.col("lead") - last).cast("long"))
    rows = None
    for number, group in enumerate(in_passes(every, pass_words)):
        # a text's own row, of no template, keeps those without a hit, and counts equal rows
        hits = met(texts, group, step, number == 0).withColumn("starts", F.when(F.size("phrase") > 0, places(step)))
        is_base = F.size("phrase") > 0
        found = hits.where(F.col("label").isNull() | ~is_base | (F.size("starts") > 0)).select(
            *keys, F.when(F.col("label").isNull(), F.col("n_words")).alias("n_words"), F.when(is_base, F.col("label")).alias("base"), "label",
            "share", F.when(is_base, F.size("starts").cast("long")).alias("n"),
            F.when(is_base, (F.col("at") + F.array_min("starts")).cast("long")).alias("low"),
            F.when(is_base, (F.col("at") + F.array_max("starts")).cast("long")).alias("high")
        )
        rows = found if rows is None else rows.unionByName(found)
    whole = rows.groupBy(*keys).agg(
        F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"),
        F.min("low").alias("first_word"), F.max("high").alias("last_word"), F.collect_set("base").alias("base"),
        F.collect_set("label").alias("label"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score")
    )
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    told = whole.select(
        "copies", "doc_id", "n_words", (F.col("places") / F.col("copies")).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("label").alias("labels"), "score"
    )
    # equal rows were counted as one; they come back a bounded number at a time
    part = told.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    again = part.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("from"), F.lit(COPIES)))))
    return again.drop("copies", "from", "copy")


def op11_licenses(spark, sf_dir: str) -> DataFrame:
    """Phrases and license notices in all documents; see scan()."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle_sql(step: int = STEP) -> str:
    """Every block against every template, without any filter."""
    templates = ", ".join(
        f"({i}, '{t.label}', {_sql_words(sorted(set(t.words)))}, {t.need}, {_sql_words(t.words) if t.phrase else '[]::VARCHAR[]'})"
        for i, t in enumerate([*PHRASES, *NOTICES])
    )
    return rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
templates(number, label, wanted, need, phrase) AS (VALUES {templates}),
blocks AS (SELECT r, lo, w[lo + 1 : lo + {2 * step}] AS block FROM words, unnest(generate_series(0, len(w) - 1, {step})) AS t(lo)),
hits AS (
  SELECT r, lo, block, label, phrase, len(list_filter(wanted, lambda x: list_contains(block, x))) / len(wanted) AS share
  FROM blocks, templates WHERE len(list_filter(wanted, lambda x: list_contains(block, x))) >= need),
starts AS (
  SELECT r, label, share, len(phrase) > 0 AS is_base, [lo + i FOR i IN range(0, {step}) IF len(phrase) > 0 AND block[i + 1 : i + len(phrase)] = phrase] AS places FROM hits),
fits AS (SELECT * FROM starts WHERE NOT is_base OR len(places) > 0),
told AS (
  SELECT r, sum(len(places)) AS n_base, min(list_min(places)) AS first_word, max(list_max(places)) AS last_word, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM fits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN told USING (r)
"""


ORACLE_SQL = oracle_sql()
