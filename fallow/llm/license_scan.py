"""License scan: an exact containment join of text blocks with license templates.

A block is a window of a document's words, twice as long as a notice, that begins with one
of its words and runs across line ends.  A template is the distinct words of a notice.  A block
meets a template when it holds at least `containment` of the template's words, among them
all words that name the license, which a template states beside its text.  Names of
sibling licenses (`SIBLINGS`) do not count as words.

The words of a text are only taken where, as parts of the text, it holds what some template needs;
removing siblings leaves parts of it.  Windows are made only around anchors, words of which a met block holds one: a required word, or
the n - need + 1 words that fewest templates have.  The join is the prefix filter for
set similarity: words are ordered by how many blocks hold them, rarest first; a template
with n words of which `need` are required can only be met by a block that holds one of its
n - need + 1 rarest words, so only these are join keys.  A positional filter (enough words
left after the first shared one) follows the join, and the full sets confirm what is left.
No filter loses a block.

Blocks are reduced to the words that occur in some template of their length and then to
distinct sets, so that a notice that a third of all documents carry is joined once.

Beside the templates, phrases are found as consecutive words, with their places.
Words are maximal runs of digits, letters and characters beyond ASCII, with ASCII
letters lowered.

Defined results: a null text counts as empty: no word, no place, empty labels, score
0; repeated rows get the same result; an empty table gives an empty result; without
templates only phrases are found; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fallow.session import settle

# Phrases and their labels; labels, wordings of notices and the words that name each license.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit-notice", "Released under the MIT License", "released mit license"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2 0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0 international"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
)
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of text in either case
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
SIBLINGS = (
    rf"attribution{GAP}(?:non{GAP}commercial|noncommercial|share{GAP}alike|sharealike|no{GAP}deriv|noderiv)",
    rf"(?<!{WORD[:-1]})nc{GAP}(?:sa|nd)(?!{WORD[:-1]})",
    rf"gnu{GAP}(?:lesser|affero|library){GAP}general",
)


def words_of(text: str) -> list[str]:
    """Distinct words of a template, sorted."""
    return sorted(set(_tokens(text)))


def _tokens(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def need_of(n: int, containment: float) -> int:
    return max(1, math.ceil(containment * n - 1e-9))


def anchors_of(words: list[str], need: int, required: list[str], sets: list[list[str]]) -> list[str]:
    """Words of which every met block holds one."""
    if required:
        return [max(required, key=lambda w: (not w.isdigit(), len(w), w))]
    return sorted(words, key=lambda w: (sum(w in ws for ws in sets), -len(w), w))[: len(words) - need + 1]


def windows_of(words: Column, length: int, members: list[str], anchors: list[str], least: int) -> Column:
    """Distinct sorted sets of at least `least` members in windows that begin with a member and hold an anchor."""
    listed, wanted = (F.array(*[F.lit(w) for w in ws]) for ws in (members, anchors))
    none = F.expr("cast(array() as array<array<string>>)")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(listed, x["word"]))
    places = F.array(hits)  # bound once

    def sets(own):
        spots = F.transform(F.filter(own, lambda x: F.array_contains(wanted, x["word"])), lambda x: x["at"])
        # an anchor reaches back over the members that begin a window with it
        first = F.filter(
            F.transform(own, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))),
            lambda x: F.exists(spots, lambda p: (p >= x["at"]) & (p < x["at"] + length)),
        )

        def block(x):
            near = F.filter(F.slice(own, x["i"] + 1, F.lit(length)), lambda y: y["at"] < x["at"] + length)
            return F.array_sort(F.array_distinct(F.transform(near, lambda y: y["word"])))

        return F.filter(F.transform(first, block), lambda b: F.size(b) >= least)

    return F.when(F.arrays_overlap(words, wanted), F.array_distinct(F.flatten(F.transform(places, sets)))).otherwise(none)


def may_meet(lowered: Column, words: list[str], need: int, required: list[str], anchors: list[str]) -> Column:
    """Whether a text may hold a block that meets a template: as parts of the text, it holds all required words, or an anchor and `need` of the words."""
    holds = lambda w: F.contains(lowered, F.lit(w))
    if required:
        return reduce(and_, map(holds, sorted(required, key=lambda w: (-len(w), w))))
    return reduce(or_, map(holds, anchors)) & (sum((holds(w).cast("int") for w in words), F.lit(0)) >= need)


def phrase_places(text: Column, n_words: Column, phrase: str) -> Column:
    """struct(n, first, last) of a phrase's places, counted in words from 0."""
    words = phrase.split(" ")
    pattern = "(?i)(?<!" + WORD[:-1] + ")" + GAP.join(words) + "(?!" + WORD[:-1] + ")"
    pieces = F.split(text, pattern, -1)
    n = F.size(pieces) - 1
    before = F.regexp_count(F.element_at(pieces, 1), F.lit(WORD))
    after = F.regexp_count(F.element_at(pieces, -1), F.lit(WORD))
    found = F.struct(n.alias("n"), before.alias("first"), (n_words - after - len(words)).alias("last"))
    none = F.expr("named_struct('n', 0, 'first', cast(null as int), 'last', cast(null as int))")
    return F.when(F.contains(F.lower(text), F.lit(words[-1])) & text.rlike(pattern), found).otherwise(none)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels and labels (arrays), score (largest containment met, 1 with a phrase)."""
    spark = docs.sparkSession
    every = [words_of(t) for _, t, _ in templates]
    sets = [(label, words_of(t), need_of(len(words_of(t)), containment), words_of(names), 2 * len(_tokens(t))) for label, t, names in templates if words_of(t)]

    lowered = F.regexp_replace("__lower", "|".join(SIBLINGS), " ")
    own = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = own.withColumn("n_words", F.regexp_count("__text", F.lit(WORD)))  # no letter beyond ASCII is ever a gap, in either case
    gates = [may_meet(F.col("__lower"), ws, need, names, anchors_of(ws, need, names, every)) for _, ws, need, names, _ in sets]
    own = own.withColumn("__lower", F.lower("__text")).withColumn("__may", reduce(or_, gates, F.lit(False)))
    own = own.withColumn("words", F.when(F.col("__may"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))))
    kept = []
    for length in sorted({n for *_, n in sets}):
        same = [x for x in sets if x[-1] == length]
        members = sorted({w for _, ws, *_ in same for w in ws})
        anchors = sorted({w for _, ws, need, required, _ in same for w in anchors_of(ws, need, required, every)})
        found = windows_of(F.col("words"), length, members, anchors, min(need for _, _, need, _, _ in same))
        kept.append(F.transform(found, lambda b: F.struct(F.lit(length).alias("length"), b.alias("words"))))  # noqa: B023)
    blocks = F.concat(F.expr("cast(array() as array<struct<length:int,words:array<string>>>)"), *kept)
    own = own.select(
        F.monotonically_increasing_id().alias("row"),  # fixed once written
        "__key", "n_words", blocks.alias("sets"),
        *[phrase_places(F.col("__text"), F.col("n_words"), p).alias(f"p{i}") for i, (p, _) in enumerate(phrases)],
    )
    own = settle(own)

    met = settle(_met_sets(spark, own.select(F.inline("sets")).distinct(), sets))
    per_row = (
        own.select("row", F.inline("sets")).join(met, ["length", "words"])
        .groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("found"))).alias("found"), F.max("score").alias("score"))
    )
    spots = [F.col(f"p{i}") for i in range(len(phrases))]
    n_base = sum((s["n"] for s in spots), F.lit(0))
    base = F.array_compact(F.array(*[F.when(s["n"] > 0, F.lit(label)) for s, (_, label) in zip(spots, phrases, strict=True)]))
    lead = [F.lit(None).cast("int")] * 2  # least and greatest need two arguments
    found = F.coalesce("found", F.expr("cast(array() as array<string>)"))
    return own.join(per_row, "row", "left").select(
        F.col("__key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        n_base.cast("long").alias("n_base"),
        F.least(*lead, *[s["first"] for s in spots]).cast("long").alias("first_word"),
        F.greatest(*lead, *[s["last"] for s in spots]).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.array_sort(F.array_union(base, found)).alias("labels"),
        F.greatest(F.coalesce("score", F.lit(0.0)), F.when(n_base > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def _met_sets(spark, blocks: DataFrame, sets) -> DataFrame:
    """Of distinct word sets (`words`, sorted) of windows of a length: the labels found and the largest containment."""
    if not sets:
        return spark.createDataFrame([], "length int, words array<string>, found array<string>, score double")
    listed = spark.createDataFrame([(i, *x) for i, x in enumerate(sets)], "template int, label string, template_words array<string>, need int, required array<string>, length int")
    # global order: rarest first, over the template words, of which there are few
    counted = blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "word")
    index = (
        listed.select("template", "label", "template_words", "need", "required", "length", F.explode("template_words").alias("word"))
        .join(counted, "word", "left")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= F.size("template_words") - F.col("need") + 1)  # prefix filter
    )
    pairs = blocks.select("length", "words", F.explode("words").alias("word")).join(index, ["length", "word"])
    # positional filter: after its rarest shared word a template has `size - place` words left to share
    pairs = pairs.where(F.least(F.size("words"), F.size("template_words") - F.col("place") + 1) >= F.col("need"))
    shared = F.size(F.array_intersect("words", "template_words"))
    met = (
        pairs.groupBy("length", "words", "template").agg(F.first("label").alias("label"), F.first("need").alias("need"), F.first("required").alias("required"), F.first("template_words").alias("template_words"))
        .where((shared >= F.col("need")) & (F.size(F.array_except("required", "words")) == 0))
        .select("length", "words", "label", (shared / F.size("template_words")).alias("score"))
    )
    return met.groupBy("length", "words").agg(F.collect_set("label").alias("found"), F.max("score").alias("score"))
