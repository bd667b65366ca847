"""License scans as an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A text's words are laid out in blocks of twice the longest template, one block each template length, so each passage of
that length lies whole in a block. A block matches a template if it holds at least `threshold` of the template's
distinct words. Which blocks can match is found as in prefix-filtering joins:

* words are ordered by how many documents hold them, rarest first, counted over the whole corpus;
* prefix: of a template of n words that needs o of them, one of the n - o + 1 rarest must be in the block;
* length: the block must hold o words that templates know;
* position: what can still match from the two places of the shared word on must make up o words.

Blocks that pass are compared in full. Base phrases are templates that need all their words; each place where such a
phrase's words stand consecutively is then looked for in the blocks that match, and counted in the block where it starts.

Templates stand in the plan as literals, a bounded number in each pass, and the results of passes are put together: a row
is joined where it is, and nothing but word counts is shuffled, so hot documents, copies and skewed keys cost no more
than others.

Rows: a null text is empty, matches nothing and has score 0; a null id, repeated rows and ties stay as they are, each
row with its own result; an empty table gives an empty table; a text of any length is laid out block by block. Columns
of the input named like a result are replaced; other columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Templates that stand in a plan at once; more are scanned for in further passes.
MAX_TEMPLATES = 200
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")


@dataclass(frozen=True)
class Template:
    """A license text; `exact` ones are phrases that count place by place and need all their words."""

    label: str
    text: str
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def needed(self, threshold: float) -> int:
        n = len(set(self.words))
        return n if self.exact else math.ceil(threshold * n - 1e-9)


#: The base phrases and their labels.
BASE = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
#: Notices of common licenses, by their SPDX identifiers.
NOTICES = (
    Template("Apache-2.0", "licensed under the apache license version 2 0"),
    Template("BSD", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("GPL", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("MIT", "released under the mit license"),
    Template("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
THRESHOLD = 0.85


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased: what stands between runs of other characters, which are matched much faster."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def word_order(docs: DataFrame, templates: tuple[Template, ...], text_col: str = "text") -> list[str]:
    """The templates' words by the number of documents that hold them, over all of `docs`, rarest first."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_intersect(words_of(F.col(f"`{text_col}`")), F.lit(vocabulary))
    counts = {r.word: r.n for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _any(items: list[Column]) -> Column:
    return F.array_compact(F.array(*items)) if items else F.array()


def _together(df: DataFrame) -> DataFrame:
    """`df` with the results of two passes as one; those of the earlier pass are named with two underscores."""
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.concat(F.split(f"__{c}", ","), F.split(c, ",")), lambda x: x != ""))), ",")
    both = {"n_words": F.col("n_words"), "n_base": F.col("__n_base") + F.col("n_base"), "matches": F.concat("__matches", "matches")}
    both |= {c: f(F.col(f"__{c}"), F.col(c)) for c, f in (("first_word", F.least), ("last_word", F.greatest), ("score", F.greatest))}
    both |= {c: labels(c) for c in ("base_labels", "labels")}
    return df.withColumns({c: both[c] for c in RESULTS}).drop(*[f"__{c}" for c in RESULTS])


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, threshold: float = THRESHOLD, text_col: str = "text", stride: int | None = None) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and matches.

    `matches` has a row for each block and template that meet: first word, last word + 1, label, containment.
    `stride`: words of half a block, those of the longest template if not given.
    """
    if not templates:
        raise ValueError("there is a template at least")
    stride = stride or max(len(t.words) for t in templates)
    if len(templates) > MAX_TEMPLATES:
        out = scan(docs, templates[:MAX_TEMPLATES], threshold, text_col, stride)
        for at in range(MAX_TEMPLATES, len(templates), MAX_TEMPLATES):
            earlier = out.withColumnsRenamed({c: f"__{c}" for c in RESULTS})
            out = _together(scan(earlier, templates[at : at + MAX_TEMPLATES], threshold, text_col, stride))
        return out
    order = word_order(docs, templates, text_col)
    rank = {w: i for i, w in enumerate(order)}
    sized = [(t, sorted(set(t.words), key=rank.__getitem__), t.needed(threshold)) for t in templates]
    prefixes = {w for _, own, needed in sized for w in own[: len(own) - needed + 1]}

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches", "__words", "__found"]
    df = docs.drop(*names).withColumn("__words", words_of(F.col(f"`{text_col}`")))
    words, n = F.col("__words"), F.size("__words")
    count = F.ceil(n / F.lit(stride)).cast("int")
    block = lambda k: F.slice(words, k * stride + 1, F.lit(2 * stride))

    def candidates(known: Column, t: Template, own: list[str], needed: int) -> Column:
        """Whether the prefix, length and position filters let the pair pass; `known`: the block's words in order."""
        passes = F.lit(False)
        for p, word in enumerate(own[: len(own) - needed + 1]):
            q = F.array_position(known, word)
            passes = passes | ((q > 0) & (F.least(F.lit(len(own) - p), F.size(known) - q + 1) >= needed - p))
        return (F.size(known) >= needed) & passes

    def matched(k: Column) -> Column:
        """The matches of block k, as an array."""

        def compared(known: Column) -> Column:
            found = []
            for i, (t, own, needed) in enumerate(sized):
                share = F.size(F.array_intersect(known, F.lit(own))) / F.lit(float(len(own)))
                full = F.when(share >= needed / len(own) - 1e-9, F.struct(F.lit(i).alias("t"), k.alias("k"), share.alias("share")))
                found.append(F.when(candidates(known, t, own, needed), full))
            return _any(found)

        known = F.array_intersect(F.lit(order), block(k))
        return F.flatten(F.transform(F.array(known), compared))

    # blocks without any prefix word are passed over before their words are ordered
    worth = F.filter(F.sequence(F.lit(0), count - 1), lambda k: F.arrays_overlap(block(k), F.lit(sorted(prefixes))))
    some = F.arrays_overlap(words, F.lit(sorted(prefixes)))
    empty = F.array().cast("array<struct<t:int,k:int,share:double>>")
    found = F.when(some & (n > 0), F.flatten(F.transform(worth, matched))).otherwise(empty)
    df = df.withColumn("__found", found)

    def places(t: Template, i: int) -> Column:
        """Where the phrase starts, in the blocks that hold all its words; each start belongs to one block."""
        own = t.words
        blocks = F.filter("__found", lambda m: m["t"] == i)

        def starts(m: Column) -> Column:
            first = m["k"] * stride
            return F.filter(F.sequence(first, F.least(first + stride - 1, n - 1)), lambda at: F.slice(words, at + 1, len(own)) == F.lit(own))

        return F.flatten(F.transform(blocks, starts))

    exact = [(i, t) for i, (t, _, _) in enumerate(sized) if t.exact]
    df = df.withColumns({f"__at{i}": places(t, i) for i, t in exact})
    starts = F.concat(*[F.col(f"__at{i}") for i, _ in exact]) if exact else F.array().cast("array<int>")
    base = _any([F.when(F.size(f"__at{i}") > 0, F.lit(t.label)) for i, t in exact]).cast("array<string>")
    label_of = F.lit([t.label for t in templates])
    by_blocks = F.transform(F.filter("__found", lambda m: ~F.get(F.lit([t.exact for t in templates]), m["t"])), lambda m: F.get(label_of, m["t"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    df = df.withColumns({"__starts": starts, "__base": base})
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "n_base": F.size("__starts").cast("long"),
            "first_word": F.array_min("__starts").cast("long"),
            "last_word": F.array_max("__starts").cast("long"),
            "base_labels": joined(F.col("__base")),
            "labels": joined(F.concat("__base", by_blocks)),
            "score": F.coalesce(F.array_max(F.transform("__found", lambda m: m["share"])), F.lit(0.0)),
            "matches": F.transform("__found", lambda m: F.struct((m["k"] * stride).alias("first"), F.least(m["k"] * stride + 2 * stride, n).alias("end"), F.get(label_of, m["t"]).alias("label"), m["share"].alias("containment"))),
        }
    )
    return df.drop("__words", "__found", "__starts", "__base", *[f"__at{i}" for i, _ in exact])
