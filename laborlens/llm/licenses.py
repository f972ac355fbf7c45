"""Licence scan by a positional index of rare licence words.

The index holds, for each word of the licence notices below, the notices and places it stands at.
One pass over the texts keeps the licence words of each text with their places; how many texts have
a word gives its weight.  A text then looks up its licence words of highest weight: each occurrence
and each posting of the word vote for a place where that notice would begin, and the places on which
several different words agree are candidates.  A candidate is a find if the notice's mandatory
phrase stands where it should.  Plain key phrases are found anywhere (`BASE`).

DataFrame functions only.  A text is read in one row, some ten times its size; only the few texts
with enough words of one notice are shuffled, by row and place, so copies share no key.

Null and empty texts have no words, labels or score.  Repeated rows, null and repeated ids are
judged each for itself.  Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage

# Phrases whose every occurrence is a base find, and their labels.
BASE = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Notices as their licences word them: label, mandatory phrase, text.
NOTICES = (
    ("apache", "apache license",
     "licensed under the apache license version 2 0"),
    ("apache", "apache license",
     "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license you may obtain a copy of the license at"),
    ("bsd", "binary forms with",
     "redistribution and use in source and binary forms with or without modification are permitted"
     " provided that the following conditions are met"),
    ("cc-by", "creative commons attribution",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc",
     "licensed under cc by nc 4 0"),
    ("cc-by-nc", "attribution noncommercial",
     "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "general public license",
     "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license",
     "this program is free software you can redistribute it and or modify it under the terms of the"
     " gnu general public license as published by the free software foundation"),
    ("isc", "without fee",
     "permission to use copy modify and or distribute this software for any purpose with or without"
     " fee is hereby granted provided that the above copyright notice and this permission notice"
     " appear in all copies"),
    ("lgpl", "lesser general public",
     "this library is free software you can redistribute it and or modify it under the terms of the"
     " gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license",
     "released under the mit license"),
    ("mit", "hereby granted free",
     "permission is hereby granted free of charge to any person obtaining a copy of this software"
     " and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered software released",
     "this is free and unencumbered software released into the public domain"),
)
# Words too common to tell a licence, unless a phrase needs them.
COMMON = frozenset(
    "a above all and any are as at by can in into is it may not of on or the this to under use with"
    " you".split())
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOOKED_UP = 16  # licence words of a text that are looked up, those of highest weight
LEAST_AGREE = 2  # different words that must agree on a place
SLACK = 3  # words by which the mandatory phrase may be off its place


def _phrases() -> list[str]:
    return sorted({*BASE, *(phrase for _, phrase, _ in NOTICES)})


def vocabulary() -> list[str]:
    """The licence words; a word's number is its place here."""
    told = {w for _, _, text in NOTICES for w in text.split() if w not in COMMON and not w.isdigit()}
    return sorted(told | {w for phrase in _phrases() for w in phrase.split()})


def index() -> list[tuple[int, int, int]]:
    """(word, notice, place), sorted: the postings of the words that may be looked up."""
    number = {w: k for k, w in enumerate(vocabulary())}
    return sorted((number[w], notice, place) for notice, (_, _, text) in enumerate(NOTICES)
                  for place, w in enumerate(text.split()) if w in number and w not in COMMON)


def _anchor(notice: int) -> int:
    """Where the mandatory phrase begins in a notice."""
    _, phrase, text = NOTICES[notice]
    words, wanted = text.split(), phrase.split()
    return next(k for k in range(len(words)) if words[k:k + len(wanted)] == wanted)


def licence_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_words, hits): the licence words (w, p) of each text, in order."""
    known = vocabulary()
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"),
        F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"))

    def known_word(x: Column) -> Column:
        # lower() also turns a few other letters into ASCII ones; those are longer in UTF-8.
        lowered = F.lower(x)
        return lowered.isin(known) & (F.octet_length(x) == F.octet_length(lowered))

    placed = F.transform("words", lambda x, i: F.when(known_word(x), F.struct(
        (F.array_position(F.lit(known), F.lower(x)) - 1).cast("int").alias("w"), i.alias("p"))))
    return words.select("row", "key", F.size("words").cast("long").alias("n_words"),
                        F.filter(placed, lambda h: h.isNotNull()).alias("hits"))


def _starts(phrase: str) -> Column:
    """The places in `hits` where the words of the phrase stand one after the other."""
    number = {w: k for k, w in enumerate(vocabulary())}
    wanted = [number[w] for w in phrase.split()]

    def begins(h: Column, i: Column) -> Column:
        met = [h["w"] == wanted[0]]
        for k, w in enumerate(wanted[1:], 1):
            after = F.get("hits", i + k)
            met.append((after["w"] == w) & (after["p"] == h["p"] + k))
        return F.coalesce(reduce(lambda a, b: a & b, met), F.lit(False))

    return F.transform(F.filter("hits", begins), lambda h: h["p"])


def _rare(weights: dict[int, int]) -> Column:
    """The text's licence words of highest weight: in the fewest texts, then by number."""
    texts = F.lit([int(weights.get(k, 0)) for k in range(len(vocabulary()))])
    own = F.array_distinct(F.transform("hits", lambda h: h["w"]))
    posted = sorted({w for w, _, _ in index()})
    ordered = F.array_sort(F.transform(
        F.filter(own, lambda w: w.isin(posted)),
        lambda w: F.struct(F.get(texts, w).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ordered, 1, LOOKED_UP), lambda x: x["w"])


def _votes() -> Column:
    """(notice, start, w) for every occurrence of a word looked up and every posting of it."""
    by_word = [[] for _ in vocabulary()]
    for w, notice, place in index():
        by_word[w].append((notice, place))
    postings = F.array(*[
        F.array(*[F.struct(F.lit(n).alias("notice"), F.lit(p).alias("place")) for n, p in some])
        if some else F.array().cast("array<struct<notice:int,place:int>>") for some in by_word])
    return F.flatten(F.transform(
        F.filter("hits", lambda h: F.array_contains("rare", h["w"])),
        lambda h: F.transform(F.get(postings, h["w"]), lambda q: F.struct(
            q["notice"].alias("notice"), (h["p"] - q["place"]).alias("start"), h["w"].alias("w")))))


def _asked(notice: int) -> Column:
    """How many of the words looked up the notice has."""
    own = sorted({w for w, n, _ in index() if n == notice})
    return F.size(F.filter("rare", lambda w: w.isin(own)))


def candidates(hits: DataFrame) -> DataFrame:
    """(row, notice, start, agreeing, asked): places that several rare words of a text agree on.

    `asked` is how many of the words looked up the notice has at all.
    """
    counted = (hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
               .groupBy("w").count().collect())  # one row per licence word at most
    looked = hits.where(F.size("hits") >= LEAST_AGREE).withColumn(
        "rare", _rare({r["w"]: r["count"] for r in counted}))
    sizes = F.array(*[_asked(n) for n in range(len(NOTICES))])
    votes = (looked.withColumn("asked", sizes)
             .where(F.exists("asked", lambda n: n >= LEAST_AGREE))
             .select("row", "asked", F.explode(_votes()).alias("vote"))
             .select("row", "vote.*", F.get("asked", F.col("vote.notice")).alias("asked")))
    return (votes.where(F.col("asked") >= LEAST_AGREE)
            .groupBy("row", "notice", "start").agg(
                F.count_distinct("w").alias("agreeing"), F.max("asked").alias("asked"))
            .where((F.col("agreeing") >= LEAST_AGREE) & (2 * F.col("agreeing") >= F.col("asked"))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, base (phrase starts, label), finds (label, notice, start, score).

    A find's score is the share of the notice's words looked up that agree on its place.
    """
    hits = cut_lineage(licence_words(docs, key, text))
    found = candidates(hits)
    phrases = {p: f"s{k}" for k, p in enumerate(_phrases())}
    placed = hits.select("row", *[_starts(p).alias(name) for p, name in phrases.items()])
    # The phrase that each notice needs, in the order of the notices.
    needed = F.array(*[F.col(phrases[phrase]) for _, phrase, _ in NOTICES])
    anchors = F.lit([_anchor(n) for n in range(len(NOTICES))])
    labels = F.lit([label for label, _, _ in NOTICES])
    verified = (
        found.join(placed, "row")
        .where(F.exists(F.get(needed, F.col("notice")), lambda p: F.abs(
            p - F.col("start") - F.get(anchors, F.col("notice"))) <= SLACK))
        .groupBy("row", F.get(labels, F.col("notice")).alias("label"))
        .agg(F.max(F.struct((F.col("agreeing") / F.col("asked")).alias("score"),
                            F.col("agreeing"), (-F.col("start")).alias("back"), "notice")).alias("best"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(  # one per label
            "label", "best.notice", (-F.col("best.back")).alias("start"), "best.score"))).alias("finds")))
    base = F.array(*[F.struct(F.lit(label).alias("label"), _starts(phrase).alias("starts"))
                     for phrase, label in BASE.items()])
    return (hits.select("row", "key", "n_words", base.alias("base")).join(verified, "row", "left")
            .select(F.col("key").alias(key), "n_words", "base", F.coalesce("finds", F.array().cast(
                "array<struct<label:string,notice:int,start:int,score:double>>")).alias("finds")))
