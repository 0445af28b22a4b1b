"""Licence scan with a positional index of rare words.

The index says at which places of which templates a licence word stands. The
words' document frequencies are counted over the whole corpus. A template can
stand in a file only if all words of its mandatory key phrase do, so the words
by which a file is looked up are, of the file's licence words, the two of the
highest IDF in that phrase. Each of the two, at place i of the file and p of the
template, says that the template starts at i - p; only starts that both say are
left when their postings are intersected. At each the key phrase is verified
word by word, and longer templates also need a share of their words in place.

Only DataFrame functions are used, and a file's row is never split or shuffled:
starts stay in arrays, one short entry for each rare word found.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Java pattern of what separates words of the lower-cased text.
NOT_WORDS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"
#: Share of a template's words that must stand in place.
SHARE = 0.6


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    #: place and number of the words that must all be there
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str | None = None) -> Template:
    words, wanted = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, (at, len(wanted)), key is None)


#: The phrases of the base labels, and openings of well-known licence texts with the phrase that each must hold.
TEMPLATES = (
    template("gpl", "gnu general public license"),
    template("apache", "apache license"),
    template("cc-by", "cc by"),
    template("mit", "mit license"),
    template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "software is provided as is without warranty of any kind"),
    template("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    template("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "may not use this file except in compliance with the license"),
    template("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you can redistribute it and or modify it"),
    template("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty", "distributed in the hope that it will be useful"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("cc-text", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    template("cc0-text", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    template("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "may be used to endorse or promote products derived from this software"),
    template("mpl-header", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("epl", "eclipse public license", "eclipse public license"),
    template("boost", "boost software license version 1 0", "boost software license"),
    template("unlicense-text", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    template("zlib-text", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    template("spdx", "spdx license identifier", "spdx license identifier"),
)
#: Rare words of the key phrase whose postings are intersected.
LOOKUPS = 2


def split_words(text: Column) -> Column:
    """The parts of a text: its lower-cased words, with an empty string before the first or after the last where other signs stand there.

    Lower-casing beyond A-Z never makes a word equal to an ASCII word without k.
    """
    return F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS)


def document_frequencies(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """In how many of docs' texts each template word stands; one row a template word comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(split_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counted}


def lookups(t: Template, frequencies: dict[str, int], most: int = LOOKUPS) -> list[str]:
    """The words of the key phrase that are rarest in the corpus (highest IDF), ties by word; fewer if the phrase has fewer."""
    a, n = t.key
    return sorted(set(t.words[a : a + n]), key=lambda w: (frequencies.get(w, 0), w))[:most]


def _found(t: Template, rare: list[str], hits: Column, parts: Column) -> Column:
    """(start, share) of the places in parts where the template stands. hits: places of all files' rare words."""
    a, n = t.key

    def starts(word):
        at = F.filter(hits, lambda i: F.get(parts, i) == word)
        return F.flatten(F.transform(at, lambda i: F.array(*[i - p for p in range(a, a + n) if t.words[p] == word])))

    both = starts(rare[0])
    for word in rare[1:]:
        both = F.array_intersect(both, starts(word))

    def holds(s):
        ok = F.lit(True)
        for p in range(a, a + n):
            ok = ok & F.coalesce(F.get(parts, s + p) == t.words[p], F.lit(False))
        return ok

    placed = F.transform(F.filter(F.array_distinct(both), holds), lambda s: F.struct(s.alias("start"), (F.lit(1.0) if n == len(t.words) else _share(t, parts, s)).alias("share")))
    return placed if n == len(t.words) else F.filter(placed, lambda x: x["share"] >= SHARE)


def _share(t: Template, parts: Column, s: Column) -> Column:
    same = [F.coalesce(F.get(parts, s + p) == w, F.lit(False)).cast("int") for p, w in enumerate(t.words)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / F.lit(float(len(t.words)))


def scan(docs: DataFrame, templates=TEMPLATES, frequencies: dict[str, int] | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a found template's words that stand in
    place, 1 for base phrases, 0 where nothing is found. Null texts count as
    empty: no words, no labels (empty strings), null places. Null ids and
    repeated rows are scanned like any other; words of equal frequency are
    taken in their own order, which changes no result; other columns of docs
    are not read; an empty table gives an empty result.
    """
    frequencies = document_frequencies(docs, templates) if frequencies is None else frequencies
    rare = {t.label: lookups(t, frequencies) for t in templates}
    every = sorted({w for x in rare.values() for w in x})
    base = {f"t{k}" for k, t in enumerate(templates) if t.base}
    none = F.array().cast("array<struct<start:int,share:double>>")

    def row(parts):
        lead = (F.element_at(parts, 1) == "").cast("int")
        tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
        hits = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.get(parts, i).isin(every))
        found = let(hits, lambda h: F.struct(*[F.when(F.size(h) >= len(rare[t.label]), _found(t, rare[t.label], h, parts)).otherwise(none).alias(f"t{k}") for k, t in enumerate(templates)]))
        return F.struct((F.size(parts) - lead - tail).alias("n_words"), lead.alias("lead"), found.alias("found"))

    rows = docs.select("doc_id", let(split_words(F.col("text")), row).alias("s"))
    at = F.transform(F.concat(*[F.col(f"s.found.{k}") for k in sorted(base)]), lambda x: x["start"] - F.col("s.lead"))

    def labels(wanted):
        named = [F.when(F.size(f"s.found.t{k}") > 0, F.lit(t.label)) for k, t in enumerate(templates) if f"t{k}" in wanted]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))), ",")

    everything = [f"t{k}" for k in range(len(templates))]
    score = F.coalesce(F.array_max(F.transform(F.concat(*[F.col(f"s.found.{k}") for k in everything]), lambda x: x["share"])), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("s.n_words").cast("long").alias("n_words"), F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(everything).alias("labels"), score.alias("score"),
    )
