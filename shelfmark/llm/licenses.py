"""Licence scan: a positional rare-token index over licence templates."""

import re
from collections import defaultdict
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, stored, text_bytes

DRIFT = 3
COVERAGE = 0.75
VOTING_SHARE = 0.6
SLICE_BYTES = 8 << 20

# Phrases of the result's contract: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Openings of public licences: label, text, phrases that must stand in the matched place.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
               "compliance with the License.", ("apache license", "version 2 0")),
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license",)),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation", ("lesser general public license",)),
    ("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
             "published by the Free Software Foundation", ("affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met", ("redistribution and use", "conditions are met")),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
     ("mozilla public license",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted", ("with or without fee", "hereby granted")),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
     ("creative commons attribution",)),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
     ("creative commons attribution sharealike",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.",
     ("unencumbered software", "public domain")),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License",
     ("eclipse public license",)),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be "
             "held liable for any damages arising from the use of this software.", ("provided as is", "held liable")),
)

_BLANKED = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters a-z, digits and characters outside ASCII."""
    return text.translate(_BLANKED).split()


@dataclass
class Index:
    """Word numbers, template words and the key phrases of each template."""

    ids: dict[bytes, int] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    keys: list[list[tuple[int, ...]]] = field(default_factory=list)
    by_template: list[dict[int, list[int]]] = field(default_factory=list)
    base: list[tuple[tuple[int, ...], str]] = field(default_factory=list)

    def number(self, text: str) -> tuple[int, ...]:
        return tuple(self.ids.setdefault(w, len(self.ids)) for w in words_of(text.encode()))


def build_index(templates=TEMPLATES, base=BASE) -> Index:
    index = Index()
    for label, text, keys in templates:
        words = index.number(text)
        own = defaultdict(list)
        for at, w in enumerate(words):
            own[w].append(at)
        index.by_template.append(own)
        index.labels.append(label)
        index.lengths.append(len(words))
        index.keys.append([index.number(k) for k in keys])
    index.base = [(index.number(phrase), label) for phrase, label in base]
    return index


def licence_words(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n_words and the places and numbers of the words any template or phrase holds."""
    ids = index.ids

    def run(batches):
        for part in slices(batches, "data", SLICE_BYTES):
            counts, places, numbers = [], [], []
            for data in part.column("data").to_pylist():
                words = words_of(data)
                at = [i for i, w in enumerate(words) if w in ids]
                counts.append(len(words))
                places.append(at)
                numbers.append([ids[words[i]] for i in at])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, pa.list_(pa.int32())),
                 pa.array(numbers, pa.list_(pa.int32()))], ["doc_id", "n_words", "places", "numbers"])

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("data")).mapInArrow(
        run, "doc_id bigint, n_words bigint, places array<int>, numbers array<int>")


def phrase_starts(at: dict[int, int], of: dict[int, list[int]], phrase: tuple[int, ...]) -> list[int]:
    """Places where the phrase's words stand one after another."""
    return [p for p in of.get(phrase[0], ()) if all(at.get(p + k) == w for k, w in enumerate(phrase))]


@dataclass
class Voting:
    """The places of each template's rarest words, by word, and the weight their votes must reach."""

    postings: dict[int, list[tuple[int, int]]]
    weights: list[dict[int, float]]
    needed: list[float]


def voting_words(index: Index, idf: list[float]) -> Voting:
    """Each template's own rarest words, until they hold ``VOTING_SHARE`` of its weight, vote for it.

    A place that covers ``COVERAGE`` of a template misses at most the rest of its weight, so its votes weigh
    at least the voters' weight without that rest: the bound loses no place.
    """
    voting = Voting(defaultdict(list), [], [])
    for template, own in enumerate(index.by_template):
        weights = {where: idf[w] for w, spots in own.items() for where in spots}
        total, held, taken = sum(weights.values()), 0.0, {}
        for w in sorted(own, key=lambda w: (-idf[w], w)):
            if held >= VOTING_SHARE * total:
                break
            for where in own[w]:
                voting.postings[w].append((template, where))
                taken[where] = weights[where]
                held += weights[where]
        voting.weights.append(taken)
        voting.needed.append(held - (1 - COVERAGE) * total - 1e-9)
    return voting


def match_templates(at, of, index: Index, idf: list[float], voting: Voting) -> list[tuple[str, int, int, float]]:
    """(label, first word, last word, coverage) of the template places in a document.

    The rarest words of each template vote for the place where it begins (in steps of ``DRIFT``); a place
    whose votes, with those of the steps the comparison reaches, weigh enough is compared with the whole
    template, weighted by IDF, and must hold the template's key phrases. Of neighbouring steps that share the
    words of one place, the one with the most votes counts.
    """
    votes: dict[tuple[int, int], set[int]] = defaultdict(set)
    for w in of.keys() & voting.postings.keys():
        for template, where in voting.postings[w]:
            for p in of[w]:
                votes[template, (p - where) // DRIFT].add(where)
    found = {}
    for template, cell in votes:
        weights, needed = voting.weights[template], voting.needed[template]
        reached = set().union(*(votes.get((template, c), ()) for c in range(cell - 1, cell + 3)))
        if sum(weights[where] for where in reached) < needed:
            continue
        start = cell * DRIFT
        total = got = 0.0
        last = start
        for w, spots in index.by_template[template].items():
            for where in spots:
                total += idf[w]
                near = next((q for q in range(start + where - DRIFT, start + where + 2 * DRIFT + 1) if at.get(q) == w), None)
                if near is not None:
                    got += idf[w]
                    last = max(last, near)
        coverage = got / total if total else 0.0
        if coverage < COVERAGE:
            continue
        reach = range(start - 2 * DRIFT, start + index.lengths[template] + 2 * DRIFT + 1)
        if all(any(all(at.get(p + k) == w for k, w in enumerate(key)) for p in reach) for key in index.keys[template]):
            own = sum(weights[where] for where in votes[template, cell])
            found[template, cell] = (own, (index.labels[template], max(0, start), last, min(1.0, coverage)))
    return [
        match for (template, cell), (own, match) in found.items()
        if own >= voting.needed[template]
        or all(own >= found.get((template, c), (0,))[0] for c in range(cell - 2, cell + 3))
    ]


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and n_matches, one row per row.

    Document frequencies of the licence words are counted over all documents. ``score`` is the best
    template coverage, or 1 where a base phrase stands. Null and empty texts have no words, no
    labels (empty strings) and score 0; repeated rows give repeated results; an empty table gives no rows; other
    columns are not read.
    """
    index = build_index(templates, base)
    hits = stored(licence_words(docs, index), "licence-words")
    counted = hits.select(F.explode(F.array_distinct("numbers")).alias("word")).groupBy("word").count().collect()
    n = hits.count()
    frequency = {r.word: r["count"] for r in counted}
    idf = [log((n + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in range(len(index.ids))]
    voting = voting_words(index, idf)
    schema = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
              "labels string, score double, n_matches bigint")

    def run(batches):
        for part in batches:
            out = []
            for doc_id, n_words, places, numbers in zip(*(part.column(c).to_pylist() for c in part.schema.names), strict=True):
                at, of = dict(zip(places, numbers, strict=True)), defaultdict(list)
                for p, w in zip(places, numbers, strict=True):
                    of[w].append(p)
                starts, plain = [], set()
                for phrase, label in index.base:
                    here = phrase_starts(at, of, phrase)
                    starts += here
                    plain |= {label} if here else set()
                matches = match_templates(at, of, index, idf, voting)
                labels = plain | {m[0] for m in matches}
                score = 1.0 if plain else max((m[3] for m in matches), default=0.0)
                out.append((doc_id, n_words, len(starts), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted(plain)), ",".join(sorted(labels)), score, len(matches)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], re.findall(r"(\w+) \w+(?:,|$)", schema))

    return hits.mapInArrow(run, schema)
