"""License scans: base phrases, and licence texts found through a positional index of rare words.

Method. Each licence template is indexed by word and place. Of each template, the words with the highest inverse document
frequency (counted over all documents) are looked up, by rank within the template and so many that a stretch with enough
of the template's words cannot miss them, however frequent they are: no table, copy or other licence hides a template.
Every meeting of a file's place and a template's
place votes for their difference, so a template that stands in the file, whole or in part, gathers votes at one relative
position. An aligned template is a finding if enough of its words stand in the aligned stretch and its mandatory key
phrases stand there word for word.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Defined results: a null text counts as
empty; without words or findings the labels are empty strings, first_word and last_word null and the score 0; rows that
repeat an id are scanned each; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import ship

# Base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# The wording by which licences are known, and the phrases that a finding must hold.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("free software you can redistribute it", "gnu general public license"),
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
        ("free software you can redistribute it", "lesser general public license"),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "permitted provided that the following conditions are met"),
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("subject to the terms of the mozilla public license",),
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
}

LEAST_VOTES = 3
LEAST_COVER = 0.6
#: How far places may drift within an aligned stretch, for words put in or left out.
DRIFT = 8
BASE_SCORE = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


_PARTS = {label: words_of(text.encode()) for label, (text, _) in TEMPLATES.items()}
_KEYS = {label: [words_of(x.encode()) for x in keys] for label, (_, keys) in TEMPLATES.items()}
VOCABULARY = sorted({w for words in _PARTS.values() for w in words})
_BASE = [(tuple(w.encode() for w in words), label) for words, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase's words stand consecutively."""
    found = []
    for i, word in enumerate(words):
        if word == b"license":
            found += [(i - len(phrase) + 1, label) for phrase, label in _BASE if i + 1 >= len(phrase) and tuple(words[i + 1 - len(phrase) : i + 1]) == phrase]
    return sorted(found)


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


def rare_postings(idf: dict[bytes, float]) -> dict[bytes, list[tuple[str, int]]]:
    """(label, place) of each template's rarest words: of a stretch that reaches LEAST_COVER, LEAST_VOTES or more are among them."""
    rare: dict[bytes, list[tuple[str, int]]] = {}
    for label, words in _PARTS.items():
        ranked = sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))
        chosen = set(ranked[: len(words) - math.ceil(LEAST_COVER * len(words)) + LEAST_VOTES])
        for place, word in enumerate(words):
            if word in chosen:
                rare.setdefault(word, []).append((label, place))
    return rare


def aligned_licences(words: list[bytes], idf: dict[bytes, float], rare: dict[bytes, list[tuple[str, int]]] | None = None) -> dict[str, tuple[int, float]]:
    """label: (start, share of the template's words that stand in the aligned stretch) of verified findings. rare: ``rare_postings`` of idf."""
    present = set(words)
    # A finding holds its key phrases, so a file without one of them needs no look.
    may = {label for label, keys in _KEYS.items() if all(present.issuperset(key) for key in keys) and all(_holds(words, key) for key in keys)}
    if not may:
        return {}
    rare = rare_postings(idf) if rare is None else rare
    votes: dict[tuple[str, int], set[bytes]] = {}
    for place, word in enumerate(words):
        for label, at in rare.get(word, ()):
            if label in may:
                votes.setdefault((label, (place - at) // DRIFT), set()).add(word)
    found: dict[str, tuple[int, float]] = {}
    for label, block in sorted(votes):
        together = votes[label, block] | votes.get((label, block + 1), set())
        if len(together) < LEAST_VOTES:
            continue
        start = max(0, block * DRIFT)
        stretch = words[start : block * DRIFT + 2 * DRIFT + len(_PARTS[label]) + DRIFT]
        cover = sum((Counter(stretch) & Counter(_PARTS[label])).values()) / len(_PARTS[label])
        if cover >= LEAST_COVER and cover > found.get(label, (0, 0.0))[1] and all(_holds(stretch, key) for key in _KEYS[label]):
            found[label] = (start, cover)
    return found


def _word_counts(batches):
    """Documents that hold each licence word; the last number counts all documents."""
    hashes = np.array([w for w in VOCABULARY], dtype=object)
    data = np.frombuffer(b" ".join(hashes), np.uint8)
    names = tx.split(data, np.array([0, len(data)]), tx.ALNUM).hashes()
    order = np.argsort(names)
    names = names[order]
    counts = np.zeros(len(VOCABULARY) + 1, np.int64)
    for batch in batches:
        for low, high, chunk, offsets in tx.chunks(batch.column(0)):
            words = tx.split(chunk, offsets, tx.ALNUM)
            found = words.hashes()
            at = np.minimum(np.searchsorted(names, found), len(names) - 1)
            hit = names[at] == found
            pairs = np.unique(words.owner()[hit] * len(names) + at[hit])
            counts[:-1] += np.bincount(order[pairs % len(names)], minlength=len(names))
            counts[-1] += high - low
    yield pa.record_batch({"word": pa.array(range(len(counts)), pa.int32()), "n": pa.array(counts, pa.int64())})


def licence_idf(documents: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of each licence word over all documents."""
    ship(documents.sparkSession)
    rows = documents.select("text").mapInArrow(_word_counts, "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row per licence word
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.get(len(VOCABULARY), 0)
    return {w: math.log((1 + total) / (1 + counts.get(i, 0))) for i, w in enumerate(VOCABULARY)}


def _scans(idf: dict[bytes, float]):
    def run(batches):
        rare = rare_postings(idf)
        for batch in batches:
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found")}
            for text in batch.column(1).to_pylist():
                words = words_of((text or "").encode("utf-8", "surrogatepass"))
                base = base_places(words)
                found = aligned_licences(words, idf, rare)
                labels = {label for _, label in base}
                out["n_words"].append(len(words))
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(labels)))
                out["labels"].append(",".join(sorted(labels | set(found))))
                out["score"].append(max([0.0, BASE_SCORE * bool(base), *(min(1.0, cover) for _, cover in found.values())]))
                out["found"].append(",".join(f"{k}:{v[0]}" for k, v in sorted(found.items())))
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    return run


def scan_licences(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found (label:word)."""
    idf = licence_idf(documents)
    return documents.select("doc_id", "text").mapInArrow(
        _scans(idf), "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, found string"
    )
