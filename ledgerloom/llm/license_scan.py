"""License scans (operator 9): conditional compression.

Candidate blocks are stretches of words in which a template's own words are dense enough: a run that differs from a template
in at most `MOST_CHANGED` of its words holds the others of them within a bounded number of words, so no match lies outside.
There is no list of telling words: what is sought follows from the templates that are given. Blocks run across line breaks
and sentence ends.

In a block, every run of words that could be the template, free to begin and end anywhere, is compressed alone and with
the template as a zstandard raw dictionary; how much smaller the template makes it, as a share of the run's size or the
template's, whichever is smaller, must reach `LEAST`. Winners are confirmed by exact wording differences: the words that
must be removed from and added to the template to give the run (case, punctuation and spacing aside), zero for an exact
quotation. For each end the cheapest run counts, the shortest among equals. Every template that reaches `LEAST` is confirmed.

Of runs that overlap, the one that has most words of its template, less those added, wins, then the larger reduction.
Words of the same sentence that stand in place of the template's missing first or last ones are shown and counted as added,
as far as the run stays a match.

Templates come in few lines and are part of the task; nothing is shuffled.

Defined cases: null and empty texts have no rows; repeated rows give repeated results; a null identifier stays; among
equal runs the first template in byte order wins; a template without words matches nothing; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import table

#: Fixed values: (name, wording), short notices in public use.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
LEAST, MOST_CHANGED = 0.3, 0.3

_end = re.compile(r"(?<=[.!?:])\s+|\n+")
_word = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def wording(text: str) -> list[str]:
    return [*map(str.lower, _word.findall(text))]


def changed(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each end in b, 0 to len(b): words to remove from a and to add to it to make the run of b that ends there and is
    most like it, and where that run starts (the shortest among equals)."""
    n = len(b)
    step = n + 1
    added = np.arange(n + 1) * step
    row = np.arange(n, -1, -1)  # cost times step, plus n - start
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    for x in a:
        last, row = row, row + step
        if x in places:
            at = np.array(places[x])
            row[at + 1] = np.minimum(row[at + 1], last[at])
        row = np.minimum.accumulate(row - added) + added
    return row // step, n - row % step


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = sorted(t for t in templates if wording(t[1]))
        self.words = [wording(t) for _, t in self.templates]
        self.limits = [int(MOST_CHANGED * len(w)) for w in self.words]
        # the templates that have a word
        self.of = {}
        for k, own in enumerate(self.words):
            for w in dict.fromkeys(own):
                self.of.setdefault(w, []).append(k)
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False, write_checksum=False)
        raws = [" ".join(w).encode() for w in self.words]
        self.given = [
            zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for raw in raws
        ]
        self.sizes = [len(self.alone.compress(raw)) for raw in raws]

    def blocks(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(template, first word, end) of the stretches that may hold a match of a template."""
        held: dict[int, list[int]] = {}
        for at in [j for j, w in enumerate(words) if w in self.of]:
            for k in self.of[words[at]]:
                held.setdefault(k, []).append(at)
        for k, places in held.items():
            need, reach = len(self.words[k]) - self.limits[k], len(self.words[k]) + self.limits[k]
            if len(places) < need:
                continue
            at = np.array(places)
            # places from which `need` of the template's words follow within `reach` words
            first = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < reach)
            # a run of at most `reach` words that holds them
            low, high = np.maximum(at[first + need - 1] - reach + 1, 0), np.minimum(at[first] + reach, len(words))
            for part in np.split(np.arange(len(first)), np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1]) + 1):
                if len(part):
                    yield k, int(low[part[0]]), int(high[part].max())

    def reduction(self, k: int, words: list[str]) -> float:
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        return (size - len(self.given[k].compress(raw))) / min(size, self.sizes[k])

    def runs(self, words: list[str]) -> list[tuple[int, int, int, float, int]]:
        """(first word, end, template, reduction, changed words) of the matches in words."""
        found = []
        for k, low, high in self.blocks(words):
            cost, start = changed(self.words[k], words[low:high])
            for end in np.flatnonzero((cost <= self.limits[k]) & (start < np.arange(len(cost)))).tolist():
                at, n = int(start[end]), int(cost[end])
                reduction = self.reduction(k, words[low + at : low + end])
                if reduction >= LEAST:
                    found.append((n - len(self.words[k]), -reduction, k, low + at, low + end, n))
        out, taken = [], np.zeros(len(words), bool)
        for _, reduction, k, at, end, n in sorted(found):
            if not taken[at:end].any():
                taken[at:end] = True
                out.append((at, end, k, -reduction, n))
        return sorted(out)

    def scan(self, text: str) -> Iterator[tuple[int, str, int, float, int]]:
        """(start, block, template, reduction, changed words) of each notice."""
        words = wording(text)
        found = self.runs(words) if any(w in self.of for w in words) else []
        if not found:
            return
        places = [m.span() for m in _word.finditer(text)]
        starts, ends = [x for x, _ in places], [0, *(cut.end() for cut in _end.finditer(text))]
        sentences = [(a, b) for a, b in zip(ends, [*ends[1:], len(text)], strict=True)]
        for i, (at, end, k, reduction, n) in enumerate(found):
            own = self.words[k]
            free = (found[i - 1][1] if i else 0, found[i + 1][0] if i + 1 < len(found) else len(words))
            for back in (False, True):
                # the sentence that the run ends in, and then the one that it starts in
                left, right = sentences[bisect_right(sentences, (starts[at if back else end - 1], len(text))) - 1]
                if (words[at] if back else words[end - 1]) == (own[0] if back else own[-1]):
                    continue
                while end - at < len(own) and n < self.limits[k]:
                    if back and at > free[0] and starts[at - 1] >= left:
                        at -= 1
                    elif not back and end < free[1] and starts[end] < right:
                        end += 1
                    else:
                        break
                    n += 1
            yield starts[at], text[starts[at] : places[end - 1][1]], k, reduction, n


@lru_cache(2)
def scanner_of(templates: tuple) -> Scanner:
    return Scanner(list(templates))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each confirmed notice: id_col, start, block, license, wording (number among the sorted templates),
    reduction, n_changed, exact."""
    ship(docs.sparkSession)
    held = tuple(map(tuple, templates))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scanner_of(held)
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].astype("Int64"), batch["text"], strict=True):
                for start, block, k, reduction, n in own.scan(text):
                    out.append((key, start, block, own.templates[k][0], k, reduction, n, n == 0))
            yield pd.DataFrame(out, columns=["id", "start", "block", "license", "wording", "reduction", "n_changed", "exact"]).astype({"id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = "id long, start long, block string, license string, wording int, reduction double, n_changed int, exact boolean"
    return rows.mapInPandas(scan, schema).withColumnRenamed("id", id_col)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
