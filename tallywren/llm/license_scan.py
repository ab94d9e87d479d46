"""Operator 6: license scans by MinHash bands over overlapping text windows.

Templates are grouped by length; a group's windows are three times as long as its longest template, at a stride
of its length, so that every copy stretched to at most twice that length lies wholly inside some window. Window and
template are compared by MinHash over word shingles with bands of one row: a window that holds the share ``CONTAINMENT`` of
a template's ``m`` shingles among its own ``k`` has a similarity of ``C / (k + m - C)`` or more with ``C = CONTAINMENT * m``,
and ``bands_for`` takes as many bands as make a common value at least ``RECALL`` likely.
The templates' band values lie in one sorted table for each group, in which a window's values are looked up, so that a scan's work doesn't
grow with the number of templates in a group. Templates that a window retrieves are verified by exact containment of their
shingles in the window widened by a stride on both sides.

Defined cases: null and empty texts hold no license; texts of any length are scanned whole; templates shorter than a shingle are one
shingle of all their words; templates without words are left out; where several windows hold a template best, the first counts;
repeated rows are scanned alike; an empty table gives an empty result, and no templates give no licenses; other columns, whatever their names, are passed by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, cut

SHINGLE, CONTAINMENT, RECALL, GROWTH = 5, 0.8, 0.999, 1.15

# Notices of common public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def bands_for(similarity: float, recall: float = RECALL) -> int:
    """The fewest bands of one row that share a value with at least the chance ``recall``."""
    return 1 if similarity >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - similarity))


PIECE = 8192  # shingles hashed at once


class Group:
    """Templates of like length, their windows, and their MinHash values."""

    def __init__(self, templates: list[tuple[str, list[bytes]]], scanner: "Scanner"):
        self.stride = max(2 * max(len(w) for _, w in templates), SHINGLE + 1) // 2
        self.window = 3 * self.stride
        self.ids = [name for name, _ in templates]
        self.sizes = [len(w) for _, w in templates]
        shingles = [scanner.shingles(w) for _, w in templates]
        self.sets = [set(map(int, s)) for s in shingles]
        held = [(math.ceil(CONTAINMENT * len(s)), len(s)) for s in self.sets]
        self.bands = bands_for(min(c / (self.window + m - c) for c, m in held))
        low = np.stack([scanner.minhash(s, self.bands).min(axis=1) for s in shingles])
        self.values = np.unique(low)
        # The band and the templates of each value of the table.
        self.owners: list[list[tuple[int, int]]] = [[] for _ in self.values]
        for t, row in enumerate(np.searchsorted(self.values, low).tolist()):
            for band, at in enumerate(row):
                self.owners[at].append((band, t))

        # Most values are told from those of the table by their last bits alone.
        self.last = np.uint64((1 << (64 * len(self.values)).bit_length()) - 1)
        self.maybe = np.zeros(int(self.last) + 1, bool)
        self.maybe[(self.values & self.last).astype(np.int64)] = True

    def retrieved(self, lows: np.ndarray) -> set[tuple[int, int]]:
        """``(window, template)`` that share a band's value; ``lows`` is bands x windows."""
        bands, windows = np.nonzero(self.maybe[(lows & self.last).view(np.int64)])
        found = lows[bands, windows]
        at = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        same = np.flatnonzero(self.values[at] == found).tolist()
        return {(int(windows[i]), t) for i in same for own, t in self.owners[at[i]] if own == bands[i]}


class Scanner:
    """Finds templates in word sequences; the template set is small and travels with it."""

    MEMORY = 500_000

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        rng = np.random.default_rng(77)
        self.multiply = rng.integers(1, 1 << 62, 512, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 62, 512, np.uint64)
        self.mix = rng.integers(1, 1 << 62, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
        self.known: dict[bytes, int] = {}
        split = sorted(((n, alnum_words(t.encode())) for n, t in templates.items()), key=lambda x: (len(x[1]), x[0]))
        parts: list[list] = []
        for item in (x for x in split if x[1]):
            if parts and len(item[1]) <= GROWTH * len(parts[-1][0][1]):
                parts[-1].append(item)
            else:
                parts.append([item])
        self.groups = [Group(p, self) for p in parts]

    def shingles(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.MEMORY:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(words))
        out = np.zeros(len(words) - n + 1, np.uint64)
        for i in range(n):
            out = (out ^ (out >> np.uint64(31))) * self.mix[i] + h[i : len(h) - n + 1 + i]
        return out ^ (out >> np.uint64(33))

    def minhash(self, shingles: np.ndarray, bands: int) -> np.ndarray:
        return self.multiply[:bands, None] * shingles + self.add[:bands, None]

    @staticmethod
    def containment(g: Group, t: int, shingles: np.ndarray, start: int) -> float:
        """The share of a template's shingles in the window at ``start``, widened."""
        around = shingles[max(0, start - g.stride) : start + g.window + g.stride]
        return len(g.sets[t].intersection(around.tolist())) / len(g.sets[t])

    def scan(self, words: list[bytes]) -> dict[str, tuple[float, int]]:
        """The containment of each license found, and the word at which its best window begins."""
        found: dict[str, tuple[float, int]] = {}
        if not words or not self.groups:
            return found
        shingles = self.shingles(words)
        most = max(g.bands for g in self.groups)
        hashed = [self.minhash(shingles[a : a + PIECE], most) for a in range(0, len(shingles), PIECE)]
        for g in self.groups:
            step = g.stride
            starts = np.arange(0, len(shingles), step)
            if len(hashed) == 1:
                blocks = np.minimum.reduceat(hashed[0][: g.bands], starts, axis=1)
            else:
                blocks = np.full((g.bands, len(starts)), np.iinfo(np.uint64).max, np.uint64)
                for i, part in enumerate(hashed):
                    first = i * PIECE
                    at = np.unique(np.concatenate([[0], starts[(starts >= first) & (starts < first + part.shape[1])] - first])).astype(int)
                    to = (at + first) // step
                    blocks[:, to] = np.minimum(blocks[:, to], np.minimum.reduceat(part[: g.bands], at, axis=1))
            lows = blocks
            for _ in range(2):
                lows = np.minimum(lows, np.hstack([lows[:, 1:], lows[:, -1:]]))
            for w, t in sorted(g.retrieved(lows)):
                share, name = self.containment(g, t, shingles, int(starts[w])), g.ids[t]
                if share >= CONTAINMENT and share > found.get(name, (0.0, 0))[0]:
                    found[name] = share, int(starts[w])
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: ``n_words``, and ``licenses`` with containment and place."""
    docs = docs.select(*carry, "text")
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("word", pa.int64())]))
        for batch in cut(batches):
            sizes, out = [], []
            for text in batch["text"].to_pylist():
                words = alnum_words(text)
                sizes.append(len(words))
                out.append([{"license": n, "containment": c, "word": a} for n, (c, a) in sorted(scanner.scan(words).items())])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(sizes, pa.int64()), pa.array(out, kind)], [*carry, "n_words", "licenses"])

    return as_bytes(docs, *carry).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), "n_words long", "licenses array<struct<license:string,containment:double,word:long>>"]))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", "n_words", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.license", ",").alias("licenses"),
        F.coalesce(F.array_max("licenses.containment"), F.lit(0.0)).alias("best_containment"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
