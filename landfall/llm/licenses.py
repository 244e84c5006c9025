"""Licence scans: normalised texts compared with licence templates by the Dice coefficient of word bigrams.

The units compared are all runs of consecutive words, so a notice is found inside a line, over several lines
or as the whole text. A template can only match a run whose number of bigrams, and of bigrams that both have,
lies within the bounds that the threshold sets, which rules out most runs at once; none is left to chance.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from heapq import heappop, heappush
from itertools import islice
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEXTS

#: Units from this coefficient on match a template.
DICE = 0.8
#: Templates of up to so many bigrams are notices: a unit must have all their words with digits, which tell versions apart.
NOTICE = 100
#: Notices by which texts state their licence, and full texts. More templates can be given as a parameter.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "GPL-2.0": ["Released under the GNU General Public License v2.0.", "This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["Released under the GNU General Public License v3.0.", "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["Released under the GNU Lesser General Public License v2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Released under the GNU Lesser General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["Released under the GNU Affero General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: What the versions of the Creative Commons licences are called.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
TEMPLATES |= {
    f"CC-{short}-{version}": [f"This work is licensed under a Creative Commons {long} {version} {area} License.", f"Licensed under CC {short} {version}."]
    for short, long in COMMONS.items() for version, area in COMMONS_VERSIONS.items()
}
#: The Affero licence is the GNU GPL of version 3 by another name, but for its preamble and section 13.
AFFERO = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer "
    "all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access "
    "to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding "
    "Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph."
)
_before, _after = (re.sub(r"(?<!Affero )General Public License", "Affero General Public License", part, flags=re.I) for part in TEXTS["GPL-3.0"].split("13. Use with the GNU Affero General Public License."))
TEXTS = TEXTS | {"AGPL-3.0": _before + AFFERO + _after}
TEMPLATES = {name: [*notices, *([TEXTS[name]] if name in TEXTS else [])] for name, notices in TEMPLATES.items()}
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
COPYRIGHT = re.compile(r"^\W*(?:copyright|\(c\)|©).*$", re.I | re.M)


def bigrams(text: str) -> Counter:
    """Normalised word bigrams: case, punctuation and copyright lines make no difference. One word is a bigram with nothing."""
    words = WORD.findall(COPYRIGHT.sub(" ", text).casefold())
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2.0 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    def __init__(self, templates: Mapping[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, grams, sum(grams.values())) for name, texts in templates.items() for grams in map(bigrams, texts)]
        self.low = min((n for _, _, n in self.templates), default=0) * threshold / (2 - threshold)
        self.high = max((n for _, _, n in self.templates), default=0) * (2 - threshold) / threshold
        bound = threshold / (2 - threshold)
        self.least = [ceil(n * bound - 1e-9) for _, _, n in self.templates]
        self.widest = [floor(n / bound + 1e-9) for _, _, n in self.templates]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams, _) in enumerate(self.templates):
            for gram in grams:
                self.holders.setdefault(gram, []).append(k)
        self.single = any(not b for _, b in self.holders)
        self.versions = [{w for gram in grams for w in gram if any(map(str.isdigit, w))} if n <= NOTICE else set() for _, grams, n in self.templates]

    def _versioned(self, k: int, grams: Iterable[tuple[str, str]]) -> bool:
        return self.versions[k] <= {w for gram in grams for w in gram}

    def best(self, text: str) -> tuple[float, str] | None:
        """The best template of one unit, the first by name of equal ones."""
        if text.count(" ") + text.count("\n") < self.low - 1:  # too few words for any template, if they are spaced
            if len(text) < 2 * self.low:
                return None
        grams = bigrams(text)
        size = sum(grams.values())
        if not self.low <= size <= self.high:
            return None
        bound = self.threshold / (2 - self.threshold)
        found = [(dice(grams, g), name) for k, (name, g, n) in enumerate(self.templates) if bound * n <= size <= n / bound and self._versioned(k, grams)]
        found = [x for x in found if x[0] >= self.threshold]
        return min(found, key=lambda x: (-x[0], x[1])) if found else None

    def _best_runs(self, k: int, at: list[int], grams: list[tuple[str, str]]) -> tuple[float, list[tuple[int, int]]]:
        """The coefficient of the best runs of words for a template, and first and last bigram of such runs that do not overlap.

        Only bigrams of the template are given: a best run begins and ends with one. Beginnings are taken
        by what the widest run from there has of the template, until that cannot beat the best.
        """
        _, need, n = self.templates[k]
        versions = self.versions[k]
        if not self._versioned(k, grams):
            return self.threshold, []
        least, widest = self.least[k], self.widest[k]
        begins: list[tuple[int, int]] = []
        have = dict.fromkeys(need, 0)
        common = end = 0
        for a, first in enumerate(at):
            while end < len(at) and at[end] < first + widest:
                have[grams[end]] += 1
                common += have[grams[end]] <= need[grams[end]]
                end += 1
            if common >= least:
                begins.append((-common, a))
            common -= have[grams[a]] <= need[grams[a]]
            have[grams[a]] -= 1
        begins.sort()
        best, runs = self.threshold, []
        for most, a in begins:
            if 2.0 * -most / (n - most) < best:
                break
            if runs and at[a] <= runs[-1][1] and 2.0 * -most / (n - most) <= best:
                continue
            have, common, lacking = {}, 0, set(versions)
            for b in range(a, len(at)):
                size = at[b] - at[a] + 1
                if size > widest:
                    break
                have[grams[b]] = seen = have.get(grams[b], 0) + 1
                common += seen <= need[grams[b]]
                if lacking:
                    lacking.difference_update(grams[b])
                if not lacking and common >= least and (score := 2.0 * common / (size + n)) >= best:
                    if score > best:
                        best, runs = score, [(at[a], at[b])]
                    elif not runs or at[a] > runs[-1][1]:
                        runs.append((at[a], at[b]))
        return best, runs

    def _runs(self, text: str) -> Iterator[tuple[str, float, int]]:
        """License, coefficient and line (0: all words) of each licence's best run of the text's words, best first.

        Words count for one licence: a run that overlaps a better one is none, and its template is compared
        with what the better ones leave.
        """
        words = WORD.findall(text)
        holders = self.holders
        hits = [(i, g) for i, g in enumerate(zip(words, words[1:])) if g in holders]
        if self.single:
            hits += [(i, g) for i, g in enumerate((w, "") for w in words) if g in holders]
        at: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for hit in hits:
            for k in holders[hit[1]]:
                at.setdefault(k, []).append(hit)
        begins, ends = [], []  # words of the runs taken, in order
        queue: list[tuple] = []
        named: set[str] = set()

        def search(k: int, part: list[tuple[int, tuple[str, str]]]) -> None:
            """Queue the best runs of each piece that no taken run and no gap too wide for a match parts."""
            gap = self.widest[k] - self.least[k] + 1
            piece: list[tuple[int, tuple[str, str]]] = []
            before = None
            for hit in [*part, None]:
                if hit:
                    reach = hit[0] + bool(hit[1][1])
                    side = bisect_right(begins, reach)
                    if side and ends[side - 1] >= hit[0]:
                        continue
                if piece and (not hit or side != before or hit[0] - piece[-1][0] > gap):
                    if len(piece) >= self.least[k]:
                        score, runs = self._best_runs(k, [i for i, _ in piece], [g for _, g in piece])
                        if runs:
                            heappush(queue, (-score, self.templates[k][0], runs[0][0], k, runs, piece))
                    piece = []
                if hit:
                    piece.append(hit)
                    before = side

        for k, part in at.items():
            if len(part) >= self.least[k]:
                search(k, part)
        while queue:
            score, name, _, k, runs, piece = heappop(queue)
            wide = bool(piece[0][1][1])
            for first, last in runs:
                side = bisect_right(begins, last + wide)
                if side and ends[side - 1] >= first:
                    continue
                begins.insert(side, first)
                ends.insert(side, last + wide)
                if name in named:
                    continue
                named.add(name)
                whole = first == 0 and last + wide == len(words) - 1
                yield name, -score, 0 if whole else text.count("\n", 0, next(islice(WORD.finditer(text), first, None)).start()) + 1
            search(k, piece)

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """License, coefficient and first line (0: the whole text) of the best match of each licence.

        Lines that look like a copyright are left out, and once more kept, as a notice can wrap to such a
        line or stand on it.
        """
        if not text:
            return []
        bare = COPYRIGHT.sub(lambda m: " " + "\n" * m[0].count("\n"), text)
        hits: dict[str, tuple[float, int]] = {}
        for variant in [bare] if bare == text else [bare, text]:
            for name, score, at in self._runs(variant.casefold()):
                if name not in hits or (-score, at) < (-hits[name][0], hits[name][1]):
                    hits[name] = (score, at)
        return [(name, score, at) for name, (score, at) in sorted(hits.items())]


def license_scan(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, threshold: float = DICE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license (best match or null), dice (double, 0 without one), line (bigint) and n_licenses for every row.

    All runs of words are scanned, in texts of any length; line is where the best one begins, 0 if it is
    the whole text. Null and empty texts match nothing; ties go to the name that comes first; rows stand
    for themselves, whatever their key; an empty table gives no rows; other columns are not read.
    """
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    chosen = {k: list(v) for k, v in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                hits = scanner.scan(value)
                top = min(hits, key=lambda x: (-x[1], x[0])) if hits else (None, 0.0, None)
                rows.append((*top, len(hits)))
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.record_batch([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["doc_id", "license", "dice", "line", "n_licenses"])

    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, license string, dice double, line bigint, n_licenses bigint")
