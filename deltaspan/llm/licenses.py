"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text and templates are lower-cased runs of letters, digits and underscores; a bigram is two neighbours, and bigrams
count as often as they occur. The Dice coefficient of a window of the text and a template is twice the size of their
common multiset by the sum of their sizes. Every window of the whole text counts, so that a notice inside a longer
document is found. Overlaps are settled over all windows with 0.8 or more, the best first: one that meets a better
window of another licence, such as another version of it, is dropped, unless that one was dropped itself. Of what is
left the best window of each document and licence is reported. A window of a bigrams
can reach t against a template of b only if b t / (2 - t) <= a <= b (2 - t) / t: that bounds the windows, and drops
templates for which the text has too few bigrams, or too few in common.

Nulls: a null text holds no licence. Repeated rows give rows each, an empty table an empty result; ties go to the
earliest and then the shortest window. Very long texts are read in full. Other columns don't matter.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, windows, words

DICE = 0.8

#: Texts of notices and licences, a fixed table; each has a name and one or more texts.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def _bigrams(text: str) -> np.ndarray:
    w = words(pa.array([text], type=pa.string()))
    return windows(w.hash, w.at, 2)[0]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], dice: float = DICE) -> None:
        self.dice = dice
        self.names = [(name, Counter(_bigrams(text).tolist())) for name, texts in templates.items() for text in texts]
        self.names = [(name, c) for name, c in self.names if c]
        self.known = np.unique(np.array([x for _, c in self.names for x in c], dtype=np.uint64))
        self.member = [np.isin(self.known, np.array(list(c), dtype=np.uint64)) for _, c in self.names]
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.known & np.uint64((1 << 20) - 1)] = True

    def found(self, template: int, gram: np.ndarray, place: np.ndarray) -> list[tuple[float, int, int]]:
        """Dice, start and bigrams of the windows that reach it; windows begin and end at the template's own bigrams."""
        _, want = self.names[template]
        b, t = sum(want.values()), self.dice
        longest, need = int(b * (2 - t) / t + 1e-9), b * t / (2 - t) - 1e-9
        near = np.searchsorted(place, place + longest)
        found: list[tuple[float, int, int]] = []
        for i in np.flatnonzero(near - np.arange(len(place)) >= need).tolist():
            seen: Counter[int] = Counter()
            common = 0
            for j in range(i, int(near[i])):
                x = int(gram[j])
                if seen[x] < want[x]:
                    common += 1
                seen[x] += 1
                size = int(place[j] - place[i]) + 1
                score = 2 * common / (size + b)
                if score >= t - 1e-12:
                    found.append((score, int(place[i]), size))
        return found

    @staticmethod
    def settle(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
        """The best window of each licence that meets no better one of another, by name."""
        order = sorted(found, key=lambda x: (-x[1], x[2], x[3], x[0]))
        best: dict[str, tuple[str, float, int, int]] = {}
        if len({x[0] for x in order}) < 2:
            return order[:1]
        # windows that stay, by start; other windows of the same notice would stand in the way of its neighbours
        stay: list[tuple[int, int, float, str]] = []
        longest = max(x[3] for x in order)
        for x in order:
            name, score, start, size = x
            near = stay[bisect.bisect_left(stay, (start - longest,)) : bisect.bisect_left(stay, (start + size + 1,))]
            if not any(begin + n >= start and (other == name or more > score) for begin, n, more, other in near):
                bisect.insort(stay, (start, size, score, name))
                best.setdefault(name, x)
        return sorted(best.values())

    def scan(self, texts: pa.Array) -> list[list[tuple[str, float, int, int]]]:
        out: list[list[tuple[str, float, int, int]]] = []
        for a, b in chunks(texts):
            w = words(texts.slice(a, b - a))
            gram, place = windows(w.hash, w.at, 2)
            hit = np.flatnonzero(self.bitmap[gram & np.uint64((1 << 20) - 1)])
            spot = np.searchsorted(self.known, gram[hit])
            good = self.known[np.minimum(spot, len(self.known) - 1)] == gram[hit] if len(self.known) else np.zeros(0, dtype=bool)
            hit, spot = hit[good], spot[good]
            row = np.searchsorted(w.at, place[hit], side="right") - 1
            ends = np.searchsorted(row, np.arange(b - a + 1))
            size = np.maximum(np.diff(w.at) - 1, 0)
            # how many bigrams of each template a text has
            part: list[list[tuple[str, float, int, int]]] = [[] for _ in range(b - a)]
            for k, (name, want) in enumerate(self.names):
                own = self.member[k][spot]
                least = sum(want.values()) * self.dice / (2 - self.dice) - 1e-9
                count = np.bincount(row[own], minlength=b - a)
                for r in np.flatnonzero((count >= least) & (size >= least)).tolist():
                    i = np.arange(ends[r], ends[r + 1])[own[ends[r] : ends[r + 1]]]
                    part[r] += [(name, *x) for x in self.found(k, gram[hit[i]], place[hit[i]] - w.at[r])]
            out += [self.settle(x) for x in part]
        return out


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, license, dice, start_word and n_words of the best window, for each document and licence found."""
    texts_of = TEMPLATES if templates is None else templates
    made: list[Scanner] = []
    kind = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64())])

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(texts_of, dice))
        return pa.array([[{"license": n, "dice": d, "start_word": s, "n_words": k + 1} for n, d, s, k in own] for own in made[0].scan(texts)], type=pa.list_(kind))

    find = F.arrow_udf(run, "array<struct<license:string,dice:double,start_word:bigint,n_words:bigint>>").asNondeterministic()
    return docs.select("doc_id", F.explode(find(F.col("text"))).alias("f")).select("doc_id", "f.license", F.round("f.dice", 6).alias("dice"), "f.start_word", "f.n_words")
