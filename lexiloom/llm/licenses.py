"""License scans: templates retrieved by MinHash bands, verified by containment.

A text's words (lower-cased, letters and digits) form shingles of ``SHINGLE``
words. For each length s of a template the text is read in windows of a little
over 2s shingles that start every s/4, so whatever lies within 2s shingles, with
words inserted or not, lies whole in some window. A window and a template meet
if one of ``BANDS`` bands of ``ROWS`` MinHash values agree. A window that holds
0.8 of a template has a Jaccard similarity of at least 0.29 to it, so the chance
that no band agrees is at most (1 - 0.29 ** ROWS) ** BANDS = 1.3e-5. Only windows
that hold some template's shingle can agree with one in any band, so others are
not hashed. The match is then the exact containment of the template's shingles
in the window.

Licenses of one family share most of their words. Of matches that overlap, the
one with the most shingles in the text, then the higher containment, names the
license; the others say in ``beaten_by`` which template that is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS, CONTAINED = 5, 128, 2, 0.8
#: Shingles that are hashed at once.
PIECE = 8192
WORD = re.compile(r"[^\W_]+")
#: License notices, public texts, by SPDX id. At most MOST of them are broadcast.
MOST = 4096
BSD_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = BSD_FORMS + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
FREE = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. "
#: How whole license texts begin, title first.
OPENINGS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + FREE + "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it.",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + FREE + "Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.",
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. " + FREE + "Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + FREE + "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions.",
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + FREE + "Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor's Contribution.",
}
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "BSD-2-Clause OR BSD-3-Clause": [BSD_FORMS],
    "BSD-2-Clause": [BSD_TWO + BSD_END],
    "BSD-3-Clause": [BSD_TWO + BSD_THIRD + BSD_END],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}

TEMPLATES = {spdx: [*own, *([OPENINGS[spdx]] if spdx in OPENINGS else [])] for spdx, own in TEMPLATES.items()}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Ids(dict):
    """A 64-bit hash per word, computed once a worker."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11)
        return h


WORD_HASH = _Ids()


def shingle_hashes(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """A hash per k-word shingle; fewer words: one of them all; none: empty."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    x = np.fromiter(map(WORD_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h ^ x[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a, b = (rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
    return (a | np.uint64(1))[:, None], b[:, None]


def minima(shingles: np.ndarray, step: int) -> np.ndarray:
    """(BANDS * ROWS, blocks): the MinHash values of each block of ``step`` shingles; those of a union are the least of its blocks'."""
    a, b = _coefficients()
    mixed = (shingles[None, :] ^ b) * a
    mixed ^= mixed >> np.uint64(31)
    return np.minimum.reduceat(mixed, np.arange(0, len(shingles), step), axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(BANDS, columns): a hash of each band's number and its ROWS MinHash values."""
    rows = low.reshape(BANDS, ROWS, -1)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[:, None], rows[:, 0].shape)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def window_shape(size: int) -> tuple[int, int]:
    """(step, blocks) of the windows for templates of ``size`` shingles: ``blocks`` blocks of ``step`` shingles hold any 2 * size in a row."""
    step = max(1, size // 4)
    return step, -(-2 * size // step) + 1


class Library:
    """Templates with their shingles and, for each length, band keys in order."""

    def __init__(self, templates: dict[str, list[str]]):
        listed = [(spdx, i, t) for spdx, own in templates.items() for i, t in enumerate(own)]
        if len(listed) > MOST:
            raise ValueError(f"at most {MOST} templates are broadcast")
        self.licenses = [spdx for spdx, _, _ in listed]
        self.names = [f"{spdx}#{i}" for spdx, i, _ in listed]
        self.shingles = [np.unique(shingle_hashes(words_of(t))) for _, _, t in listed]
        self.every = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *self.shingles]))
        sizes: dict[int, list[int]] = {}
        for n, s in enumerate(self.shingles):
            if s.size:
                sizes.setdefault(int(s.size), []).append(n)
        self.bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, own in sizes.items():
            keys = np.concatenate([band_keys(minima(self.shingles[n], size))[:, 0] for n in own])
            order = np.argsort(keys, kind="stable")
            self.bands[size] = keys[order], np.repeat(own, BANDS)[order]

    def _met(self, h: np.ndarray, anchors: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
        """(first shingle, end, template) of the windows that agree with a template of ``size`` shingles in a band."""
        (step, blocks), (keys, own) = window_shape(size), self.bands[size]
        windows = np.unique(np.maximum(0, np.unique(anchors // step)[:, None] - np.arange(blocks)))
        far = np.r_[False, np.diff(windows) > blocks]
        piece = windows * step // PIECE
        for some in np.split(windows, np.flatnonzero(far | np.r_[False, np.diff(piece) > 0])):
            low = minima(h[some[0] * step : (some[-1] + blocks) * step], step)
            most = np.full((len(low), some[-1] - some[0] + blocks - low.shape[1]), np.iinfo(np.uint64).max, dtype=np.uint64)
            least = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, most], axis=1), blocks, axis=1).min(axis=2)
            asked = band_keys(least[:, some - some[0]])
            left, right = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
            band, column = np.nonzero(right > left)
            pairs = {(int(some[c]), int(n)) for i, c in zip(band, column, strict=True) for n in own[left[i, c] : right[i, c]]}
            yield from ((w * step, (w + blocks) * step, n) for w, n in sorted(pairs))

    def scan(self, text: str) -> list[tuple[str, float, int, int, str | None]]:
        """(template, containment, first word, words, beaten by) of the best window of each template that the text contains."""
        h = shingle_hashes(words_of(text))
        if not h.size or not self.every.size:
            return []
        at = np.minimum(np.searchsorted(self.every, h), self.every.size - 1)
        anchors = np.flatnonzero(self.every[at] == h)
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.bands if anchors.size else ():
            for first, end, n in self._met(h, anchors, size):
                c = float(np.isin(self.shingles[n], h[first:end]).mean())
                if c >= CONTAINED and c > best.get(n, (0.0,))[0]:
                    hit = np.flatnonzero(np.isin(h[first:end], self.shingles[n]))
                    best[n] = (c, first + int(hit[0]), int(hit[-1] - hit[0]) + SHINGLE)
        return [(self.names[n], *best[n], self._beaten_by(n, best)) for n in sorted(best)]

    def _beaten_by(self, n: int, best: dict[int, tuple[float, int, int]]) -> str | None:
        """The template of another license that overlaps the match of ``n`` with more of its shingles found; on equal numbers, with more of the template."""
        rank = lambda m: (round(best[m][0] * self.shingles[m].size), best[m][0])
        _, first, length = best[n]
        over = [m for m, (_, at, k) in best.items() if self.licenses[m] != self.licenses[n] and at < first + length and first < at + k and rank(m) > rank(n)]
        return self.names[max(over, key=lambda m: (rank(m), -m))] if over else None


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, template, containment, first_word, span_words, beaten_by): a row per text and template it contains.

    Containment: the largest share of the template's distinct shingles in a
    window, 0.8 or more. ``beaten_by``: null, or the template of another license
    that fits the same place better. Null, empty and wordless texts have no match.
    Repeated rows match each; ties between windows go to the first. Whole texts
    are scanned, in bounded pieces; extra columns are ignored; an empty table
    gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)
    made: list[Library] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Library(held.value))
        for batch in batches:
            out = [(i, *m) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for m in made[0].scan(t.as_py())]
            ids, names, share, first, n, beaten = zip(*out, strict=True) if out else ((), (), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.rpartition("#")[0] for x in names], pa.string()), pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(beaten, pa.string())], names=["id", "license", "template", "containment", "first_word", "span_words", "beaten_by"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, license string, template string, containment double, first_word long, span_words long, beaten_by string")
