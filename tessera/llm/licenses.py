"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts become lower-case words (letters and digits). Each license template (notices and whole short licenses) has shingles of three
words and a size, its own word count rounded up to one of ``SIZES``; windows of one and a half sizes start every half size, so each
occurrence lies whole in some window. A window whose words hold at least ``CONTAINMENT`` of a template has Jaccard similarity of at least
c / (w + m - c) with it (m and w shingles in template and window, c = CONTAINMENT * m), and there are enough bands of ``ROWS`` minima
that it is retrieved with probability ``RECALL`` or more. Retrieved windows are then judged by the exact share of the template's
shingles that they hold.

Before windows are cut, texts that hold none of the templates' key words are passed over, and for each size windows without key words
of its own templates: the key words of a template touch so many of its shingles that no text without them can reach
``CONTAINMENT`` (no loss). DataFrame operations only. The templates are a fixed list, so their bands are broadcast (some hundred rows
each). Null and empty texts match nothing. Rows of an equal or null ``doc_id`` are scanned one by one and reported apart where their
texts differ; a hot source only adds rows in proportion.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.scratch import materialize

SHINGLE, CONTAINMENT, RECALL, ROWS = 3, 0.8, 0.999, 2
# Public license notices and texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction"
    ),
    "mit-mention": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-international": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved",
    "all-rights-reserved-book": "All rights reserved. No part of this publication may be reproduced",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "bsd-2-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        'that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this "
        "software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution."
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
        "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
        "by any means."
    ),
    "gpl-notice-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
        "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
}
SIZES = (3, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def key_words(words: list[str]) -> set[str]:
    """Words that touch more than 1 - CONTAINMENT of the distinct shingles: without them the template cannot match."""
    shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    left, out = set(shingles), set()
    for word in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(left) < CONTAINMENT * len(shingles):
            break
        out.add(word)
        left = {s for s in left if word not in s}
    return out


def bands_needed(similarity: float, rows: int) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log1p(-(similarity**rows)))


def _size(words: list[str]) -> int:
    return next(s for s in SIZES if s >= len(words))


def stride(size: int) -> int:
    return max(1, size // 2)


def plan() -> dict[int, int]:
    """Window size -> bands of ``ROWS``: enough for the template least like its window."""
    out = {}
    for text in TEMPLATES.values():
        words = _words(text)
        size = _size(words)
        have = len(words) - SHINGLE + 1
        inside = CONTAINMENT * have
        similarity = inside / (size + stride(size) - SHINGLE + 1 + have - inside)
        out[size] = max(out.get(size, 0), bands_needed(similarity, ROWS))
    return out


def _shingles(words: Column) -> Column:
    spans = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))
    )
    return F.array_distinct(spans)


def _band_keys(shingles: Column, size: int, bands: int) -> Column:
    minima = F.transform(F.sequence(F.lit(0), F.lit(ROWS * bands - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))
    one = lambda m: lambda b: F.xxhash64(F.lit(size), b, *[F.get(m, b * ROWS + r) for r in range(ROWS)])
    # Bound to a lambda variable, the minima are computed once for all bands.
    return F.transform(F.array(minima), lambda m: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), one(m)))[0]


def _templates(spark: SparkSession, size: int) -> DataFrame:
    """(license, template) of one size: its distinct shingles."""
    rows = [(name, words) for name, text in TEMPLATES.items() for words in [_words(text)] if _size(words) == size]
    return spark.createDataFrame(rows, "license string, words array<string>").select("license", _shingles(F.col("words")).alias("template"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, containment, n_windows): the licenses each document holds, by the best window."""
    spark = docs.sparkSession
    keys: dict[int, set[str]] = {}
    for text in TEMPLATES.values():
        keys.setdefault(_size(_words(text)), set()).update(key_words(_words(text)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    gate = None
    for k in sorted(set().union(*keys.values())):
        hit = F.contains("text", F.lit(k))
        gate = hit if gate is None else gate | hit
    tokens = texts.where(gate).select("doc_id", F.xxhash64("text").alias("version"), F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    tokens = materialize(tokens, "gated")
    found = None
    for size, bands in sorted(plan().items()):
        own = F.array(*map(F.lit, sorted(keys[size])))
        starts = F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(stride(size))))
        cut = tokens.where(F.arrays_overlap("words", own)).select("doc_id", "version", "words", starts.alias("at"))
        cut = cut.select("doc_id", "version", "at", F.slice("words", F.col("at"), size + stride(size)).alias("window"))
        near = cut.where(F.arrays_overlap("window", own)).select("doc_id", "version", "at", _shingles(F.col("window")).alias("shingles"))
        keyed = near.select("doc_id", "version", "at", "shingles", F.explode_outer(_band_keys(F.col("shingles"), size, bands)).alias("band"))
        known = _templates(spark, size)
        known = known.select("license", "template", F.explode_outer(_band_keys(F.col("template"), size, bands)).alias("band"))
        hits = keyed.join(F.broadcast(known), "band").select(
            "doc_id", "version", F.struct(F.lit(size), "at").alias("at"), "license", (F.size(F.array_intersect("template", "shingles")) / F.size("template")).alias("containment")
        )
        found = hits if found is None else found.unionByName(hits)
    return (
        found.where(F.col("containment") >= CONTAINMENT)
        .groupBy("doc_id", "version", "license")
        .agg(F.max("containment").alias("containment"), F.countDistinct("at").alias("n_windows"))
        .drop("version")
    )
