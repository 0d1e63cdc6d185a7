"""License scan by diagonal voting.

All rolling word k-grams of all texts are hashed and joined with the places of
the same k-grams in a small, fixed set of templates (its size is the source
text below, so it may be broadcast). A hit at word p of a text and word t of a
template votes for the diagonal p - t; votes are counted by text, template and
diagonal, neighbouring diagonals (a word put in or left out) are merged, and a
merged span is verified: a second hash of every k-gram, over hashes of its
words that are made from the bytes by another base, must agree, and the
template words that it covers must reach a share of the template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty
from .flat import BASE, blocks, mix, per_text, prefix, runs, span_hash

K = 3
#: Diagonals at most so far apart are one span.
NEIGHBOURS = 3
#: Share of a template's words that a span must cover: short templates (under LONG words) and long ones.
SHORT_SHARE, LONG_SHARE, LONG = 0.9, 0.6, 20
_U = np.uint64
#: Base of the second word hash; a row of the input is known by two 64-bit hashes of id and text.
OTHER_BASE, KEY = 0xC2B2AE3D27D4EB4F, ["key", "twin"]

#: Phrases whose every place is counted, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Wordings of public licenses and of their usual notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Released under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "distributed under the terms of the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License version 3, 29 June 2007"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gnu-gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gnu-gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gnu-gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/"),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = 1
    return t


LOWER, WORD = _lower_table(), _word_bytes()


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _words(buf: np.ndarray, off: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the bounds of each text's."""
    low = LOWER[buf]
    start, end, _ = runs(WORD[low], off)
    return span_hash(prefix(low, base), start, end, base), per_text(start, off)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hash of the k words from each word on (the last k - 1 have none)."""
    n = max(0, len(h) - K + 1)
    out = np.full(n, K, np.uint64)
    for i in range(K):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def _hash_words(words: list[str], base: int = BASE) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    _, _, buf, off = next(blocks(pa.array([" ".join(words)]), 1 << 30))
    return _words(buf, off, base)[0]


def _gram_rows(docs: DataFrame) -> DataFrame:
    """(key, twin, first, second): the two hashes of every k-gram of a text, in order."""
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(batch.column(2)):
                h, bounds = _words(buf, off)
                other, _ = _words(buf, off, OTHER_BASE)
                size = np.maximum(np.diff(bounds) - K + 1, 0)
                at = np.repeat(bounds[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                to = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
                cols = [pa.ListArray.from_arrays(to, pa.array(_grams(x)[at].view(np.int64))) for x in (h, other)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(2)), *cols], schema=pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("first", kind), ("second", kind)]))

    return map_arrow(docs.select(*KEY, "text"), run, "key bigint, twin bigint, first array<bigint>, second array<bigint>")


def _base(docs: DataFrame) -> DataFrame:
    """Word counts and the places of the fixed phrases."""
    phrases = [(_hash_words(words_of(p)), label) for p, label in PHRASES]
    names = sorted(label for _, label in phrases)
    schema = pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, off in blocks(batch.column(3)):
                h, bounds = _words(buf, off)
                n = j - i
                total, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                has = np.zeros((n, len(names)), bool)
                for want, label in phrases:
                    m = len(h) - len(want) + 1
                    if m <= 0:
                        continue
                    hit = np.ones(m, bool)
                    for k, x in enumerate(want):
                        hit &= h[k : k + m] == x
                    at = np.flatnonzero(hit)
                    doc = np.searchsorted(bounds, at, "right") - 1
                    inside = at + len(want) <= bounds[doc + 1]
                    at, doc = at[inside], doc[inside]
                    np.add.at(total, doc, 1)
                    np.minimum.at(first, doc, at - bounds[doc])
                    np.maximum.at(last, doc, at - bounds[doc])
                    has[doc, names.index(label)] = True
                none = total == 0
                labels = [",".join(x for x, y in zip(names, row, strict=True) if y) for row in has.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, n) for k in range(3)), pa.array(np.diff(bounds)), pa.array(total), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(labels)], schema=schema
                )

    return map_arrow(docs.select(*KEY, "doc_id", "text"), run, "key bigint, twin bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string")


def _template_rows() -> tuple[list[tuple], list[tuple]]:
    grams, sizes = [], []
    for i, (label, text) in enumerate(TEMPLATES):
        h, other = (_hash_words(words_of(text), base) for base in (BASE, OTHER_BASE))
        sizes.append((i, label, len(h), float(LONG_SHARE if len(h) >= LONG else SHORT_SHARE)))
        grams += [(i, t, int(a), int(b)) for t, (a, b) in enumerate(zip(_grams(h).view(np.int64), _grams(other).view(np.int64), strict=True))]
    return grams, sizes


def _keyed(docs: DataFrame) -> DataFrame:
    out = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    return out.withColumns({"key": F.xxhash64("doc_id", "text"), "twin": F.xxhash64(F.lit(1), "doc_id", "text")})


def spans(docs: DataFrame) -> DataFrame:
    """Verified license spans: doc_id, label, first_word, last_word (the span's words), share (of the template that it covers).

    Rows of one doc_id and one text give their spans once; a null doc_id counts as an id.
    """
    keyed = _keyed(docs)
    return _spans(keyed).join(keyed.select("doc_id", *KEY).dropDuplicates(KEY), KEY).select("doc_id", "label", "first_word", "last_word", "share")


def _spans(docs: DataFrame) -> DataFrame:
    """The same by key and twin in place of doc_id."""
    spark = docs.sparkSession
    grams, sizes = _template_rows()
    templates = spark.createDataFrame(grams, "template int, t int, first bigint, check bigint")
    about = spark.createDataFrame(sizes, "template int, label string, size int, least double")
    rows = _gram_rows(docs)
    hits = (
        rows.select(*KEY, F.posexplode(F.arrays_zip("first", "second")).alias("p", "g"))
        .select(*KEY, "p", F.col("g.first").alias("first"), F.col("g.second").alias("second"))
        .join(F.broadcast(templates), "first")
        .where("second = check")
    )
    votes = hits.groupBy(*KEY, "template", (F.col("p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"), F.min("p").alias("p0"), F.max("p").alias("p1"))
    w = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    near = (
        votes.withColumn("far", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > NEIGHBOURS).cast("int"), F.lit(1)))
        .withColumn("span", F.sum("far").over(w))
        .groupBy(*KEY, "template", "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("p0").alias("first_word"), (F.max("p1") + K - 1).alias("last_word"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + F.lit(K - 1))))))
    return near.join(F.broadcast(about), "template").withColumn("share", covered / F.col("size")).where("share >= least").select(*KEY, "label", "first_word", "last_word", "share")


def scan(docs: DataFrame) -> DataFrame:
    """License labels of documents (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (the largest covered share of a template; 1 where a base
    phrase stands) and n_spans. A null text is empty: no words, empty labels,
    score 0. Each row has the labels of its own text, also where rows share a
    doc_id or have none; repeated rows each give a row. Texts of any length
    are worked whole. An empty table gives no rows; other columns are not read.
    """
    docs = _keyed(docs)
    found = _spans(docs).groupBy(*KEY).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"), F.count("*").alias("spans"))
    base = _base(docs)
    own = F.when(F.col("base_labels") != "", F.split("base_labels", ",")).otherwise(F.array().cast("array<string>"))
    both = F.array_join(F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>")))), ",")
    return base.join(found, KEY, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", both.alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("spans", F.lit(0)).cast("bigint").alias("n_spans"),
    )
