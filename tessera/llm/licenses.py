"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

Every line of every file is compared with the templates; a file's header is its best line of a cosine of at least
``LINE``. A file is a licence file if its name is one of ``NAMES`` or its whole text's cosine is at least ``WHOLE``. A
file that is neither takes the licence of the nearest ancestor directory that holds a licence file; of several there,
the best cosine, ties to the smaller licence id; a whole text's match counts before its best line's. Terms are words of letters and digits, hashed; a term's weight is
1 + log(n / df) over all lines of all files, counted in an array of fixed size, times its number in the line.

Cosines need only the terms that a template has, and a line's norm. Directories are joined as a small table of distinct
directories with their ancestors: rows of files join once, at the end.

Edge cases: a null or empty text has no header and is no licence file by its text; a null path is a file of no
directory; repeated paths are files of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import array_sum
from .common import hot_keys, load, salted_join, thrifty, written
from .shingles import _LOWER, CHUNK, U, byte_chunks, runs, span_hashes

# Licence templates: the notices by which the licences are named in headers, and the texts, or the first paragraphs of
# the texts, of licence files (fixed values).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("isc", "Released under the ISC License"),
    ("bsd-2-clause", "Released under the BSD 2-Clause License"),
    ("bsd-3-clause", "Released under the BSD 3-Clause License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "Released under CC0 1.0 Universal"),
    ("epl-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
    (
        "mit",
        """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
        NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd-2-clause",
        """BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.""",
    ),
    (
        "bsd-3-clause",
        """BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names
        of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
        DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the software to the public domain.
        We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
        We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
        this software under copyright law.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    ),
    (
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details.""",
    ),
]
NAMES = "^(licen[cs]e|copying|notice)([.][a-z]+)?$"
LINE, WHOLE = 0.6, 0.6
BITS = 18

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


class Lines:
    """Hashed terms of each line of each text of a chunk."""

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(a, b, line of each term, its bucket, text of each line)."""
        for a, b, data, offsets in byte_chunks(texts, CHUNK):
            n = len(data)
            start, stop = runs(_WORD[data], offsets)
            bucket = (span_hashes(_LOWER[data], start, stop)[0] >> U(64 - BITS)).astype(np.int64)
            breaks = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
            breaks = breaks[breaks < max(1, n)]
            line = np.searchsorted(breaks, start, "right") - 1
            yield a, b, line, bucket, np.searchsorted(offsets, breaks, "right") - 1


def template_vectors(weight: np.ndarray, templates: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(terms x templates) weights of unit norm, and which buckets are terms (a place, or -1)."""
    (_, _, line, bucket, _), *_ = Lines().chunks(pa.array([" ".join(t.split()) for _, t in templates]))
    terms, place = np.unique(bucket, return_inverse=True)
    v = np.zeros((len(terms), len(templates)))
    np.add.at(v, (place, line), weight[bucket])
    index = np.full(1 << BITS, -1, dtype=np.int32)
    index[terms] = np.arange(len(terms))
    return v / np.linalg.norm(v, axis=0), index


def cosines(line: np.ndarray, bucket: np.ndarray, n: int, weight: np.ndarray, vectors: np.ndarray, index: np.ndarray) -> np.ndarray:
    """(n x templates): the cosine of each line's sparse vector with each template."""
    pair, times = np.unique(line * (1 << BITS) + bucket, return_counts=True)
    line, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    w = weight[bucket] * times
    norm = np.sqrt(np.bincount(line, weights=w * w, minlength=n))
    hit = index[bucket] >= 0
    dot = np.zeros((n, vectors.shape[1]))
    np.add.at(dot, line[hit], w[hit, None] * vectors[index[bucket[hit]]])
    return np.divide(dot, norm[:, None], out=np.zeros_like(dot), where=norm[:, None] > 0)


def line_weights(files: DataFrame) -> np.ndarray:
    """1 + log(n / df) of each bucket over all lines."""

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        lines, total = Lines(), None
        for batch in batches:
            total = np.zeros((1 << BITS) + 64, dtype=np.int64) if total is None else total
            for _, _, line, bucket, text in lines.chunks(batch.column(0)):
                pair = np.unique(line * (1 << BITS) + bucket)
                total[: 1 << BITS] += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
                total[1 << BITS] += len(text)
        return total

    total = array_sum(files.select("text"), (1 << BITS) + 64, fill)
    return 1 + np.log((total[1 << BITS] + 1) / (total[: 1 << BITS] + 1))


SCANNED = "id long, path string, header string, header_cosine double, whole string, whole_cosine double"


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Each file's best header line and whole-text match. files: id, path, text."""
    weight = line_weights(files)
    names = np.array([name for name, _ in templates])
    shared = files.sparkSession.sparkContext.broadcast((weight, *template_vectors(weight, templates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        for batch in batches:
            header, whole = np.full(batch.num_rows, -1), np.full(batch.num_rows, -1)
            best, most = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for a, b, line, bucket, text in lines.chunks(batch.column(2)):
                by_line = cosines(line, bucket, len(text), *shared.value)
                by_text = cosines(text[line], bucket, b - a, *shared.value)
                top = by_line.max(axis=1)
                order = np.lexsort((-top, text))  # the best line of each text comes first, the first of equals
                first = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))] if len(order) else order
                best[a + text[first]], header[a + text[first]] = top[first], by_line[first].argmax(axis=1)
                most[a:b], whole[a:b] = by_text.max(axis=1), by_text.argmax(axis=1)
            good, all_ = best >= LINE, most >= WHOLE
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[header], mask=~good), pa.array(best), pa.array(names[whole], mask=~all_), pa.array(most)], ["id", "path", "header", "header_cosine", "whole", "whole_cosine"])

    return files.select("id", "path", "text").mapInArrow(thrifty(run), SCANNED)


def directory(path: str) -> Column:
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with directory, licence and where it is from: header, directory (with the ancestor), or null."""
    own = scanned.withColumn("dir", directory("path")).withColumn("named", F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike(NAMES))
    is_file = F.col("whole").isNotNull() | (F.col("named") & F.col("header").isNotNull())
    candidate = F.struct((-F.greatest("whole_cosine", "header_cosine")).alias("less"), F.coalesce("whole", "header").alias("licence"))
    held = own.where(is_file & F.col("dir").isNotNull()).groupBy(F.col("dir").alias("ancestor")).agg(F.min(candidate)["licence"].alias("inherited"))
    dirs = written(own.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")), "directories")
    hot = hot_keys(dirs, "dir", count="n")
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("ancestor")).distinct()
    # directories below a common root are its rows here
    ups = written(ups, "ancestors")
    nearest = salted_join(ups, held, "ancestor", hot_keys(ups, "ancestor"), ["dir"]).groupBy("dir").agg(F.max_by(F.struct("ancestor", "inherited"), F.length("ancestor")).alias("near"))
    out = salted_join(own.where("dir is not null"), nearest, "dir", hot, ["id", "path"], "left")
    out = out.unionByName(own.where("dir is null"), allowMissingColumns=True)
    licence = F.coalesce("whole", "header", "near.inherited")  # a whole licence says more than its best line
    source = F.when(F.col("header").isNotNull() | F.col("whole").isNotNull(), F.lit("header")).when(F.col("near").isNotNull(), F.lit("directory"))
    return out.select("id", "path", licence.alias("licence"), source.alias("licence_from"), F.when(source == "directory", F.col("near.ancestor")).alias("ancestor"), F.round("header_cosine", 6).alias("header_cosine"), F.round("whole_cosine", 6).alias("whole_cosine"))


def license_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """files: id, path, text."""
    return inherit(written(scan(files, templates), "licences"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/document."""
    docs = load(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return license_scan(files).withColumnRenamed("id", "doc_id")
