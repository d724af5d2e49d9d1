"""License scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A template is a bag of words: an SPDX tag, a notice, a header block, or a whole licence. It is compared with windows of as many words, wherever lines end: they
begin every eighth of their length, and the last one ends with the text; a shorter text is one window. Vectors live in the vocabulary of
the templates; any other word of a window has the weight of a word that no document has, and a dimension of its own. Document frequencies are counted over all documents.

A window cannot reach the threshold unless the template's vector, cut down to the words that the window has, is as long as that. Sums of squared weights over a text's
words say so in advance, so that only a few windows are compared; the filter is exact.

A document's own licence is that of the window with the highest product of cosine and logarithm of its words (plus one): whole blocks tell versions
and clauses apart, and count more than a phrase in them. A file is a licence file if its name says so, or if half of its words belong to matching windows;
its licence holds for its directory. Documents without a licence of their own take that of the nearest ancestor directory, by joins on paths.

Scale: texts are read twice and never shuffled; document frequencies are a vector of the templates' vocabulary; the joins move paths only.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.llm._frames import Tokens, checkpointed, quoted, text_chunks, token_hash, with_fields
from callweave.session import importable

THRESHOLD = 0.6
#: A tag names one licence or another by one word.
EXACT = 0.95

_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}"
_GNU_LICENCES = (("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"))
_TAGS = (
    ("Apache-2.0", "Apache-2.0"), ("MIT", "MIT"), ("GPL-2.0", "GPL-2.0"), ("GPL-3.0", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3.0"), ("AGPL-3.0", "AGPL-3.0"), ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"),
    ("MPL-2.0", "MPL-2.0"), ("ISC", "ISC"), ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("EPL-2.0", "EPL-2.0"), ("BSL-1.0", "BSL-1.0"), ("Zlib", "Zlib"),
)

#: (licence, a notice as it stands in headers or at the top of licence files).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    *((name, _GNU.format(thing, title, version)) for name, thing, title, version in _GNU_LICENCES),
    *((name, f"This work is licensed under the GNU {title}, version {version}") for name, _, title, version in _GNU_LICENCES),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC0-1.0", "CC0 1.0 Universal, dedicated to the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("LicenseRef-Proprietary", "All rights reserved"),
)


_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_BREAK = np.ones(0x110000, dtype=bool)
_BREAK[0x80:] = False
_BREAK[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = False
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([._-][^/]*)?$"




def bag(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        counts[w] = counts.get(w, 0) + 1
    return counts


def default_templates() -> list[tuple[str, dict[str, int], float]]:
    """(licence, counts of words, threshold): tags, notices, and whole licences, whose counts of words are in licence_terms.json."""
    whole = json.loads(Path(__file__).with_name("licence_terms.json").read_text())
    counted = ((name, {w: int(n or 1) for w, _, n in (t.partition(":") for t in terms.split())}) for name, terms in whole.items())
    tags = ((name, bag(f"SPDX-License-Identifier: {tag}"), EXACT) for name, tag in _TAGS)
    return [*tags, *((name, bag(text), THRESHOLD) for name, text in NOTICES), *((name, counts, THRESHOLD) for name, counts in counted)]


class Model:
    """Template vectors for given document frequencies ``df`` of the templates' words among ``n_docs`` documents."""

    def __init__(self, templates, n_docs: int, df: dict[str, int]):
        vocabulary = sorted(df)
        place = {w: i for i, w in enumerate(vocabulary)}
        hashes = np.array([token_hash(w) for w in vocabulary], dtype=np.int64)
        self.by_hash = np.argsort(hashes)
        self.hashes = hashes[self.by_hash]
        self.other = len(vocabulary)
        self.unseen = math.log(n_docs + 1) + 1
        self.idf = np.array([math.log((n_docs + 1) / (df[w] + 1)) + 1 for w in vocabulary])
        self.names, self.words, self.thresholds, self.vectors, anchors = [], [], [], [], set()
        for name, counts, threshold in templates:
            vector = np.zeros(len(vocabulary) + 1)
            for w, n in counts.items():
                vector[place[w]] = n * self.idf[place[w]]
            vector /= math.sqrt((vector**2).sum())
            self.names.append(name)
            self.words.append(sum(counts.values()))
            self.thresholds.append(threshold)
            self.vectors.append(vector)
            left = 1.0
            for i in np.lexsort((np.arange(len(vector)), -vector)).tolist():
                if left < (threshold - 1e-9) ** 2:
                    break
                anchors.add(i)
                left -= vector[i] ** 2
        self.squares = np.stack(self.vectors) ** 2
        self.least = (np.array(self.thresholds) - 1e-9) ** 2
        self.anchors = np.zeros(len(vocabulary) + 1, dtype=bool)
        self.anchors[list(anchors)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary; other words have the place after the last."""
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.by_hash[at], self.other)

    def cosine(self, words: np.ndarray, t: int) -> float:
        counts = np.bincount(words, minlength=self.other + 1)
        weights = counts[:-1] * self.idf
        norm = (weights**2).sum() + counts[-1] * self.unseen**2
        return float(weights @ self.vectors[t][:-1]) / math.sqrt(norm)

    def judge(self, words: np.ndarray) -> tuple[str | None, float | None, int]:
        """Licence of the best window, its cosine, and the number of words in matching windows. Ties go to the earlier template, then the earlier window."""
        best, name, score = 0.0, None, None
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        # What a whole text does not reach, no window of it does.
        for t in np.flatnonzero(self.squares @ np.bincount(words, minlength=self.other + 1) >= self.least).tolist():
            size, threshold = self.words[t], self.thresholds[t]
            n = min(size, len(words))
            last = len(words) - n
            starts = np.arange(0, last + 1, max(1, size // 8))
            if starts[-1] != last:
                starts = np.append(starts, last)
            sums = np.concatenate(([0.0], np.cumsum(self.squares[t][words])))
            for start in starts[sums[starts + n] - sums[starts] >= self.least[t]].tolist():
                cosine = self.cosine(words[start : start + n], t)
                if cosine >= threshold:
                    covered[start] += 1
                    covered[start + n] -= 1
                    value = cosine * math.log(n + 1)
                    if value > best + 1e-12:
                        best, name, score = value, self.names[t], round(cosine, 6)
        return name, score, int((np.cumsum(covered[:-1]) > 0).sum())

    def scan(self, texts: list[str | None]):
        """For each text: its licence, the cosine, words in matching windows, words in all."""
        out = []
        for low, high in text_chunks(texts):
            tokens = Tokens([(t or "").lower() for t in texts[low:high]], _BREAK)
            places, counts = self.places(tokens.hashes), tokens.counts
            hit = np.bincount(tokens.owners(), weights=self.anchors[places], minlength=high - low) > 0
            for i in range(high - low):
                name, score, words = self.judge(places[tokens.offsets[i] : tokens.offsets[i + 1]]) if hit[i] else (None, None, 0)
                out.append((name, score, words, int(counts[i])))
        return out


def fit(docs: DataFrame, templates, text_col: str = "text") -> Model:
    """Counts, over all documents, how many have each word of the templates."""
    vocabulary = sorted({w for _, counts, _ in templates for w in counts})
    hashes = np.array([token_hash(w) for w in vocabulary], dtype=np.int64)
    order = np.argsort(hashes)

    def count(batches):
        have, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for low, high in text_chunks(texts):
                tokens = Tokens([(t or "").lower() for t in texts[low:high]], _BREAK)
                place = np.searchsorted(hashes[order], tokens.hashes).clip(max=len(order) - 1)
                hit = hashes[order][place] == tokens.hashes
                pairs = np.unique(tokens.owners()[hit] * len(order) + place[hit])
                have[order] += np.bincount(pairs % len(order), minlength=len(order))
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(have)), -1]), pa.array([*have.tolist(), n])], names=["word", "n"])

    counted = docs.select(docs[quoted(text_col)]).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()}  # one row per word of the templates
    return Model(templates, found.get(-1, 0), {w: found.get(i, 0) for i, w in enumerate(vocabulary)})


def license_scan(
    docs: DataFrame,
    path: Column | str = "path",
    templates: list[tuple[str, dict[str, int], float]] | None = None,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, path, license, score, origin, from_dir) for every row. ``templates`` are (licence, counts of words, threshold); None: default_templates().

    ``origin`` is "own", "inherited" (with the directory it comes from), or "none" with a null licence. Directories are a path's parts before the last
    "/", the root being ''. If several licence files lie in one directory, the one with the highest score counts, ties by path, then
    licence. Null and empty texts have no licence of their own but can inherit. A null path has no directory and inherits nothing. Repeated rows get the same
    answer each. Ids may be of any type. Other columns, whatever their names, are never read. An empty table gives an empty table.
    """
    spark = importable(docs.sparkSession)
    model = fit(docs, default_templates() if templates is None else templates, text_col)
    shared = spark.sparkContext.broadcast(model)  # the templates' vectors: of fixed size

    def run(batches):
        for batch in batches:
            found = list(zip(*shared.value.scan(batch.column(2).to_pylist()))) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(found, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "path", "license", "score", "hit", "words"])

    where = docs[quoted(path)] if isinstance(path, str) else path
    read = docs.select(docs[quoted(id_col)].alias("doc_id"), where.cast("string").alias("path"), docs[quoted(text_col)].alias("text"))
    found = with_fields(T.StructType([read.schema["doc_id"]]), ("path", T.StringType()), ("license", T.StringType()), ("score", T.DoubleType()), ("hit", T.LongType()), ("words", T.LongType()))
    scanned = checkpointed(read.mapInArrow(run, found))  # a narrow row per document, read four times below
    folder = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/+$", "")

    is_file = F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(_FILE_NAME) | (F.col("hit") * 2 >= F.col("words")))
    best = Window.partitionBy("dir").orderBy(F.col("score").desc(), "path", "license")
    files = scanned.where(is_file).select(folder.alias("dir"), "license", "score", "path").withColumn("place", F.row_number().over(best)).where("place = 1")
    files = files.select(F.col("dir").alias("from_dir"), F.col("license").alias("theirs"), F.col("score").alias("their_score"))

    own = scanned.where("license is not null").select("doc_id", "path", "license", "score", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("from_dir"))
    rest = scanned.where("license is null").select("doc_id", "path")
    # Paths repeat seldom, directories often: the nearest licensed ancestor is found once per directory.
    dirs = rest.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("d"), n.alias("depth"))))
    climbed = dirs.select("dir", up.alias("up")).select("dir", F.col("up.d").alias("from_dir"), F.col("up.depth").alias("depth")).join(files, "from_dir")
    nearest = climbed.groupBy("dir").agg(F.max_by(F.struct("from_dir", "theirs", "their_score"), "depth").alias("near"))
    joined = rest.withColumn("dir", folder).join(nearest, "dir", "left")
    origin = F.when(F.col("near").isNull() | F.col("path").isNull(), "none").otherwise("inherited")
    given = lambda c: F.when(origin == "inherited", F.col(f"near.{c}"))
    inherited = joined.select(
        "doc_id", "path", given("theirs").alias("license"), given("their_score").alias("score"), origin.alias("origin"), given("from_dir").alias("from_dir")
    )
    return own.unionByName(inherited)
