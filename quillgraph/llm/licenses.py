"""License scans by diagonal voting.

Words of every text and of the license templates are hashed, and so is every run of K words (a k-gram). The k-grams
of all positions are joined with the templates' positions; a hit at word p of the text and word t of a template votes
for the diagonal p - t. Neighbouring diagonals (an inserted or missing word shifts the rest by one) are merged, and a
merged span is kept if the words that its hits cover are enough of the template and of the span itself.

All k-grams of the whole texts go to Spark, which joins them with the broadcast table of the templates' positions (the
templates are constants, so it is bounded). Verified spans come back to the documents by doc_id and a hash of the text,
broadcast while they are few.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case, so bytes serve.

Defined results: a null or empty text has no words and no labels, score 0; rows without doc_id and repeated rows are
each reported (rows of the same doc_id and text have the same result, others are told apart by the text); a text with a template many times has a span for
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import record, slices, table, texts_of, written

K = 5
#: Diagonals this near each other belong to one span.
NEAR = 2
#: A span needs this share of its template, or so many words of it; and this share of its own words.
COVER = 0.8
WORDS = 12
#: The score of a text in which only base phrases stand.
BASE_SCORE = 0.5

# Base phrases and labels, fixed by the query's contract.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices, as published by their authors.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "This software is distributed under the BSD License.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-sa-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc-by-nc-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
}

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KNOWN: dict[bytes, int] = {}
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ADD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def kgram_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """A hash for each run of k words; none for shorter texts."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    known, hashes = _KNOWN.get, []
    for w in words:
        h = known(w)
        if h is None:
            h = _KNOWN[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : n + i]) * _STEP + _ADD
    return out ^ (out >> np.uint64(29))


def template_rows(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, int, int, int, int]]:
    """(label, template, its length, position, hash)"""
    rows, n = [], 0
    for label, texts in templates.items():
        for text in texts:
            words = words_of(text)
            rows += [(label, n, len(words), i, h) for i, h in enumerate(kgram_hashes(words).view(np.int64).tolist())]
            n += 1
    return rows


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word, label) of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in PHRASES.items():
        sought = f" {phrase} ".encode()
        at, before, word = joined.find(sought), 0, 0
        while at >= 0:
            word += joined.count(b" ", before, at)
            found.append((word, label))
            before, at = at, joined.find(sought, at + 1)
    return sorted(found)


_COUNTED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string()))])
_GRAMS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("grams", pa.list_(pa.int64()))])
#: Rows of spans that are broadcast to the documents; more are joined by a shuffle of small rows.
BROADCAST_ROWS = 200_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")


def counted(docs: DataFrame) -> DataFrame:
    """One row a document: number of words, base places and labels."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch):
                words = words_of(text)
                base = base_places(words)
                rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted({label for _, label in base})))
            yield record(_COUNTED, doc_id=batch.column("doc_id"), th=batch.column("th"), **{n: [r[i] for r in rows] for i, n in enumerate(_COUNTED.names[2:])})

    return _keyed(docs).mapInArrow(run, "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, base array<string>")


def rolling(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, hash): every k-gram of every text."""

    def run(batches):
        for batch in slices(batches):
            yield record(_GRAMS, doc_id=batch.column("doc_id"), th=batch.column("th"), grams=[kgram_hashes(words_of(t)).view(np.int64) for t in texts_of(batch)])

    grams = _keyed(docs).mapInArrow(run, "doc_id long, th long, grams array<long>")
    return grams.select("doc_id", "th", F.posexplode("grams").alias("at", "hash"))


def spans(hits: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, th, label, start, stop, cover): verified spans from (doc_id, th, at, hash)."""
    voted = hits.join(F.broadcast(templates), "hash").withColumn("diagonal", F.col("at") - F.col("position"))
    row = ["doc_id", "th"]
    diagonals = voted.groupBy(*row, "template", "diagonal").agg(F.first("label").alias("label"), F.first("length").alias("length"), F.sort_array(F.collect_set("at")).alias("ats"))
    by = Window.partitionBy(*row, "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int"), F.lit(1))
    merged = diagonals.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*row, "template", "span").agg(F.first("label").alias("label"), F.first("length").alias("length"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda p: F.sequence(p, p + (K - 1))))))
    start, stop = F.array_min("ats"), F.array_max("ats") + K
    told = merged.select(*row, "label", start.alias("start"), stop.alias("stop"), covered.alias("covered"), "length")
    enough = (F.col("covered") >= COVER * F.col("length")) | (F.col("covered") >= WORDS)
    return told.where(enough & (F.col("covered") >= COVER * (F.col("stop") - F.col("start")))).select(*row, "label", "start", "stop", F.least(F.lit(1.0), F.col("covered") / F.col("length")).alias("cover"))


def detect(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """One row a document: counts, base places, labels, score, and the verified spans in words."""
    spark = docs.sparkSession
    constant = spark.createDataFrame(template_rows(templates), "label string, template int, length int, position int, hash long")
    verified = spans(rolling(docs), constant)
    told = verified.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"), F.sort_array(F.collect_set(F.struct("start", "stop", "label"))).alias("spans"))
    told = written(told.withColumnsRenamed({"doc_id": "of_id", "th": "of_th"}), "licenses")
    few = told.count() <= BROADCAST_ROWS
    found = counted(docs)
    out = found.join(F.broadcast(told) if few else told, found["doc_id"].eqNullSafe(told["of_id"]) & (found["th"] == told["of_th"]), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce("cover", F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)), F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["stop"].cast("string"))), ","), F.lit("")).alias("spans"),
    )


def op4_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_diagonals": op4_license_diagonals}
ORACLES: dict[str, str] = {}
