"""License scans by diagonal voting, in DataFrame operations only.

Every rolling word 3-gram of every text is joined by hash to the places where license notices have it.  Hits
vote for the diagonal (place in the text minus place in the notice); neighbouring diagonals are merged, so a
word more or less doesn't split a notice, and spans that hold enough of their notice are verified.
Templates are a table (label, text); the constant list below is the default.  Only templates of at most BROADCAST_GRAMS 3-grams together are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public license notices by label.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("apache", "You may not use this file except in compliance with the License. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl", "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
GRAM = 3
#: Rows of some 60 bytes.
BROADCAST_GRAMS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _CAPITALS, _SMALL), F.lit(WORD), F.lit(0))


def _grams(words: str) -> Column:
    """(place, hash) of every 3-gram; fewer than three words have none."""
    places = F.when(F.size(words) >= GRAM, F.sequence(F.lit(0), F.size(words) - GRAM)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(*[F.get(words, i + j) for j in range(GRAM)]).alias("hash")))


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "label string, text string")


def _template_grams(templates: DataFrame) -> DataFrame:
    """(notice, label, length, q, hash): every 3-gram of every distinct template, with its place.

    Templates of fewer than three words have none and are never found; null ones are left out."""
    read = templates.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label is not null and text is not null").distinct()
    worded = read.select(F.xxhash64("label", "text").alias("notice"), "label", words_of(F.col("text")).alias("v"))
    grams = worded.select("notice", "label", F.size("v").alias("length"), F.explode(_grams("v")).alias("g"))
    return grams.select("notice", "label", "length", F.col("g.place").alias("q"), F.col("g.hash").alias("hash"))


def notice_spans(words: DataFrame, templates: DataFrame | None = None, min_share: float = 0.75, drift: int = 2) -> DataFrame:
    """(key, label, first, last, share) of the notices in texts; ``words`` has key (rows of equal key have equal words) and words.

    share is the part of a notice's 3-grams that one band of diagonals holds; spans with ``min_share`` or more and no longer than
    the notice by half are kept.  Diagonals at most ``drift`` apart are one band.  Words of no text have no spans.
    """
    notices = _template_grams(default_templates(words.sparkSession) if templates is None else templates)
    if templates is None or notices.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS:
        notices = F.broadcast(notices)  # counted
    grams = words.select("key", F.explode(_grams("words")).alias("g")).select("key", F.col("g.place").alias("p"), F.col("g.hash").alias("hash"))
    hits = grams.join(notices, "hash").select("key", "notice", "label", "length", "p", "q", (F.col("p") - F.col("q")).alias("diagonal"))
    votes = hits.groupBy("key", "notice", "label", "length", "diagonal").agg(F.collect_set("q").alias("qs"), F.min("p").alias("first"), F.max("p").alias("last"))
    along = W.partitionBy("key", "notice").orderBy("diagonal")
    band = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= drift, 0).otherwise(1)).over(along)
    spans = votes.withColumn("band", band).groupBy("key", "notice", "label", "length", "band").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"), F.min("first").alias("first"), (F.max("last") + GRAM).alias("last"))
    share = F.size("qs") / (F.col("length") - GRAM + 1)
    kept = spans.withColumn("share", share).where((F.col("share") >= min_share) & (F.col("last") - F.col("first") <= 1.5 * F.col("length")))
    return kept.select("key", "label", "first", "last", "share")


def _phrase_places(words: str) -> Column:
    """(start, label) of every place of every phrase."""
    every = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        starts = F.filter(every, lambda i: _all(F.get(words, i + j).eqNullSafe(F.lit(w)) for j, w in enumerate(parts)))
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*[places(*p) for p in PHRASES])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def licenses(docs: DataFrame, templates: DataFrame | None = None, min_share: float = 0.75) -> DataFrame:
    """doc_id, n_words, base (places and labels of the fixed phrases), notices (label, first, last, share) and score.

    score: 1 with a phrase, else the greatest share of a notice, else 0.  ``docs`` needs doc_id and text; other columns are left out.
    ``templates`` (label, text) default to the constant notices.  Null and empty texts have no words.  One row per input row, each with the
    notices of its own text, whether or not its doc_id is missing or repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # A row's key: its id and text.  Rows that share it have the same notices.
    key = F.struct(F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))
    worded = read.select("doc_id", "key", words_of(F.col("text")).alias("words"), F.col("text").rlike("(?i)general|reserved|cc[^0-9a-z]+by").alias("likely"))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    base = worded.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("likely"), _phrase_places("words")).otherwise(none).alias("base"))
    spans = notice_spans(worded.select("key", "words"), templates, min_share)
    notices = spans.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("label", "first", "last", "share"))).alias("notices"))
    out = base.join(notices, base["key"] == F.col("_key"), "left").drop("_key", "key")
    best = F.coalesce(F.array_max(F.transform("notices", lambda s: s["share"])), F.lit(0.0))
    return out.withColumn("score", F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(best, F.lit(1.0))))
