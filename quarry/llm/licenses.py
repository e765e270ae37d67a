"""License scans: sparse TF-IDF cosine of notices to templates, and inheritance from
the nearest ancestor directory that has a licence file.

1. Notices: every sentence or line of the whole text with a licence cue, and the
   sentences of paragraphs whose lines are joined.  Long units: blocks between
   empty lines and their paragraphs (comment marks taken off), and every text
   whole; they are compared with the fuller templates ``FULL``.
2. Each notice is a bag of terms hashed to ``SLOTS``; document frequencies cover
   all notices of the table (and the templates), one count per slot.
3. A notice takes the template of highest cosine, if it is at least
   ``least_score`` (``LONG_SCORE`` for a long unit); a text takes its best notice.
   A known SPDX identifier counts as a notice of score 1 and goes first.
4. A licence file is one by its name (LICENSE, COPYING, ...) or because licence
   notices make up at least half of its words or it matches a fuller template whole.  It stands for its directory and
   everything below.
5. A file without a notice of its own inherits from its nearest ancestor
   directory with a licence file.  Only distinct directories are expanded to
   their ancestors and joined; files meet the answer of their directory once.

Defined cases: null or empty text has no notice; a null path is a file in the
root without a name; equal cosines go to the first template name, several
licence files in one directory to the highest score, then the smaller path;
repeated rows each give a row; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, add_columns, documents, stored

# Short public notices by SPDX identifier.
TEMPLATES = {
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3"],
    "Apache-2.0": ["licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "BSD-2-Clause": ["licensed under the BSD 2-Clause License", "simplified BSD License"],
    "BSD-3-Clause": ["licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "CC-BY-4.0": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["dedicated to the public domain under CC0 1.0 Universal"],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2"],
    "GPL-3.0": ["this work is licensed under the GNU General Public License, version 3", "free software: you can redistribute it under the terms of the GNU General Public License version 3"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3"],
    "MIT": ["released under the MIT License", "licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["all rights reserved", "no part of this work may be copied without permission"],
}
_GPL = "free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Header blocks, title blocks of licence files, and short licences whole.
FULL = {
    "AGPL-3.0": ["This program is " + _GPL.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-2-Clause": [f"{_BSD} {_BSD_END}", _BSD],
    "BSD-3-Clause": [f"{_BSD} {_BSD_3} {_BSD_END}", f"{_BSD} {_BSD_3}"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": ["This program is " + _GPL.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This program is " + _GPL.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["This library is " + _GPL.format("Lesser General Public License", 2.1), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": ["This library is " + _GPL.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": [f"MIT License {_MIT} {_MIT_END}", _MIT],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
}
LONG_SCORE = 0.75
EMPTY_LINE = r"\n[ \t\r]*\n"
COMMENT_MARK = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)[ \t\r]*$"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)"
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+-]*"
CUE = r"(?i)licen[sc]e|no part of this|all rights reserved|permission is hereby|redistribution and use|creative commons|public domain|free software"
SENTENCE_END = r"\n|(?<=[.!?])\s+"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([-._].*)?$"
SLOTS = 1 << 14


def slots(notice: Column) -> Column:
    """The term occurrences of a notice as slots."""
    return F.transform(F.regexp_extract_all(F.lower(notice), F.lit(TERM), F.lit(0)), lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int"))


def notices(text: Column) -> Column:
    cut = F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(CUE))
    return F.when(text.rlike(CUE), cut).otherwise(F.array().cast("array<string>"))


def long_units(text: Column) -> tuple[Column, Column]:
    """(joined sentences, long units) of a text, as arrays."""
    none = F.array().cast("array<string>")
    cued = lambda xs: F.filter(xs, lambda x: x.rlike(CUE))
    plain = lambda x: F.regexp_replace(x, COMMENT_MARK, "")
    blocks = F.transform(cued(F.split(text, EMPTY_LINE)), plain)
    paragraphs = cued(F.flatten(F.transform(blocks, lambda b: F.split(b, EMPTY_LINE))))
    wrapped = F.filter(paragraphs, lambda p: p.contains("\n"))
    joined = cued(F.flatten(F.transform(wrapped, lambda p: F.split(F.regexp_replace(p, r"\s+", " "), SENTENCE_END))))
    given = lambda xs: F.when(text.rlike(CUE), xs).otherwise(none)
    return given(joined), given(F.array_distinct(F.concat(F.array(plain(text)), blocks, paragraphs)))


def spdx_ids(text: Column) -> Column:
    """The identifiers that the SPDX tags of a text name."""
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(SPDX_ID), F.lit(0))))
    return F.when(text.contains("SPDX") | text.contains("spdx"), F.transform(found, lambda x: F.regexp_replace(x, r"(?i)(-only|-or-later|\+)$", ""))).otherwise(F.array().cast("array<string>"))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def unit(bag: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.bincount(np.asarray(bag, np.int64), minlength=SLOTS) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def best_template(names: list[str], matrix: np.ndarray, idf: np.ndarray, bags) -> tuple[str | None, float]:
    """The template of highest cosine to any of the notices; equal ones by name."""
    best, score = None, 0.0
    for bag in bags:
        if len(bag):
            cosines = matrix @ unit(bag, idf)
            i = int(np.argmax(np.round(cosines, 12)))
            if cosines[i] > score + 1e-12:
                best, score = names[i], float(cosines[i])
    return best, score


def best_of(units: dict, short: tuple, full: tuple, idf: np.ndarray, least_long: float) -> tuple[str | None, float, bool]:
    """(template, score, whether the first long unit, the text as a whole, matches) of a file's units."""
    known = {name.lower(): name for name in [*short[0], *full[0]]}
    tagged = next((known[x.lower()] for x in units["spdx"] if x.lower() in known), None)
    name, score = best_template(*short, idf, [*units["notices"], *units["joined"]])
    long = [best_template(*full, idf, [bag]) for bag in units["long"]]
    whole = bool(long and long[0][1] >= least_long)
    for n, x in long:
        if x >= least_long and x > score + 1e-12:
            name, score = n, x
    return (tagged, 1.0, whole) if tagged else (name, score, whole)


def detect(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least_score: float = 0.6) -> DataFrame:
    """(.., license, score, is_license_file) for files (.., path, words, notice_words, units); ``units`` as ``scan`` makes them."""
    spark = files.sparkSession
    named = sorted((name, text) for name, texts in templates.items() for text in texts)
    rows = spark.createDataFrame(named, "name string, text string").select("name", slots(F.col("text")).alias("bag")).orderBy("name", "text").collect()
    # the fuller templates of a licence go with its short ones
    fuller = spark.createDataFrame(sorted((n, t) for n, ts in FULL.items() if templates is TEMPLATES or n in templates for t in ts) or [(None, "")], "name string, text string")
    fuller = fuller.select("name", slots(F.col("text")).alias("bag")).orderBy("name", "text").collect()
    counted = files.select(F.explode("units.notices").alias("bag")).select(F.explode(F.array_distinct("bag")).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    df = np.zeros(SLOTS)
    for slot, n in counted.collect():  # at most SLOTS rows
        df[slot] = n
    for r in rows:
        df[np.unique(r.bag)] += 1
    total = len(rows) + (files.agg(F.sum(F.size("units.notices"))).first()[0] or 0)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    stacked = lambda rs: ([r.name for r in rs], np.stack([unit(r.bag, idf) for r in rs]))
    sent = spark.sparkContext.broadcast((stacked(rows), stacked(fuller), idf, max(least_score, LONG_SCORE)))  # templates * SLOTS numbers

    def start():
        return lambda rows: [best_of(units, *sent.value) for units in rows]

    hit = F.col("_score") >= least_score
    mostly = 2 * F.aggregate("notice_words", F.lit(0), lambda a, x: a + x) >= F.col("words")
    return (
        add_columns(files, "units", start, "_license string, _score double, _whole boolean")
        .withColumn("license", F.when(hit, F.col("_license")))
        .withColumn("score", F.when(hit, F.col("_score")).otherwise(F.lit(0.0)))
        .withColumn("is_license_file", F.col("license").isNotNull() & (basename(F.col("path")).rlike(LICENCE_FILE) | mostly | F.col("_whole")))
        .drop("_license", "_score", "_whole")
    )


def directory(path: Column) -> Column:
    """'a/b' of 'a/b/c'; '' is the root."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """(depth, dir) of the directory itself and all above, the root at depth 0."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))


def inherit(found: DataFrame) -> DataFrame:
    """Add ``effective`` (own or inherited licence), and ``inherited_from`` (the directory)."""
    found = found.withColumn("_dir", directory(F.col("path")))
    first = F.min(F.struct(-F.round("score", 9), F.col("path"), F.col("license")))
    by_dir = found.where("is_license_file").groupBy(F.col("_dir").alias("dir")).agg(first.alias("f")).select("dir", F.col("f.license").alias("from_license"))
    folders = found.select("_dir").distinct().select("_dir", F.explode(ancestors(F.col("_dir"))).alias("a")).select("_dir", "a.depth", "a.dir")
    # stored, so that both sides of the join are plain exchanges and Spark can split a directory of many files
    nearest = stored(folders.join(by_dir, "dir").groupBy("_dir").agg(F.max_by(F.struct("dir", "from_license"), "depth").alias("near")), "licence-nearest")
    own = F.col("license").isNotNull()
    return (
        found.join(nearest, "_dir", "left")
        .withColumn("effective", F.coalesce("license", "near.from_license"))
        .withColumn("inherited_from", F.when(~own, F.col("near.dir")))
        .drop("_dir", "near")
    )


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least_score: float = 0.6) -> DataFrame:
    """(doc_id, path, license, score, is_license_file, effective, inherited_from) of files (doc_id, path, text)."""
    text = F.coalesce("text", F.lit(""))
    joined, long = long_units(text)
    read = files.select("doc_id", "path", notices(text).alias("cut"), n_words(text).alias("words"), joined.alias("joined"), long.alias("long"), spdx_ids(text).alias("spdx"))
    bags = lambda c: F.transform(c, slots).alias(c)
    units = F.struct(bags("cut").alias("notices"), bags("joined"), bags("long"), "spdx")
    narrow = read.select("doc_id", "path", "words", F.transform("cut", n_words).alias("notice_words"), units.alias("units"))
    found = detect(stored(narrow, "licence-notices"), templates, least_score)
    return inherit(stored(found.drop("words", "units", "notice_words"), "licence-found"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: source/[lang/[id / 1000/]]id.txt, at three depths by the id."""
    docs = documents(spark, sf_dir, "text", "lang", "source")
    folder = F.concat_ws(
        "/",
        F.coalesce("source", F.lit("none")),
        F.when(F.col("doc_id") % 3 > 0, F.coalesce("lang", F.lit("none"))),
        F.when(F.col("doc_id") % 3 > 1, F.floor(F.col("doc_id") / 1000).cast("string")),
    )
    files = docs.select("doc_id", F.concat_ws("/", folder, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))).alias("path"), "text")
    return scan(files).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "is_license_file", "effective", "inherited_from")


QUERIES = {"op4_license_scan": op4_license_scan}
ORACLE: dict[str, str] = {}
