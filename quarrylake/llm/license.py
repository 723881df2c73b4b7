"""Licences of files: TF-IDF cosine of headers and licence files to templates, and inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FEW_KEYS, documents, narrowed, stored

#: Statements by which licences name themselves in headers.
STATEMENTS = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain. CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
]
#: Whole short licences, and the headings and first paragraphs of long ones.
TEXTS = [
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
#: Each licence also has its tag.
TAGS = [(name, f"SPDX-License-Identifier: {tag}") for name, tag in [("MIT", "MIT"), ("ISC", "ISC"), ("Zlib", "Zlib"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3.0-or-later"), ("GPL-3.0", "GPL-3.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-2.0", "GPL-2.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1-or-later"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("CC-BY-4.0", "CC-BY-4.0"), ("Unlicense", "Unlicense")]]
TEMPLATES = STATEMENTS + TEXTS + TAGS
#: A statement that names no licence counts only where nothing else does.
WEAK = "Proprietary"
#: What a passage must hold to be compared with the templates; each template holds it.
CUE = r"(?i)licen[cs]e|rights reserved|spdx|permission (is|to use)|public domain|free software|redistribution and use|creative commons|neither the name"
#: Comment marks at the ends of lines.
MARKS = r"(?m)^[ \t]*(/\*+|\*+/|\*|//+|#+|--|;+|<!--|%+)[ \t]*|[ \t]*(\*+/|-->)[ \t]*$"
#: Names of files that license their directory and all below it.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-][a-z0-9._-]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST_COSINE = 0.6
#: Passages of more than this many times the words of the longest template are compared by their lines and sentences only.
TIMES_LONGER = 3


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _weights(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, float]], dict[str, float], float]:
    """(template, term, weight) with unit length for each template; idf of the terms; idf of all others."""
    counts = [Counter(_terms(text)) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for k, c in enumerate(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        rows += [(k, t, x / norm) for t, x in raw.items()]
    return rows, idf, math.log(1 + len(counts)) + 1


def matched(passages: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(passage, license, score): the licence whose template is nearest to each distinct passage, by TF-IDF cosine (ties:
    the first by name); only from LEAST_COSINE on. `passages` has the column passage."""
    spark = passages.sparkSession
    rows, idf, unknown = _weights(templates)
    # As many rows as the templates have terms, whatever the corpus.
    weights = F.broadcast(spark.createDataFrame(rows, "template int, term string, weight double"))
    rarity = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    names = F.broadcast(spark.createDataFrame([(k, name) for k, (name, _) in enumerate(templates)], "template int, license string"))
    distinct = passages.select("passage").distinct()
    terms = distinct.select("passage", F.explode(F.regexp_extract_all(F.lower("passage"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = terms.groupBy("passage", "term").agg(F.count("*").alias("n")).join(rarity, "term", "left")
    counts = counts.withColumn("x", (1 + F.log("n")) * F.coalesce("idf", F.lit(unknown)))
    norms = counts.groupBy("passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counts.join(weights, "term").groupBy("passage", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "passage").join(names, "template").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= LEAST_COSINE)
    return near.groupBy("passage").agg(F.min(_rank(F.col("score"))).alias("best")).select("passage", "best.license", (-F.col("best.s")).alias("score"))


def _rank(score: Column) -> Column:
    """Orders licences: those that are named before WEAK, then by falling score, then by name."""
    return F.struct((F.col("license") == WEAK).alias("weak"), (-score).alias("s"), "license")


def _clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[/\\]+", "/"), "^/|/$", "")


def _split(text: Column, pattern: str) -> Column:
    return F.transform(F.split(text, pattern), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))


def most_words(templates: list[tuple[str, str]]) -> int:
    return TIMES_LONGER * max((len(text.split()) for _, text in templates), default=0)


def passages_of(text: Column, whole: Column, most: int) -> Column:
    """The passages of a text with a licence's cue: paragraphs, lines and sentences, without comment marks; where `whole` is
    true, the text as one passage too. Those of more than `most` words are left to their parts."""
    bare = F.regexp_replace(text, MARKS, "")
    paragraphs = _split(bare, r"\n\s*\n")
    sentences = _split(F.regexp_replace(F.array_join(paragraphs, "\n"), r"([.!?:])\s+([A-Z(])", "$1\n$2"), r"\n")
    every = F.concat(paragraphs, _split(bare, r"\n"), sentences, F.when(whole, F.array(F.trim(F.regexp_replace(bare, r"\s+", " ")))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda p: p.rlike(CUE) & (F.size(F.split(p, " ")) <= most)))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: tuple[str, ...] = (), templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(path, license, score, kind, from_path, ...): one row for each row of `files`, with the columns named in `keep`.

    A file's own licence is that of the passage nearest to a template: a header's
    passages are paragraphs, lines and sentences with a licence's cue, a licence
    file is also taken as a whole (what has over three times the words of the
    longest template, by its parts). A licence that is named goes before `All
    rights reserved`; then the nearest (ties: the first by name). Its kind is
    `header` or `file`. Files without one inherit from the licence file in the
    nearest directory above them (kind `inherited`, with that file's path); of
    several there, the first by path. Others have null license and kind. Null and
    empty texts have no passages; a null path inherits nothing; repeated paths
    are rows of their own. An empty table gives an empty table. Other columns are
    not read. `templates` may hold whole licences of any length.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    rows = files.select(_clean_path(F.col(path_col).cast("string")).alias("path"), F.col(text_col).cast("string").alias("text"), kept.alias("kept"))
    is_file = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    found_in = F.when(F.col("text").rlike(CUE), passages_of(F.col("text"), is_file, most_words(templates))).otherwise(F.array().cast("array<string>"))
    light = stored(rows.select("path", "kept", is_file.alias("is_file"), found_in.alias("passages"), F.monotonically_increasing_id().alias("row")), "passages")
    passages = light.select("row", F.explode("passages").alias("passage"))
    known = stored(matched(passages, templates).withColumnRenamed("score", "near"), "matched")
    own = narrowed(passages, known, ["passage"], spread="row").withColumn("score", F.col("near"))
    own = own.groupBy("row").agg(F.min(_rank(F.col("score"))).alias("best")).select("row", "best.license", (-F.col("best.s")).alias("score"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = stored(light.select("row", "path", "kept", "is_file", folder.alias("in")).join(own, "row", "left"), "own")
    granted = own.where("is_file AND license IS NOT NULL AND path IS NOT NULL").groupBy(F.col("in").alias("folder")).agg(F.min(F.struct("path", "license", "score")).alias("grant"))
    # Files of one directory climb together: a row for each directory and each directory above it.
    climbing = own.where("license IS NULL AND path IS NOT NULL").select("in").distinct()
    steps = climbing.select("in", F.explode(folders_of(F.col("in"))).alias("folder"))
    nearest = stored(steps.join(granted, "folder").groupBy("in").agg(F.max_by("grant", F.length("folder")).alias("grant")), "nearest")
    names = ["path", "license", "score", "kind", "from_path"]
    own_kind = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header"))
    alone = own.join(F.broadcast(nearest.select("in")), "in", "left_anti") if nearest.limit(FEW_KEYS + 1).count() <= FEW_KEYS else own.join(nearest.select("in"), "in", "left_anti")
    heirs = narrowed(own, nearest, ["in"], spread="row")
    inherits = F.col("license").isNull()
    more = [F.col(f"kept.`{c}`").alias(c) for c in keep]
    heirs = heirs.select("path", F.coalesce("license", "grant.license").alias("license"), F.coalesce("score", "grant.score").alias("score"), F.coalesce(own_kind, F.lit("inherited")).alias("kind"), F.when(inherits, F.col("grant.path")).alias("from_path"), *more)
    return alone.select("path", "license", "score", own_kind.alias("kind"), F.lit(None).cast("string").alias("from_path"), *more).unionByName(heirs)


def folders_of(folder: Column) -> Column:
    """A directory and all above it, the root ('') first."""
    above = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(above)), lambda k: F.array_join(F.slice(above, 1, k), "/"))))


#: In op7's view of the table, documents whose id is divisible by this are licence files of their directory.
LICENCE_SHARE = 50


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's and language's directories; some are the directory's licence files."""
    docs = documents(spark, sf_dir)
    name = F.concat(F.when(F.pmod("doc_id", F.lit(LICENCE_SHARE)) == 0, "LICENSE-").otherwise(""), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), name)
    found = scan(docs.select(path.alias("path"), "text", "doc_id"), keep=("doc_id",))
    return found.select("doc_id", "path", "license", "score", "kind", "from_path")


def _values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _oracle() -> str:
    """The same in DuckDB SQL; weights of the templates are worked out there too."""
    squeeze = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    term = TERM.replace("'", "''")
    cue = CUE.replace("'", "''")
    marks = MARKS.replace("'", "''")
    return rf"""
WITH tpl(template, license, text) AS (VALUES {_values([(k, *x) for k, x in enumerate(TEMPLATES)])}),
tt AS (SELECT template, term, count(*) AS n FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{term}')) AS term FROM tpl) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tpl)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
tw AS (SELECT template, term, (1 + ln(n)) * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
d AS (
  SELECT *, dir || '/' || CASE WHEN is_file THEN 'LICENSE-' ELSE '' END || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS path
  FROM (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir, coalesce(doc_id % {LICENCE_SHARE} = 0, FALSE) AS is_file FROM documents)
), bare AS (SELECT r, is_file, regexp_replace(text, '{marks}', '', 'g') AS b FROM d WHERE regexp_matches(text, '{cue}')),
para AS (SELECT r, is_file, b, list_transform(regexp_split_to_array(b, '\n\s*\n'), lambda p: {squeeze("p")}) AS ps FROM bare),
pas AS (
  SELECT DISTINCT r, p AS passage FROM (
    SELECT r, unnest(list_concat(ps, list_transform(regexp_split_to_array(b, '\n'), lambda p: {squeeze("p")}),
      list_transform(regexp_split_to_array(regexp_replace(array_to_string(ps, chr(10)), '([.!?:])\s+([A-Z(])', '\1' || chr(10) || '\2', 'g'), '\n'), lambda p: {squeeze("p")}),
      CASE WHEN is_file THEN [{squeeze("b")}] ELSE [] END)) AS p FROM para) WHERE regexp_matches(p, '{cue}') AND len(string_split(p, ' ')) <= {most_words(TEMPLATES)}
), pt AS (SELECT passage, term, count(*) AS n FROM (SELECT passage, unnest(regexp_extract_all(lower(passage), '{term}')) AS term FROM (SELECT DISTINCT passage FROM pas)) GROUP BY ALL),
px AS (SELECT passage, term, (1 + ln(n)) * coalesce(idf, ln(1.0 + (SELECT count(*) FROM tpl)) + 1) AS x FROM pt LEFT JOIN idf USING (term)),
pn AS (SELECT passage, sqrt(sum(x * x)) AS norm FROM px GROUP BY passage),
dots AS (SELECT passage, template, sum(x * w) AS dot FROM px JOIN tw USING (term) GROUP BY ALL),
near AS (SELECT passage, license, round(dot / (pn.norm * tn.norm), 6) AS score FROM dots JOIN pn USING (passage) JOIN tn USING (template) JOIN tpl USING (template) WHERE round(dot / (pn.norm * tn.norm), 6) >= {LEAST_COSINE}),
own AS (SELECT r, license, score FROM pas JOIN near USING (passage) QUALIFY row_number() OVER (PARTITION BY r ORDER BY license = '{WEAK}', score DESC, license) = 1),
f AS (SELECT d.*, license, score FROM d LEFT JOIN own USING (r)),
granted AS (SELECT dir, path, license, score FROM f WHERE is_file AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path, license, score) = 1)
SELECT doc_id, f.path, coalesce(f.license, g.license) AS license, coalesce(f.score, g.score) AS score,
  CASE WHEN f.license IS NOT NULL THEN CASE WHEN f.is_file THEN 'file' ELSE 'header' END WHEN g.license IS NOT NULL THEN 'inherited' END AS kind,
  CASE WHEN f.license IS NULL THEN g.path END AS from_path
FROM f LEFT JOIN granted g ON g.dir = f.dir
"""


OP7_SQL = _oracle()
