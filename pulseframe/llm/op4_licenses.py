"""Licences of files: TF-IDF cosine to templates, then inheritance from the nearest directory above.

Units are a file's opening, its lines, its paragraphs of several lines, and its whole text.
A unit's weights are word counts times ln((1 + files) / (1 + files with the word)) + 1, the
files counted over the whole table by hash bucket of the word. A unit can only reach
the threshold if it has one of the rarest words of the template: without
those, what is left of the template is shorter than the threshold. Only such units are
taken apart. A file that opens with a licence's title, of which licence text makes up a large
part, or whose name says so, is a licence file and speaks for its directory; files without a licence of their own take that of
the nearest directory above, looked up per directory, not per file.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, functions as F

from pulseframe.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, FILE_SHARE = 0.6, 0.25

#: What a title counts for from, and names of files that hold nothing but their licence.
TITLE_THRESHOLD = 0.9
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
#: Kinds of template, the stronger first: a licence's title, which only counts where it opens a text; wording of one
#: licence; wording that stands beside many licences.
TITLE, TEXT, SHARED = 0, 1, 2

# Licence ids and the wording they are recognised by.
_BSD_OPENS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met")
_BSD_TWO = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission.")
_BSD_AS_IS = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
              "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
              "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
              "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES")
_GNU_NOTICE = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the "
               "Free Software Foundation, either version {} of the License, or (at your option) any later version")
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
       "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = [("GPL-1.0", "General Public License", "1", "February 1989"), ("GPL-2.0", "General Public License", "2", "June 1991"),
        ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("LGPL-2.0", "Library General Public License", "2", "June 1991"),
        ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
        ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
        ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
        ("GFDL-1.2", "Free Documentation License", "1.2", "November 2002"),
        ("GFDL-1.3", "Free Documentation License", "1.3", "3 November 2008")]
_IDS = ["Apache-2.0", "MIT", "ISC", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "MPL-1.1", "MPL-2.0", "CC0-1.0", "Artistic-1.0"]
TEMPLATES = [
    ("Apache-2.0", TEXT, "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", TEXT, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", TITLE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", TITLE, "Apache License Version 2.0"),
    ("MIT", TEXT, "Released under the MIT License"),
    ("MIT", TEXT, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
                  "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", TITLE, "MIT License"),
    ("MIT", TITLE, "The MIT License (MIT)"),
    ("ISC", TEXT, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", TITLE, "ISC License"),
    ("Unlicense", TEXT, "This is free and unencumbered software released into the public domain"),
    ("BSD-2-Clause", TEXT, " ".join([_BSD_OPENS, _BSD_TWO, _BSD_AS_IS])),
    ("BSD-2-Clause", TITLE, "BSD 2-Clause License"),
    ("BSD-3-Clause", TEXT, " ".join([_BSD_OPENS, _BSD_TWO, _BSD_NAME, _BSD_AS_IS])),
    ("BSD-3-Clause", TEXT, _BSD_NAME),
    ("BSD-3-Clause", TITLE, "BSD 3-Clause License"),
    ("BSD-3-Clause", SHARED, _BSD_OPENS),
    ("MPL-1.1", TITLE, "Mozilla Public License Version 1.1"),
    ("MPL-1.1", TEXT, "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", TITLE, "Mozilla Public License Version 2.0"),
    ("MPL-2.0", TEXT, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Artistic-1.0", TITLE, 'The "Artistic License"'),
    ("CC0-1.0", TITLE, "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC0-1.0", TEXT, "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"),
    ("CC0-1.0", TEXT, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    *[(f"CC-{code}-4.0", TEXT, f"Licensed under CC {code} 4.0") for code in _CC],
    *[(f"CC-{code}-4.0", TEXT, f"This work is licensed under a Creative Commons {name} 4.0 International License") for code, name in _CC.items()],
    *[(f"CC-{code}-4.0", TITLE, f"{name} 4.0 International") for code, name in _CC.items()],
    *[(key, TITLE, f"GNU {name} Version {version}, {day}") for key, name, version, day in _GNU],
    *[(key, TITLE, f"GNU {name} Version {version}") for key, name, version, _ in _GNU],
    *[(key, TEXT, f"This work is licensed under the GNU {name}, version {version}") for key, name, version, _ in _GNU],
    *[(key, TEXT, _GNU_NOTICE.format(name, version)) for key, name, version, _ in _GNU if not key.startswith("GFDL")],
    *[(key, TEXT, f"SPDX-License-Identifier: {key}{end}") for key, *_ in _GNU for end in ("", "-only", "-or-later")],
    *[(key, TEXT, f"SPDX-License-Identifier: {key}") for key in [*_IDS, *(f"CC-{code}-4.0" for code in _CC)]],
    # An identifier that is not in the list is nearer to this one than to any other.
    ("Other", TEXT, "SPDX-License-Identifier:"),
    ("Proprietary", SHARED, "All rights reserved"),
    ("Proprietary", SHARED, "All rights reserved. No part may be reproduced without permission"),
]


def words(text):
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^0-9a-z]+"), lambda w: w != "")


def bucket(word):
    return F.substring(F.md5(word.cast("binary")), 1, 4)


def template_weights(idf: dict[str, float], templates=None) -> list[tuple[int, str, int, str, float]]:
    """(template, licence, kind, word, weight) with weights of length 1 per template."""
    out = []
    for k, (name, kind, text) in enumerate(templates or TEMPLATES):
        each = re.findall("[0-9a-z]+", text.lower())
        raw = {w: each.count(w) * idf[w] for w in sorted(set(each))}
        length = math.sqrt(sum(v * v for v in raw.values()))
        out += [(k, name, kind, w, v / length) for w, v in raw.items()]
    return out


def leading_words(weights: list[tuple[int, str, int, str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Rarest words of each template, without which the rest is shorter than the threshold."""
    lead: set[str] = set()
    for k in {w[0] for w in weights}:
        own, rest = sorted((w for w in weights if w[0] == k), key=lambda w: (-idf[w[3]], -w[4], w[3])), 1.0
        needed = max(threshold, TITLE_THRESHOLD) if own[0][2] == TITLE else threshold
        for w in own:
            if math.sqrt(max(0.0, rest)) < needed - 1e-9:
                break
            lead.add(w[3])
            rest -= w[4] ** 2
    return sorted(lead)


def _any_of(found: list[str]) -> str:
    """Pattern of a word that is one of these, looked up by its first letter."""
    letters = sorted({w[0] for w in found})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in found if w[0] == c)})" for c in letters)


def _units(text):
    """The opening of a text (its first line, paragraph, two paragraphs), its lines, its paragraphs of several lines, and itself."""
    blank = r"\n[\x20\x09-\x0D]*\n"
    start = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    opening = F.split(start, blank, 3)
    several = F.filter(F.split(text, blank), lambda p: F.instr(p, "\n") > 0)
    return F.concat(F.array(F.substring_index(start, "\n", 1), opening[0], F.concat_ws("\n", F.slice(opening, 1, 2))), F.split(text, "\n"), several, F.array(text))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """(path, license, cosine, is_file) of the files with a licence text of their own.

    A title that opens the file decides, then wording of one licence, then wording that many share; among
    these the greatest cosine, and ties go to the licence first by name. A path's rows count
    together. A null text has no words, a null path no licence.
    """
    spark = files.sparkSession
    files = files.where(files["path"].isNotNull()).select(files["path"], F.coalesce(files["text"].cast("string"), F.lit("")).alias("text"))
    total = files.count()
    seen = files.select(F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("bucket"))
    frequency = materialize(seen.groupBy("bucket").agg(F.count("*").alias("n")), "licence_words")  # at most 65,536 rows
    vocabulary = sorted({w for *_, t in TEMPLATES for w in re.findall("[0-9a-z]+", t.lower())})
    known = spark.createDataFrame([(w,) for w in vocabulary], "word string").withColumn("bucket", bucket(F.col("word")))
    idf = {r.word: math.log((1 + total) / (1 + (r.n or 0))) + 1 for r in known.join(frequency, "bucket", "left").collect()}
    weights = template_weights(idf)
    lead = leading_words(weights, idf, threshold)
    # Files with a leading word, cut into units.
    likely = files.where(F.translate("text", UPPER, LOWER).rlike(f"(^|[^0-9a-z])({_any_of(lead)})([^0-9a-z]|$)"))
    units = likely.select("path", F.size(words(F.col("text"))).alias("n_file"), F.posexplode(_units(F.col("text"))).alias("unit", "text"))
    units = units.select("path", "n_file", "unit", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("words"))
    units = units.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in lead])))
    units = materialize(units.withColumn("n_unit", F.size("words")), "licence_units")
    unit = ["path", "n_file", "unit", "tie", "n_unit"]
    # First the template words alone (a table of fixed size): what a unit's other words add to its length is at least 1 each.
    table = F.broadcast(spark.createDataFrame(weights, "template int, license string, kind int, word string, tw double"))
    given = F.broadcast(spark.createDataFrame(list(idf.items()), "word string, idf double"))
    ours = units.select(*unit, F.explode("words").alias("word")).join(given, "word").groupBy(*unit, "word", "idf").agg(F.count("*").alias("tf"))
    ours = ours.groupBy(*unit).agg(
        F.collect_list(F.struct("word", (F.col("tf") * F.col("idf")).alias("w"))).alias("terms"), F.sum("tf").alias("n_ours"))
    square = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["w"] * t["w"])
    bound = ours.withColumn("least", F.sqrt(square + F.col("n_unit") - F.col("n_ours")))
    dot = bound.select(*unit, "least", F.explode("terms").alias("t")).select(*unit, "least", "t.word", "t.w").join(table, "word")
    dot = dot.where(f"kind > {TITLE} OR unit < 3").groupBy(*unit, "least", "template", "license", "kind").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    dot = materialize(dot.where(F.col("dot") >= threshold * F.col("least") - 1e-6).select(*unit, "license", "kind", "dot"), "licence_candidates")
    # Then the exact length of the few units that are left.
    near = units.join(dot.select(*unit).distinct(), unit, "left_semi")
    counts = near.select(*unit, F.explode("words").alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("tf"))
    counts = counts.withColumn("bucket", bucket(F.col("word"))).join(frequency, "bucket", "left")
    counts = counts.withColumn("w", F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("n", F.lit(0)))) + 1))
    length = counts.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    cosine = dot.join(length, unit)
    cosine = cosine.withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("cosine") >= threshold)
    cosine = cosine.where(f"kind > {TITLE} OR cosine >= {TITLE_THRESHOLD}")
    whole = (F.col("kind") == TITLE) | (F.col("n_unit") >= file_share * F.col("n_file")) | F.col("path").rlike(FILE_NAMES)
    best = F.min_by(F.struct("license", "cosine"), F.struct("kind", -F.col("cosine"), "license"))
    return cosine.groupBy("path").agg(best.alias("best"), F.max(whole).alias("is_file")).select("path", "best.*", "is_file")


def _folder(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def licenses(files: DataFrame, threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """path, license, basis (own, file, inherited or null), cosine and directory (of the licence file) per distinct path."""
    own = materialize(own_licenses(files, threshold, file_share), "own_licences")
    paths = files.select("path").distinct().withColumn("folder", _folder(F.col("path")))
    speaking = own.where("is_file").groupBy(_folder(F.col("path")).alias("directory")).agg(
        F.min_by(F.struct("license", "cosine"), F.struct(-F.col("cosine"), "path")).alias("given"))
    # The nearest directory above, per folder: a folder of a third of all files is one row here.
    above = paths.select("folder").distinct().withColumn("parts", F.split("folder", "/"))
    above = above.select("folder", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts")
    above = above.withColumn("directory", F.concat_ws("/", F.slice("parts", 1, F.col("depth")))).where("depth > 0 OR folder <> ''")
    nearest = above.join(speaking, "directory").groupBy("folder").agg(F.max_by(F.struct("directory", "given"), "depth").alias("from"))
    out = paths.join(own, "path", "left").join(nearest, "folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path", F.coalesce("license", "from.given.license").alias("license"),
        F.when(mine & F.col("is_file"), "file").when(mine, "own").when(F.col("from").isNotNull(), "inherited").alias("basis"),
        F.coalesce("cosine", "from.given.cosine").alias("cosine"),
        F.when(mine, F.lit(None)).otherwise(F.col("from.directory")).alias("directory"))


def document_path(docs: DataFrame):
    """Documents as files: a folder per source, and below it folders of 1,000 and of 20 ids."""
    part = lambda by: F.floor(docs["doc_id"] / by).cast("string")
    return F.concat_ws("/", F.coalesce(docs["source"], F.lit("-")), part(1000), part(20), docs["doc_id"].cast("string"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, basis, cosine and directory of every document; rows of one id and source share the path's result."""
    named = docs.select(docs["doc_id"], document_path(docs).alias("path"), docs["text"])
    return named.select("doc_id", "path").join(licenses(named), "path")


def _sql() -> str:
    values = ", ".join("({}, '{}', {}, '{}')".format(k, n, kind, t.replace("'", "''")) for k, (n, kind, t) in enumerate(TEMPLATES))
    blank, start = r"'\n[\x20\x09-\x0D]*\n'", r"regexp_replace(text, '^[\x20\x09-\x0D]+', '')"
    cut = "regexp_extract_all(translate({}, '" + UPPER + "', '" + LOWER + "'), '[0-9a-z]+')"
    return rf"""
WITH f AS (SELECT doc_id, coalesce(source, '-') || '/' || CAST(doc_id // 1000 AS VARCHAR) || '/' || CAST(doc_id // 20 AS VARCHAR)
      || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(text, '') AS text FROM documents),
  df AS (SELECT bucket, count(*) AS n FROM (SELECT DISTINCT doc_id, substr(md5(word), 1, 4) AS bucket
    FROM (SELECT doc_id, unnest({cut.format('text')}) AS word FROM f)) GROUP BY bucket),
  t AS (SELECT * FROM (VALUES {values}) AS v(template, license, kind, text)),
  tw AS (SELECT template, license, kind, word, tf * (ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(n, 0))) + 1) AS w
    FROM (SELECT template, license, kind, word, count(*) AS tf FROM (SELECT template, license, kind, unnest({cut.format('text')}) AS word FROM t)
      GROUP BY ALL) LEFT JOIN df ON bucket = substr(md5(word), 1, 4)),
  tn AS (SELECT template, license, kind, word, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS w FROM tw),
  u AS (SELECT path, len({cut.format('whole')}) AS n_file, unit, {cut.format('text')} AS words
    FROM (SELECT path, text AS whole, unnest(units) AS text, generate_subscripts(units, 1) AS unit FROM (SELECT path, text,
      [string_split(start, chr(10))[1], regexp_split_to_array(start, {blank})[1], array_to_string(regexp_split_to_array(start, {blank})[1:2], chr(10))]
      || string_split(text, chr(10)) || list_filter(regexp_split_to_array(text, {blank}), lambda p: contains(p, chr(10)))
      || [text] AS units FROM (SELECT *, {start} AS start FROM f)))),
  uw AS (SELECT path, n_file, unit, n_unit, word, count(*) AS tf
    FROM (SELECT path, n_file, unit, len(words) AS n_unit, unnest(words) AS word FROM u) GROUP BY ALL),
  ui AS (SELECT path, n_file, unit, n_unit, word, tf * (ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(n, 0))) + 1) AS w
    FROM uw LEFT JOIN df ON bucket = substr(md5(word), 1, 4)),
  un AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY path, unit)) AS length FROM ui),
  c AS (SELECT path, n_file, n_unit, unit, license, kind, round(sum(un.w * tn.w) / any_value(length), 6) AS cosine
    FROM un JOIN tn USING (word) WHERE kind > {TITLE} OR unit <= 3 GROUP BY path, n_file, n_unit, unit, template, license, kind),
  own AS (SELECT path, arg_min(license, (kind, -cosine, license)) AS license, arg_min(cosine, (kind, -cosine, license)) AS cosine,
    bool_or(kind = {TITLE} OR n_unit >= {FILE_SHARE} * n_file OR regexp_matches(path, '{FILE_NAMES}')) AS is_file
    FROM c WHERE cosine >= {THRESHOLD} AND (kind > {TITLE} OR cosine >= {TITLE_THRESHOLD}) GROUP BY path),
  d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, arg_min(license, (-cosine, path)) AS license,
    arg_min(cosine, (-cosine, path)) AS cosine FROM own WHERE is_file GROUP BY 1),
  a AS (SELECT DISTINCT path, directory, d.license, d.cosine, length(directory) AS size FROM f JOIN d ON starts_with(path, directory || '/')),
  n AS (SELECT path, arg_max(directory, size) AS directory, arg_max(license, size) AS license, arg_max(cosine, size) AS cosine FROM a GROUP BY path)
SELECT f.doc_id, f.path, coalesce(own.license, n.license) AS license,
  CASE WHEN own.license IS NOT NULL AND is_file THEN 'file' WHEN own.license IS NOT NULL THEN 'own'
    WHEN n.license IS NOT NULL THEN 'inherited' END AS basis, coalesce(own.cosine, n.cosine) AS cosine,
  CASE WHEN own.license IS NULL THEN n.directory END AS directory
FROM f LEFT JOIN own ON f.path = own.path LEFT JOIN n ON f.path = n.path"""


SQL = _sql()
