"""Licence scan: text units against licence templates by Dice over word bigrams. Built-in functions only.

Text is normalised (lower case, words of letters and digits). Units are a
document's lines, and its paragraphs and whole text where they have more than
one line. A template is a candidate for a unit only if the sizes of the two
bigram sets allow the threshold: dice >= t needs
size * t / (2 - t) <= template's size <= size * (2 - t) / t.
Units whose size lies in no template's bounds are dropped before their bigrams
are joined; the join (the templates' own bigrams are broadcast, a list that does
not grow with the documents) holds each template to its own bounds, and overlaps
are counted. Full licence texts are given as further templates.

Defined cases: null or empty texts and units under two words have no bigrams
and match nothing; repeated rows count their units together under one doc_id;
a null doc_id reports under null; ties between templates go to the first by
name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import once

#: Notices and short licence texts in common use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
PERCENT = 80


def normalised(text: Column) -> Column:
    """Lower case; everything but a-z, 0-9 and the other letters of the text becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(text), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " "))


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised unit, as hashes."""
    pairs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))
    return once(F.split(unit, " ", -1), lambda w: F.when(F.size(w) >= 2, pairs(w)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """licence, size, h: one row for each bigram of each template."""
    t = spark.createDataFrame(list(templates.items()), "licence string, body string")
    t = t.select("licence", bigrams(normalised(F.col("body"))).alias("b")).where("b is not null")
    return t.select("licence", F.size("b").alias("t_size"), F.explode("b").alias("h"))


def units(text: Column) -> Column:
    """Lines, then paragraphs and the whole text where those have several lines."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n", -1)
    paragraphs = F.filter(F.split(t, "\n[\\x20\\t\\r]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    several = F.contains(t, F.lit("\n"))
    # the whole text once more only if no paragraph is the whole text already
    whole = F.when(several & t.rlike("\n[\\x20\\t\\r]*\n"), F.array(t)).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, paragraphs, whole)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """doc_id, licence, units, shared, size, t_size: the best unit's figures and how many units match that licence."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    sizes = sorted(r[0] for r in table.select("t_size").distinct().collect())  # one for each template at most
    if not sizes:
        raise ValueError("no template has two words")
    fits = lambda t: ((200 - percent) * t >= percent * F.col("size")) & ((200 - percent) * F.col("size") >= percent * t)
    cut = F.filter(units(F.col("text")), lambda u: F.length(u) >= 3)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(cut).alias("pos", "unit"))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("unit_id"), bigrams(normalised(F.col("unit"))).alias("b"))
    rows = rows.withColumn("size", F.size("b")).where(F.exists(F.array(*[F.lit(t) for t in sizes]), fits))
    rows = rows.select("doc_id", "unit_id", "size", F.explode("b").alias("h"))
    found = rows.join(F.broadcast(table), "h").where(fits(F.col("t_size"))).groupBy("doc_id", "unit_id", "size", "licence", "t_size").agg(F.count(F.lit(1)).alias("shared"))
    found = found.where(200 * F.col("shared") >= percent * (F.col("size") + F.col("t_size")))
    score = F.col("shared") * 2 / (F.col("size") + F.col("t_size"))
    best = F.max(F.struct(score.alias("dice"), F.col("shared"), F.col("size"), F.col("t_size")))
    return found.groupBy("doc_id", "licence").agg(F.count(F.lit(1)).alias("units"), best.alias("best")).select("doc_id", "licence", "units", F.col("best.shared").cast("long").alias("shared"), F.col("best.size").cast("long").alias("size"), F.col("best.t_size").cast("long").alias("t_size"), F.col("best.dice").alias("dice"))
