"""Licence scans with DataFrame functions alone: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlake.llm.lines import normalised

# Wordings of common licence notices, by SPDX-like name.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-rights-reserved", "All rights reserved."),
)


SENT = 1 << 20  # characters of templates up to which they are sent to every task; beyond it Spark shuffles or sends by its own estimate


def bigrams(text: Column) -> Column:
    """Hashes of the distinct pairs of neighbouring words of the normalised text.

    The words are bound once, as the one element of an array: a plain reference would split the text anew for every word.
    """

    def pairs(words: Column) -> Column:
        first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
        return F.array_distinct(F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1))))

    return F.get(F.transform(F.array(F.split(normalised(text), " ")), pairs), 0)


def template_table(docs: DataFrame, templates: Sequence[tuple[str, str]], percent: int) -> DataFrame:
    """(size, template, license, wanted, b): each template at every size of a text that can reach ``percent``.

    Of a bigrams against b at most min(a, b) are shared, so the coefficient 2c / (a + b) needs a between b p / (200 - p) and b (200 - p) / p.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", F.explode(F.array(bigrams(F.col("text")))).alias("wanted")).withColumn("b", F.size("wanted")).filter("b > 0")
    low = F.ceil(F.col("b") * percent / (200 - percent)).cast("int")
    high = F.floor(F.col("b") * (200 - percent) / percent).cast("int")
    return rows.withColumn("size", F.explode(F.sequence(low, high)))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, at, found): the bigrams of every line, and of every paragraph (between blank lines) of more than one line.

    They are made inside the explode, so that a filter on them does not make them again. Numbers count from 0.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    lines = F.transform(F.split("text", "\n"), bigrams)
    blocks = F.transform(F.split("text", r"\n[ \t]*\n"), lambda p: F.when(F.contains(p, F.lit("\n")), bigrams(p)))
    lined = text.select("doc_id", F.lit("line").alias("kind"), F.posexplode(lines).alias("at", "found"))
    return lined.unionByName(text.select("doc_id", F.lit("paragraph").alias("kind"), F.posexplode(blocks).alias("at", "found")))


def licence_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = 80) -> DataFrame:
    """One row per notice found: doc_id, kind, at, license, shared (bigrams), dice.

    A line or paragraph is a notice if the Dice coefficient of its distinct word bigrams and a template's is ``percent`` per cent or more; of
    several templates the one with the largest coefficient counts, of equal ones the first name. Templates are tried only on texts
    whose size can reach that. Null, empty and one-word texts hold none. A long text is one unit per line and paragraph, taken whole.
    Rows repeated come as often; a null doc_id stays null. Templates are a
    parameter; up to ``SENT`` characters of them go to every task, so that texts stay where they are.
    """
    known = template_table(docs, templates, percent)
    scanned = units(docs).withColumn("size", F.size("found")).filter("size > 0")
    if sum(len(text) for _, text in templates) <= SENT:
        known = F.broadcast(known)
    met = scanned.join(known, "size").withColumn("shared", F.size(F.array_intersect("found", "wanted")))
    near = met.filter(200 * F.col("shared") >= percent * (F.col("size") + F.col("b")))
    dice = 2.0 * F.col("shared") / (F.col("size") + F.col("b"))
    # Templates of one unit meet in its own row, so the best is found without a shuffle of units.
    best = near.select("doc_id", "kind", "at", "size", F.struct(-dice, "license", "shared", "template").alias("m"), F.hash("found").alias("h"))
    best = best.groupBy("doc_id", "kind", "at", "size", "h").agg(F.min("m").alias("m"), F.count_distinct("m.template").alias("k"), F.count(F.lit(1)).alias("n"))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / F.col("k")).cast("int")))
    out = best.withColumn("copy", copies)
    return out.select("doc_id", "kind", "at", F.col("m.license").alias("license"), F.col("m.shared").alias("shared"), (-F.col("m.col1")).alias("dice"))


def _sql() -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    norm = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH t AS (SELECT k, license, {grams} AS b FROM (SELECT k, license, string_split({norm.format("text")}, ' ') AS w
  FROM (VALUES {quoted}) AS v(k, license, text))),
u AS (SELECT doc_id, 'line' AS kind, generate_subscripts(p, 1) - 1 AS "at", unnest(p) AS unit
    FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', generate_subscripts(p, 1) - 1 AS "at", unnest(p) AS unit
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS p FROM documents)) WHERE contains(unit, chr(10))),
g AS (SELECT doc_id, kind, "at", {grams} AS a FROM (SELECT doc_id, kind, "at", string_split({norm.format("unit")}, ' ') AS w FROM u)),
m AS (SELECT doc_id, kind, "at", license, len(list_intersect(a, b)) AS shared, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice,
  row_number() OVER (PARTITION BY doc_id, kind, "at" ORDER BY 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) DESC, license, len(list_intersect(a, b)), k) AS r
  FROM g JOIN t ON 3 * len(a) >= 2 * len(b) AND 2 * len(a) <= 3 * len(b) AND len(a) > 0
  WHERE 200 * len(list_intersect(a, b)) >= 80 * (len(a) + len(b)))
SELECT doc_id, kind, CAST("at" AS INT) AS "at", license, CAST(shared AS INT) AS shared, CAST(dice AS DOUBLE) AS dice FROM m WHERE r = 1
"""


SQL = _sql()
