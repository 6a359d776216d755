"""Licence scan: word bigrams compared with templates by the Dice coefficient. DataFrame functions only.

A text is cut into blocks at empty lines, and blocks into lines. Every line, and
every block of several lines, is compared with all templates whose size allows the
wanted likeness: with Dice d, sizes differ by a factor of at most (2 - d) / d.
Sizes are word counts, known before any bigram is formed; candidates are found by a
join on them. The table of sizes depends on the templates alone.

Bigrams are bags: the second "the software" of a passage only meets a second one in
the template. They include the first word with a mark for the beginning and the
last with one for the end.

Defined cases: a missing or empty text has no finding; passages without words are
passed over; repeated rows give their findings once each; of templates of equal
likeness the first by name is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: short notices by which texts name their licence
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
    "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
    "and limitations under the License.",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Released under the ISC License.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall "
    "be included in all copies or substantial portions of the Software.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_BEGIN, _END = "<", ">"


def words_of(passage: Column) -> Column:
    return F.array_remove(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"), "")


def bigrams_of(words: Column) -> Column:
    framed = F.concat(F.array(F.lit(_BEGIN)), words, F.array(F.lit(_END)))
    return F.zip_with(F.slice(framed, 1, F.size(framed) - 1), F.slice(framed, 2, F.size(framed) - 1),
                      lambda a, b: F.concat(a, F.lit(" "), b))


def numbered(pairs: str) -> Column:
    """The bigrams of a column, each with the number of equal ones before it."""
    return F.transform(pairs, lambda x, i: F.concat(
        x, F.lit(" "), F.size(F.filter(F.slice(pairs, 1, i), lambda y: y == x)).cast("string")))


def template_table(spark: SparkSession, templates: dict[str, str], least: float) -> DataFrame:
    """For each number of bigrams ``n``: the templates that can reach ``least`` with it, and all their words."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, passage string")
    rows = rows.withColumn("words", words_of(F.col("passage"))).withColumn("pairs", bigrams_of(F.col("words")))
    rows = rows.withColumn("bigrams", numbered("pairs")).withColumn("size", F.size("pairs")).withColumn(
        "repeats", F.col("size") - F.size(F.array_distinct("pairs")))
    low = F.ceil(F.col("size") * least / (2 - least) - 1e-9).cast("int")
    high = F.floor(F.col("size") * (2 - least) / least + 1e-9).cast("int")
    return rows.select("*", F.explode(F.sequence(low, high)).alias("n")).groupBy("n").agg(
        F.sort_array(F.collect_list(F.struct("name", "size", "repeats", "pairs", "bigrams"))).alias("candidates"),
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("vocabulary"))


def _kept(value: Column, test) -> Column:
    """``value`` as a generated row if it passes: formed once, unlike a filter that is pushed below its column."""
    return F.explode(F.filter(F.array(value), test))


def scan_licenses(docs: DataFrame, *, text: str = "text", id_column: str = "doc_id", templates: dict[str, str] | None = None,
                  least: float = 0.8) -> DataFrame:
    """One row per finding: id, ``block`` and ``line`` (numbers from 0; line -1: the whole block), ``license`` and ``dice``."""
    table = template_table(docs.sparkSession, templates or TEMPLATES, least)
    smallest, largest = table.agg(F.min("n"), F.max("n")).first()
    blocks = docs.select(F.col(id_column).alias("id"), F.posexplode(F.split(text, r"\n[ \t\r]*\n")).alias("block", "passage")).select(
        "id", "block", F.transform(F.split("passage", "\n"), words_of).alias("lines"))
    whole = F.filter(F.array(F.struct(F.lit(-1).alias("line"), F.flatten("lines").alias("words"))), lambda u: F.size("lines") > 1)
    units = F.concat(F.transform("lines", lambda w, i: F.struct(i.alias("line"), w.alias("words"))), whole)
    fitting = F.filter(units, lambda u: (F.size(u["words"]) > 0) & F.size(u["words"]).between(smallest - 1, largest - 1))
    sized = blocks.select("id", "block", F.explode(fitting).alias("u")).select(
        "id", "block", "u.line", "u.words", (F.size("u.words") + 1).alias("n"))
    # a common bigram has a word of the template
    near = sized.join(F.broadcast(table), "n").where(F.arrays_overlap("words", "vocabulary")).withColumn("pairs", bigrams_of(F.col("words")))
    # bags share at most what sets share and the template's repeats
    able = F.filter("candidates", lambda c: 2.0 * (F.size(F.array_intersect("pairs", c["pairs"])) + c["repeats"])
                    >= least * (F.col("n") + c["size"]) - 1e-9)
    near = near.select("id", "block", "line", "n", _kept(F.struct(able.alias("able"), "pairs"), lambda x: F.size(x["able"]) > 0).alias("x"))
    near = near.select("id", "block", "line", "n", "x.able", "x.pairs").withColumn("bigrams", numbered("pairs"))
    dice = F.transform("able", lambda c: F.struct(
        (2.0 * F.size(F.array_intersect("bigrams", c["bigrams"])) / (F.col("n") + c["size"])).alias("dice"), c["name"].alias("name")))
    best = F.reduce(dice, F.struct(F.lit(0.0).alias("dice"), F.lit(None).cast("string").alias("name")),
                    lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a))
    return near.select("id", "block", "line", _kept(best, lambda b: b["dice"] >= least).alias("best")).select(
        F.col("id").alias(id_column), F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"),
        F.col("best.name").alias("license"), F.col("best.dice").alias("dice"))
