r"""Licence scans, in DataFrame functions only.

A document is cut into lines; each line and template is normalised (ASCII letters lowered,
runs of ASCII digits to one 0, everything else but letters and digits to a space) and taken
as the set of its word bigrams.  A line carries a licence if the Dice coefficient of its
bigrams and a template's is `least` or more.  2*min(a,b)/(a+b) bounds the coefficient, so
only templates whose size lies within least/(2-least) .. (2-least)/least of the line's are
compared, and lines that no template's size allows are left out before bigrams are made.  Lines
without any of the words that every match must have (see telling_words) are left out first.

Notices inside longer lines, wrapped over lines or in texts without line breaks are passages of
the whole normalised text: windows of a template's number of bigrams are compared with it in the
same way, but for those that the next window is sure to equal (see passages).

The templates are a fixed table in this module: it is broadcast, and doesn't grow with data.

Defined results: null and empty texts have no lines and no match; a line of one word has that
word as its only gram; repeated lines are counted each, passages are not counted; a line's best template is the one of
the highest coefficient, then of the smallest name; a
document's best has the highest coefficient, at equal ones a line goes before a passage, then a
passage of a larger template before others, then the smallest name; documents without a match appear with
null licence; repeated rows appear each; an empty table gives no row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_or_empty

LEAST = 0.6
COMMON = {"a", "and", "are", "at", "by", "for", "in", "is", "it", "of", "or", "that", "the", "this", "to", "with", "you"}

# Notices by which works commonly name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-notice": "Released under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normalised(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[0-9]+", "0"), r"[^\p{L}0-9]+", " "))


def bigrams(plain: Column) -> Column:
    """Set of word bigrams of a normalised text; of a single word, that word."""
    words = F.split(plain, " ", -1)
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(plain == "", F.array().cast("array<string>")).when(n == 1, words).otherwise(F.array_distinct(pairs))


def telling_words(known: dict[str, str], least: float) -> str:
    """A pattern that any line with a licence matches.

    A coefficient of `least` takes least/(2-least) of a template's bigrams to be in the line.
    Words are chosen, longest first and COMMON ones last, until the bigrams without any of them are fewer: then the
    line has one of the words, literally but for the case of ASCII letters."""
    chosen: set[str] = set()
    for wording in known.values():
        words = re.sub(r"[^a-z0-9]+", " ", re.sub("[0-9]+", "0", wording.lower())).split()
        grams = set(zip(words, words[1:])) if len(words) > 1 else {(words[0],)}
        for w in sorted({w for w in words if w.isalpha()}, key=lambda w: (w in COMMON, -len(w), w)):
            if len([g for g in grams if not chosen & set(g)]) < least / (2 - least) * len(grams):
                break
            chosen.add(w)
        else:
            if len([g for g in grams if not chosen & set(g)]) >= least / (2 - least) * len(grams):
                return "(?s).*"  # a template without enough plain words: any line may have it
    return "(?i)(?<![a-z])(?:" + "|".join(sorted(chosen)) + ")(?![a-z])"


def templates(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    """(licence, wording, t_grams, t_size)"""
    rows = spark.createDataFrame(sorted(known.items()), "licence string, wording string")
    return rows.select("licence", "wording", bigrams(normalised(F.col("wording"))).alias("t_grams")).withColumn("t_size", F.size("t_grams"))


def matches(docs: DataFrame, least: float = LEAST, known: dict[str, str] | None = None) -> DataFrame:
    """(row, line_no, licence, dice) for every line and template at `least` or more; docs has
    columns row and text."""
    spark = docs.sparkSession
    wanted = templates(spark, known or TEMPLATES).drop("wording")
    low, high = least / (2 - least), (2 - least) / least
    reach = wanted.agg(F.min("t_size").alias("lo"), F.max("t_size").alias("hi")).first()
    telling = telling_words(known or TEMPLATES, least)
    lines = docs.where(F.col("text").rlike(telling)).select("row", F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("line_no", "line"))
    # A set of bigrams is no larger than the number of blanks in a normalised line (or one).
    plain = lines.where(F.col("line").rlike(telling)).select("row", "line_no", normalised(F.col("line")).alias("plain")).where("plain <> ''")
    plain = plain.where(F.greatest(F.length("plain") - F.length(F.translate("plain", " ", "")), F.lit(1)) >= reach["lo"] * low)
    grams = plain.select("row", "line_no", bigrams(F.col("plain")).alias("grams")).withColumn("size", F.size("grams")).where(F.col("size").between(reach["lo"] * low, reach["hi"] * high))
    # Broadcast: the template table is fixed in this module.
    near = grams.join(F.broadcast(wanted), (F.col("t_size") >= F.col("size") * low) & (F.col("t_size") <= F.col("size") * high))
    dice = 2.0 * F.size(F.array_intersect("grams", "t_grams")) / (F.col("size") + F.col("t_size"))
    return near.select("row", "line_no", "licence", dice.alias("dice")).where(F.col("dice") >= least)


def passages(rows: DataFrame, least: float, known: dict[str, str]) -> DataFrame:
    """(row, licence, t_size, dice) of the best window of each text and template, at `least` or more."""
    spark = rows.sparkSession
    wanted = templates(spark, known).withColumn("t_places", F.greatest(F.size(F.split(normalised(F.col("wording")), " ", -1)) - 1, F.lit(1))).drop("wording")
    low = least / (2 - least)
    # By number: little text, much work, so splits by bytes would leave few tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = rows.where("text is not null").repartition(parts, "row")
    plain = held.select("row", normalised(F.col("text")).alias("plain")).where("plain <> ''")
    words = plain.select("row", F.split("plain", " ", -1).alias("w"))
    n = F.size("w")
    pairs = F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
    grams = words.select("row", F.when(n == 1, F.col("w")).otherwise(pairs).alias("g")).withColumn("own", F.array_distinct("g"))
    # Broadcast: the template table is fixed in this module.
    near = grams.join(F.broadcast(wanted), F.size(F.array_intersect("own", "t_grams")) >= F.col("t_size") * low)
    # A window whose first bigram is neither the template's nor met again inside it loses one
    # bigram and no hit by moving on, and gains one at most: the next one's coefficient is no less.
    again = lambda k: F.array_contains(F.slice(F.col("g"), k + 1, F.col("t_places") - 1), F.element_at("g", k))
    starts = F.filter(F.sequence(F.lit(1), F.size("g")), lambda k: F.array_contains(F.col("t_grams"), F.element_at("g", k)) | again(k))

    def dice(k: Column) -> Column:
        window = F.array_distinct(F.slice(F.col("g"), k, F.col("t_places")))
        return 2.0 * F.size(F.array_intersect(window, F.col("t_grams"))) / (F.size(window) + F.col("t_size"))

    return near.select("row", "licence", "t_size", F.array_max(F.transform(starts, dice)).alias("dice")).where(F.col("dice") >= least)


def scan(docs: DataFrame, least: float = LEAST, known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licence, dice (of the best line or passage), licence_lines (lines with a match) for every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # Staged with the texts that may match alone, so that a row keeps its number.
    rows = stage(rows.withColumn("text", F.when(F.col("text").rlike(telling_words(known or TEMPLATES, least)), F.col("text"))), "licence-rows")
    best = matches(rows, least, known).groupBy("row", "line_no").agg(F.max("dice").alias("dice"), F.collect_list(F.struct("dice", "licence")).alias("all"))
    # At most one entry a template is collected for a line.
    best = best.select("row", F.lit(0).alias("t_size"), "dice", F.array_min(F.transform(F.filter("all", lambda x: x["dice"] == F.col("dice")), lambda x: x["licence"])).alias("licence"), F.lit(True).alias("line"))
    more = passages(rows, least, known or TEMPLATES).withColumn("line", F.lit(False))
    order = F.struct((-F.col("dice")).alias("d"), (~F.col("line")).alias("passage"), (-F.col("t_size")).alias("smaller"), "licence")
    found = best.unionByName(more).groupBy("row").agg(F.min(order).alias("top"), F.count(F.when(F.col("line"), 1)).alias("licence_lines"))
    out = rows.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", F.col("top.licence").alias("licence"), F.round(-F.col("top.d"), 6).alias("dice"), F.coalesce("licence_lines", F.lit(0)).cast("long").alias("licence_lines"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(least: float = LEAST, known: dict[str, str] | None = None) -> str:
    """DuckDB SQL for op4_licence_scan: every line against every template, no pruning."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted((known or TEMPLATES).items()))
    plain = lambda x: f"trim(regexp_replace(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^\\p{{L}}0-9]+', ' ', 'g'))"
    grams = "CASE WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END"
    return f"""
WITH t AS (SELECT licence, {grams} AS g FROM (SELECT licence, string_split({plain('wording')}, ' ') AS w FROM (VALUES {rows}) v(licence, wording))),
l AS (SELECT doc_id, line_no, {grams} AS g FROM (
  SELECT doc_id, line_no, string_split(p, ' ') AS w FROM (
    SELECT doc_id, line_no, {plain('line')} AS p FROM (
      SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS line_no
      FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS x FROM documents))) WHERE p <> '')),
m AS (SELECT doc_id, line_no, licence, 2.0 * len(list_intersect(l.g, t.g)) / (len(l.g) + len(t.g)) AS dice FROM l, t),
b AS (SELECT doc_id, line_no, licence, dice FROM m WHERE dice >= {least}
      QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, licence) = 1),
r AS (SELECT doc_id, licence, dice, count(*) OVER (PARTITION BY doc_id) AS n,
             row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, licence) AS k FROM b)
SELECT d.doc_id, r.licence, round(CAST(r.dice AS DOUBLE), 6) AS dice, CAST(coalesce(r.n, 0) AS BIGINT) AS licence_lines
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.k = 1
"""
