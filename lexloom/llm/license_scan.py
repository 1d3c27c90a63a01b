"""Licence scans: texts against licence templates by Dice coefficient over word bigrams.

Text is normalised (lower case, runs of anything but letters and digits become one
space). Every line of a document, and the document as a whole, is a unit; so is, for each
template, every run of as many words as the template has (fewer at the end of the text)
that begins with one of its bigrams, wherever lines break: notices wrapped over lines or
inside a longer paragraph. A unit's set of word bigrams B is compared with a template's
set T by 2 |B & T| / (|B| + |T|). As the intersection is no larger than the smaller set, a
template can only reach a threshold t if 2 min(|B|, |T|) >= t (|B| + |T|); units and
templates out of these bounds are never compared. By the same bound a unit holds
t / (2 - t) of the template's bigrams at least, so a text that holds fewer of them as a
whole is out for this template, and most texts for all.

Everything is one projection of DataFrame functions over each row: no shuffle, no join,
no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices as their licences' publishers word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("Proprietary", "All rights reserved."),
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def template_bigrams(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def fits(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return 2 * F.least(a, b) >= threshold * (a + b) - 1e-9


def _order(p: Column, q: Column) -> Column:
    """Higher Dice first, then the name."""
    later = F.when(p["name"] > q["name"], 1).otherwise(0)
    return F.when(p.dice > q.dice, -1).when(p.dice < q.dice, 1).when(p["name"] < q["name"], -1).otherwise(later)


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_units, n_notices, license, dice, passage`` of every row of ``docs``.

    ``n_units`` counts the lines with at least one word, ``n_notices`` those that reach the
    threshold for some template; ``license`` and ``dice`` are of the best template of any
    line, the whole text or a run of words (ties to the first name), null without one;
    ``passage`` tells whether only a run of words reaches that value.

    A null or empty text has no units; very long lines cost time in proportion; repeated
    rows are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    known = [(name, template_bigrams(t), len(words_of(t))) for name, t in templates]
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("b"), F.lit(n - 1).alias("run")) for name, b, n in known))
    every = F.array(*map(F.lit, sorted({x for _, b, _ in known for x in b})))
    tidy = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")

    def bigrams(line):
        return F.transform(F.array(F.split(line, " ")), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))[0]

    def dice(b, t):
        return (2 * F.size(F.array_intersect(b, t.b)) / (F.size(b) + F.size(t.b))).alias("dice")

    def best(b):
        """The best near template of a set of bigrams, by Dice and then by name."""
        fit = F.filter("near", lambda t: fits(F.size(b), F.size(t.b), threshold))
        return F.get(F.array_sort(reached(F.transform(fit, lambda t: F.struct(dice(b, t), t["name"].alias("name")))), _order), F.lit(0))

    def reached(scored):
        return F.filter(scored, lambda s: s.dice >= threshold - 1e-9)

    def notices(units):
        return F.filter(F.transform(units, lambda u: best(F.array_distinct(bigrams(u)))), lambda s: s.isNotNull())

    def passages(t):
        """Dice and name of each run of words that begins with one of the template's bigrams."""
        starts = F.filter(F.sequence(F.lit(1), F.size("bigrams")), lambda i: F.array_contains(t.b, F.get("bigrams", i - 1)))
        sets = F.filter(F.transform(starts, lambda i: F.array_distinct(F.slice("bigrams", i, t.run))), lambda b: fits(F.size(b), F.size(t.b), threshold))
        return reached(F.transform(sets, lambda b: F.struct(dice(b, t), t["name"].alias("name"))))

    none = F.array().cast("array<struct<dice:double,name:string>>")
    some = lambda found: F.when(F.size("near") > 0, found).otherwise(none)
    first = lambda found: F.get(F.array_sort(found, _order), F.lit(0))
    rows = docs.select("doc_id", tidy.alias("tidy")).select("doc_id", lines_of(F.col("tidy")).alias("units"))
    rows = rows.select("doc_id", "units", F.array_join("units", " ").alias("whole"))
    rows = rows.withColumn("bigrams", bigrams(F.col("whole"))).withColumn("held", F.array_intersect("bigrams", every))
    rows = rows.withColumn("near", F.filter(table, lambda t: F.size(F.array_intersect(t.b, "held")) >= F.size(t.b) * (threshold / (2 - threshold)) - 1e-9))
    rows = rows.withColumn("found", some(notices(F.col("units"))))
    entire = F.when(F.size("units") > 1, notices(F.array("whole"))).otherwise(none)
    rows = rows.withColumn("unit", first(F.concat("found", some(entire))))
    rows = rows.withColumn("run", first(some(F.flatten(F.transform("near", passages)))))
    higher = F.col("run").isNotNull() & (F.col("unit").isNull() | (F.col("run.dice") > F.col("unit.dice")))
    top = F.get(F.array_sort(F.array_compact(F.array("unit", "run")), _order), F.lit(0))
    return rows.select("doc_id", F.size("units").cast("long").alias("n_units"), F.size("found").cast("long").alias("n_notices"), top["name"].alias("license"), F.round(top["dice"], 6).alias("dice"), higher.alias("passage"))


def lines_of(tidy: Column) -> Column:
    """Trimmed lines of normalised text that have a word."""
    return F.filter(F.transform(F.split(tidy, "\n"), lambda x: F.trim(x)), lambda x: x != "")
