import re

from lexloom.llm import license_scan as ls
from tests.llm.helpers import DOC, documents


def slow(text):
    tidy = re.sub(r"[^\w\n]+|_", " ", (text or "").lower())
    lines = [" ".join(x.split()) for x in tidy.split("\n") if x.strip()]
    known = [(n, set(ls.template_bigrams(t))) for n, t in ls.TEMPLATES]

    def best(unit):
        w = unit.split(" ")
        b = {f"{x} {y}" for x, y in zip(w, w[1:])}
        hits = [(-2 * len(b & t) / (len(b) + len(t)), n) for n, t in known if 2 * len(b & t) / (len(b) + len(t)) >= 0.8 - 1e-9]
        return min(hits, default=None)

    found = [x for x in map(best, lines) if x]
    none = (None, None)
    unit = min(found + [x for x in [best(" ".join(lines))] if x and len(lines) > 1], default=none)
    w = " ".join(lines).split(" ")
    runs = []
    for (n, t), (_, template) in zip(known, ls.TEMPLATES):
        for i in range(len(w) - 1):
            if f"{w[i]} {w[i + 1]}" in t:
                part = w[i : i + len(ls.words_of(template))]
                b = {f"{x} {y}" for x, y in zip(part, part[1:])}
                dice = 2 * len(b & t) / (len(b) + len(t))
                runs += [(-dice, n)] if dice >= 0.8 - 1e-9 else []
    run = min(runs, default=none)
    top = min([x for x in (unit, run) if x[1]], default=none)
    return len(lines), len(found), top[1], top[0] and round(-top[0], 6), bool(run[1] and (not unit[1] or run[0] < unit[0]))


TEXTS = [
    None, "", "\n\n", "plain prose without any notice at all", "Intro.\nReleased under the MIT License.\nOutro.", "released UNDER the mit   license!!", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
    "Licensed under CC BY 4.0.", "Licensed under the Apache License,\nVersion 2.0.", "This work is licensed under the GNU General Public License, version 2.", ls.TEMPLATES[7][1].replace("version 3", "version 2"),
    "All rights reserved. All rights reserved.", "x " * 500 + "\nReleased under the MIT License.", "All rights\nreserved", "Permission is hereby granted, free of charge, to any person",
    "Prose before.\n" + ls.TEMPLATES[9][1].replace(" and ", "\nand ").replace("to deal", "\nto deal") + "\nProse after it, on lines of its own.",
    "word " * 300 + ls.TEMPLATES[2][1] + " word" * 300, "some words and all rights reserved by nobody", "it ends with released under the mit", "all rights all rights reserved all rights",
    " ".join(ls.TEMPLATES[7][1].replace("modify", "change").split()[:-3]) + "\nmore", "rights reserved all\nrights", "word", "two words",
]


def test_matches_brute_force(spark):
    got = {r.doc_id: (r.n_units, r.n_notices, r.license, r.dice, r.passage) for r in ls.scan(documents(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == slow(t), t
    assert got[15][2:] == ("MIT", 1.0, True) and got[16][2:] == ("BSD-3-Clause", 1.0, True)


def test_edges(spark):
    rows = [(None, "All rights reserved.", None, None, None)] * 2
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as tidy", "2 as units", "3 as found", "4 as near", "5 as bigrams")
    assert [(r.doc_id, r.license, r.dice) for r in ls.scan(df).collect()] == [(None, "Proprietary", 1.0)] * 2
    assert ls.scan(df.limit(0)).collect() == []
