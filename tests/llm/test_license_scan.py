import re

import pytest

from readqc.llm import license_scan as L

TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "All rights reserved.", "SPDX-License-Identifier: LGPL-2.1", "ALL RIGHTS   reserved; cc_by cc by, cc-by general public license", None, "", " \t\n", "été general public licenseé", "general\x00public/license",
    "unlicence the Unlicense", "gnu lesser general public licence v 2.1 or the gnu general public license", "cc by sa 3 0 cc by sa 3 cc by", "İ cc by İ", "nothing to see here", "in the public domain, with no rights reserved",
    "licence cecill", "share CC BY " * 50,
]


def plain(text: str | None, rules=L.RULES) -> tuple:
    """The docstring word for word; every rule is tried, and every match held against every other."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    x = "".join(f" {w} " for w in words)
    found = [(x[: m.start()].count(" ") // 2, (x[: m.end()].count(" ")) // 2, r.level, -i, r) for i, r in enumerate(rules) for m in re.finditer(r.pattern, x)]
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and b[2] >= a[2] and (b[:2] != a[:2] or b[2:4] > a[2:4])
    stand = [a for a in found if not any(inside(a, b) for b in found)]
    base = [(i, label, c) for p, label, c in L.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [b[0] for b in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({b[1] for b in base})),
        ",".join(sorted({b[1] for b in base} | {a[4].label for a in stand})), max([0.0, *(b[2] for b in base), *(a[4].confidence for a in stand)]),
    )


def test_rules():
    assert len(L.RULES) > 300 and all(r.needs for r in L.RULES)
    for r in L.RULES:
        re.compile(r.pattern)


def rows(found):
    return {r["doc_id"]: tuple(r)[1:8] for r in found.collect()}


def test_against_plain(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, x string").repartition(3)
    assert rows(L.scan(docs)) == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_what_is_found(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:6])), "doc_id int, text string")
    found = {k: v[5] for k, v in rows(L.scan(docs)).items()}
    assert found == {0: "apache-2.0", 1: "mit", 2: "gpl,gpl-3.0", 3: "cc-by,cc-by-nc-4.0", 4: "reserved", 5: "lgpl-2.1"}


def test_levels_and_containment(spark):
    rules = [L.Rule("a b c d", "low", 0, 0.1), L.Rule("b c", "high", 2, 0.9), L.Rule("c d", "low2", 0, 0.2), L.Rule("b c", "same", 2, 0.5), L.Rule("d e", "partly", 0, 0.3), L.Rule("b|c", "inner", 1, 0.3)]
    rules = [r for r in rules if r.needs]
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id int, text string")
    row = L.scan(docs, rules=rules).first()
    assert row["labels"] == "high,low,partly" and [d["label"] for d in row["detections"]] == ["low", "high", "partly"]


def test_long_empty_and_repeated(spark):
    line = "Licensed under the MIT License. All rights reserved. "
    docs = spark.createDataFrame([(1, line * 5_000 + "x " * 300_000), (1, None), (None, "cc by"), (None, "cc by")], "doc_id long, text string")
    found = sorted(L.scan(docs).drop("detections").collect(), key=lambda r: (r["doc_id"] is None, r["n_words"]))
    assert [(r["doc_id"], r["n_words"], r["n_base"]) for r in found] == [(1, 0, 0), (1, 340_000, 5_000), (None, 2, 1), (None, 2, 1)]
    assert found[1]["first_word"] == 5 and found[1]["last_word"] == 39_997 and found[1]["labels"] == "mit,reserved"
    assert L.scan(docs.limit(0)).collect() == []


def test_no_shuffle_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = L.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)
    assert rows(L.scan(docs)) == {r["doc_id"]: plain(r["text"]) for r in docs.collect()}


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_column_types(spark, name):
    docs = spark.createDataFrame([("7", "cc by")], "doc_id string, text string").withColumn("words", L.F.lit(1)).withColumn("x", L.F.lit(None).cast("int"))
    assert L.scan(docs).first()["n_base"] == 1
