"""Operator 11: licence scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased (A-Z) and cut into words, and every word is written between two spaces, so that a rule is a regular
expression over whole words. Rules come from families of licences (title, short names, versions, web address) and forms in
which these are named: identifier lines, addresses, titles, grants, notices; several hundred rules. Each has a level (how much it
says), a confidence and keywords, the words that every match has. Keywords are sought first, by hash, and only rules whose
keywords are all there are tried on a text.
A match inside another one of a higher level, or of the same level, is suppressed; of two on the same words the higher level,
then the earlier rule stays. A match around another of a higher level suppresses nothing, and both stay.

The base phrases are counted wherever their words stand, whatever the rules say, and their labels always stay.
All of this happens inside a row: no shuffle, no join.

Defined results: null text: empty; a text without words: zeros, no places (null), empty labels, score 0; repeated rows and
null ids are rows of their own; extra columns are ignored; no document: no row. score is the highest confidence
of what was found, base phrases included (BASE), else 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is no word, in either case.
BLANK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrase, label, confidence.
BASE = (("cc by", "cc-by", 0.7), ("general public license", "gpl", 0.8), ("all rights reserved", "reserved", 0.4))

# Public names of licences. Identifier, titles, short names, versions, words of the web address.
FAMILIES = (
    ("gpl", ("gnu general public licen[sc]e", "gnu gpl"), ("gpl", "gnu general public licen[sc]e"), ("1 0", "2 0", "3 0"), "gnu org licen[sc]es gpl"),
    ("lgpl", ("gnu lesser general public licen[sc]e", "gnu library general public licen[sc]e", "gnu lgpl"), ("lgpl", "lesser gpl"), ("2 0", "2 1", "3 0"), "gnu org licen[sc]es lgpl"),
    ("agpl", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "gnu agpl"), ("agpl", "affero gpl"), ("1 0", "3 0"), "gnu org licen[sc]es agpl"),
    ("gfdl", ("gnu free documentation licen[sc]e", "free documentation licen[sc]e"), ("gfdl", "gnu fdl"), ("1 1", "1 2", "1 3"), "gnu org licen[sc]es fdl"),
    ("apache", ("apache licen[sc]e", "apache software licen[sc]e"), ("apache licen[sc]e", "asl"), ("1 0", "1 1", "2 0"), "apache org licen[sc]es licen[sc]e"),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "x11 licen[sc]e"), ("mit licen[sc]e", "mit"), (), "opensource org licen[sc]es mit"),
    ("bsd-2-clause", ("bsd 2 clause licen[sc]e", "simplified bsd licen[sc]e", "freebsd licen[sc]e"), ("bsd 2 clause", "two clause bsd"), (), "opensource org licen[sc]es bsd 2 clause"),
    ("bsd-3-clause", ("bsd 3 clause licen[sc]e", "new bsd licen[sc]e", "modified bsd licen[sc]e"), ("bsd 3 clause", "three clause bsd"), (), "opensource org licen[sc]es bsd 3 clause"),
    ("bsd", ("bsd licen[sc]e", "berkeley software distribution licen[sc]e"), ("bsd", "bsd licen[sc]e"), (), "opensource org licen[sc]es bsd licen[sc]e"),
    ("mpl", ("mozilla public licen[sc]e",), ("mpl",), ("1 0", "1 1", "2 0"), "mozilla org mpl"),
    ("epl", ("eclipse public licen[sc]e",), ("epl",), ("1 0", "2 0"), "eclipse org legal epl"),
    ("cddl", ("common development and distribution licen[sc]e",), ("cddl",), ("1 0", "1 1"), "opensource org licen[sc]es cddl"),
    ("cpl", ("common public licen[sc]e",), ("common public licen[sc]e",), ("0 5", "1 0"), "opensource org licen[sc]es cpl"),
    ("eupl", ("european union public licen[sc]e",), ("eupl",), ("1 0", "1 1", "1 2"), "joinup ec europa eu eupl"),
    ("artistic", ("artistic licen[sc]e", "perl artistic licen[sc]e"), ("artistic licen[sc]e",), ("1 0", "2 0"), "opensource org licen[sc]es artistic licen[sc]e"),
    ("bsl", ("boost software licen[sc]e",), ("boost licen[sc]e",), ("1 0",), "boost org licen[sc]e"),
    ("isc", ("isc licen[sc]e", "internet systems consortium licen[sc]e"), ("isc licen[sc]e",), (), "opensource org licen[sc]es isc"),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ("zlib licen[sc]e",), (), "opensource org licen[sc]es zlib"),
    ("unlicense", ("the unlicen[sc]e", "unlicen[sc]e"), ("unlicen[sc]e",), (), "unlicen[sc]e org"),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e",), ("wtfpl",), ("1 0", "2 0"), "wtfpl net"),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("ofl",), ("1 0", "1 1"), "scripts sil org ofl"),
    ("psf", ("python software foundation licen[sc]e", "psf licen[sc]e agreement"), ("psf licen[sc]e",), ("2 0",), "python org psf licen[sc]e"),
    ("php", ("php licen[sc]e",), ("php licen[sc]e",), ("3 0", "3 01"), "php net licen[sc]e"),
    ("ruby", ("ruby licen[sc]e",), ("ruby licen[sc]e",), (), "ruby lang org en about licen[sc]e"),
    ("afl", ("academic free licen[sc]e",), ("academic free licen[sc]e",), ("1 1", "2 1", "3 0"), "opensource org licen[sc]es afl"),
    ("osl", ("open software licen[sc]e",), ("open software licen[sc]e",), ("1 0", "2 1", "3 0"), "opensource org licen[sc]es osl"),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e"), ("ncsa licen[sc]e",), (), "opensource org licen[sc]es ncsa"),
    ("odbl", ("open database licen[sc]e", "odc open database licen[sc]e"), ("odbl",), ("1 0",), "opendatacommons org licen[sc]es odbl"),
    ("odc-by", ("open data commons attribution licen[sc]e",), ("odc by",), ("1 0",), "opendatacommons org licen[sc]es by"),
    ("pddl", ("public domain dedication and licen[sc]e",), ("pddl",), ("1 0",), "opendatacommons org licen[sc]es pddl"),
    ("ms-pl", ("microsoft public licen[sc]e",), ("ms pl",), (), "opensource org licen[sc]es ms pl"),
    ("ms-rl", ("microsoft reciprocal licen[sc]e",), ("ms rl",), (), "opensource org licen[sc]es ms rl"),
    ("upl", ("universal permissive licen[sc]e",), ("universal permissive licen[sc]e",), ("1 0",), "oss oracle com licen[sc]es upl"),
    ("ecl", ("educational community licen[sc]e",), ("educational community licen[sc]e",), ("1 0", "2 0"), "opensource org licen[sc]es ecl"),
    ("cecill", ("cecill free software licen[sc]e agreement", "licence cecill"), ("cecill",), ("1 0", "2 0", "2 1"), "cecill info licen[sc]es"),
    ("busl", ("business source licen[sc]e",), ("business source licen[sc]e",), ("1 1",), "mariadb com bsl11"),
    ("sspl", ("server side public licen[sc]e",), ("sspl",), ("1",), "mongodb com licen[sc]ing server side public licen[sc]e"),
    ("elastic", ("elastic licen[sc]e",), ("elastic licen[sc]e",), ("1 0", "2 0"), "elastic co licen[sc]ing elastic licen[sc]e"),
    ("openrail", ("creativeml open rail m licen[sc]e", "open responsible ai licen[sc]e", "bigscience rail licen[sc]e"), ("openrail", "open rail m"), ("1 0",), "bigscience huggingface co openrail"),
    ("cc0", ("creative commons zero", "cc0 universal", "cc zero"), ("cc0", "cc zero"), ("1 0",), "creativecommons org publicdomain zero"),
)
# Conditions of Creative Commons licences as codes and in full, and versions.
CONDITIONS = (
    ("by", ("attribution",)), ("by sa", ("attribution sharealike", "attribution share alike")), ("by nc", ("attribution noncommercial", "attribution non commercial")),
    ("by nd", ("attribution noderiv(?:ative)?s", "attribution no deriv(?:ative)?s")), ("by nc sa", ("attribution noncommercial sharealike", "attribution non commercial share alike")),
    ("by nc nd", ("attribution noncommercial noderiv(?:ative)?s", "attribution non commercial no deriv(?:ative)?s")),
)
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Notices, most of which name no licence. Words, label, level, confidence.
NOTICES = (
    ("copyright ?c [0-9]{4}", "copyright", 1, 0.4), ("copyright holders?", "copyright", 0, 0.3), ("copyright notice", "copyright", 0, 0.3),
    ("protected by copyright", "copyright", 1, 0.4), ("dedicated to the public domain", "public-domain", 2, 0.9), ("released in|into|to the public domain", "public-domain", 2, 0.9),
    ("public domain mark", "public-domain", 2, 0.9), ("in the public domain", "public-domain", 1, 0.6), ("proprietary and confidential", "proprietary", 2, 0.7),
    ("proprietary licen[sc]e", "proprietary", 2, 0.7), ("commercial licen[sc]e", "commercial", 1, 0.5), ("for noncommercial use only", "non-commercial", 2, 0.7), ("for non commercial use only", "non-commercial", 2, 0.7),
    ("for personal use only", "personal-use", 1, 0.5), ("end user licen[sc]e agreement", "eula", 2, 0.7), ("licen[sc]e agreement", "license-text", 0, 0.3),
    ("see the licen[sc]e file", "license-text", 0, 0.3), ("terms of this|the licen[sc]e", "license-text", 0, 0.3), ("licen[sc]ed under", "license-text", 0, 0.2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 2, 0.9), ("permission to use copy modify and or distribute this software for any purpose", "isc", 2, 0.9),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 2, 0.9), ("neither the name of", "bsd-3-clause", 1, 0.5),
    ("provided as is without warranty of any kind", "warranty-disclaimer", 1, 0.3), ("without any warranty", "warranty-disclaimer", 0, 0.3), ("you may not use this file except in compliance with the licen[sc]e", "apache", 2, 0.9),
    ("this program is free software you can redistribute it", "gpl", 2, 0.8), ("altered source versions must be plainly marked as such", "zlib", 2, 0.9), ("no rights reserved", "cc0", 1, 0.5),
    ("some rights reserved", "creative-commons", 1, 0.5), ("all wrongs reserved", "copyleft", 0, 0.3), ("creative commons", "creative-commons", 0, 0.4), ("unsplash licen[sc]e", "unsplash", 2, 0.8),
    ("used with permission", "permission", 0, 0.3), ("reproduced with|by permission", "permission", 0, 0.3), ("do not copy|distribute|redistribute", "restricted", 0, 0.3),
    ("may not be copied|reproduced|distributed|redistributed", "restricted", 1, 0.4), ("confidential do not distribute", "restricted", 1, 0.5), ("crown copyright", "crown-copyright", 2, 0.7),
    ("open government licen[sc]e", "ogl", 2, 0.9), ("open source licen[sc]e", "open-source", 0, 0.3), ("free software licen[sc]e", "open-source", 0, 0.3), ("royalty free licen[sc]e", "royalty-free", 1, 0.5),
)


#: How a licence is granted.
GRANT = "licen[sc]ed|released|distributed|published|available under ?the ?terms ?of ?the"


@dataclass(frozen=True)
class Rule:
    """words: a pattern for each word, apart by spaces; ? before a word: it may be missing (never the first). level: 3
    identifiers and addresses, 2 titles with version and grants, 1 titles and notices, 0 hints."""

    words: str
    label: str
    level: int
    confidence: float

    @property
    def pattern(self) -> str:
        """Over words that stand between two spaces each; group 1 is the match without the outer ones."""
        first, *more = self.words.split(" ")
        word = lambda w: f"(?:{w})" if "|" in w else w
        return f" ({word(first)}{''.join(f'(?:  {word(w[1:])})?' if w[0] == '?' else f'  {word(w)}' for w in more)}) "

    @property
    def needs(self) -> tuple[str, ...]:
        """Keywords: the plain words that every match has, licences written with s."""
        return tuple(dict.fromkeys(w for w in self.words.replace("[sc]", "s").replace("licenc", "licens").split(" ") if w.isalnum()))

    @property
    def anchor(self) -> str:
        return max(self.needs, key=len)


def _version(v: str) -> str:
    """2 0 may stand as 2."""
    return f"{v[:-2]} ?0" if v.endswith(" 0") else v


def rules() -> list[Rule]:
    """All rules in order."""
    out = []
    for name, titles, shorts, versions, address in FAMILIES:
        spdx = name.replace("-", " ")
        numbered = [(_version(v), f"{name}-{v.replace(' ', '.')}") for v in versions]
        out += [Rule(f"spdx licen[sc]e identifier {spdx} {v}", label, 3, 1.0) for v, label in numbered]
        out.append(Rule(f"spdx licen[sc]e identifier {spdx}", name, 3, 1.0))
        out += [Rule(f"{address} {v}", label, 3, 0.95) for v, label in numbered]
        out.append(Rule(address, name, 3, 0.9))
        out += [Rule(f"{GRANT} {s} ?version|v {v}", label, 2, 0.95) for s, (v, label) in product(shorts, numbered)]
        out += [Rule(f"{t} ?version|v {v}", label, 2, 0.95) for t, (v, label) in product(titles, numbered)]
        out += [Rule(f"{GRANT} {s}", name, 2, 0.9) for s in shorts]
        out += [Rule(t, name, 1, 0.8) for t in titles]
    for code, full in CONDITIONS:
        name = f"cc-{code.replace(' ', '-')}"
        for v in CC_VERSIONS:
            label = f"{name}-{v.replace(' ', '.')}"
            out += [Rule(f"spdx licen[sc]e identifier cc {code} {v}", label, 3, 1.0), Rule(f"creativecommons org licen[sc]es {code} {v}", label, 3, 0.95)]
            out += [Rule(f"{GRANT} cc {code} {v}", label, 2, 0.95), Rule(f"cc {code} {v}", label, 2, 0.95)]
            out += [Rule(f"creative commons {x} {v}", label, 2, 0.95) for x in full]
        out += [Rule(f"creativecommons org licen[sc]es {code}", name, 3, 0.9), Rule(f"cc {code}", name, 1, 0.7)]
        out += [Rule(f"creative commons {x}", name, 1, 0.7) for x in full]
    return out + [Rule(*x) for x in NOTICES]


RULES = rules()
LEVELS = 4
_RULE = "array<struct<at:int,pattern:string,needs:array<string>,level:int>>"
_HIT = "array<struct<start:int,before:int,under:int,at:int>>"
_START, _END = "\x01", "\x02"


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def spans(x: Column, pattern: Column) -> Column:
    """array<struct<start, end>> of a pattern's matches, in words from 0; end is the word after the last."""
    marked = F.regexp_replace(x, pattern, F.lit(f" {_START}$1{_END} "))
    words = F.split(F.trim(marked), "  ")
    places = lambda has, shift: F.filter(F.transform(words, lambda w, i: F.when(has(w), i + shift)), lambda i: i.isNotNull())
    found = F.arrays_zip(places(lambda w: w.startswith(_START), 0).alias("start"), places(lambda w: w.endswith(_END), 1).alias("end"))
    return F.when(F.contains(marked, F.lit(_START)), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def kept(hits: Column) -> Column:
    """Numbers of the rules that have a match inside no other one of their level or above. hits: array of (start, -end, -level, rule)."""
    start = F.struct(*(F.lit(-1).alias(f"m{i}") for i in range(LEVELS)), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, h: Column) -> Column:
        end, level = -h["before"], -h["under"]
        reach = F.element_at(F.array(*(a[f"m{i}"] for i in range(LEVELS))), level + 1)
        new = F.when((reach >= end) | F.array_contains(a["kept"], h["at"]), a["kept"]).otherwise(F.array_append(a["kept"], h["at"]))
        return F.struct(*(F.when(level >= i, F.greatest(a[f"m{i}"], end)).otherwise(a[f"m{i}"]).alias(f"m{i}") for i in range(LEVELS)), new.alias("kept"))

    return F.aggregate(F.array_sort(hits), start, step)["kept"]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row, and detections: array of
    (label, level, confidence), the rules that stand, in their order."""
    listed = _constant([{"at": i, "pattern": r.pattern, "needs": list(r.needs), "level": r.level} for i, r in enumerate(rules)], _RULE)
    told = _constant([{"label": r.label, "level": r.level, "confidence": r.confidence} for r in rules], "array<struct<label:string,level:int,confidence:double>>")
    needed = {w for r in rules for w in r.needs}
    anchors = sorted({r.anchor for r in rules} | {max(phrase.split(" "), key=len) for phrase, *_ in BASE})
    written = lambda words: _constant(sorted({w.replace("licens", x) for w in words for x in ("licens", "licenc")}), "array<string>")
    blank = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), BLANK, "  "))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.concat(F.lit(" "), blank, F.lit(" ")).alias("x"))  # two spaces: no word
    rows = rows.select("doc_id", "x", F.split(F.trim(F.lower("x")), "  ").alias("words"))
    rows = rows.select("doc_id", "x", F.when(F.col("x") == "  ", 0).otherwise(F.size("words")).cast("long").alias("n_words"), "words", F.arrays_overlap("words", written(anchors)).alias("anchored"))
    keys = F.transform(F.array_intersect("words", written(needed)), lambda w: F.replace(w, F.lit("licenc"), F.lit("licens")))
    rows = rows.select("doc_id", "n_words", F.when(F.col("anchored"), keys).alias("keys"), F.when(F.col("anchored"), F.translate("x", UPPER, LOWER)).alias("x"))
    none = F.array().cast(_HIT)
    tried = F.filter(listed, lambda r: F.size(F.array_except(r["needs"], F.col("keys"))) == 0)
    hit = lambda r, s: F.struct(s["start"].alias("start"), (-s["end"]).alias("before"), (-r["level"]).alias("under"), r["at"].alias("at"))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(spans(F.col("x"), r["pattern"]), lambda s: hit(r, s))))
    places = [F.when(F.contains("x", F.lit(f" {phrase.replace(' ', '  ')} ")), F.transform(spans(F.col("x"), F.lit(Rule(phrase, "", 0, 0).pattern)), lambda s: s["start"])) for phrase, *_ in BASE]
    places = [F.coalesce(p, F.array().cast("array<int>")).alias(f"base{i}") for i, p in enumerate(places)]
    rows = rows.select("doc_id", "n_words", F.when(F.col("keys").isNotNull(), hits).otherwise(none).alias("hits"), *places)
    base = [F.col(f"base{i}") for i in range(len(BASE))]
    rows = rows.select("doc_id", "n_words", *base, F.transform(F.array_sort(kept(F.col("hits"))), lambda i: F.element_at(told, i + 1)).alias("detections"))
    labels = F.array_compact(F.array(*(F.when(F.size(b) > 0, F.lit(label)) for b, (_, label, _) in zip(base, BASE))))
    sure = F.array_compact(F.concat(F.array(F.lit(0.0), *(F.when(F.size(b) > 0, F.lit(c)) for b, (*_, c) in zip(base, BASE))), F.transform("detections", lambda d: d["confidence"])))
    every = F.array_sort(F.array_distinct(F.concat(labels, F.transform("detections", lambda d: d["label"]))))
    return rows.select(
        "doc_id",
        "n_words",
        sum((F.size(b) for b in base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.concat(*base)).cast("long").alias("first_word"),
        F.array_max(F.concat(*base)).cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.array_max(sure).alias("score"),
        "detections",
    )


def oracle(rules: list[Rule] = RULES) -> str:
    """The same without detections, in DuckDB's SQL: every rule on every text, matches held against each other pair by pair."""
    own = ", ".join(f"({i}, '{r.pattern}', '{r.label}', {r.level}, {r.confidence})" for i, r in enumerate(rules))
    base = ", ".join(f"({-1 - i}, '{Rule(p, '', 0, 0).pattern}', '{label}', -1, {c})" for i, (p, label, c) in enumerate(BASE))
    place = "list_filter(list_transform(w, lambda v, i: CASE WHEN {} THEN i - 1 END), lambda v: v IS NOT NULL)"
    return f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BLANK}', '  ', 'g')) AS t FROM documents),
x AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, '  ')) END::BIGINT AS n_words, concat(' ', t, ' ') AS x FROM d),
rules AS (SELECT * FROM (VALUES {own}, {base}) AS r(ord, pattern, label, lev, conf)),
m AS (SELECT doc_id, ord, label, lev, conf, string_split(trim(regexp_replace(x, pattern, concat(' ', chr(1), '\1', chr(2), ' '), 'g')), '  ') AS w FROM x JOIN rules ON regexp_matches(x, pattern)),
s AS (SELECT doc_id, ord, label, lev, conf, unnest({place.format("starts_with(v, chr(1))")}) AS a, unnest({place.format("ends_with(v, chr(2))")}) + 1 AS b FROM m),
inside AS (SELECT DISTINCT s.doc_id, s.ord, s.a FROM s JOIN s o ON s.doc_id = o.doc_id AND s.lev >= 0 AND o.lev >= s.lev AND o.a <= s.a AND o.b >= s.b AND (o.a, o.b) <> (s.a, s.b)
  UNION SELECT s.doc_id, s.ord, s.a FROM s JOIN s o ON s.doc_id = o.doc_id AND s.lev >= 0 AND o.a = s.a AND o.b = s.b AND (o.lev > s.lev OR o.lev = s.lev AND o.ord < s.ord)),
f AS (SELECT s.doc_id, count(*) FILTER (lev < 0) AS n_base, min(a) FILTER (lev < 0) AS first_word, max(a) FILTER (lev < 0) AS last_word,
  list_sort(list_distinct(list(label) FILTER (lev < 0))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, max(conf) AS score
  FROM s ANTI JOIN inside i ON s.doc_id = i.doc_id AND s.ord = i.ord AND s.a = i.a GROUP BY s.doc_id)
SELECT doc_id, n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM x LEFT JOIN f USING (doc_id)
"""
