"""Insertions, deletions and mismatches of an alignment in closed form: array expressions on CIGAR and MD, and the
same as small helpers for one read (mismatches_of, gaps_of), which the profiles call on Arrow batches.

Positions count the read's aligned bases (M = X I) in sequencing direction, from 0. No gapped string is
built: an event's place follows from running sums over the operations.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from readqc.functions.reads import sum_ops

# Patterns of the public SAM format.
_MD, _CIGAR = re.compile(r"([0-9]+)|(\^[A-Za-z]+)|([A-Za-z])"), re.compile(r"([0-9]+)([MIDNSHP=X])")
_FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def gaps_of(cigar: str) -> tuple[int, list, list]:
    """Aligned read bases in all, (read bases before it, length) of each run of I, (read bases before it, 0) of each run of D."""
    total, last, ins, dels = 0, "", [], []
    for length, op in _CIGAR.findall(cigar):
        n = int(length)
        kind = "M" if op in "=X" else op
        if not n or kind not in "MID":
            continue  # shows nothing: equal neighbours on either side are one run
        if kind == "I":
            if last == "I":
                ins[-1] = (ins[-1][0], ins[-1][1] + n)
            else:
                ins.append((total, n))
        elif kind == "D" and last != "D":
            dels.append((total, 0))
        total += n if kind != "D" else 0
        last = kind
    return total, ins, dels


def letters_of(cigar: str, md: str, literal: bool = False) -> tuple[int, list]:
    """Aligned read bases in all, (read bases before it, place in SEQ, letter) of each of MD's letters that has an aligned base."""
    letters, col = [], 0
    for number, gap, letter in _MD.findall(md):
        if letter:
            letters.append((col, letter))
        col += int(number) if number else len(gap) - 1 if gap else 1
    out, col, rp, q, i = [], 0, 0, 0, 0
    for length, op in _CIGAR.findall(cigar):
        n = int(length)
        if op in "M=X":
            while i < len(letters) and letters[i][0] < col + n:
                at, letter = letters[i]
                if at >= col:
                    out.append((rp + at - col, q + at - col, letter))
                i += 1
        col += n if op in "M=XD" else 0
        rp += n if op in "M=XI" else 0
        q += n if op in "M=XI" else 0 if op != "S" else 1 if literal else n
    return rp, out


def differing(total: int, letters: list, seq: str, reverse: bool) -> list:
    """(position, base) of the bases of SEQ that differ from their letters (see letters_of)."""
    out = [(rp, seq[q]) for rp, q, letter in letters if q < len(seq) and seq[q] != letter]
    return [(total - 1 - pos, base.translate(_FLIP)) for pos, base in out] if reverse else out


def mismatches_of(cigar: str, md: str, seq: str, reverse: bool, literal: bool = False) -> list:
    """(position, base) of the aligned bases that differ from MD's letters, like mismatches()."""
    return differing(*letters_of(cigar, md, literal), seq, reverse)


def alignment_of(cigar: str, md: str | None, seq: str) -> tuple[str, str, str]:
    """Genome, marks (| where both agree) and read of one alignment, as three rows of equal length for a look at it."""
    genome, read, q = [], [], 0
    for length, op in _CIGAR.findall(cigar):
        n = int(length)
        bases = list(seq[q : q + n]) if op in "M=XI" else []
        if op in "M=XID":
            read += bases or ["-"] * n
            genome += ["-"] * n if op == "I" else ["N"] * n if op == "D" else bases
        q += n if op in "M=XIS" else 0
    shown, at = [i for i, c in enumerate(genome) if c != "-"], 0
    for number, gap, letter in _MD.findall(md or ""):
        for c in gap[1:] or letter:
            if at < len(shown):
                genome[shown[at]] = c
            at += 1
        at += int(number or 0)
    return "".join(genome), "".join("|" if a == b else " " for a, b in zip(genome, read)), "".join(read)


def runs(ops: Column) -> Column:
    """Runs of M (also = X), I and D with their length and the read bases before them (c); N P H S and empty
    operations show nothing, so equal neighbours on either side of them are one run."""
    kind = lambda op: F.when(op.isin("M", "=", "X"), F.lit("M")).otherwise(op)
    kept = F.transform(F.filter(ops, lambda x: x["op"].isin("M", "=", "X", "I", "D") & (x["len"] > 0)), lambda x: F.struct(kind(x["op"]).alias("op"), x["len"].alias("len")))
    start = F.struct(F.array().cast("array<struct<op:string,len:int,c:int>>").alias("done"), F.lit(0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        n = F.size(a["done"])
        last = F.try_element_at(a["done"], F.lit(-1))
        joins = (n > 0) & (last["op"] == x["op"])
        head = F.when(joins, F.slice(a["done"], F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(a["done"])
        new = F.struct(x["op"].alias("op"), (x["len"] + F.when(joins, last["len"]).otherwise(0)).alias("len"), F.when(joins, last["c"]).otherwise(a["c"]).alias("c"))
        return F.struct(F.concat(head, F.array(new)).alias("done"), (a["c"] + F.when(x["op"] != "D", x["len"]).otherwise(0)).alias("c"))

    return F.aggregate(kept, start, step)["done"]


def insertions(ops: Column, reverse: Column) -> Column:
    """First position of each insertion."""
    total = sum_ops(ops, "M=XI")
    return F.transform(F.filter(runs(ops), lambda r: r["op"] == "I"), lambda r: F.when(reverse, total - r["c"] - r["len"]).otherwise(r["c"]))


def deletions(ops: Column, reverse: Column) -> Column:
    """Read bases before each deletion."""
    total = sum_ops(ops, "M=XI")
    return F.transform(F.filter(runs(ops), lambda r: r["op"] == "D"), lambda r: F.when(reverse, total - r["c"]).otherwise(r["c"]))


def _differing(md: Column) -> Column:
    """(column, letter) of MD's single letters; columns are those of the reference that M, =, X and D show."""
    tokens = F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"([0-9]+|\^[A-Za-z]+|[A-Za-z])"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<col:int,letter:string>>").alias("found"), F.lit(0).alias("col"))

    def step(a: Column, t: Column) -> Column:
        number, gap = t.rlike("^[0-9]"), t.startswith("^")
        width = F.when(number, F.try_to_number(t, F.lit("9999999999")).cast("int")).when(gap, F.length(t) - 1).otherwise(1)
        found = F.when(number | gap, a["found"]).otherwise(F.concat(a["found"], F.array(F.struct(a["col"].alias("col"), t.alias("letter")))))
        return F.struct(found.alias("found"), (a["col"] + width).alias("col"))

    return F.aggregate(tokens, start, step)["found"]


def _matched(ops: Column, literal: bool) -> Column:
    """M = X operations with their first column, first aligned read base and first base in SEQ."""
    start = F.struct(F.array().cast("array<struct<col:int,rp:int,q:int,len:int>>").alias("m"), F.lit(0).alias("col"), F.lit(0).alias("rp"), F.lit(0).alias("q"))

    def step(a: Column, x: Column) -> Column:
        match, ins, gap, clip = x["op"].isin("M", "=", "X"), x["op"] == "I", x["op"] == "D", x["op"] == "S"
        add = lambda *when: F.when(when[0], x["len"]).otherwise(0)
        shown = F.concat(a["m"], F.array(F.struct(a["col"].alias("col"), a["rp"].alias("rp"), a["q"].alias("q"), x["len"].alias("len"))))
        return F.struct(
            F.when(match, shown).otherwise(a["m"]).alias("m"),
            (a["col"] + add(match | gap)).alias("col"),
            (a["rp"] + add(match | ins)).alias("rp"),
            (a["q"] + F.when(clip, F.lit(1) if literal else x["len"]).otherwise(add(match | ins))).alias("q"),
        )

    return F.aggregate(ops, start, step)["m"]


def mismatches(ops: Column, md: Column, seq: Column, reverse: Column, literal: bool = False) -> Column:
    """array<struct<pos, base>>: aligned bases that differ from MD's letter, in sequencing direction.

    seq is SEQ as stored. literal: a soft clip moves the place in SEQ by one base whatever its length.
    """
    total = sum_ops(ops, "M=XI")

    def place(d: Column, m: Column) -> Column:
        hit = F.try_element_at(F.filter(m, lambda x: (x["col"] <= d["col"]) & (d["col"] < x["col"] + x["len"])), F.lit(1))
        rp, q = hit["rp"] + d["col"] - hit["col"], hit["q"] + d["col"] - hit["col"]
        return F.struct(rp.alias("rp"), F.substring(seq, q + 1, F.lit(1)).alias("base"), d["letter"].alias("letter"))

    matched = _matched(ops, literal)
    found = F.transform(_differing(md), lambda d: place(d, matched))
    found = F.filter(found, lambda x: x["rp"].isNotNull() & (F.length(x["base"]) > 0) & (x["base"] != x["letter"]))
    flip = lambda b: F.translate(b, "ACGTacgt", "TGCAtgca")
    return F.transform(found, lambda x: F.struct(F.when(reverse, total - 1 - x["rp"]).otherwise(x["rp"]).alias("pos"), F.when(reverse, flip(x["base"])).otherwise(x["base"]).alias("base")))
