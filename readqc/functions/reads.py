"""Scalar rules on reads, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FLAG bits of the public SAM format.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY = 1, 2, 4, 16, 64, 128, 256

# Mapping-quality classes and their labels, base series, quality levels, bins of a normalised read.
MAPQ_LABELS = ("MAPQ gt 30", "MAPQ lt 30", "MAPQ lt 10", "Unmapped")
BASES = "ACGTN"
QUALITIES = 42
NORM_BINS = 100


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def mapped(flag: Column, is_aligned: Column) -> Column:
    return F.coalesce(is_aligned, F.lit(False)) & ~has(F.coalesce(flag, F.lit(0)), UNMAPPED)


def mapq_bin(flag: Column, mapq: Column, is_aligned: Column) -> Column:
    """0: at least 30, 1: under 30, 2: under 10, 3: unmapped or from a file without alignments."""
    bad = ~F.coalesce(is_aligned, F.lit(False)) | has(F.coalesce(flag, F.lit(0)), UNMAPPED) | mapq.isNull()
    return F.when(bad, 3).when(mapq < 10, 2).when(mapq < 30, 1).otherwise(0)


def mapq_label(bin_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MAPQ_LABELS)), bin_ + 1)


def read_no(flag: Column) -> Column:
    """Mate: 1 if first, else 2 if second, else 1."""
    flag = F.coalesce(flag, F.lit(0))
    return F.when(~has(flag, FIRST) & has(flag, SECOND), 2).otherwise(1)


def base_code(ch: Column) -> Column:
    """A, C, G, T in either case: 0 to 3; everything else 4."""
    at = F.instr(F.lit("ACGT"), F.upper(ch))
    return F.when((F.length(ch) == 1) & (at > 0), at - 1).otherwise(4)


def phred(ch: Column, offset: Column | int = 33) -> Column:
    """Quality of a character, within 0 to 41."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return F.greatest(F.least(F.ascii(ch) - offset, F.lit(QUALITIES - 1)), F.lit(0))


def quality_offset(lowest: Column, highest: Column) -> Column:
    """33, or 64 where the codes of a file's qualities can't be on 33: none below 59 (-5 on 64), and one above 74 (41 on 33)."""
    return F.when((lowest >= 59) & (highest > 74), 64).otherwise(33)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len: int, op: string>>; empty for null or ``*``."""
    tokens = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(tokens, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _clip(ops: Column, index: int, literal: bool) -> Column:
    seen = ops if literal else F.filter(ops, lambda x: x["op"] != "H")
    end = F.try_element_at(seen, F.lit(index))
    return F.coalesce(F.when(end["op"] == "S", end["len"]), F.lit(0))


def clip5(ops: Column, literal: bool = False) -> Column:
    """Length of a soft clip at the start. literal: only the very first operation counts, so a hard clip hides it."""
    return _clip(ops, 1, literal)


def clip3(ops: Column, literal: bool = False) -> Column:
    return _clip(ops, -1, literal)


# What is passed over beside an end's soft clip: hard clips (not if literal), and what is no operation.
_PASSED = {literal: r"(?:" + ("" if literal else "[0-9]++H|") + r"[^0-9]|[0-9]++(?![MIDNSHP=X]))*+" for literal in (False, True)}


def _clip_of(cigar: Column, pattern: str) -> Column:
    return F.when(cigar.contains("S"), F.concat(F.lit("0"), F.regexp_extract(cigar, pattern, 1)).cast("int")).otherwise(0)


def clip5_of(cigar: Column, literal: bool = False) -> Column:
    """clip5() from CIGAR as text: no array is made, so it is compiled."""
    return _clip_of(cigar, "^" + _PASSED[literal] + "([0-9]++)S")


def clip3_of(cigar: Column, literal: bool = False) -> Column:
    return _clip_of(cigar, "([0-9]++)S" + _PASSED[literal] + r"\z")


def sum_ops(ops: Column, kinds: str) -> Column:
    """Total length of the operations of these kinds."""
    return F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(F.lit(kinds).contains(x["op"]), x["len"]).otherwise(0))


def aln_len(ops: Column) -> Column:
    """Columns of the gapped alignment: M = X I D."""
    return sum_ops(ops, "M=XID")


def norm_bin(pos: Column, length: Column) -> Column:
    """Hundredth of a read that holds a position; the division comes first."""
    return F.floor(pos.cast("double") / length * F.lit(float(NORM_BINS))).cast("int")


def human_count(n: Column) -> Column:
    """Under 1000 as it is, else rounded to whole K, M or G."""
    text = lambda by, unit: F.concat(F.round(n / F.lit(float(by))).cast("long").cast("string"), F.lit(unit))
    return F.when(n < 1_000, n.cast("string")).when(n < 1_000_000, text(1_000, "K")).when(n < 1_000_000_000, text(1_000_000, "M")).otherwise(text(1_000_000_000, "G"))


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null where there is no whole."""
    share = F.round(F.try_divide(part * F.lit(100.0), whole.cast("double")), 1)
    return F.when(share.isNotNull(), F.format_string("%.1f", share))


def plot_id(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", *parts), r"\s", "_")


# Fixed values of the position clusters: exact positions, then the width of a cluster by position.
EXACT, LINEAR_MOST, LINEAR_WIDTH = 250, 1_000, 5
WIDTHS = ((2_000, 10), (5_000, 50), (10_000, 100), (None, 500))


def clusters(length: int) -> list[tuple[int, int]]:
    """(first, last) 0-based position of each cluster beyond the exact ones, for a matrix of this length."""
    if length <= EXACT:
        return []
    out, start = [], EXACT + 1
    for i in range(EXACT + 1, length):
        width = LINEAR_WIDTH if length <= LINEAR_MOST else next(w for most, w in WIDTHS if most is None or i < most)
        if (i - EXACT) % width == 0:
            out.append((start, i))
            start = i + 1
    return out + ([(start, length - 1)] if start < length else [])


def cluster_of(pos: Column, length: Column) -> Column:
    """Cluster of a 0-based position in a matrix of this length: a closed form, so that it works for any length."""
    i = pos - (EXACT + 1)
    step = lambda at, first, width: F.floor((pos - at) / F.lit(width)).cast("int") + first
    exponential = (
        F.when(pos <= 2_000, step(251, 251, 10))
        .when(pos <= 4_950, step(2_001, 426, 50))
        .when(pos <= 9_950, step(4_951, 485, 100))
        .when(pos <= 10_250, 535)
        .otherwise(step(10_251, 536, 500))
    )
    linear = F.floor(i / F.lit(LINEAR_WIDTH)).cast("int") + EXACT + 1
    return F.when(pos <= EXACT, pos).when(length <= EXACT, pos).when(length <= LINEAR_MOST, linear).otherwise(exponential)


def cluster_start(cluster: Column, length: Column) -> Column:
    """First position of a cluster."""
    c = cluster
    exponential = F.when(c <= 425, 251 + (c - 251) * 10).when(c <= 484, 2_001 + (c - 426) * 50).when(c <= 534, 4_951 + (c - 485) * 100).otherwise(9_951 + F.when(c > 535, 300 + (c - 536) * 500).otherwise(0))
    return F.when((c <= EXACT) | (length <= EXACT), c).when(length <= LINEAR_MOST, EXACT + 1 + (c - EXACT - 1) * LINEAR_WIDTH).otherwise(exponential)


def cluster_label(cluster: Column, length: Column) -> Column:
    """1-based position for short matrices; else the 0-based position, or start-end."""
    start, end = cluster_start(cluster, length), F.least(cluster_start(cluster + 1, length) - 1, length - 1)
    return F.when(length <= EXACT, (cluster + 1).cast("string")).when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))


def matrix_length(longest: Column) -> Column:
    return F.greatest(F.lit(EXACT), longest + 1)
