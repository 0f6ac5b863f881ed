import random

import pytest
from pyspark.sql import functions as F

from readqc.functions import errors as E
from readqc.functions import reads as R

COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_mapping_class_and_mate(spark):
    rows = [(0, 0, 2), (0, 9, 2), (0, 10, 1), (0, 29, 1), (0, 30, 0), (0, 255, 0), (4, 60, 3), (64, 10, 1)]
    got = spark.createDataFrame(rows, "flag int, mapq int, want int").select(R.mapq_bin(F.col("flag"), F.col("mapq"), F.lit(True)).alias("b"), "want", R.mapq_bin(F.col("flag"), F.col("mapq"), F.lit(False)).alias("none")).collect()
    assert all(x.b == x.want and x.none == 3 for x in got)
    mates = spark.createDataFrame([(0, 1), (64, 1), (128, 2), (192, 1), (None, 1)], "flag int, want int")
    assert all(x.m == x.want for x in mates.select(R.read_no(F.col("flag")).alias("m"), "want").collect())
    assert [one(spark, R.mapq_label(F.lit(i))).c0 for i in range(4)] == list(R.MAPQ_LABELS)


def test_bases_and_qualities(spark):
    chars = "ACGTacgtNn-U*RéZ"
    got = one(spark, *(R.base_code(F.lit(c)) for c in chars))
    assert list(got) == [0, 1, 2, 3, 0, 1, 2, 3] + [4] * 8
    assert list(one(spark, *(R.phred(F.lit(c)) for c in "!I~ J"))) == [0, 40, 41, 0, 41]
    assert one(spark, R.reverse_complement(F.lit("AaCGNT-"))).c0 == "-ANCGtT"


def test_normalised_position_divides_first(spark):
    assert [one(spark, R.norm_bin(F.lit(p), F.lit(100))).c0 for p in (0, 28, 29, 57, 58, 99)] == [0, 28, 28, 56, 57, 99]


def test_human_counts_and_percentages(spark):
    want = {0: "0", 999: "999", 1000: "1K", 1499: "1K", 1500: "2K", 999_999: "1000K", 1_000_000: "1M", 2_500_000_000: "3G"}
    for n, text in want.items():
        assert one(spark, R.human_count(F.lit(n).cast("long"))).c0 == text
    assert list(one(spark, R.percent(F.lit(1), F.lit(3)), R.percent(F.lit(0), F.lit(0)))) == ["33.3", None]
    assert one(spark, R.plot_id(F.lit("a b"), F.lit("c\td"))).c0 == "a_b_c_d"


@pytest.mark.parametrize("cigar,both,literal", [("10M", (0, 0), (0, 0)), ("3S7M", (3, 0), (3, 0)), ("2H3S5M4S1H", (3, 4), (0, 0)), ("8S", (8, 8), (8, 8)), ("*", (0, 0), (0, 0)), (None, (0, 0), (0, 0)), ("5M2S", (0, 2), (0, 2))])
def test_clips(spark, cigar, both, literal):
    ops = R.cigar_ops(F.lit(cigar).cast("string"))
    got = one(spark, R.clip5(ops), R.clip3(ops), R.clip5(ops, True), R.clip3(ops, True), R.cigar_text(ops))
    assert (got.c0, got.c1) == both and (got.c2, got.c3) == literal
    assert got.c4 == ("" if cigar in (None, "*") else cigar)


def test_clips_of_text(spark):
    """The same as from the array of operations, on any text."""
    r = random.Random(3)
    texts = [None, "", "*", "S", "5", "3S7M", "2H1H3S5M4S1H2H", "8S", "4H", "1H2S3H", "12S3", "xS5S", "7S\n", "5M2S*1H-", "3SS4H5S6"]
    texts += ["".join(r.choice(["1", "12", "H", "S", "3S", "2H", "4M", "x", "\n"]) for _ in range(r.randrange(1, 9))) for _ in range(800)]
    cigar, ops = F.col("cigar"), R.cigar_ops(F.col("cigar"))
    pairs = [(f(cigar, x), g(ops, x)) for x in (False, True) for f, g in ((R.clip5_of, R.clip5), (R.clip3_of, R.clip3))]
    got = spark.createDataFrame([(t,) for t in texts], "cigar string").select("cigar", *(c.alias(f"{name}{i}") for i, pair in enumerate(pairs) for name, c in zip("ab", pair))).collect()
    assert not [x for x in got if any(x[f"a{i}"] != x[f"b{i}"] for i in range(4))]
    assert sum(x.a0 > 0 for x in got) > 100 and sum(x.a1 > 0 for x in got) > 100


@pytest.mark.parametrize("length", [1, 250, 251, 256, 300, 1000, 1001, 2000, 2003, 4951, 5000, 9951, 10_252, 33_048])
def test_clusters_closed_form(spark, length):
    """Every position closes its cluster where its distance from 250 is a multiple of the width there."""
    naive, now = [], 0
    for i in range(length):
        naive.append(now)
        width = 5 if length <= 1000 else 10 if i < 2000 else 50 if i < 5000 else 100 if i < 10_000 else 500
        now += length <= 250 or i <= 250 or (i - 250) % width == 0
    got = spark.range(length).select(F.col("id").cast("int").alias("i")).withColumn("c", R.cluster_of(F.col("i"), F.lit(length)))
    got = got.withColumns({"s": R.cluster_start(F.col("c"), F.lit(length)), "label": R.cluster_label(F.col("c"), F.lit(length))}).orderBy("i").collect()
    assert [x.c for x in got] == naive
    first, last = {}, {}
    for i, c in enumerate(naive):
        first.setdefault(c, i)
        last[c] = i
    assert all(x.s == first[x.c] for x in got)
    show = lambda c: str(first[c] + 1) if length <= 250 else str(first[c]) if first[c] == last[c] else f"{first[c]}-{last[c]}"
    assert all(x.label == show(x.c) for x in got)
    assert [(a, b) for a, b in R.clusters(length)] == [(first[c], last[c]) for c in sorted(first) if length > 250 and first[c] > 250]


def expanded(cigar, md, seq, reverse, literal=False):
    """Insertions, deletions, mismatches by building the two gapped strings."""
    ops = [(int(n), o) for n, o in cigar]
    genome, read, q = [], [], 0
    for n, o in ops:
        if o in "M=X":
            read += seq[q : q + n]
            genome += seq[q : q + n]
            q += n
        elif o == "I":
            read += seq[q : q + n]
            genome += ["-"] * n
            q += n
        elif o == "D":
            read += ["-"] * n
            genome += ["N"] * n
        elif o == "S":
            q += 1 if literal else n
    at = 0
    columns = [i for i, g in enumerate(genome) if g != "-"]
    for token in md:
        if isinstance(token, int):
            at += token
        elif token[0] == "^":
            at += len(token) - 1
        else:
            if at < len(columns):
                genome[columns[at]] = token
            at += 1
    if reverse:
        genome, read = genome[::-1], [c.translate(COMPLEMENT) for c in read[::-1]]
        genome = [c.translate(COMPLEMENT) for c in genome]
    ins, dels, mis, rp, before = [], [], [], 0, ""
    for g, r in zip(genome, read):
        kind = "I" if g == "-" else "D" if r == "-" else "M"
        if kind == "I" and before != "I":
            ins.append(rp)
        if kind == "D" and before != "D":
            dels.append(rp)
        if kind == "M" and g != r:
            mis.append((rp, r))
        rp += kind != "D"
        before = kind
    return sorted(ins), sorted(dels), sorted(mis)


def test_errors_in_closed_form(spark):
    r = random.Random(7)
    rows, want = [], []
    for i in range(400):
        cigar = [(r.choice([0, 1, 2, 5, 9]), r.choice("MMMMIDNP=XS" if j in (0, 5) else "MMMIDNP=X")) for j in range(r.randrange(1, 7))]
        if r.random() < 0.3:
            cigar = [(2, "H"), *cigar]
        seq = "".join(r.choice("ACGTacgtN") for _ in range(sum(n for n, o in cigar if o in "M=XIS") + 3))
        md: list = []
        for n, o in cigar:  # some plausible, some arbitrary
            md += [r.randrange(0, n + 1), r.choice("ACGT")] if o in "M=X" and n else ["^" + "A" * n] if o == "D" and n else []
        md += [r.randrange(5)]
        reverse = r.random() < 0.5
        rows.append((i, "".join(f"{n}{o}" for n, o in cigar), "".join(map(str, md)), seq, reverse))
        want.append([expanded(cigar, md, seq, reverse, literal) for literal in (False, True)])
    frame = spark.createDataFrame(rows, "i int, cigar string, md string, seq string, rev boolean").withColumn("ops", R.cigar_ops(F.col("cigar")))
    mis = lambda literal: E.mismatches(F.col("ops"), F.col("md"), F.col("seq"), F.col("rev"), literal)
    got = frame.select("i", E.insertions(F.col("ops"), F.col("rev")).alias("ins"), E.deletions(F.col("ops"), F.col("rev")).alias("dels"), mis(False).alias("m0"), mis(True).alias("m1"), R.aln_len(F.col("ops")).alias("n")).orderBy("i").collect()
    for x, (a, b) in zip(got, want):
        assert (sorted(x.ins), sorted(x.dels), sorted((m.pos, m.base) for m in x.m0)) == a
        assert sorted((m.pos, m.base) for m in x.m1) == b[2]
    for (_, cigar, md, seq, reverse), (a, b) in zip(rows, want):  # the helpers for one read
        total, ins, dels = E.gaps_of(cigar)
        assert sorted(total - c - n if reverse else c for c, n in ins) == a[0] and sorted(total - c if reverse else c for c, _ in dels) == a[1]
        assert sorted(E.mismatches_of(cigar, md, seq, reverse)) == a[2] and sorted(E.mismatches_of(cigar, md, seq, reverse, True)) == b[2]
