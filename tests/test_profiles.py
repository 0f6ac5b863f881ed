import gzip
import json
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readqc.operators import derive as D
from readqc.operators import profiles as P
from readqc.functions.errors import alignment_of
from readqc.operators.reads import RAW, alignments, derive
from readqc.plans.profile import profile, profile_reads, report
from readqc.plans.queries import QUERIES
from readqc.sources import records
from readqc.sources.files import chosen, file_type, in_order, output_path, peek, read

SAM = "\n".join(
    "\t".join(map(str, x))
    for x in [
        ("@HD", "VN:1.6"),
        ("@SQ", "SN:chr", "LN:100"),
        ("p1", 67, "chr", 1, 30, "8M", "=", 20, 10, "ACGTACGT", "IIIIIIII", "NM:i:1", "MD:Z:3A4"),
        ("p1", 147, "chr", 20, 29, "2S4M2I", "=", 1, -10, "AACCGGTT", "!!!!IIII", "MD:Z:4"),
        ("p2", 65, "chr", 1, 9, "3M2D3M", "*", 0, 0, "AAATTT", "*"),
        ("p2", 133, "*", 0, 60, "4M", "*", 0, 0, "NNAC", "####"),
        ("s", 256, "chr", 1, 60, "4M", "*", 0, 0, "ACGT", "IIII"),
        ("sup", 2048, "chr", 1, 255, "1H2S4M", "*", 0, 0, "GGACGT", "~~~~~~", "MD:Z:1C2"),
        ("none", 0, "chr", 1, 0, "*", "*", 0, 0, "*", "*"),
        ("clip", 0, "chr", 1, 0, "5S", "*", 0, 0, "ACGTA", "IIIII"),
    ]
)


@pytest.fixture
def sam(tmp_path):
    path = tmp_path / "x.sam"
    path.write_text(SAM + "\n")
    return str(path)


def cells(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_file_types(tmp_path):
    assert [file_type(x) for x in ("a.sam", "a.bam", "a.fa", "a.fasta.gz", "a.fq", "a.fq.gz", "a.cram", "sam")] == ["sam", "bam", "fasta", "fasta", "fastq", "fastq", None, None]
    assert file_type("a.fq.gz", more=False) is None and file_type("a.fna.gz", more=False) == "fasta"
    assert chosen(["a.sam", "b.txt", "c.fa"]) == [("a.sam", "sam"), ("c.fa", "fasta")]
    for bad in (["a.sam", "a.sam"], ["b.txt"]):
        with pytest.raises(ValueError):
            chosen(bad)
    assert output_path("/d/a.sam") == "/d/a.sam.readqc.html" and output_path("/d/a.sam", str(tmp_path)) == f"{tmp_path}/a.sam.readqc.html"
    with pytest.raises(ValueError):
        output_path("/d/a.sam", "/no/such")


def test_sam_profile(spark, sam):
    p = profile(spark, sam, plot_end=True, norm=True)[sam]
    t = p.tables
    assert p.reads.count() == 7  # the secondary record is gone, the supplementary one stays
    assert cells(t["read_counts"], "read_no", "mapq_bin", "n") == [(1, 0, 2), (1, 2, 3), (2, 1, 1), (2, 3, 1)]
    x = t["pairs"].first()
    assert (x.total, x.n_read1, x.n_read2, x.n_paired, x.n_proper, x.pct_paired, x.pct_proper) == (7, 5, 2, 4, 2, "57.1", "50.0")
    assert ("Total", 5, 1.0) in cells(t["mapping"], "class", "n", "fraction")
    assert cells(t["lengths"], "read_no", "mapq_bin", "len", "n") == [(1, 0, 4, 1), (1, 0, 8, 1), (1, 2, 0, 2), (1, 2, 6, 1), (2, 1, 6, 1), (2, 3, 4, 1)]
    # reverse mate: AACCGGTT turns to AACCGGTT, its clip to the 3' end
    assert cells(t["bases"].where("read_no = 2 and mapq_bin = 1"), "pos", "series", "n") == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (3, 1, 1), (4, 2, 1), (5, 2, 1)]
    assert cells(t["qualities"].where("read_no = 2 and mapq_bin = 1"), "pos", "series") == [(0, 40), (1, 40), (2, 40), (3, 40), (4, 0), (5, 0)]
    assert cells(t["qualities"].where("read_no = 1 and mapq_bin = 2"), "pos") == []
    assert cells(t["bases_from_end"].where("read_no = 2 and mapq_bin = 3"), "pos", "series") == [(0, 1), (1, 0), (2, 4), (3, 4)]
    assert cells(t["bases_normalised"].where("read_no = 2 and mapq_bin = 3"), "pos") == [(0,), (25,), (50,), (75,)]
    assert cells(t["insertions"], "read_no", "pos", "n") == [(2, 0, 1)]
    assert cells(t["deletions"], "read_no", "pos", "n") == [(1, 3, 1)]
    assert cells(t["mismatches"], "mapq_bin", "pos", "series", "n") == [(0, 3, 3, 1)]
    p.release()


def test_alignment_text(spark, sam):
    shown = {r.read_id: r.alignment for r in alignments(derive(read(spark, sam)).where("read_id in ('p1', 'p2') and read_no = 1")).collect()}
    assert shown["p1"] == "p1\nACGTACGT\nCIGAR: 8M\n   MD: 3A4\nACGAACGT (genome)\n||| ||||\nACGTACGT (read)\n"
    assert shown["p2"].endswith("\nAAANNTTT (genome)\n|||  |||\nAAA--TTT (read)\n")
    assert alignment_of("2S2M1I2M1D1M", "1A2^G1", "ttACGTCA") == ("AA-TCGA", "|  || |", "ACGTC-A")


def test_literal_clips_and_missing_quality(spark, sam):
    raw = read(spark, sam)
    plain, compat = derive(raw), derive(raw, compat=True)
    assert plain.where("read_id = 'sup'").first().clip5 == 2 and compat.where("read_id = 'sup'").first().clip5 == 0
    assert cells(P.qualities_from_end(plain).where("read_no = 1 and mapq_bin = 2 and pos > 4"), "pos") == []
    assert cells(P.qualities_from_end(compat, compat=True).where("read_no = 1 and mapq_bin = 2 and pos > 4"), "pos", "series") == [(5, 41)]
    # the clip moves by one base only: the second aligned base is read from CGT's place
    assert cells(P.mismatches(compat, compat=True).where("read_no = 1 and mapq_bin = 0"), "pos", "series") == [(1, 0), (3, 3)]


def test_broken_sam(spark, tmp_path):
    path = tmp_path / "b.sam"
    path.write_text(SAM + "\nbroken\tx\n")
    assert read(spark, str(path), mode="PERMISSIVE").count() == 8
    with pytest.raises(Exception, match="broken SAM record"):
        read(spark, str(path)).count()


def test_fasta_and_fastq(spark, tmp_path):
    fasta = ">xx first\nAAAA\nTT\n>yy\nacgt\n\n>empty\n>z\nNN"
    (tmp_path / "a.fa").write_text(fasta)
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(fasta)
    for name in ("a.fa", "a.fa.gz"):
        got = read(spark, str(tmp_path / name))
        assert cells(got, "read_id", "seq") == [("empty", ""), ("xx", "AAAATT"), ("yy", "acgt"), ("z", "NN")]
    counts = profile(spark, str(tmp_path / "a.fa"))[str(tmp_path / "a.fa")].tables
    assert cells(counts["read_counts"], "read_no", "mapq_bin", "n") == [(1, 3, 4)]
    assert cells(counts["bases"].where("pos = 0"), "series", "n") == [(0, 2), (4, 1)]
    fastq = "@a 1\nACGT\n+\n@@II\n@b\nGG\n+b\n+@\n\n@c\nAC\n+\n!I\n"
    (tmp_path / "a.fq").write_text(fastq)
    with gzip.open(tmp_path / "a.fastq.gz", "wt") as f:
        f.write(fastq)
    for name in ("a.fq", "a.fastq.gz"):
        assert cells(read(spark, str(tmp_path / name)), "read_id", "seq", "qual") == [("a", "ACGT", "@@II"), ("b", "GG", "+@"), ("c", "AC", "!I")]
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n@b\nGG\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        read(spark, str(tmp_path / "bad.fq")).count()
    (tmp_path / "cut.fq").write_text("@a\nACGT\n+\nIIII\n@b\nGG\n+\n")
    with pytest.raises(Exception, match="broken FASTQ"):
        read(spark, str(tmp_path / "cut.fq")).count()
    assert cells(read(spark, str(tmp_path / "cut.fq"), mode="PERMISSIVE"), "read_id") == [("a",)]
    assert cells(read(spark, str(tmp_path / "bad.fq"), mode="PERMISSIVE"), "read_id") == [("b",)]


@pytest.fixture
def split(spark):
    """A function that makes Spark cut files into splits of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]

    def set_(n):
        for k in keys:
            spark.conf.set(k, str(n))

    yield set_
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


def test_fastq_splits(spark, split, tmp_path, monkeypatch):
    text = "".join(f"@r{i} x\n{'ACGT' * (i % 7)}A\n+\n{'@+I!' * (i % 7)}@\n" + "\n" * (i % 11 == 0) for i in range(200))
    text += "@empty\n\n+\n\n@crlf\r\nAC\r\n+\r\n@@\r\n"
    path = tmp_path / "r.fq"
    path.write_bytes(text.encode())
    want = sorted([(f"r{i}", "ACGT" * (i % 7) + "A", "@+I!" * (i % 7) + "@") for i in range(200)] + [("empty", "", ""), ("crlf", "AC", "@@")])
    for step, lines in ((37, 400), (100, 400), (1000, 400), (1000, 12), (10**6, 400)):
        split(step)
        monkeypatch.setattr(records, "LINES", lines)
        got = read(spark, str(path))
        assert sorted((r.read_id, r.seq, r.qual or "") for r in got.collect()) == want
        assert step > 10**5 or got.rdd.getNumPartitions() > len(text) // step


def bgzf(data):
    out = b""
    for i in range(0, len(data), 300):
        raw = data[i : i + 300]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bam_bytes(rows):
    header = b"@HD\tVN:1.6\n"
    out = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 1000)
    for name, flag, mapq, cigar, seq, qual, md in rows:
        ops = [(int(n), records.OPERATIONS.index(o)) for n, o in re.findall(r"(\d+)(\D)", cigar or "")]
        codes = [records.LETTERS.index(c) for c in seq] + [0] * (len(seq) % 2)
        tags = b"NMi" + struct.pack("<i", 1) + b"XBBc" + struct.pack("<i", 2) + b"ab" + (b"MDZ" + md.encode() + b"\0" if md else b"")
        quality = bytes(ord(c) - 33 for c in qual) if qual else b"\xff" * len(seq)
        body = struct.pack("<iiBBHHHiiii", 0, 5, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2)) + quality + tags
        out += struct.pack("<i", len(body)) + body
    return out


BAM_ROWS = [(f"read{i}", [0, 16, 65, 4, 1024][i % 5], i % 61, f"{2 * (i % 2)}S{10 + i % 40}M1P2D{i % 3}H" if i % 5 != 3 else None, "ACGTN"[i % 5] * (10 + i % 40 + 2 * (i % 2)), "I" * (10 + i % 40 + 2 * (i % 2)) if i % 3 else None, "5A3" if i % 2 else None) for i in range(300)]
BAM_WANT = sorted((str(x) for x in ((*r[:6], None if r[1] & 4 else r[6]) for r in BAM_ROWS)))


def bam_rows(frame):
    return sorted(str(tuple(r)) for r in frame.select("read_id", "flag", "mapq", "cigar", "seq", "qual", "md").collect())


def test_bam(spark, split, tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(bgzf(bam_bytes(BAM_ROWS)))
    for step in (211, 1000, 5000, 10**6):
        split(step)
        assert bam_rows(read(spark, str(path))) == BAM_WANT
    (tmp_path / "bad.bam").write_bytes(bgzf(b"not a bam file at all"))
    with pytest.raises(Exception, match="not a BAM file"):
        read(spark, str(tmp_path / "bad.bam")).count()
    (tmp_path / "none.bam").write_bytes(bgzf(bam_bytes([])))
    assert read(spark, str(tmp_path / "none.bam")).count() == 0


def blocks_at(data):
    out, at = [], 0
    while at < len(data):
        out.append(at)
        at += records.block_size(data[at : at + 40])
    return out


@pytest.mark.parametrize("step", [400, 3000, 10**6])
def test_damaged_bam_is_never_read_in_silence(spark, split, tmp_path, step):
    """Cut between and inside blocks, a broken block header, a broken checksum, a lost block, over several splits."""
    split(step)
    whole = bgzf(bam_bytes(BAM_ROWS))
    at = blocks_at(whole)
    middle = at[len(at) // 2]
    damaged = {
        "no closing block": whole[: at[-1]],
        "cut between blocks": whole[:middle],
        "cut inside a block": whole[: middle + 50],
        "cut inside a header": whole[: middle + 5],
        "header": whole[:middle] + b"xxxx" + whole[middle + 4 :],
        "block length": whole[: middle + 16] + b"\xff\xff" + whole[middle + 18 :],
        "checksum": whole[: middle - 7] + bytes([whole[middle - 7] ^ 1]) + whole[middle - 6 :],
        "content": whole[: middle + 60] + bytes([whole[middle + 60] ^ 1]) + whole[middle + 61 :],
        "lost block": whole[:middle] + whole[at[len(at) // 2 + 1] :],
    }
    for name, data in damaged.items():
        path = tmp_path / f"{name.replace(' ', '-')}.bam"
        path.write_bytes(data)
        with pytest.raises(Exception, match="damaged block|was cut|broken BAM record"):
            read(spark, str(path)).collect()
        kept = bam_rows(read(spark, str(path), mode="PERMISSIVE"))
        assert set(kept) <= set(BAM_WANT) and len(kept) == len(set(kept))
        lost = len(BAM_WANT) - len(kept)
        assert lost == 0 if name == "no closing block" else lost < 30 or "cut" in name


def test_paths_that_only_spark_opens(spark, split, sam, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.reads.link./in", f"file://{tmp_path}")
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes(BAM_ROWS)))
    (tmp_path / "x.fq").write_text("".join(f"@q{i}\nACGT\n+\nIIII\n" for i in range(100)))
    (tmp_path / "x.fa").write_text(">a\nAC\n")
    (tmp_path / "out").mkdir()
    for step in (500, 10**6):
        split(step)
        assert bam_rows(read(spark, "viewfs://reads/in/x.bam")) == BAM_WANT
        assert read(spark, "viewfs://reads/in/x.fq").count() == 100 and read(spark, "viewfs://reads/in/x.sam").count() == 8
    pages = report(spark, ["viewfs://reads/in/x.bam", "viewfs://reads/in/x.fa"], outdir=str(tmp_path / "out"))
    assert f"{os.path.getsize(tmp_path / 'x.bam')} bytes" in open(pages[0], encoding="utf-8").read()
    with pytest.raises(ValueError, match="outdir"):
        report(spark, "viewfs://reads/in/x.fa")


def test_bam_equals_sam(spark, sam, tmp_path):
    rows = [tuple(r) for r in read(spark, sam).select("read_id", "flag", "mapq", "cigar", "seq", "qual", "md").collect()]
    path = tmp_path / "same.bam"
    path.write_bytes(bgzf(bam_bytes(rows)))
    assert bam_rows(read(spark, str(path))) == sorted(str((*r[:6], r[6])) for r in rows)
    one, two = (profile(spark, p, plot_end=True, norm=True)[p] for p in (sam, str(path)))
    for name in one.tables:
        assert sorted(map(str, one.tables[name].collect())) == sorted(map(str, two.tables[name].collect()))


def test_peek(spark, split, tmp_path):
    split(100)  # a peek reads in file order all the same
    path, aligned = str(tmp_path / "many.fa"), str(tmp_path / "many.sam")
    (tmp_path / "many.fa").write_text("".join(f">r{i}\nAC\n" for i in range(50)))
    (tmp_path / "many.sam").write_text("".join(f"r{i}\t0\tchr\t1\t9\t2M\t*\t0\t0\tAC\tII\n" for i in range(50)))
    for p in (path, aligned):
        found = profile(spark, p, peek=10)[p]
        assert found.partial == 10 and sorted(int(r.read_id[1:]) for r in found.reads.collect()) == list(range(10))
        assert profile(spark, p, peek=50)[p].partial is None
    # whole blocks of 10,000: a FASTA file of 50 records is past n, an aligned one was read to its end
    for p, partial in ((path, 50), (aligned, None)):
        found = profile(spark, p, peek=10, peek_mode="chunk")[p]
        assert found.partial == partial and found.reads.count() == 50
    raw = read(in_order(spark), aligned)
    assert [peek(raw, 10, "chunk", block, aligned=True)[1] for block in (7, 25, 50, 51)] == [14, 25, 50, None]
    pages = report(spark, [path, aligned], outdir=str(tmp_path), peek=10)
    assert all("first 10 reads only" in open(x, encoding="utf-8").read() for x in pages)
    assert "reads only" not in open(report(spark, aligned, outdir=str(tmp_path), peek=10, peek_mode="chunk")[0], encoding="utf-8").read()
    for bad in ({"peek": 9}, {"nthreads": 0}, {"subsample": 2}, {"outdir": "/no/such"}, {"report_max_len": 0}):
        with pytest.raises(ValueError):
            profile(spark, path, **bad)


def test_peek_reads_only_the_start(spark, tmp_path):
    """What stands behind the records asked for is not even parsed."""
    path = str(tmp_path / "broken.fq")
    (tmp_path / "broken.fq").write_text("".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(200_000)) + "@broken\n")
    assert profile(spark, path, peek=100)[path].tables["pairs"].first().total == 100
    with pytest.raises(Exception, match="broken FASTQ"):
        read(spark, path).count()


def test_subsample_is_exact(spark):
    r = random.Random(3)
    rows = [(f, f"r{i // 2}", r.randrange(4), 30, "4M", "ACGT", "IIII", None, True) for f, n in (("a", 1001), ("b", 40), ("c", 1)) for i in range(n)]
    reads = spark.createDataFrame(rows, RAW).repartition(5)
    size = lambda x: {k["file"]: k["count"] for k in x.groupBy("file").count().collect()}
    assert size(P.subsample(reads, 0.25, 11)) == {"a": 250, "b": 10, "c": 1}  # round(0.25) is 0: all stay
    assert size(P.subsample(reads, 1.0)) == size(P.subsample(reads, 0)) == {"a": 1001, "b": 40, "c": 1}
    for share in (0.5, 0.0123, 0.9):
        got = size(P.subsample(reads, share, 5))
        assert got["a"] == math.floor(1001 * share + 0.5)
    first, again = (sorted(map(str, x.collect())) for x in (P.subsample(reads, 0.3, 1), P.subsample(reads.repartition(2), 0.3, 1)))
    assert first == again != sorted(map(str, P.subsample(reads, 0.3, 2).collect()))


def test_one_pass_equals_the_single_counts(spark, sam):
    reads = derive(read(spark, sam))
    cells = P.everything(reads, plot_end=True, norm=True).cache()
    single = {
        "bases": P.bases(reads), "qualities": P.qualities(reads), "bases_from_end": P.bases_from_end(reads), "qualities_from_end": P.qualities_from_end(reads),
        "bases_normalised": P.bases_normalised(reads), "qualities_normalised": P.qualities_normalised(reads), "mismatches": P.mismatches(reads),
        "insertions": P.insertions(reads).withColumn("series", F.lit(0)), "deletions": P.deletions(reads).withColumn("series", F.lit(0)),
        "lengths": P.lengths(reads).select("read_no", "mapq_bin", F.col("len").alias("pos"), F.lit(0).alias("series"), "n"),
    }
    columns = ("read_no", "mapq_bin", "pos", "series", "n")
    for what, counts in single.items():
        assert cells_of(cells.where(F.col("what") == what), columns) == cells_of(counts, columns) and counts.count()
    assert str(P.pairs_of(cells).first()) == str(P.pair_counts(reads).first())


def cells_of(frame, columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_mean_quality_and_gap(spark):
    counts = spark.createDataFrame([(1, 0, 0, 10, 3), (1, 0, 0, 40, 1), (1, 0, 1, 7, 5), (1, 0, 3, 9, 2)], "read_no int, mapq_bin int, pos int, series int, n long")
    got = {r.pos: r for r in D.mean_quality(counts).collect()}
    mean = (10 * 3 + 40) / 4
    assert got[0]["mean"] == mean and math.isclose(got[0].std_err, math.sqrt((3 * (mean - 10) ** 2 + (40 - mean) ** 2) / 4) / 2)
    assert (got[1]["mean"], got[1].std_err) == (7, 0)
    assert cells(D.until_first_gap(D.mean_quality(counts)), "pos") == [(0,), (1,)]


def test_clustered_average(spark):
    counts = spark.createDataFrame([(1, 0, 5, 0, 7), (1, 0, 251, 0, 3), (1, 0, 255, 0, 10), (1, 0, 299, 1, 4)], "read_no int, mapq_bin int, pos int, series int, n long")
    got = cells(D.clustered(counts, 299), "cluster", "label", "series", "n")
    assert got == [(5, "5", 0, 7), (251, "251-255", 0, 3), (260, "296-299", 1, 1)]


def test_density(spark):
    counts = spark.createDataFrame([(1, 0, 10, 5), (1, 1, 10, 1), (1, 1, 20, 3), (1, 1, 30, 4)], "read_no int, mapq_bin int, len int, n long")
    got = D.length_density(counts).collect()
    assert [r.density for r in got if r.mapq_bin == 0] == [1.0]
    x = np.linspace(-200, 300, 20_001)
    full = D.density(np.concatenate(([10.0, 20.0, 30.0], x)), np.concatenate(([1.0, 3.0, 4.0], np.zeros(len(x)))))
    assert math.isclose(float(full[3:].sum() * (x[1] - x[0])), 1, rel_tol=1e-3)


def test_density_of_many_lengths(spark):
    """Against the plain form where that is quick; half a million lengths of one class are spread over groups of a tile's cells."""
    r = np.random.default_rng(5)
    lens = [np.unique(r.integers(1, 90, 300)), np.unique(r.lognormal(8, 1, 3_000).astype(int)), np.array([7, 7_000_000]), np.array([5, 6]), np.arange(100, 104), np.unique(np.concatenate((r.integers(1, 50, 40), r.integers(10**6, 10**6 + 5_000, 900))))]
    rows = [(1 + (i > 2), i, int(x), int(n)) for i, some in enumerate(lens) for x, n in zip(some, r.integers(1, 10**6 if i % 2 else 4, len(some)))]
    frame = spark.createDataFrame(rows, "read_no int, mapq_bin int, len int, n long").repartition(3)
    got = {(x.mapq_bin, x.len): x.density for x in D.length_density(frame).collect()}
    assert len(got) == len(rows)
    for i, some in enumerate(lens):
        n = np.array([float(x[3]) for x in rows if x[1] == i])
        want, have = D.density(some.astype(float), n), np.array([got[i, int(x)] for x in some])
        assert np.abs(want - have).max() < 1e-12 * max(want.max(), 1)
    many = spark.range(500_000).select(F.lit(1).alias("read_no"), F.lit(0).alias("mapq_bin"), (F.col("id") * 3 + 20).cast("int").alias("len"), (F.col("id") % 7 + 1).alias("n"))
    inner = D.length_density(many).where("len between 600000 and 900000")
    x = inner.agg(F.min("density"), F.max("density"), F.count("*")).first()
    assert x[2] == 100_000 and abs(x[0] * 1.5e6 - 1) < 1e-3 and abs(x[1] * 1.5e6 - 1) < 1e-3


def test_density_reads_once(spark):
    """The lengths are counted once, whatever the density's plan takes of them."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    reads = spark.range(2_000).selectExpr("cast(1 + id % 2 AS int) AS read_no", "cast(id % 3 AS int) AS mapq_bin", "cast(30 + id * id % 97 AS int) AS n_clipped")
    assert len(D.length_density(P.lengths(reads.mapInArrow(look, reads.schema))).collect()) > 100 and seen.value == 2_000


def test_error_totals_take_no_text_they_need_not(spark, sam):
    """Qualities, and bases of reads whose MD has no letter, are not worked out; classes without errors have zeros."""
    reads = derive(read(spark, sam))
    never = F.raise_error(F.lit("worked out")).cast("string")
    lettered = F.col("md").rlike("(^|[0-9])[A-Za-z]")
    bare = reads.withColumns({"qual_o": never, "seq_o": never, "seq": F.when(lettered, F.col("seq")).otherwise(never)})
    got = {(x.read_no, x.mapq_bin): (x.n_mis, x.n_ins, x.n_del) for x in P.error_totals(bare).collect()}
    want = {(x.read_no, x.mapq_bin): [0, 0, 0] for x in P.read_counts(reads).collect()}
    for i, counts in enumerate((P.mismatches(reads), P.insertions(reads), P.deletions(reads))):
        for x in counts.collect():
            want[x.read_no, x.mapq_bin][i] += x.n
    assert got == {k: tuple(v) for k, v in want.items()} and got[2, 3] == (0, 0, 0) and sum(map(sum, got.values())) == 3
    assert P.error_totals(reads.where("false")).collect() == []


@pytest.mark.parametrize("name", ["detected_quality_offsets", "dense_base_composition"])
def test_queries_count_once(spark, tmp_path, name):
    """Counts that a query takes twice are counted once: all characters pass through Python once."""
    lines = "id AS l_orderkey, id % 97 AS l_partkey, id % 11 AS l_suppkey, cast(id % 7 + 1 AS int) AS l_linenumber, cast(id % 50 AS double) AS l_quantity, 0.1D AS l_discount, 'N' AS l_returnflag, 'O' AS l_linestatus"
    spark.range(500).selectExpr(*lines.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert len(found.collect()) > 500
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow run(") == 1


def test_totals_match(spark, sam):
    reads = derive(read(spark, sam)).cache()
    at = {(r.read_no, r.mapq_bin, r.pos): r.n for r in P.bases(reads).groupBy("read_no", "mapq_bin", "pos").agg(F.sum("n").alias("n")).collect()}
    sizes = [(r.read_no, r.mapq_bin, r.n_clipped) for r in reads.collect()]
    for (m, c, pos), n in at.items():
        assert n == sum(1 for a, b, size in sizes if (a, b) == (m, c) and size > pos)
    assert sum(r.n for r in P.read_counts(reads).collect()) == reads.count()
    e = P.error_totals(reads).groupBy().agg(F.sum("n_mis"), F.sum("n_ins"), F.sum("n_del")).first()
    assert tuple(e) == (1, 1, 1)
    kinds = P.raw_and_mapped_lengths(reads).groupBy("kind").agg(F.sum("n").alias("n")).collect()
    assert {r.kind: r.n for r in kinds} == {"raw": 7, "mapped": 3}
    dense = D.zero_filled(P.bases(reads), 5)
    assert dense.where("read_no = 2 and mapq_bin = 3").count() == 20
    assert {(r.read_no, r.mapq_bin): r.visible for r in D.extents(P.bases(reads)).collect()} == {(1, 0): True, (1, 2): False, (2, 1): True, (2, 3): False}


def test_report(spark, sam, tmp_path):
    (tmp_path / "out").mkdir()
    fasta = tmp_path / "long.fa"
    fasta.write_text("".join(f">a{i}\n" + "ACGT" * 400 + "\n" for i in range(8)) + ">b\nAC\n")
    pages = report(spark, [sam, str(fasta)], outdir=str(tmp_path / "out"), plot_end=True, norm=True)
    texts = [open(p, encoding="utf-8").read() for p in pages]
    assert "Mapping statistics" in texts[0] and "57.1% paired" in texts[0] and "Read 2" in texts[0]
    plots = [json.loads(re.search(r"const plots=(\[.*\]);plots", t)[1]) for t in texts]
    ids = {p["id"] for p in plots[0]}
    assert {"bases_1", "bases_2", "qualities_1", "end_bases_1", "norm_bases_2", "mismatches_1", "insertions_2", "deletions_1", "lengths_1"} <= ids and "insertions_1" not in ids
    assert {p["id"] for p in plots[1]} == {"bases_1", "end_bases_1", "norm_bases_1", "lengths_1"} and "9 reads" in texts[1]
    base = next(p for p in plots[1] if p["id"] == "bases_1")
    assert base["labels"][250:253] == ["250", "251-260", "261-270"]
    assert 'type="range"' in texts[1] and "const view=250" in texts[1]
    assert "Read 1" in texts[0] and "Read 1" not in texts[1]


def test_titles_follow_second_mates(spark, tmp_path):
    """Paired reads of which none is a second mate: both mates are looked for, but titles name none."""
    (tmp_path / "x.sam").write_text("".join(f"r{i}\t65\tchr\t1\t9\t2M\t*\t0\t0\tAC\tII\n" for i in range(5)))
    page = open(report(spark, str(tmp_path / "x.sam"))[0], encoding="utf-8").read()
    assert "100.0% paired" in page and "<h2>Base composition</h2>" in page and "Read 1" not in page


def test_empty_input(spark):
    p = profile_reads(spark.createDataFrame([], RAW), "none.sam")
    assert all(t.count() == 0 for n, t in p.tables.items() if n != "pairs") and p.tables["pairs"].first().total == 0


def test_stream_counts_like_a_batch(spark, sam, tmp_path):
    from readqc.streaming import profiles as S

    raw = read(spark, sam)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, make in (("read_counts", S.read_counts), ("lengths", S.lengths), ("bases", S.bases)):
        q = make(S.stream_of_records(spark, str(tmp_path / "in"), 1)).writeStream.outputMode("complete").format("memory").queryName(f"s_{name}").start()
        q.processAllAvailable()
        q.stop()
        got = sorted(map(tuple, spark.table(f"s_{name}").collect()))
        assert got == sorted(map(tuple, getattr(P, name)(derive(raw)).collect()))


@pytest.mark.parametrize("place", ["start", "end", "norm"])
def test_block_counts_equal_the_plain_plan(spark, place):
    from readqc.functions import reads as R

    rows = [(1, 0, "ACGTNacgt"), (1, 0, "é🙂A" * 40), (2, None, "A"), (2, 3, ""), (1, 0, None), (2, None, "!~I#" * 100)] * 3
    frame = spark.createDataFrame(rows, "read_no int, mapq_bin int, s string").repartition(3)
    for kind, series in (("base", R.base_code), ("quality", R.phred)):
        if kind == "quality":
            frame = frame.where("s is null or s not like '%é%'")
        fast = P.tally(frame, F.col("s"), P.KEY, kind, place)
        plain = P.per_base(frame, F.col("s"), P.KEY, series, place)
        show = lambda x: sorted(map(str, x.select("read_no", "mapq_bin", "pos", "series", "n").collect()))
        assert show(fast) == show(plain) and fast.count()


def test_wide_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "CELLS", 10)
    got = list(P._counting(["k"], "base", "start")(iter([__import__("pyarrow").RecordBatch.from_pydict({"k": [1, 2, 1], "_s": ["ACG", "A", "AA"]})])))
    assert sorted(zip(*(got[0].column(i).to_pylist() for i in range(4)))) == [(1, 0, 0, 2), (1, 1, 0, 1), (1, 1, 1, 1), (1, 2, 2, 1), (2, 0, 0, 1)]


def stored(data, size=60_000):
    """Blocks of level 0: what stands in the records stands in the file."""
    out = b""
    for i in range(0, len(data), size):
        raw = data[i : i + size]
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out + bgzf(b"")


def tagged(n, tag):
    """A BAM header and n records, each with the bytes in a tag."""
    out = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 4) + b"chr\0" + struct.pack("<i", 1000)
    for i in range(n):
        name = f"r{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", 0, i, len(name), 30, 0, 1, 0, 10, -1, -1, 0) + name + struct.pack("<I", 10 << 4) + b"\x11" * 5 + b"\x20" * 10 + b"XBBC" + struct.pack("<i", len(tag)) + tag
        out += struct.pack("<i", len(body)) + body
    return out


@pytest.mark.parametrize("tag", [b"\x1f\x8b\x08\x04", bgzf(b"A whole block stands in each record." * 3)])
@pytest.mark.parametrize("size", [5_000, 60_000])
def test_block_separators_inside_blocks(spark, split, tmp_path, tag, size):
    path = tmp_path / "stored.bam"
    n = 200 if len(tag) < 10 else 400
    path.write_bytes(stored(tagged(n, tag), size))
    for step in (1_500, 3_001, 6_007, 9_001, 10**6):
        split(step)
        for mode in ("FAILFAST", "PERMISSIVE"):
            assert sorted(int(r.read_id[1:]) for r in read(spark, str(path), mode=mode).collect()) == list(range(n))


def test_splits_longer_than_a_chain(spark, split, tmp_path):
    """Real splits of some hundred kilobytes: blocks are found by their chain, few bytes are fragments."""
    path = tmp_path / "long.bam"
    path.write_bytes(stored(tagged(12_000, b"\x1f\x8b\x08\x04" + bytes(range(100))), 50_000))
    split(400_000)
    raw = read(spark, str(path), issues=True)
    assert raw.where("issue is not null").count() == 0 and raw.select("read_id").distinct().count() == raw.count() == 12_000
    found = records._bam(False)
    pieces = path.read_bytes()[400_000:1_300_000].split(records.MAGIC)[1:]
    got = list(found(iter([__import__("pyarrow").array(pieces, "binary")]), False, "x", False))
    places = {x[0]: len(x[1]) for x in got if isinstance(x, tuple)}
    assert places[records.EARLY] < 200_000 and sum(len(x) for x in got if not isinstance(x, tuple)) > 4_000 and records.TAIL in places


def fastq(n, quality, name="r"):
    return "".join(f"@{name}{i}\n{'ACGT'[i % 4] * len(quality)}\n+\n{quality}\n" for i in range(n))


def test_quality_offset_of_each_file(spark, tmp_path):
    """Older files have qualities on 64; SAM is on 33 by its format."""
    (tmp_path / "old.fq").write_text(fastq(4, "hhhB"))
    (tmp_path / "new.fq").write_text(fastq(4, "II5!"))
    (tmp_path / "high.fq").write_text(fastq(4, "IIII"))
    (tmp_path / "x.sam").write_text("r\t0\tchr\t1\t9\t4M\t*\t0\t0\tACGT\thhhB\n")
    names = {n: str(tmp_path / n) for n in ("old.fq", "new.fq", "high.fq", "x.sam")}
    levels = lambda p: [r.series for r in p.tables["qualities"].orderBy("pos").collect()]
    found = profile(spark, list(names.values()), plot_end=True)
    assert {n: levels(found[p]) for n, p in names.items()} == {"old.fq": [40, 40, 40, 2], "new.fq": [40, 40, 20, 0], "high.fq": [40] * 4, "x.sam": [41, 41, 41, 33]}
    assert sorted(r.series for r in found[names["old.fq"]].tables["qualities_from_end"].collect()) == [2, 40, 40, 40]
    assert levels(profile(spark, names["old.fq"], quality_offset=33)[names["old.fq"]]) == [41, 41, 41, 33]
    assert levels(profile(spark, names["old.fq"], peek=10)[names["old.fq"]]) == [40, 40, 40, 2]
    assert next(iter(profile(spark, names["high.fq"], quality_offset=64).values())).tables["qualities"].agg(F.max("series")).first()[0] == 9


def test_many_files_in_one_plan(spark, tmp_path):
    """One damaged file of many: all others have their pages and the tables that they have alone."""
    (tmp_path / "out").mkdir()
    paths = []
    for i in range(24):
        path = tmp_path / f"f{i}.fq"
        path.write_text(fastq(3 + i % 5, "hh" if i % 2 else "I!", f"x{i}_"))
        paths.append(str(path))
    (tmp_path / "f7.fq").write_text(fastq(3, "II") + "@broken\nACGT\nxx\nII\n@more\nAC\n+\nII\n")
    with pytest.raises(Exception, match="broken FASTQ record in .*f7.fq") as e:
        report(spark, paths, outdir=str(tmp_path / "out"))
    assert list(e.value.failed) == [paths[7]] and len(e.value.pages) == len(list((tmp_path / "out").iterdir())) == 23
    found = profile(spark, paths)
    assert len({id(p.shared) for p in found.values()}) == 1
    for p in (paths[0], paths[23]):
        alone = profile(spark, p)[p]
        assert found[p].tables["pairs"].first().total == 3 + int(p.rsplit("f", 2)[1].split(".")[0]) % 5
        for name in alone.tables:
            assert sorted(map(str, alone.tables[name].collect())) == sorted(map(str, found[p].tables[name].collect()))
    with pytest.raises(Exception, match="broken FASTQ"):
        found[paths[7]].tables["bases"].collect()
    loose = profile(spark, paths, mode="PERMISSIVE")
    assert loose[paths[7]].tables["pairs"].first().total == 4 and loose[paths[0]].dropped == {}
    assert loose[paths[7]].dropped == {"broken FASTQ record": (1, len("@broken\nACGT\nxx\nII\n"))}
    page = open(report(spark, paths[7], mode="PERMISSIVE")[0], encoding="utf-8").read()
    assert "Left out: broken FASTQ record, 1 times, 19 bytes" in page and "4 reads" in page


def test_what_is_left_out_is_counted(spark, split, sam, tmp_path):
    whole = bgzf(bam_bytes(BAM_ROWS))
    middle = blocks_at(whole)[10]
    path = tmp_path / "x.bam"
    path.write_bytes(whole[: middle + 60] + bytes([whole[middle + 60] ^ 1]) + whole[middle + 61 :])
    (tmp_path / "broken.sam").write_text(open(sam).read() + "a\tb\n")
    for step in (400, 10**6):
        split(step)
        bad = profile(spark, [str(path), str(tmp_path / "broken.sam")], mode="PERMISSIVE")
        assert bad[str(path)].dropped["damaged block, or the file was cut"][1] > 100
        assert bad[str(tmp_path / "broken.sam")].dropped == {"broken SAM record": (1, 4)}


def test_pages_on_any_path(spark, sam, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.sink.link./pages", f"file://{tmp_path}/pages")
    (tmp_path / "pages").mkdir()
    assert report(spark, sam, outdir="viewfs://sink/pages") == [f"viewfs://sink/pages/{os.path.basename(sam)}.readqc.html"]
    assert "Mapping statistics" in (tmp_path / "pages" / f"{os.path.basename(sam)}.readqc.html").read_text(encoding="utf-8")
    with pytest.raises(ValueError, match="no such folder"):
        report(spark, sam, outdir="viewfs://sink/pages/none")


def test_plans_are_built_without_jobs(spark):
    """No registered query on reads starts a job before its result is asked for; a scan with fewer tasks than cores is dealt out."""
    from readqc.plans.queries import QUERIES

    tracker = spark.sparkContext.statusTracker()
    sf = "/root/testdata/sf0.001"
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        plans = {name: q(spark, sf) for name, q in QUERIES.items()}
        stages = [tracker.getJobInfo(j).stageIds for j in tracker.getJobIdsForGroup("plans")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # what remains is one task for each read of a Parquet file, for its schema
    assert all(len(s) == 1 for s in stages) and len(stages) <= len(plans) + 5
    assert "RoundRobinPartitioning" in plans["base_composition"]._jdf.queryExecution().toString()
    shuffled = P.bases(derive(spark.createDataFrame([], RAW).repartition(3)))
    assert "RoundRobinPartitioning(4)" not in shuffled._jdf.queryExecution().toString()


def test_differences_by_md_and_nm(spark, tmp_path):
    rows = [("a", 0, "5M1I4M2D3M", "4A4^AC3", 4), ("b", 0, "5M1I4M2D3M", "4A4^AC3", 3), ("c", 16, "13M", None, 0), ("d", 0, "13M", "13", None), ("e", 4, "13M", "13", 0), ("f", 0, "13M", None, None)]
    lines = [f"{r}\t{flag}\tchr\t1\t40\t{cigar}\t*\t0\t0\t{'A' * 13}\t{'I' * 13}" + (f"\tNM:i:{nm}" if nm is not None else "") + (f"\tMD:Z:{md}" if md else "") for r, flag, cigar, md, nm in rows]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    found = {(r.verdict): (r.n, r.nm_sum, r.found_sum) for r in P.difference_counts(derive(read(spark, str(tmp_path / "x.sam")))).collect()}
    assert found == {"agrees": (1, 4, 4), "differs": (1, 3, 4), "no_md": (1, 0, None), "no_nm": (1, None, 0)}
    (tmp_path / "x.bam").write_bytes(bgzf(bam_bytes(BAM_ROWS)))
    assert {r.nm for r in read(spark, str(tmp_path / "x.bam")).select("nm").distinct().collect()} == {1, None}
    assert records.tags_of(b"NMC\xc8MDZ5A\0", 0) == ("5A", 200) and records.tags_of(b"NMc\xff", 0) == (None, -1)
