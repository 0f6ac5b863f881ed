"""Text in compressed blocks, read in splits, against the same text in one gzip stream and plain."""

import gzip
import random
import struct
import zlib

import pytest

from readqc.plans.profile import profile
from readqc.sources import blocks, records
from readqc.sources.files import in_order, peek, read
from tests.test_profiles import split  # noqa: F401

END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def packed(data, size=60_000, level=6, closed=True):
    out = []
    for i in range(0, len(data), size):
        part = data[i : i + size]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + END * closed


def texts(n, longest=60, seed=1):
    """The same kind of reads as SAM, FASTA and FASTQ."""
    r = random.Random(seed)
    seqs = ["".join(r.choices("ACGTN", k=r.randrange(longest))) for _ in range(n)]
    quals = ["".join(chr(r.randrange(33, 75)) for _ in s) for s in seqs]
    sam = "@HD\tVN:1.6\n" + "".join(f"r{i}\t{r.choice((0, 16, 4))}\tchr\t{i}\t{r.randrange(60)}\t{len(s)}M\t*\t0\t0\t{s or '*'}\t{q or '*'}\tNM:i:0\tMD:Z:{len(s)}\n" for i, (s, q) in enumerate(zip(seqs, quals)))
    fasta = "".join(f">r{i} a>b\n{s[:30]}\n{s[30:]}\n" for i, s in enumerate(seqs))
    fastq = "".join(f"@r{i}\n{s}\n+\n{q}\n" for i, (s, q) in enumerate(zip(seqs, quals)))
    return {"sam": sam.encode(), "fasta": fasta.encode(), "fastq": fastq.encode()}


def rows(frame):
    return sorted(map(str, frame.drop("file").collect()))


@pytest.mark.parametrize("kind", ["sam", "fasta", "fastq"])
def test_small_splits(spark, split, tmp_path, kind):  # noqa: F811
    text = texts(300)[kind]
    (tmp_path / f"plain.{kind}").write_bytes(text)
    (tmp_path / f"x.{kind}.gz").write_bytes(packed(text, 700))
    want = rows(read(spark, str(tmp_path / f"plain.{kind}")))
    assert len(want) == 300
    for step in (2_000, 7_001, 10**7):
        split(step)
        for mode in ("FAILFAST", "PERMISSIVE"):
            assert rows(read(spark, str(tmp_path / f"x.{kind}.gz"), mode=mode)) == want
    with_alone = read(in_order(spark), str(tmp_path / f"x.{kind}.gz"), alone=True)
    assert [r.read_id for r in peek(with_alone, 20)[0].collect()] == [f"r{i}" for i in range(20)]


@pytest.mark.parametrize("kind,level", [("sam", 6), ("fasta", 0), ("fastq", 0), ("fastq", 6)])
def test_splits_longer_than_a_chain(spark, split, tmp_path, kind, level):  # noqa: F811
    """More than one task reads records of its own, and what the tasks read is the file."""
    text = texts(25_000, 150)[kind]
    path = tmp_path / f"x.{kind}.gz"
    path.write_bytes(packed(text, 40_000, level))
    with gzip.open(tmp_path / f"one.{kind}.gz", "wb", 1) as f:
        f.write(text)
    assert blocks.parted(spark, [str(path), str(tmp_path / f"one.{kind}.gz")]) == ([str(tmp_path / f"one.{kind}.gz")], [str(path)])
    split(400_001)
    got = read(spark, str(path))
    assert rows(got) == rows(read(spark, str(tmp_path / f"one.{kind}.gz")))
    pieces = records._pieces(spark, [str(path)], records.MAGIC, blocks.raw(spark))
    assert pieces.rdd.getNumPartitions() == -(-path.stat().st_size // 400_001) > 2
    rule = blocks.Fastq(False) if kind == "fastq" else blocks.Parts(b"\n>", 1) if kind == "fasta" else blocks.Parts(b"\n", 0)
    found = records.in_blocks(blocks._walk(rule, False), rule.issue, False)
    open_ = pieces.mapInArrow(records._reading(found, records.Names({"x": str(path)}), True), records.FRAGMENT).collect()
    assert sum(len(r.data or b"") for r in open_) < len(text) * (0.5 if level else 0.9)


def test_both_kinds_in_one_folder(spark, tmp_path):
    text = texts(90)["fastq"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fastq.gz").write_bytes(packed(text))
    (tmp_path / "in" / "b.fastq.gz").write_bytes(gzip.compress(text))
    (tmp_path / "in" / "c.fastq").write_bytes(text)
    (tmp_path / "in" / "d.fastq.gz").write_bytes(b"")
    got = read(spark, str(tmp_path / "in"), "fastq")
    assert got.count() == 270
    several = read(spark, [str(tmp_path / "in" / n) for n in ("a.fastq.gz", "b.fastq.gz")])
    assert {r["file"].rsplit("/", 1)[1]: r["count"] for r in several.groupBy("file").count().collect()} == {"a.fastq.gz": 90, "b.fastq.gz": 90}


@pytest.mark.parametrize("kind", ["sam", "fasta", "fastq"])
@pytest.mark.parametrize("step", [1_500, 10**7])
def test_damage_is_counted(spark, split, tmp_path, kind, step):  # noqa: F811
    """A broken checksum, a file that was cut: an error, or all that is whole and a count of the rest."""
    text = texts(300)[kind]
    whole = packed(text, 2_000)
    at = [i for i in range(len(whole)) if whole.startswith(records.MAGIC, i)]
    broken = bytearray(whole)
    broken[at[6] - 6] ^= 1
    split(step)
    want = {r.read_id for r in read(spark, str(_write(tmp_path / f"good.{kind}.gz", whole))).collect()}
    for name, data in (("broken", bytes(broken)), ("cut", whole[: at[-1]]), ("inside", whole[: at[4] + 30])):
        path = str(_write(tmp_path / f"{name}.{kind}.gz", data))
        with pytest.raises(Exception, match="block|file was cut"):
            read(spark, path).collect()
        got = [r.read_id for r in read(spark, path, mode="PERMISSIVE").collect()]
        assert len(got) == len(set(got)) and set(got) <= want | {"r"}
        if name == "broken":  # a block has 2,000 of some 12,000 bytes or more
            assert 300 * (1 - 2_000 / len(text)) - 12 <= len(got) < 300
        assert read(spark, path, mode="PERMISSIVE", issues=True).where("issue is not null").count() >= 1
    dropped = profile(spark, str(tmp_path / f"broken.{kind}.gz"), mode="PERMISSIVE")[str(tmp_path / f"broken.{kind}.gz")].dropped
    assert sum(n for n, _ in dropped.values()) >= 1


def _write(path, data):
    path.write_bytes(data)
    return path


def test_texts_that_are_odd(spark, tmp_path):
    """No records, no line end at the end, bytes that are no UTF-8, a record over several blocks."""
    cases = {"e.fastq.gz": (b"", 0), "n.fastq.gz": (b"@a\nAC\n+\nII", 1), "u.fastq.gz": (b"@\xff\xfe\nAC\n+\nII\n", None), "l.fasta.gz": (b">a\n" + b"ACGT\n" * 50_000 + b">b\nA\n", 2), "e.sam.gz": (b"@HD\tVN:1.6\n", 0)}
    for name, (text, n) in cases.items():
        path = str(_write(tmp_path / name, packed(text, 9_000)))
        if n is not None:
            assert read(spark, path).count() == n
    longest = read(spark, str(tmp_path / "l.fasta.gz")).selectExpr("max(length(seq)) AS n").first().n
    assert longest == 200_000
