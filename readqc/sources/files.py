"""File types, and reads in the canonical schema from SAM, BAM, FASTA and FASTQ files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.operators.reads import RAW
from readqc.sources import blocks
from readqc.sources.records import Names, plain, read_bam, read_fastq

# Name endings and what they hold. The second list is accepted beyond the usual names.
ENDINGS = {
    ".sam": "sam", ".bam": "bam", ".fasta": "fasta", ".fa": "fasta", ".fastq": "fastq", ".fq": "fastq",
    ".fasta.gz": "fasta", ".fna.gz": "fasta", ".fastq.gz": "fastq",
}
MORE_ENDINGS = {".fna": "fasta", ".fa.gz": "fasta", ".fq.gz": "fastq", ".sam.gz": "sam"}


def file_type(path: str, more: bool = True) -> str | None:
    """sam, bam, fasta or fastq by the name's ending; None if it is unknown."""
    known = ENDINGS | (MORE_ENDINGS if more else {})
    found = [e for e in known if path.endswith(e)]
    return known[max(found, key=len)] if found else None


def chosen(paths: list[str]) -> list[tuple[str, str]]:
    """(path, type) of the files that can be read; doubles are refused, unknown ones left out unless all are."""
    if len(set(paths)) < len(paths):
        raise ValueError("an input file is named twice")
    known = [(p, t) for p in paths if (t := file_type(p))]
    if not known:
        raise ValueError("no input file of a known type")
    return known


def address(spark: SparkSession, path: str) -> str:
    """The path as Spark names the file in a row's metadata."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain(p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString())


def read(spark: SparkSession, path: str | list[str], kind: str | None = None, mode: str = "FAILFAST", alone: bool = False, issues: bool = False) -> DataFrame:
    """One file, or several of one type, as records in one plan; ``file`` has the path as it was given, ``nm`` the file's own
    number of differences (tag NM) of mapped reads. kind overrides what the name says.
    mode: FAILFAST raises for what can't be read, PERMISSIVE leaves it out. alone: the session reads a file as one
    split (in_order), so records come in one pass in file order. issues: keep the rows that stand for what can't be
    read (columns issue and lost; everything else but file is null) instead, whatever the mode."""
    paths = [path] if isinstance(path, str) else list(path)
    kind = kind or file_type(paths[0])
    names = Names({address(spark, p): p for p in paths})
    if kind not in ("sam", "bam", "fasta", "fastq"):
        raise ValueError(f"unknown file type: {paths[0]}")
    usual, blocked = (paths, []) if kind == "bam" else blocks.parted(spark, paths)
    found = []
    if usual and kind in ("bam", "fastq"):
        found.append((read_bam if kind == "bam" else read_fastq)(spark, usual, names, mode, alone))
    elif usual:
        found.append((read_sam if kind == "sam" else read_fasta)(spark, usual, names))
    if blocked:
        rows = blocks.read(spark, blocked, kind, names, mode, alone)
        found.append(rows if kind == "fastq" else (_sam if kind == "sam" else _fasta)(rows))
    rows = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if issues:
        return rows
    whole = F.col("issue").isNull()
    if mode == "FAILFAST" and (kind != "fasta" or blocked):
        whole = F.when(whole, True).otherwise(F.raise_error(F.concat_ws(" ", "issue", F.lit("in"), "file")))
    return rows.where(whole).drop("issue", "lost")


def _lines(rows: DataFrame, names: Names) -> DataFrame:
    """What the text reader gives, in the columns blocks.TEXT."""
    f = F.col("_metadata.file_path")
    given = F.lit(names.only) if names.only else F.coalesce(F.create_map(*(F.lit(x) for pair in names.known.items() for x in pair))[F.regexp_replace(f, "^file:///", "file:/")], f)
    return rows.select(given.alias("file"), "value", _missing("string").alias("issue"), _missing("long").alias("lost"))


def _named(*columns: Column) -> list[Column]:
    made = ("read_id", "flag", "mapq", "cigar", "seq", "qual", "md", "is_aligned")
    return [F.col("file"), *(c.alias(n) for c, n in zip(columns, made))]


def read_sam(spark: SparkSession, paths: list[str], names: Names) -> DataFrame:
    """SAM text, split by bytes into tasks."""
    return _sam(_lines(spark.read.text(paths), names))


def _sam(lines: DataFrame) -> DataFrame:
    """Lines as records. Only the columns that profiles use are taken out of a line."""
    lines = lines.where(F.col("issue").isNotNull() | ~F.col("value").startswith("@") & (F.length("value") > 0))
    x = F.split("value", "\t", 12)
    at = lambda i: F.try_element_at(x, F.lit(i))
    whole = F.col("value").isNotNull() & (F.size(x) >= 11) & at(2).rlike("^[0-9]+$") & at(5).rlike("^[0-9]+$")
    own = lambda c: F.when(whole, c)
    md = F.regexp_extract(F.coalesce(at(12), F.lit("")), r"(?:^|\t)MD:Z:([^\t]*)", 1)
    nm = F.regexp_extract(F.coalesce(at(12), F.lit("")), r"(?:^|\t)NM:i:(-?[0-9]+)", 1).try_cast("int")
    flag = at(2).try_cast("int")
    mapped = flag.bitwiseAND(F.lit(4)) == 0
    present = lambda c: F.when(c != "*", c)
    columns = (at(1), flag, at(5).try_cast("int"), present(at(6)), F.when(at(10) == "*", "").otherwise(at(10)), present(at(11)), F.when(mapped & (md != ""), md), F.lit(True))
    issue, lost = F.when(~whole, "broken SAM record"), F.when(~whole, F.octet_length("value") + 1).cast("long")
    return lines.select(*_named(*map(own, columns)), F.coalesce("issue", issue).alias("issue"), F.coalesce("lost", lost).alias("lost"), own(F.when(mapped, nm)).alias("nm"))


def _missing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def read_fasta(spark: SparkSession, paths: list[str], names: Names) -> DataFrame:
    """FASTA text: each record is what stands up to a line end before the next >, so plain files are split by bytes."""
    return _fasta(_lines(spark.read.option("lineSep", "\n>").text(paths), names))


def _fasta(records: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("value", r"^>", ""), r"\r", "")
    head = F.substring_index(text, "\n", 1)
    seq = F.regexp_replace(F.substring(text, F.length(head) + 2, F.length(text)), r"\s", "")
    rows = records.where(F.col("issue").isNotNull() | (F.length(F.trim("value")) > 0))
    aligned = F.when(F.col("issue").isNull(), False)
    columns = (F.regexp_extract(head, r"^\s*(\S*)", 1), _missing("int"), _missing("int"), _missing("string"), seq, _missing("string"), _missing("string"), aligned)
    return rows.select(*_named(*columns), "issue", "lost", _missing("int").alias("nm"))


def asked(n: int, mode: str = "exact", block: int = 10_000) -> int:
    """How many records a peek of n reads at most: n, or in mode chunk whole blocks past n."""
    if n < 10:
        raise ValueError("peek needs at least 10 records")
    if mode not in ("exact", "chunk"):
        raise ValueError(f"unknown peek mode {mode!r}")
    return n if mode == "exact" else block * (n // block + 1)


def in_order(spark: SparkSession) -> SparkSession:
    """A session (settings of its own, the same cluster) in which a file is one split: its records come in file order,
    and a limit stops reading."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 50))
    own.conf.set("spark.sql.files.openCostInBytes", str(1 << 50))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    return own


def peek(reads: DataFrame, n: int, mode: str = "exact", block: int = 10_000, aligned: bool = False) -> tuple[DataFrame, int | None]:
    """The first records of one file (read in order, see in_order), and their number if there are more.

    exact: n records. chunk: whole blocks past n, and there count as more: for aligned files a last block that is full,
    for others more than n records.
    """
    most = asked(n, mode, block)
    first = reads.limit(most)
    found = reads.limit(most + (mode == "exact")).count()
    more = found > n if mode == "exact" or not aligned else found == most
    return first, min(found, most) if more else None


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file wherever Spark can, not only on the driver's disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = (fs.getRawFileSystem() if fs.getScheme() == "file" else fs).create(p, True)  # raw: no checksum file beside it
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def size_and_time(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Bytes and time of change (milliseconds) of what a path or pattern names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.globStatus(p) or ())
    return (sum(fs.getContentSummary(x.getPath()).getLength() for x in found), max(x.getModificationTime() for x in found)) if found else None


def output_path(path: str, outdir: str | None = None, suffix: str = "readqc.html", checked: bool = False) -> str:
    """Beside the input, or in outdir, which is needed for files elsewhere than on this machine. checked: outdir is known to be a
    folder; else it must be one here."""
    if outdir is None and "://" in path and not path.startswith("file://"):
        raise ValueError(f"name an outdir for the report of {path}")
    path = path.removeprefix("file://")
    if outdir is not None and not checked and not os.path.isdir(outdir):
        raise ValueError(f"no such folder: {outdir}")
    return f"{path}.{suffix}" if outdir is None else f"{outdir.rstrip('/')}/{os.path.basename(path)}.{suffix}"


SCHEMA = RAW
