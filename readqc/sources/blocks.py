"""Text in compressed blocks (.sam.gz, .fasta.gz, .fastq.gz as block-compressing tools write them), read in splits.

Such a file is gzip to everyone, and Spark's text reader gives it to one task because of its name. Here the reader is told
not to decompress (raw), blocks are found as in BAM (records), and what they hold is cut into records: a line of
SAM, what stands up to a line end before the next > of FASTA, four lines of FASTQ. Where a record runs over a split's border
its parts are fragments, which meet in one task a file as those of BAM do. Files whose first block doesn't give its own length
are plain gzip and stay one task each.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readqc.sources import records as rec
from readqc.sources.records import HEAD, TAIL, WHOLE, Names

#: Bytes of text that are cut at once.
ENOUGH = 1 << 20
#: Records as text, and rows that stand for what can't be read.
TEXT = "file string, value string, issue string, lost long"
_TEXT = {"file": pa.string(), "value": pa.string(), "issue": pa.string(), "lost": pa.int64()}


def raw(spark: SparkSession) -> dict:
    """Options under which the text reader takes .gz files as they are, in splits. Hadoop looks for the last known suffix, in
    reversed order, before the name's own; a suffix that no file has stands between .gz and any letter before it."""
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", codec.OPT_EXTENSION: ".!.gz"}


def parted(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The paths to read as usual, and those of files in compressed blocks, told by their first bytes. A folder or pattern that
    holds both kinds is named file by file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def in_blocks(status) -> bool:
        if status.getLen() < rec.HEADER or not re.search(r"\w\.gz$", status.getPath().getName()):
            return False
        stream = status.getPath().getFileSystem(conf).open(status.getPath())
        try:
            return rec.block_size(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, rec.HEADER))) > 0
        finally:
            stream.close()

    def files(path: str) -> list:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = []
        for status in fs.globStatus(p) or ():
            found += [x for x in fs.listStatus(status.getPath()) if x.isFile() and x.getPath().getName()[0] not in "_."] if status.isDirectory() else [status]
        return found

    def sort(path: str) -> tuple[list[str], list[str]]:
        if re.search(r"\.[A-Za-z]+$", path) and not path.endswith(".gz"):  # a file of another kind
            return [path], []
        known = files(path)
        blocked = [in_blocks(x) for x in known]
        if not any(blocked):
            return [path], []
        if all(blocked):
            return [], [path]
        named = [re.sub(r"([\[\]{}*?\\])", r"\\\1", x.getPath().toString()) for x in known]
        return [n for n, b in zip(named, blocked) if not b], [n for n, b in zip(named, blocked) if b]

    with ThreadPoolExecutor(16) as pool:
        sorted_ = list(pool.map(sort, paths))
    return [p for plain, _ in sorted_ for p in plain], [p for _, blocked in sorted_ for p in blocked]


def _texts(path: str, values: list, issue: str | None = None, lost: int | None = None) -> pa.RecordBatch:
    n = len(values)
    columns = [pa.repeat(path, n), pa.array(values, pa.binary()).cast(pa.string(), safe=True), pa.array([issue] * n, pa.string()), pa.array([lost] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=list(_TEXT))


def _readable(values: list) -> list:
    """Bytes that are no UTF-8 become the replacement character, as in Spark's reader."""
    return [v if v.isascii() else v.decode("utf-8", "replace").encode() for v in values]


class Parts:
    """Records with a separator between them; ``kept`` bytes of it belong to the next record. ``first`` finds where the first record
    begins in text that may start inside one; ``cut`` takes whole records from text that starts with one and gives the bytes
    used, those left out, and the batch."""

    schema = TEXT

    def __init__(self, separator: bytes, kept: int) -> None:
        self.separator, self.size = separator, len(separator) - kept

    def issue(self, path: str, issue: str, lost: int) -> pa.RecordBatch:
        return _texts(path, [None], issue, lost)

    def first(self, data: bytearray, final: bool) -> int | None:
        at = data.find(self.separator)
        return at + self.size if at >= 0 else None

    def cut(self, data: bytearray, final: bool, path: str, light: bool) -> tuple[int, int, pa.RecordBatch | None]:
        end = len(data) if final else data.rfind(self.separator) + self.size
        if end < self.size or not end or light:
            return max(0, end), 0, None
        values = [v for v in bytes(data[:end]).split(self.separator) if v.strip()]
        return end, 0, _texts(path, _readable(values)) if values else None


class Fastq:
    """Records of four lines; see Parts."""

    schema = rec.ROWS
    issue = staticmethod(rec._issue)

    def __init__(self, permissive: bool) -> None:
        self.permissive = permissive

    def first(self, data: bytearray, final: bool) -> int | None:
        lines = bytes(data[: data.rfind(b"\n") + 1]).split(b"\n")[:-1]
        if not final and len(lines) <= rec.LINES:
            return None
        at = rec._first_record(lines[1:])  # the first line may be the end of one
        return None if at is None else sum(len(x) + 1 for x in lines[: at + 1])

    def cut(self, data: bytearray, final: bool, path: str, light: bool) -> tuple[int, int, pa.RecordBatch | None]:
        end = len(data) if final else data.rfind(b"\n") + 1
        lines = bytes(data[:end]).split(b"\n")
        if not lines[-1]:
            lines.pop()
        n, lost = len(lines) // 4, 0
        arrays = rec._fast(pa.array(lines, pa.binary()), n) if n else None
        if arrays:
            at, batch = 4 * n, None if light else rec._fastq_batch(path, *arrays)
        else:
            try:
                rows, at, lost = rec._fastq_whole(lines, self.permissive)
            except rec._Broken as e:
                return end, e.lost, None
            batch = rec._fastq_batch(path, *zip(*rows)) if rows and not light else None
        if final:
            return end, lost + sum(len(x) + 1 for x in lines[at:] if x.strip()), batch
        return sum(len(x) + 1 for x in lines[:at]), lost, batch


def _walk(kind, permissive: bool):
    """What records.in_blocks asks for: the records of what blocks hold, issues, and at the end (place, bytes) of what is open. A
    TAIL without bytes: after a gap no record began any more."""

    def walk(chunks: Iterator, path: str, first: bool, light: bool) -> Iterator:
        data, lost, headed, grown = bytearray(), not first, first, 0
        for chunk in itertools.chain(chunks, [rec._FINAL]):
            gap, edge = isinstance(chunk, tuple), chunk == rec._EDGE
            if chunk == rec._LOST:
                data, lost, headed, grown = bytearray(), True, True, 0
                continue
            end = gap or edge or chunk == rec._FINAL
            if not end:
                data += chunk
                if len(data) < grown:
                    continue
            if lost and data:
                at = kind.first(data, end)
                if at is not None:
                    if not headed:
                        yield HEAD, bytes(data[:at])
                    del data[:at]
                    lost, headed = False, True
            if not lost:
                used, bad, batch = kind.cut(data, edge, path, light)
                if batch is not None:
                    yield batch
                del data[:used]
                if bad:
                    yield kind.issue(path, rec.BROKEN, bad)
                    if not permissive:
                        return
            grown = max(ENOUGH, 2 * len(data))
            if gap:
                yield kind.issue(path, rec.DAMAGED, chunk[1] + len(data))
                if not permissive:
                    return
                if not headed:
                    yield HEAD, bytes(data)
                data, lost, headed, grown = bytearray(), True, True, 0
            elif edge:
                if lost and data:
                    yield kind.issue(path, rec.DAMAGED, len(data))
                data, lost, grown = bytearray(), False, 0
        if lost and not headed:
            yield WHOLE, bytes(data)
        else:
            if lost and data:
                yield kind.issue(path, rec.DAMAGED, len(data))
            yield TAIL, None if lost else bytes(data)

    return walk


def read(spark: SparkSession, paths: list[str], kind: str, names: Names, mode: str = "FAILFAST", alone: bool = False) -> DataFrame:
    """Records (FASTQ), or the text of each (SAM: lines, FASTA; columns TEXT), of files in compressed blocks."""
    permissive = mode != "FAILFAST"
    rule = {"sam": Parts(b"\n", 0), "fasta": Parts(b"\n>", 1), "fastq": Fastq(permissive)}[kind]
    walk = _walk(rule, permissive)
    return rec._read(spark, paths, rec.MAGIC, rec.in_blocks(walk, rule.issue, permissive), rec.blocks_stitched(walk, rule.issue, permissive), names, alone, rule.schema, raw(spark))
