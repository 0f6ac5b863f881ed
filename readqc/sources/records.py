"""FASTQ and BAM records out of Spark's own text reader, so that any path Spark opens can be read, in splits.

FASTQ is read line by line. BAM's compressed blocks all begin with the same four bytes: with these as line separator
every row of the text reader begins where a block may begin, and all rows in a row are the file. As the four bytes may
also stand inside a block, blocks are found by a chain: each ends, by its own length, where the next one begins. A chance
start inside a block can't keep up a chain for longer than a block can be (LONGEST), so a split takes the first place that a
chain reaches after that length, and hands on what stands before it, and the part of a block that is cut at its end, as
fragments.

A record may begin in one split and end in another, too. Each split finds its own first record, gives the whole records, and
hands on what stands before the first and after the last one. All fragments of a file meet in one task, in order, where they must
make whole blocks and whole records again: a wrong start or a lost piece can't go unseen. A split too short for a chain is
one fragment. Fragments come from a first walk that only looks at lengths and builds no record.

Nothing is raised inside a task: a row with an ``issue`` (what is wrong) and ``lost`` (bytes left out) stands for what
can't be read, so that other files of the same plan are read all the same; files.read() raises for it. mode FAILFAST gives up a
split at its first issue: damaged blocks (length, checksum), broken records, records that don't end, a BAM file without its
closing empty block (a file that was cut). PERMISSIVE leaves out what is damaged and goes on with the next whole record.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readqc.operators.reads import RAW

# Fixed values of the public BAM format: first bytes of a block, letters of base codes and operations, sizes of tag values.
MAGIC = b"\x1f\x8b\x08\x04"
LETTERS = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}

_SHOWN = bytes(min(q + 33, 126) for q in range(256))
_PAIRS = [a + b for a in LETTERS for b in LETTERS]
#: Records of an Arrow batch; lines in which a split's first record must begin to be found; bytes searched at once for one.
BATCH, LINES, SEARCHED = 5_000, 400, 1 << 18
#: Bytes in which a block's own length stands, in the usual layout.
HEADER = 18
FRAGMENT = "f string, start long, place int, data binary"
#: Places of a split's fragments: compressed bytes before its first block; what belongs to the split before; all of it, if no
#: record begins there; what is open at the end; compressed bytes of the block that is cut; how the split ends.
EARLY, HEAD, WHOLE, TAIL, REST, END = range(6)
#: Bytes of a compressed block at most, by the format; bytes in which a split's first chain is sought.
LONGEST, SOUGHT = 1 << 16, 1 << 18
#: The end of a split with an issue of its own, in mode FAILFAST.
GIVEN_UP = b"\2"
#: Marks among chunks of bytes: the end, and a place where a record must begin.
_FINAL, _EDGE = "final", "edge"
#: And one where it isn't known any more where a record begins.
_LOST = "lost"

_NAMES = ("file", "read_id", "flag", "mapq", "cigar", "seq", "qual", "md", "is_aligned", "issue", "lost", "nm")
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int32())
#: Records, and rows that stand for what can't be read; nm: the file's own count of differences.
ROWS = RAW + ", issue string, lost long, nm int"


def _issue(path: str, issue: str, lost: int) -> pa.RecordBatch:
    row = [path, *[None] * 8, issue, lost, None]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES)], names=list(_NAMES))


class Names:
    """The name of a file as it was given, for its address in Spark."""

    def __init__(self, known: dict) -> None:
        self.known, self.only = known, next(iter(known.values())) if len(known) == 1 else None

    def __call__(self, f: str) -> str:
        return self.known.get(plain(f)) or self.only or f


def plain(address: str) -> str:
    """Local addresses are written with one slash or three."""
    return "file:/" + address[8:] if address.startswith("file:///") else address


def _pieces(spark: SparkSession, path: list[str], separator: bytes | None = None, options: dict | None = None) -> DataFrame:
    """f, start (of the split) and x (bytes) of every line."""
    reader = spark.read.options(**options or {})
    if separator:
        reader = reader.option("lineSep", separator.decode("latin-1")).option("encoding", "ISO-8859-1")
    return reader.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("x"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((f, start), its batches of x) of one split after another; each must be read before the next."""

    def parts():
        for batch in batches:
            starts = batch.column("start").to_numpy()
            files = batch.column("f").dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield (batch.column("f")[a].as_py(), int(starts[a])), batch.column("x").slice(a, b - a)

    for key, group in itertools.groupby(parts(), key=lambda p: p[0]):
        yield key, (x for _, x in group)


def _reading(found, names: Names, fragments: bool):
    """A function for mapInArrow: found(pieces, first, name, light) gives (place, bytes) for fragments and record batches; light:
    batches aren't wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, start), pieces in _splits(batches):
            own = []
            for x in found(pieces, start == 0, names(f), fragments):
                if isinstance(x, tuple):
                    own.append((f, start, *x))
                elif not fragments:
                    yield x
            for _ in pieces:  # a split that was given up is read to its end
                pass
            if fragments and own:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), (pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["f", "start", "place", "data"])

    return run


def _stitching(whole, names: Names):
    """Fragments come by file, split and place: the records that they make together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("f", "place", "data"))))
        for f, group in itertools.groupby(rows, key=lambda r: r[0]):
            yield from whole((r[1:] for r in group), names(f))

    return run


def _alone(found, whole, names: Names):
    """For files of one split each: records and what is open at the end, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, _), pieces in _splits(batches):
            fragments = []
            for x in found(pieces, True, names(f), False):
                if isinstance(x, tuple):
                    fragments.append(x)
                else:
                    yield x
            yield from whole(iter(fragments), names(f))
            for _ in pieces:
                pass

    return run


def _read(spark: SparkSession, paths: list[str], separator: bytes | None, found, whole, names: Names, alone: bool, schema: str | None = None, options: dict | None = None) -> DataFrame:
    pieces, schema = _pieces(spark, paths, separator, options), schema or ROWS
    if alone:
        return pieces.mapInArrow(_alone(found, whole, names), schema)
    n = max(1, min(200, spark.sparkContext.defaultParallelism))
    parts = pieces.mapInArrow(_reading(found, names, True), FRAGMENT).repartition(n, "f").sortWithinPartitions("f", "start", "place")
    return pieces.mapInArrow(_reading(found, names, False), schema).unionByName(parts.mapInArrow(_stitching(whole, names), schema))


# FASTQ


def is_record(lines: list) -> bool:
    return len(lines) == 4 and lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].strip()) == len(lines[3].strip())


def _first_record(lines: list) -> int | None:
    """The line where three records follow each other, or as many as there are up to the end."""
    for i in range(min(len(lines), LINES)):
        at, good = i, 0
        while good < 3 and is_record(lines[at : at + 4]):
            at, good = at + 4, good + 1
            while at < len(lines) and not lines[at].strip():
                at += 1
        if good == 3 or good and len(lines) - at < 4 and (at >= len(lines) or lines[at][:1] == b"@"):
            return i
    return None


def _fastq_batch(path: str, heads, seqs, quals) -> pa.RecordBatch:
    """A batch of the records whose lines these are (binary)."""
    text = lambda x: pc.utf8_trim_whitespace(pa.array(x, pa.binary()).cast(pa.string()))
    n = len(heads)
    names = pc.struct_field(pc.extract_regex(pc.utf8_slice_codeunits(pa.array(heads, pa.binary()).cast(pa.string()), 1), r"^\s*(?P<name>\S*)"), 0)
    quals = text(quals)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.string())]
    columns = [pa.repeat(path, n), names, *none, text(seqs), pc.if_else(pc.equal(pc.utf8_length(quals), 0), pa.scalar(None, pa.string()), quals), pa.nulls(n, pa.string()), pa.repeat(False, n), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=list(_NAMES))


class _Broken(Exception):
    """A record that can't be read, in mode FAILFAST; lost: bytes of its first line."""

    def __init__(self, lost: int) -> None:
        self.lost = lost


BROKEN = "broken FASTQ record"
DAMAGED = "damaged block, or the file was cut"


def _fastq_whole(lines: list, permissive: bool) -> tuple[list, int, int]:
    """The records of lines from a known start on, the first line not used, and bytes left out."""
    out, at, lost = [], 0, 0
    while True:
        while at < len(lines) and not lines[at].strip():
            at += 1
        if at + 4 > len(lines):
            return out, at, lost
        if is_record(lines[at : at + 4]):
            out.append((lines[at], lines[at + 1], lines[at + 3]))
            at += 4
        elif permissive:
            lost += len(lines[at]) + 1
            at += 1
        else:
            raise _Broken(len(lines[at]) + 1)


def _fast(x: pa.Array, n: int) -> tuple | None:
    """Lines of n records as three arrays, if all are well formed."""
    line = lambda i: x.take(pa.array(np.arange(i, 4 * n, 4)))
    heads, seqs, plus, quals = map(line, range(4))
    trimmed = lambda a: pc.binary_length(pc.utf8_trim_whitespace(a.cast(pa.string())))
    ok = pc.and_(pc.and_(pc.starts_with(heads, b"@"), pc.starts_with(plus, b"+")), pc.equal(trimmed(seqs), trimmed(quals)))
    return (heads, seqs, quals) if pc.all(ok).as_py() else None


def _fastq(permissive: bool):
    def found(pieces: Iterator[pa.Array], first: bool, path: str, light: bool) -> Iterator:
        try:
            yield from records(pieces, first, path, light)
        except _Broken as e:
            yield _issue(path, BROKEN, e.lost)

    def records(pieces: Iterator[pa.Array], first: bool, path: str, light: bool) -> Iterator:
        rest: list = []
        synced, lost = first, 0
        for x in pieces:
            if not synced or rest:
                rest += x.to_pylist()
                if not synced:
                    at = _first_record(rest) if len(rest) >= LINES else None
                    if at is None:
                        continue
                    yield HEAD, b"\n".join(rest[:at])
                    rest, synced = rest[at:], True
                x = pa.array(rest, pa.binary())
                rest = []
            n = len(x) // 4
            arrays = _fast(x, n) if n else None
            if arrays:
                if not light:
                    yield _fastq_batch(path, *arrays)
                rest = x.slice(4 * n).to_pylist()
            else:
                lines = x.to_pylist()
                rows, at, bad = _fastq_whole(lines, permissive)
                lost += bad
                if rows and not light:
                    yield _fastq_batch(path, *zip(*rows))
                rest = lines[at:]
        if not synced:  # a short split
            at = _first_record(rest)
            if at is None:
                yield WHOLE, b"\n".join(rest)
                return
            yield HEAD, b"\n".join(rest[:at])
            rows, end, bad = _fastq_whole(rest[at:], permissive)
            lost += bad
            if rows and not light:
                yield _fastq_batch(path, *zip(*rows))
            rest = rest[at + end :]
        if rest:
            yield TAIL, b"\n".join(rest)
        if lost:
            yield _issue(path, BROKEN, lost)

    return found


def _fastq_stitched(permissive: bool):
    def one(held: list, path: str) -> Iterator[pa.RecordBatch]:
        lines = [line for x in held if x for line in x.split(b"\n")]
        try:
            rows, at, lost = _fastq_whole(lines, permissive)
        except _Broken as e:
            rows, at, lost = [], len(lines), e.lost
        lost += sum(len(x) + 1 for x in lines[at:])
        if rows:
            yield _fastq_batch(path, *zip(*rows))
        if lost:
            yield _issue(path, BROKEN, lost)

    def whole(fragments: Iterator[tuple], path: str) -> Iterator[pa.RecordBatch]:
        held: list = []
        for place, data in fragments:
            held.append(data)
            if place == HEAD:
                yield from one(held, path)
                held = []
        if held:
            yield from one(held, path)

    return whole


def read_fastq(spark: SparkSession, paths: list[str], names: Names, mode: str = "FAILFAST", alone: bool = False) -> DataFrame:
    """FASTQ, plain (in splits) or compressed as Spark's text reader knows it (one task a file)."""
    permissive = mode != "FAILFAST"
    return _read(spark, paths, None, _fastq(permissive), _fastq_stitched(permissive), names, alone)


# BAM


def block_size(block: bytes) -> int:
    """Length of a compressed block by its own header, 0 if this is none."""
    if len(block) < 12 or block[:4] != MAGIC:
        return 0
    i, end = 12, 12 + struct.unpack_from("<H", block, 10)[0]
    while i + 4 <= min(end, len(block)):
        n = struct.unpack_from("<H", block, i + 2)[0]
        if block[i : i + 2] == b"BC" and n == 2 and i + 6 <= len(block):
            return struct.unpack_from("<H", block, i + 4)[0] + 1
        i += 4 + n
    return 0


def _blocks(pieces: Iterator[bytes], permissive: bool, final: bool) -> Iterator:
    """What the blocks hold that the pieces make, from a known block on; None stands for a gap, with the bytes left out: (None,
    n). Lengths and checksums are verified. Unless these pieces are final, a block that goes on is given as (REST, bytes)."""
    todo, held = deque(), []
    while True:
        piece = todo.popleft() if todo else next(pieces, None)
        if piece is None and not held:
            return
        if piece is not None:
            held.append(piece)
        block = MAGIC + MAGIC.join(held)  # the four bytes may stand inside a block, too
        size = block_size(block)
        if size > len(block) or not size and len(block) < HEADER:
            if piece is not None:
                continue
            if not final:
                yield REST, block
                return
        else:
            try:
                data = zlib.decompress(block[:size], 31) if size else None
            except zlib.error:
                data = None
            if data is not None and (size == len(block) or permissive and len(held) == 1):
                yield data
                if size < len(block):
                    yield None, len(block) - size
                held = []
                continue
        yield None, len(MAGIC) + len(held[0])
        if not permissive:
            return
        todo.extendleft(reversed(held[1:]))
        held = []


def _synced(pieces: list[bytes]) -> int | None:
    """Number of the first piece that is proven to begin a block: a chain of blocks leads to it from an earlier one, longer
    than a block can be."""
    data = MAGIC + MAGIC.join(pieces)
    sizes = [len(p) + len(MAGIC) for p in pieces]
    starts = dict(zip(itertools.accumulate([0, *sizes[:-1]]), range(len(pieces))))
    for first in starts:
        if first > LONGEST:
            return None
        at = first
        while at in starts and at - first < LONGEST and (size := block_size(data[at : at + LONGEST])):
            at += size
        if at in starts and at - first >= LONGEST:
            return starts[at]
    return None


def _record_size(data, at: int) -> int:
    """Bytes of the record that can start here; 0: none can; -1: too little is known."""
    if len(data) < at + 36:
        return -1
    length, ref, pos, name, _, _, ops, _, bases, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (0 <= bases < 1 << 28 and 32 + name + 4 * ops + (bases + 1) // 2 + bases <= length < 1 << 28 and min(ref, next_ref, pos, next_pos) >= -1 and name >= 1):
        return 0
    if len(data) < at + 36 + name:
        return -1
    if data[at + 35 + name] != 0 or not all(33 <= c <= 126 for c in data[at + 36 : at + 35 + name]):
        return 0
    return length + 4


def _find(data, final: bool) -> int | None:
    """The byte where three records follow each other (fewer, if final data end with them); None if none is known yet."""
    for at in range(len(data)):
        place, good, size = at, 0, 0
        while good < 3 and (size := _record_size(data, place)) > 0:
            place, good = place + size, good + 1
        if good == 3:
            return at
        if size < 0 and not final:
            return None
        if size < 0 and good:
            return at
    return None


def _header_size(data) -> int | None:
    """Bytes before the first record; None if the header goes on, 0 if it is none."""
    if data[:4] != b"BAM\1"[: len(data)]:
        return 0
    if len(data) < 12 or len(data) < (at := 8 + struct.unpack_from("<i", data, 4)[0]) + 4:
        return None
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    for _ in range(n):
        if len(data) < at + 4:
            return None
        at += 8 + struct.unpack_from("<i", data, at)[0]
    return at if len(data) >= at else None


def _walk(chunks: Iterator, path: str, permissive: bool, header: bool, lost: bool, light: bool) -> Iterator:
    """Records of what blocks hold. chunks: bytes, (None, n) for a gap, _EDGE where a record must begin. header: they start with
    the file's header; lost: it isn't known where the first record begins. Gives batches, issues, and at the end
    (place, bytes) of what is open: HEAD before the first record found, WHOLE if there is none, TAIL after the last one."""
    data, at, rows, headed, searched = bytearray(), 0, [], not lost, SEARCHED
    for chunk in itertools.chain(chunks, [_FINAL]):
        if isinstance(chunk, tuple):  # a gap: what is open is lost
            yield _issue(path, DAMAGED, chunk[1] + len(data) - at)
            if not permissive:
                return
            if not headed:
                yield HEAD, bytes(data)
            data, at, header, lost, headed = bytearray(), 0, False, True, True
            continue
        edge = chunk == _EDGE
        final = edge or chunk == _FINAL
        if not final:
            data += chunk
        if header and data:
            size = _header_size(data)
            if size == 0:
                yield _issue(path, "not a BAM file", len(data))
                return
            if size is not None:
                header, at = False, size
        while not header:
            if lost:
                start = _find(data, final) if final or len(data) >= searched else None
                if start is None:
                    searched = max(SEARCHED, 2 * len(data))
                    break
                if not headed:
                    yield HEAD, bytes(data[:start])
                del data[:start]
                at, lost, headed, searched = 0, False, True, SEARCHED
            while (size := _record_size(data, at)) > 0 and at + size <= len(data):
                if not light:
                    row = bam_record(bytes(data[at + 4 : at + size]))
                    if row is None:
                        size = 0
                        break
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield _bam_batch(rows, path)
                        rows = []
                at += size
            if size != 0:
                break
            yield _issue(path, "broken BAM record", max(1, int.from_bytes(data[at : at + 4], "little") if len(data) - at >= 4 else 1))
            if not permissive:
                return
            del data[: at + 1]
            at, lost, searched = 0, True, 0
        if edge:
            if len(data) > at:
                yield _issue(path, "broken BAM record, or the file ends inside one", len(data) - at)
                if not permissive:
                    return
            data, at, header, lost = bytearray(), 0, False, False
        elif at > 1 << 20:
            del data[:at]
            at = 0
    if rows:
        yield _bam_batch(rows, path)
    if header:
        yield WHOLE, bytes(data)
    elif lost and not headed:
        yield WHOLE, bytes(data)
    elif not lost:
        yield TAIL, bytes(data[at:])


def _bam_walk(permissive: bool):
    return lambda chunks, path, first, light: _walk(chunks, path, permissive, first, not first, light)


def _bam(permissive: bool):
    return in_blocks(_bam_walk(permissive), _issue, permissive)


def in_blocks(walk, issue, permissive: bool):
    """What a split of a file in blocks holds. walk(chunks, path, first, light) gives batches, and fragments as (place, bytes)."""

    def found(pieces: Iterator[pa.Array], first: bool, path: str, light: bool) -> Iterator:
        stream = (p for x in pieces for p in x.to_pylist())
        early, rest, closed = [], b"", False
        if first:
            if next(stream, None):
                yield issue(path, "not a BAM file", 0)
                return
        else:
            while True:
                held, size = [], 0
                for p in stream:
                    held.append(p)
                    size += len(p) + len(MAGIC)
                    if size >= SOUGHT:
                        break
                at = _synced(held) if held else None
                early += held if at is None else held[:at]
                if at is not None or size < SOUGHT:
                    break
            if early:
                yield EARLY, MAGIC + MAGIC.join(early)
            if at is None:
                return
            stream = itertools.chain(held[at:], stream)

        def chunks() -> Iterator:
            nonlocal rest, closed
            for x in _blocks(stream, permissive, False):
                if isinstance(x, tuple) and x[0] == REST:
                    rest = x[1]
                else:
                    closed = not x
                    yield x

        for x in walk(chunks(), path, first, light):
            yield x
            if not permissive and not isinstance(x, tuple) and x.column("issue")[0].is_valid:
                yield END, GIVEN_UP
                return
        if rest:
            yield REST, rest
        yield END, b"\1" if closed else b""

    return found


def blocks_stitched(walk, issue, permissive: bool):
    def whole(fragments: Iterator[tuple], path: str) -> Iterator[pa.RecordBatch]:
        """Between two splits: what was open, the block that was cut, what stands before the next one's first block and record."""
        closed, ended = False, False

        def blocks(raw: bytes) -> Iterator:
            nonlocal closed
            for x in _blocks(iter(raw.split(MAGIC)[1:]), permissive, True) if raw else ():
                closed = not x
                yield x

        def chunks() -> Iterator:
            nonlocal closed, ended
            raw = b""
            for place, data in fragments:
                if place in (EARLY, REST):
                    raw += data
                elif place in (HEAD, WHOLE):
                    yield from blocks(raw)
                    raw = b""
                    yield data
                    if place == HEAD:
                        yield _EDGE
                elif place == TAIL:
                    yield _EDGE
                    yield _LOST if data is None else data
                elif data == GIVEN_UP:
                    return
                else:
                    closed = bool(data)
            yield from blocks(raw)
            yield _EDGE
            ended = True

        for x in walk(chunks(), path, True, False):
            if not isinstance(x, tuple):
                yield x
        if ended and not closed:
            yield issue(path, "the file was cut: it lacks the empty block that closes it", 0)

    return whole


def read_bam(spark: SparkSession, paths: list[str], names: Names, mode: str = "FAILFAST", alone: bool = False) -> DataFrame:
    permissive = mode != "FAILFAST"
    return _read(spark, paths, MAGIC, _bam(permissive), blocks_stitched(_bam_walk(permissive), _issue, permissive), names, alone)


def _bam_batch(rows: list, path: str) -> pa.RecordBatch:
    *own, nm = zip(*rows)
    columns = [[path] * len(rows), *own, [True] * len(rows), [None] * len(rows), [None] * len(rows), nm]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=list(_NAMES))


def bam_record(x: bytes) -> tuple | None:
    """read_id, flag, mapq, cigar, seq, qual, md, nm of a record; None if it is not well formed up to its end."""
    _, _, name_size, mapq, _, n_ops, flag, n, _, _, _ = struct.unpack_from("<iiBBHHHiiii", x)
    at = 32
    name = x[at : at + name_size - 1].decode()
    at += name_size
    codes = struct.unpack_from(f"<{n_ops}I", x, at)
    at += 4 * n_ops
    seq = "".join(map(_PAIRS.__getitem__, x[at : at + (n + 1) // 2]))[:n]
    at += (n + 1) // 2
    qual = x[at : at + n]
    at += n
    try:
        cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in codes)
        md, nm = tags_of(x, at)
    except (IndexError, KeyError, ValueError, struct.error):
        return None
    shown = None if not n or qual[0] == 0xFF else qual.translate(_SHOWN).decode()
    return name, flag, mapq, cigar or None, seq, shown, *((None, None) if flag & 4 else (md, nm))


def tags_of(x: bytes, at: int) -> tuple[str | None, int | None]:
    """The MD and NM tags, where they are; an error if the tags don't end where the record does."""
    md = nm = None
    while at < len(x):
        tag, kind = x[at : at + 2], chr(x[at + 2])
        at += 3
        if kind in "ZH":
            end = x.index(0, at)
            if tag == b"MD":
                md = x[at:end].decode() or None
            at = end + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(x[at])] * struct.unpack_from("<i", x, at + 1)[0]
        else:
            if tag == b"NM" and kind in "cCsSiI":
                nm = int.from_bytes(x[at : at + TAG_SIZES[kind]], "little", signed=kind.islower())
            at += TAG_SIZES[kind]
    if at != len(x):
        raise ValueError("tags run over the record's end")
    return md, nm if nm is None or abs(nm) < 1 << 31 else None
