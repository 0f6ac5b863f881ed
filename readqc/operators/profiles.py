"""Counting profiles of derived reads: plain group-bys with map-side aggregation.

Each returns sparse long counts keyed by ``by`` (mate and mapping-quality class, and the file where there are
several): no zero is stored, and a shuffle carries at most keys x positions x series rows from a task.
Bases are counted in blocks of reads (tally); per_base is the same as a plain plan, for streams and as a check.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.functions import errors as E
from readqc.functions import reads as R

KEY = ("read_no", "mapq_bin")


def read_counts(reads: DataFrame, by=KEY) -> DataFrame:
    return reads.groupBy(*by).agg(F.count("*").alias("n"))


def pair_counts(reads: DataFrame, by=()) -> DataFrame:
    """Totals, by mate, paired, and properly paired among the paired; with percentages."""
    flag = F.col("flag")
    paired = F.coalesce(F.col("is_aligned"), F.lit(False)) & R.has(flag, R.PAIRED)
    out = reads.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("read_no") == 1).alias("n_read1"),
        F.count_if(F.col("read_no") == 2).alias("n_read2"),
        F.count_if(paired).alias("n_paired"),
        F.count_if(paired & R.has(flag, R.PROPER)).alias("n_proper"),
    )
    return _percentages(out)


def _percentages(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"pct_paired": R.percent(F.col("n_paired"), F.col("total")), "pct_proper": R.percent(F.col("n_proper"), F.col("n_paired"))})


def pairs_of(cells: DataFrame, by=()) -> DataFrame:
    """pair_counts() of all reads, from everything()."""
    of = lambda what, *more: F.coalesce(F.sum(F.when(F.col("what") == what, F.when(more[0], F.col("n")) if more else F.col("n"))), F.lit(0))
    mate = lambda i: F.col("read_no") == i
    return _percentages(cells.groupBy(*by).agg(of("reads").alias("total"), of("reads", mate(1)).alias("n_read1"), of("reads", mate(2)).alias("n_read2"), of("paired").alias("n_paired"), of("proper").alias("n_proper")))


def lengths(reads: DataFrame, by=KEY) -> DataFrame:
    return reads.groupBy(*by, F.col("n_clipped").alias("len")).agg(F.count("*").alias("n"))


def spread(rows: DataFrame) -> DataFrame:
    """rows; where they come right from files that give fewer tasks than there are cores, dealt out anew before the costly part.
    Told by the plan and the files' sizes: no job runs, and rows that were shuffled before are left as they are."""
    spark = rows.sparkSession
    if rows.isStreaming:
        return rows
    plan = rows._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" +-:").split(" ")[0].split("(")[0] for line in plan.treeString().splitlines()}
    cores, files = spark.sparkContext.defaultParallelism, rows.inputFiles()
    if not nodes <= {"Project", "Filter", "Relation", ""} or not 0 < len(files) < cores:
        return rows
    size = int(plan.collectLeaves().head().stats().sizeInBytes())
    return rows.repartition(cores) if max(len(files), size // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) < cores else rows


def per_base(reads: DataFrame, text: Column, by, series, place: str = "start") -> DataFrame:
    """The declarative form of tally(): one row for each character, counted by an ordinary aggregate."""
    rows = reads.select(*by, text.alias("_s"))
    rows = rows.select(*by, F.length("_s").alias("t"), F.posexplode(F.split("_s", "")).alias("i", "ch")).where("ch <> ''")
    pos = {"start": F.col("i"), "end": F.col("t") - 1 - F.col("i"), "norm": R.norm_bin(F.col("i"), F.col("t"))}[place]
    return rows.select(*by, pos.alias("pos"), series(F.col("ch")).alias("series")).groupBy(*by, "pos", "series").agg(F.count("*").alias("n"))


#: Cells that a task counts in one array before it hands them on, and characters it takes at once.
CELLS, CHARACTERS = 4_000_000, 4_000_000


def _codes(kind: str, offset: int | None = 33) -> np.ndarray:
    """Series of each character code; the last entry stands for all higher codes. offset None: qualities stay codes."""
    if kind == "quality" and offset is None:
        return np.arange(257)
    table = np.full(257, 4 if kind == "base" else R.QUALITIES - 1, np.int64)
    if kind == "base":
        for i, letter in enumerate(R.BASES[:4]):
            table[[ord(letter), ord(letter.lower())]] = i
    else:
        table[:256] = np.clip(np.arange(256) - offset, 0, R.QUALITIES - 1)
    return table


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (at most 256) of all texts in a row, and each text's length."""
    raw = texts.cast(pa.binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4)
    data = np.frombuffer(raw.buffers()[2], np.uint8, int(first[-1] - first[0]), int(first[0])) if sizes.sum() else np.empty(0, np.uint8)
    if not len(data) or data.max() < 128:
        return data, sizes
    starts = (data & 0xC0) != 0x80  # one byte of each character; any above 127 counts as 256
    owner = np.repeat(np.arange(len(sizes)), sizes)[starts]
    return np.where(data[starts] < 128, data[starts].astype(np.int64), 256), np.bincount(owner, minlength=len(sizes))


def _groups(columns: list, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's combination of values, and the first row of each combination."""
    group = np.zeros(n, np.int64)
    for c in columns:
        coded = c.dictionary_encode(null_encoding="encode")
        group = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    _, firsts, group = np.unique(group, return_index=True, return_inverse=True)
    return group, firsts


def _cells(group: np.ndarray, n_groups: int, pos: np.ndarray, series: np.ndarray | int, n_series: int) -> tuple:
    """(group, pos, series, n) of what is there."""
    width = int(pos.max()) + 1 if len(pos) else 1
    cell = (group * width + pos) * n_series + series
    if n_groups * width * n_series <= CELLS:
        n = np.bincount(cell)
        cell = np.flatnonzero(n)
        n = n[cell]
    else:
        cell, n = np.unique(cell, return_counts=True)
    return cell // (width * n_series), (cell // n_series % width).astype(np.int32), (cell % n_series).astype(np.int32), n


def _of_texts(texts: pa.Array, group: np.ndarray, n_groups: int, codes: np.ndarray, place: str) -> Iterator[tuple]:
    """Cells of the characters of texts, in blocks of CHARACTERS."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(total // CHARACTERS)) + 1), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        data, sizes = _characters(pc.fill_null(texts.slice(a, b - a), ""))
        if not len(data):
            continue
        i = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if place == "end":
            i = np.repeat(sizes, sizes) - 1 - i
        elif place == "norm":
            i = np.floor(i / np.repeat(sizes, sizes) * float(R.NORM_BINS)).astype(np.int64)
        yield _cells(np.repeat(group[a:b], sizes), n_groups, i, codes[data], int(codes.max()) + 1)


def _counting(by: list, kind: str, place: str, offset: int | None = 33):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(kind, offset)
        for batch in batches:
            group, firsts = _groups([batch.column(c) for c in by], len(batch))
            for found in _of_texts(batch.column("_s"), group, len(firsts), codes, place):
                yield _batch(batch, by, firsts, *found)

    return run


def _batch(rows: pa.RecordBatch, by: list, firsts: np.ndarray, group, pos, series, n, what: str | None = None) -> pa.RecordBatch:
    keys = [rows.column(c).take(pa.array(firsts[group])) for c in by]
    name = [pa.repeat(what, len(n))] if what else []
    return pa.RecordBatch.from_arrays([*name, *keys, pa.array(pos, pa.int32()), pa.array(series, pa.int32()), pa.array(n, pa.int64())], names=[*(["what"] if what else []), *by, "pos", "series", "n"])


def tally(reads: DataFrame, text: Column, by, kind: str, place: str = "start", offset: int | None = 33) -> DataFrame:
    """Characters by position and series (kind: base or quality), counted in blocks of reads. offset: of qualities; None
    leaves them as codes (see derive.shifted).

    The same as per_base(), without a row for each character: a task counts whole Arrow batches with NumPy and
    hands on one row for each cell, which the aggregate adds up. place: start, end or norm.
    """
    by = list(by)
    # no filter on the text: pushed down, it would be worked out from the raw columns a second time
    rows = reads.select(*by, text.alias("_s"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "pos int, series int, n long"])
    return spread(rows).mapInArrow(_counting(by, kind, place, offset), schema).groupBy(*by, "pos", "series").agg(F.sum("n").alias("n"))


def _forward(text: str) -> Column:
    return F.substring(F.col(text), F.col("clip5") + 1, F.col("n_clipped"))


def _first(text: Column, most: int | None) -> Column:
    return text if most is None else F.substring(text, 1, most)


def bases(reads: DataFrame, by=KEY, most: int | None = None) -> DataFrame:
    """Bases by position after the 5' clip; most: only so many first positions."""
    return tally(reads, _first(_forward("seq_o"), most), by, "base")


def qualities(reads: DataFrame, by=KEY, most: int | None = None, offset: int | None = 33) -> DataFrame:
    return tally(reads, _first(_forward("qual_o"), most), by, "quality", offset=offset)


def bases_from_end(reads: DataFrame, by=KEY) -> DataFrame:
    """Bases by position from the read's end; clips are not looked at."""
    return tally(reads, F.col("seq_o"), by, "base", "end")


def _quality_or_highest(compat: bool) -> Column:
    missing = F.repeat(F.lit("J"), F.length("seq_o"))
    return F.when(F.col("qual_o").isNull() & F.lit(compat) & F.coalesce(F.col("is_aligned"), F.lit(False)), missing).otherwise(F.col("qual_o"))


def qualities_from_end(reads: DataFrame, by=KEY, compat: bool = False) -> DataFrame:
    """compat: a missing quality counts as the highest."""
    return tally(reads, _quality_or_highest(compat), by, "quality", "end")


def bases_normalised(reads: DataFrame, by=KEY) -> DataFrame:
    return tally(reads, _forward("seq_o"), by, "base", "norm")


def qualities_normalised(reads: DataFrame, by=KEY, compat: bool = False) -> DataFrame:
    quality = reads.withColumn("qual_o", _quality_or_highest(compat))
    return tally(quality, _forward("qual_o"), by, "quality", "norm")


def insertions(reads: DataFrame, by=KEY) -> DataFrame:
    rows = reads.where(F.col("cigar").contains("I")).select(*by, F.explode(E.insertions(F.col("ops"), F.col("reverse"))).alias("pos"))
    return rows.groupBy(*by, "pos").agg(F.count("*").alias("n"))


def deletions(reads: DataFrame, by=KEY) -> DataFrame:
    rows = reads.where(F.col("cigar").contains("D")).select(*by, F.explode(E.deletions(F.col("ops"), F.col("reverse"))).alias("pos"))
    return rows.groupBy(*by, "pos").agg(F.count("*").alias("n"))


def _error_columns(reads: DataFrame) -> list[Column]:
    """What errors are found from: CIGAR of mapped reads; MD and SEQ only where MD has a letter outside a deletion."""
    lettered = F.col("md").rlike("(^|[0-9])[A-Za-z]")
    cigar = F.when(R.mapped(F.col("flag"), F.col("is_aligned")) & F.col("cigar").rlike("[0-9][MIDNSHP=X]"), F.col("cigar"))
    return [cigar.alias("_cigar"), *(F.when(lettered & cigar.isNotNull(), F.col(c)).alias(f"_{c}") for c in ("md", "seq")), F.col("reverse").alias("_reverse")]


def _mismatching(rows: pa.RecordBatch, literal: bool) -> tuple[list, list, list]:
    """Row, position and base of each mismatch. Places of letters are found once for equal pairs of CIGAR and MD of a batch."""
    letters = functools.cache(functools.partial(E.letters_of, literal=literal))
    found = [
        (i, pos, base)
        for i, md, cigar, seq, reverse in zip(range(len(rows)), *(rows.column(c).to_pylist() for c in ("_md", "_cigar", "_seq", "_reverse")))
        if md is not None and cigar is not None
        for pos, base in E.differing(*letters(cigar, md), seq, reverse)
    ]
    return tuple(zip(*found)) if found else ([], [], [])


def _counted_mismatches(rows: pa.RecordBatch, group: np.ndarray, n_groups: int, literal: bool) -> tuple:
    at, pos, base = _mismatching(rows, literal)
    codes = _codes("base")
    series = codes[np.minimum(np.fromiter(map(ord, base), np.int64, len(base)), 256)]
    return _cells(group[np.array(at, np.int64)], n_groups, np.array(pos, np.int64), series, len(R.BASES))


def mismatches(reads: DataFrame, by=KEY, compat: bool = False) -> DataFrame:
    """Mismatching read bases by position; without MD there are none. Reads are looked at in Arrow batches: the same in
    array expressions (errors.mismatches) is interpreted and many times slower."""
    by = list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, firsts = _groups([batch.column(c) for c in by], len(batch))
            yield _batch(batch, by, firsts, *_counted_mismatches(batch, group, len(firsts), compat))

    rows = reads.where(F.col("md").rlike("(^|[0-9])[A-Za-z]")).select(*by, *_error_columns(reads))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "pos int, series int, n long"])
    return spread(rows).mapInArrow(run, schema).groupBy(*by, "pos", "series").agg(F.sum("n").alias("n"))


#: Names of what everything() counts beside the texts: whole reads, paired and properly paired ones, and lengths.
NUMBERS = ("reads", "paired", "proper", "lengths", "raw_lengths")


ISSUE, LOST = "issue: ", "lost: "


def _issues(batch: pa.RecordBatch, by: list) -> Iterator[pa.RecordBatch]:
    for issue in pc.unique(batch.column("_issue").drop_null()).to_pylist():
        own = batch.filter(pc.equal(batch.column("_issue"), issue))
        group, firsts = _groups([own.column(c) for c in by], len(own))
        zero, every = np.zeros(len(firsts), np.int32), np.arange(len(firsts))
        for what, n in ((ISSUE, np.bincount(group)), (LOST, np.bincount(group, own.column("_lost").to_numpy()).astype(np.int64))):
            yield _batch(own, by, firsts, every, zero, zero, n, what=what + issue)


def everything(reads: DataFrame, by=KEY, plot_end: bool = False, norm: bool = False, most: int | None = None, compat: bool = False, offset: int | None = 33) -> DataFrame:
    """what, by, pos, series, n: all counts of a profile in one pass over the reads, one task's batches at a time. Rows with
    an issue (see files.read) are counted as such: what is ISSUE or LOST and the issue, n their number or bytes."""
    by = list(by)
    texts = {"bases": (_first(_forward("seq_o"), most), "base", "start"), "qualities": (_first(_forward("qual_o"), most), "quality", "start")}
    qual = _quality_or_highest(compat)
    if plot_end:
        texts |= {"bases_from_end": (F.col("seq_o"), "base", "end"), "qualities_from_end": (qual, "quality", "end")}
    if norm:
        clipped = F.substring(qual, F.col("clip5") + 1, F.col("n_clipped"))
        texts |= {"bases_normalised": (_forward("seq_o"), "base", "norm"), "qualities_normalised": (clipped, "quality", "norm")}
    paired = F.coalesce(F.col("is_aligned"), F.lit(False)) & R.has(F.col("flag"), R.PAIRED)
    numbers = (F.lit(0), F.when(paired, 0), F.when(paired & R.has(F.col("flag"), R.PROPER), 0), F.col("n_clipped"), F.col("n"))
    rows = reads.select(*by, *(x.alias(f"_{n}") for n, (x, *_) in texts.items()), *(x.cast("int").alias(f"_{n}") for n, x in zip(NUMBERS, numbers)), *_error_columns(reads), *(F.col(c).alias(f"_{c}") for c in ("issue", "lost") if c in reads.columns))
    counted = {n: (_codes(kind, offset), place) for n, (_, kind, place) in texts.items()}

    def cells(batch: pa.RecordBatch, group: np.ndarray, n: int) -> Iterator[tuple]:
        for what, (codes, place) in counted.items():
            for found in _of_texts(batch.column(f"_{what}"), group, n, codes, place):
                yield what, found
        for what in NUMBERS:
            x = batch.column(f"_{what}")
            have = pc.is_valid(x).to_numpy(zero_copy_only=False)
            yield what, _cells(group[have], n, x.drop_null().to_numpy().astype(np.int64), 0, 1)
        reverse = batch.column("_reverse").to_pylist()
        known: dict = {}
        for what, i in (("insertions", 1), ("deletions", 2)):
            at, pos = [], []
            for row, cigar in enumerate(batch.column("_cigar").to_pylist()):
                if cigar is not None and ("I" in cigar or "D" in cigar):
                    gaps = known[cigar] if cigar in known else known.setdefault(cigar, E.gaps_of(cigar))
                    for c, length in gaps[i]:
                        at.append(row)
                        pos.append(gaps[0] - c - length if reverse[row] else c)
            yield what, _cells(group[np.array(at, np.int64)], n, np.array(pos, np.int64), 0, 1)
        yield "mismatches", _counted_mismatches(batch, group, n, compat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "_issue" in batch.schema.names and batch.column("_issue").null_count < len(batch):
                yield from _issues(batch, by)
                batch = batch.filter(pc.is_null(batch.column("_issue")))
            group, firsts = _groups([batch.column(c) for c in by], len(batch))
            for what, found in cells(batch, group, len(firsts)):
                if len(found[-1]):
                    yield _batch(batch, by, firsts, *found, what=what)

    kinds = dict(rows.dtypes)
    schema = ", ".join(["what string", *(f"{c} {kinds[c]}" for c in by), "pos int, series int, n long"])
    return spread(rows).mapInArrow(run, schema).groupBy("what", *by, "pos", "series").agg(F.sum("n").alias("n"))


def error_totals(reads: DataFrame, by=KEY) -> DataFrame:
    """Mismatches, insertions and deletions of each class, in one pass that takes only what they are found from."""
    by, names = list(by), ["n_mis", "n_ins", "n_del"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, firsts = _groups([batch.column(c) for c in by], len(batch))
            gaps = functools.cache(lambda cigar: [len(x) for x in E.gaps_of(cigar)[1:]] if cigar and ("I" in cigar or "D" in cigar) else [0, 0])
            ins, dels = np.array([gaps(x) for x in batch.column("_cigar").to_pylist()], np.int64).reshape(-1, 2).T
            mis = np.bincount(np.array(_mismatching(batch, False)[0], np.int64), minlength=len(batch))
            sums = [pa.array(np.bincount(group, x, len(firsts)).astype(np.int64)) for x in (mis, ins, dels)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(firsts)) for c in by), *sums], names=[*by, *names])

    rows = reads.select(*by, *_error_columns(reads))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} long" for c in names)])
    return spread(rows).mapInArrow(run, schema).groupBy(*by).agg(*(F.sum(c).alias(c) for c in names))


def difference_counts(reads: DataFrame, by=KEY) -> DataFrame:
    """By class, mapped reads with MD or NM by what the file says of their differences: agrees (NM is MD's letters plus inserted and
    deleted bases), differs (wrong MD, NM or CIGAR), no_nm, no_md (where MD alone is missing); with the sums of both numbers."""
    mapped = reads.where((F.size("ops") > 0) & (F.col("md").isNotNull() | F.col("nm").isNotNull()))
    letters = F.length(F.regexp_replace("md", r"\^[A-Za-z]+|[0-9]+", ""))
    found = mapped.select(*by, "nm", (letters + R.sum_ops(F.col("ops"), "ID")).alias("found"))
    verdict = F.when(F.col("nm").isNull(), "no_nm").when(F.col("found").isNull(), "no_md").when(F.col("nm") == F.col("found"), "agrees").otherwise("differs")
    return found.groupBy(*by, verdict.alias("verdict")).agg(F.count("*").alias("n"), F.sum("nm").alias("nm_sum"), F.sum("found").alias("found_sum"))


def length_range(reads: DataFrame, by=("read_no",)) -> DataFrame:
    return reads.groupBy(*by).agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"))


def raw_and_mapped_lengths(reads: DataFrame, by=KEY) -> DataFrame:
    """kind raw: whole lengths of all reads; kind mapped: clipped lengths of the clipped ones."""
    pairs = F.array(
        F.struct(F.lit("raw").alias("kind"), F.col("n").alias("len")),
        F.when(F.col("clip5") + F.col("clip3") > 0, F.struct(F.lit("mapped").alias("kind"), F.col("n_clipped").alias("len"))),
    )
    rows = reads.select(*by, F.explode(F.array_compact(pairs)).alias("x"))
    return rows.groupBy(*by, "x.kind", "x.len").agg(F.count("*").alias("n"))


def subsample(reads: DataFrame, fraction: float, seed: int = 0, by=("file",)) -> DataFrame:
    """round(n * fraction) of the n reads of each file, those with the least hash of their name and seed; 0 keeps all, and
    so does a file where that number is 0.

    Exact without a sort of all reads: sums over 65,536 ranges of the hash say up to which range whole ranges are taken
    (one number a file), and only reads of the range where the count ends are ranked. Reads that tie go by their columns.
    """
    if not fraction:
        return reads
    by, h = list(by), "_hash"
    digest = F.md5(F.concat(F.coalesce("read_id", F.lit("")), F.lit(f":{seed}")))
    keyed = reads.withColumn(h, F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    width = 1 << 44  # of a range
    ranges = keyed.groupBy(*by, F.floor(F.col(h) / width).alias("_range")).agg(F.count("*").alias("_n"))
    place = Window.partitionBy(*by).orderBy("_range")  # at most 65,536 rows
    ranges = ranges.withColumns({"_upto": F.sum("_n").over(place), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    wanted = F.round(F.col("_all") * F.lit(fraction))
    wanted = F.when(wanted > 0, wanted).otherwise(F.col("_all"))
    ends = ranges.where(F.col("_upto") >= wanted).groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)))
    ends = ends.agg(F.min(F.struct("_range", (wanted - F.col("_upto") + F.col("_n")).alias("left"))).alias("_end"))  # a row a file
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.floor(F.col(h) / width)
    joined = keyed.join(ends, same)
    whole = joined.where(own < F.col("_end._range"))
    last = joined.where(own == F.col("_end._range"))
    order = Window.partitionBy(*by).orderBy(h, *(c for c in ("read_id", "flag", "seq", "qual") if c in reads.columns))
    last = last.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_end.left"))
    return whole.select(*reads.columns).unionByName(last.select(*reads.columns))
