"""profile(): everything that is counted for one or several files, as DataFrames or as HTML reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from readqc.operators import derive as D
from readqc.operators import profiles as P
from readqc.operators.reads import derive
from readqc.sources.files import chosen, file_type, in_order, is_folder, output_path, peek, read, write_text


@dataclass(frozen=True)
class Options:
    """outdir: folder of the reports; peek: only so many first records of each file (at least 10); peek_mode:
    exact or chunk; plot_end, norm: positions from the read's end and on normalised length; nthreads: accepted,
    Spark decides; compat: literal clip rules; report_max_len, subsample, seed: the older report's options;
    mode: FAILFAST or PERMISSIVE about broken records; quality_offset: of FASTQ qualities, None finds each file's from its counts."""

    outdir: str | None = None
    peek: int | None = None
    peek_mode: str = "exact"
    plot_end: bool = False
    norm: bool = False
    nthreads: int = 4
    compat: bool = False
    report_max_len: int | None = None
    subsample: float = 0.0
    seed: int = 0
    mode: str = "FAILFAST"
    quality_offset: int | None = None

    def __post_init__(self) -> None:
        if self.nthreads < 1:
            raise ValueError("nthreads must be at least 1")
        if self.peek is not None and self.peek < 10:
            raise ValueError("peek needs at least 10 records")
        if self.report_max_len is not None and not 0 < self.report_max_len <= 10_000:
            raise ValueError("report_max_len is out of range")
        if not 0 <= self.subsample <= 1:
            raise ValueError("subsample is a share")


class DamagedFiles(Exception):
    """Some files can't be read whole; pages of all others are written. failed: path -> what is wrong; pages: those written."""

    def __init__(self, failed: dict[str, str], pages: list[str]) -> None:
        super().__init__("; ".join(f"{what} in {path}" for path, what in failed.items()))
        self.failed, self.pages = failed, pages


@dataclass
class Profile:
    """The counts of one file: cells holds all of them, from one pass over the reads of all files, and is persisted when it is
    first used; tables are views of it. partial: how many records were read, if there are more. shared: cells of all files of
    one plan, with the column file, and rows for what can't be read."""

    path: str
    options: Options
    reads: DataFrame
    aligned: bool
    partial: int | None
    cells: DataFrame
    tables: dict = field(default_factory=dict)
    shared: DataFrame | None = None
    persisted: list = field(default_factory=list)

    @property
    def dropped(self) -> dict[str, tuple[int, int]]:
        """What was left out -> (number, bytes)."""
        if self.shared is None:
            return {}
        what = F.col("what")
        rows = self.shared.where((F.col("file") == self.path) & (what.startswith(P.ISSUE) | what.startswith(P.LOST))).groupBy("what").agg(F.sum("n").alias("n")).collect()
        found = {r.what: r.n for r in rows}
        return {w.removeprefix(P.ISSUE): (n, found[P.LOST + w.removeprefix(P.ISSUE)]) for w, n in found.items() if w.startswith(P.ISSUE)}

    def write(self, folder: str) -> None:
        """Every table as Parquet, in a folder of its own."""
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")

    def release(self) -> None:
        for frame in self.persisted:
            frame.unpersist()


def tables(cells: DataFrame, o: Options) -> dict:
    """Name -> DataFrame of all counts that the options ask for, out of everything()."""

    def of(what: str, *columns) -> DataFrame:
        return cells.where(F.col("what") == what).select(*P.KEY, *columns, "n")

    counts = of("reads")
    texts = ["bases", "qualities"] + ["bases_from_end", "qualities_from_end"] * o.plot_end + ["bases_normalised", "qualities_normalised"] * o.norm + ["mismatches"]
    return {
        "read_counts": counts,
        "mapping": D.mapping_table(counts),
        "pairs": P.pairs_of(cells),
        "lengths": of("lengths", F.col("pos").alias("len")),
        **{what: of(what, "pos", "series") for what in texts},
        "insertions": of("insertions", "pos"),
        "deletions": of("deletions", "pos"),
    }


def profile_reads(raw: DataFrame, path: str, options: Options | None = None, aligned: bool = True) -> Profile:
    """Profile of records in the canonical schema, wherever they come from; for a peek they must come in order."""
    o = options or Options()
    partial = None
    if o.peek:
        raw, partial = peek(raw, o.peek, o.peek_mode, aligned=aligned)
    reads = derive(P.subsample(raw, o.subsample, o.seed), o.compat)
    detect = not aligned and o.quality_offset is None
    offset = (None if detect else o.quality_offset or 33) if not aligned else 33
    cells = P.everything(reads, plot_end=o.plot_end, norm=o.norm, most=o.report_max_len, compat=o.compat, offset=offset).persist(StorageLevel.MEMORY_AND_DISK)
    shown = _levels(cells.withColumn("file", F.lit(path))).drop("file") if detect else cells
    return Profile(path, o, reads, aligned, partial, shown, tables(shown, o), persisted=[cells])


def _levels(codes: DataFrame) -> DataFrame:
    """Counts of quality codes as counts of qualities, by the offset found for each file."""
    offsets = D.quality_offsets(codes.where(F.col("what") == "qualities"))
    return D.shifted(codes, offsets, ["what", "file", *P.KEY, "pos"], where=F.col("what").startswith("qualities"))


def _of_type(spark: SparkSession, paths: list[str], kind: str, o: Options) -> dict[str, Profile]:
    """Profiles of files of one type: one scan and one aggregate for all of them, with the file as a group key."""
    raw = read(spark, paths, kind, o.mode, issues=True)
    if o.subsample:
        raw = P.subsample(raw.where("issue IS NULL"), o.subsample, o.seed).unionByName(raw.where("issue IS NOT NULL"))
    reads = derive(raw, o.compat)
    detect = kind == "fastq" and o.quality_offset is None
    offset = None if detect else (o.quality_offset or 33) if kind == "fastq" else 33
    counted = P.everything(reads, by=("file", *P.KEY), plot_end=o.plot_end, norm=o.norm, most=o.report_max_len, compat=o.compat, offset=offset).persist(StorageLevel.MEMORY_AND_DISK)
    shared = _levels(counted) if detect else counted
    out = {}
    for p in paths:
        what = F.col("what")
        bad = what.startswith(P.ISSUE) | what.startswith(P.LOST)
        kept = F.when(~bad, True).otherwise(F.raise_error(F.concat(what, F.lit(f" in {p}")))) if o.mode == "FAILFAST" else ~bad
        own = shared.where(F.col("file") == p).where(kept).drop("file")
        out[p] = Profile(p, o, reads.where((F.col("file") == p) & F.col("issue").isNull()).drop("issue", "lost"), kind in ("sam", "bam"), None, own, tables(own, o), shared, [counted])
    return out


def profile(spark: SparkSession, paths: list[str] | str, **options) -> dict[str, Profile]:
    """Path -> Profile of each file of a known type. The type is told by the name; files of one type are counted in one pass,
    but for a peek, which reads the start of one file after another."""
    o = Options(**options)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if o.outdir is not None and not is_folder(spark, o.outdir):
        raise ValueError(f"no such folder: {o.outdir}")
    known = chosen(paths)
    if o.peek:
        session = in_order(spark)
        return {p: profile_reads(read(session, p, kind, o.mode, alone=True), p, o, kind in ("sam", "bam")) for p, kind in known}
    found: dict = {}
    for kind in dict.fromkeys(k for _, k in known):
        found |= _of_type(spark, [p for p, k in known if k == kind], kind, o)
    return {p: found[p] for p, _ in known}


def report(spark: SparkSession, paths: list[str] | str, **options) -> list[str]:
    """Write one HTML page for each file, on any path that Spark writes; gives the pages' paths. In mode FAILFAST, files that can't
    be read whole get no page, and DamagedFiles is raised when all others have theirs."""
    from readqc.plans.report import gathered, render

    found = profile(spark, paths, **options)
    targets = {p: output_path(p, x.options.outdir, checked=True) for p, x in found.items()}
    failed: dict = {}
    for p, summary in gathered(found):
        if summary.issues and found[p].options.mode == "FAILFAST":
            failed[p] = ", ".join(sorted(summary.issues))
        else:
            write_text(spark, targets[p], render(found[p], summary))
    for x in found.values():
        x.release()
    pages = [t for p, t in targets.items() if p not in failed]
    if failed:
        raise DamagedFiles(failed, pages)
    return pages


def longest(cells: DataFrame) -> int:
    """Length of the longest read."""
    return cells.where("what = 'raw_lengths'").agg(F.coalesce(F.max("pos"), F.lit(0))).first()[0]


__all__ = ["DamagedFiles", "Options", "Profile", "file_type", "longest", "profile", "profile_reads", "report", "tables"]
