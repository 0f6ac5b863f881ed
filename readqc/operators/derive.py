"""What is worked out from the counts: fractions, means, clusters, densities, extents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.functions import reads as R

KEY = ("read_no", "mapq_bin")
#: Bandwidths beyond which a point is not looked at.
FAR = 9.0
#: Lengths of one range in which a quarter is looked for.
STEP = 4096
#: Terms of a cell's series; cells of half a bandwidth to each side that count (FAR and one more); cells of a tile.
TERMS, AROUND, TILE = 16, 19, 256
FACTORIAL = [math.factorial(i) for i in range(TERMS)]


def once(counts: DataFrame) -> DataFrame:
    """counts, for a plan that takes them more than once: no column is pruned and no filter goes down through this step, so
    all branches have the same shuffle below it, which Spark then runs once. Else each would read the reads again."""
    return counts.mapInArrow(lambda batches: batches, counts.schema)


def mapping_table(counts: DataFrame, by=()) -> DataFrame:
    """From read_counts: n and fraction of the mate's total for each class, and a Total row for each mate."""
    rows = counts.groupBy(*by, "read_no", "mapq_bin").agg(F.sum("n").alias("n"))
    total = rows.groupBy(*by, "read_no").agg(F.sum("n").alias("n")).select(*by, "read_no", F.lit("Total").alias("class"), "n")
    both = rows.select(*by, "read_no", R.mapq_label(F.col("mapq_bin")).alias("class"), "n").unionByName(total)
    whole = F.max("n").over(Window.partitionBy(*by, "read_no"))  # a few rows for each mate
    return both.withColumn("fraction", F.round(F.try_divide(F.col("n").cast("double"), whole), 5))


def quality_offsets(counts: DataFrame, by=("file",)) -> DataFrame:
    """by, quality_offset: from counts of quality codes (series)."""
    return counts.groupBy(*by).agg(R.quality_offset(F.min("series"), F.max("series")).alias("quality_offset"))


def shifted(counts: DataFrame, offsets: DataFrame, keys, by=("file",), where=None) -> DataFrame:
    """Counts by keys, quality code (series): codes become qualities within 0 to 41 by each file's offset. where: which rows are
    of qualities, if not all. Works on counts, so on a small table."""
    level = F.greatest(F.least(F.col("series") - F.col("quality_offset"), F.lit(R.QUALITIES - 1)), F.lit(0))
    series = level if where is None else F.when(where, level).otherwise(F.col("series"))
    moved = counts.join(offsets, [*by], "left").withColumn("series", F.when(F.col("quality_offset").isNull(), F.col("series")).otherwise(series))
    return moved.groupBy(*keys, "series").agg(F.sum("n").alias("n"))


def mean_quality(counts: DataFrame, by=KEY) -> DataFrame:
    """Mean and standard error (population deviation over the root of n) of the qualities at each position."""
    keys = [*by, "pos"]
    q = F.col("series").cast("double")
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(q * F.col("n")).alias("s1"), F.sum(q * q * F.col("n")).alias("s2"))
    mean = F.col("s1") / F.col("n")
    spread = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))  # at most 42 levels: no cancellation to speak of
    return sums.select(*keys, "n", mean.alias("mean"), (F.sqrt(spread) / F.sqrt("n")).alias("std_err"))


def until_first_gap(means: DataFrame, by=KEY) -> DataFrame:
    """Positions before the first one without data."""
    at = Window.partitionBy(*by).orderBy("pos")  # positions of one class: bounded by the longest read
    return means.withColumn("_k", F.row_number().over(at)).where(F.col("_k") == F.col("pos") + 1).drop("_k")


def clustered(counts: DataFrame, longest: int, by=KEY) -> DataFrame:
    """Average count of each cluster of positions of one file whose longest read is ``longest``."""
    return clustered_by_file(counts.withColumn("l", R.matrix_length(F.lit(longest))), by)


def clustered_by_file(counts: DataFrame, by=KEY) -> DataFrame:
    """The same for counts that carry their file's matrix length l."""
    rows = counts.withColumn("cluster", R.cluster_of(F.col("pos"), F.col("l")).cast("int"))
    sums = rows.groupBy(*by, "series", "cluster", "l").agg(F.sum("n").alias("total"))
    start = R.cluster_start(F.col("cluster"), F.col("l"))
    end = F.least(R.cluster_start(F.col("cluster") + 1, F.col("l")), F.col("l"))
    value = F.round(F.col("total").cast("double") / (end - start)).cast("long")
    return sums.select(*by, "series", "cluster", R.cluster_label(F.col("cluster"), F.col("l")).alias("label"), value.alias("n"))


def extents(counts: DataFrame, by=KEY) -> DataFrame:
    """Last position with data, plus one, and whether the group is the first of its mate with data."""
    rows = counts.where("n > 0").groupBy(*by).agg((F.max("pos") + 1).alias("extent"), F.sum("n").alias("n"))
    return rows.withColumn("visible", F.col("mapq_bin") == F.min("mapq_bin").over(Window.partitionBy("read_no")))


def zero_filled(counts: DataFrame, n_series: int, by=KEY) -> DataFrame:
    """Dense counts up to each group's extent, for drawing."""
    counts = once(counts)
    ends = counts.groupBy(*by).agg(F.max("pos").alias("_end"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0), F.col("_end"))).alias("pos")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_series - 1))).alias("series"))
    return grid.join(counts, [*by, "pos", "series"], "left").select(*by, "pos", "series", F.coalesce("n", F.lit(0)).alias("n"))


def density(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gaussian kernel density of weighted points at the points, Silverman's bandwidth. One point: 1. The plain form, for a few
    thousand points; see length_density."""
    if len(points) == 1:
        return np.ones(1)
    share = weight / weight.sum()
    mean = (points * share).sum()
    spread = np.sqrt(((points - mean) ** 2 * share).sum())
    order = np.argsort(points)
    quarter = np.interp([0.25, 0.75], np.cumsum(share[order]), points[order])
    scale = min(spread, (quarter[1] - quarter[0]) / 1.349) or spread
    width = 0.9 * scale * weight.sum() ** -0.2
    out, own, share = np.empty(len(points)), points[order], share[order]
    for i in range(0, len(points), 1_000):
        some = own[i : i + 1_000]
        a, b = np.searchsorted(own, [some[0] - FAR * width, some[-1] + FAR * width])  # beyond, the kernel is under 1e-17
        z = (some[:, None] - own[None, a:b]) / width
        out[order[i : i + 1_000]] = (np.exp(-0.5 * z * z) * share[a:b]).sum(axis=1) / (width * np.sqrt(2 * np.pi))
    return out


def bandwidths(counts: DataFrame, by: list) -> DataFrame:
    """by, total, kinds (distinct lengths), width: Silverman's bandwidth of each class of lengths. Sums of ranges of STEP lengths
    give the deviation, and say in which range a quarter lies; only that range is looked into. Quarters are interpolated
    between lengths at their shares up to there."""
    rows = counts.withColumn("_r", F.floor(F.col("len") / STEP))
    own, n, at = F.col("own"), F.col("n").cast("double"), F.col("len") - F.col("_r") * STEP
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_r")  # ranges of a class, not its lengths
    ranges = rows.groupBy(*by, "_r").agg(F.sum("n").alias("own"), F.count("*").alias("k"), F.max("len").alias("last"), F.sum(at * n).alias("s1"), F.sum(at * at * n).alias("s2"))
    ranges = ranges.withColumns({"total": F.sum(own).over(whole), "kinds": F.sum("k").over(whole), "before": F.sum(own).over(upto) - own, "last": F.lag("last").over(upto)})
    ranges = ranges.withColumn("off", F.col("_r") * STEP - F.sum(F.col("_r") * STEP * own.cast("double") + F.col("s1")).over(whole) / F.col("total"))
    ranges = ranges.withColumn("spread", F.sqrt(F.sum(F.col("s2") + 2 * F.col("s1") * F.col("off") + own * F.col("off") * F.col("off")).over(whole) / F.col("total")))
    asked = ranges.withColumn("p", F.explode(F.array(F.lit(0.25), F.lit(0.75)))).withColumn("_w", F.col("p") * F.col("total")).where("before <= _w AND before + own > _w")
    inside = asked.select(*by, "_r", "p", "_w", "before", "last", "total", "kinds", "spread").join(rows.select(*by, "_r", "len", "n"), [*by, "_r"])
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "p").orderBy("len"))).withColumn("over", F.col("upto") > F.col("_w"))  # STEP rows at most

    def end(p: float) -> Column:
        """The quarter p: between the first length beyond it and the last one before, in this range or an earlier one."""
        here = F.col("p") == p
        next_, its = (F.min(F.when(here & F.col("over"), F.col(c))) for c in ("len", "upto"))
        last, sum_ = (F.coalesce(F.max(F.when(here & ~F.col("over"), F.col(c))), F.max(F.when(here, F.col(d)))) for c, d in (("len", "last"), ("upto", "before")))
        return F.coalesce(last + (next_ - last) * (F.max(F.when(here, F.col("_w"))) - sum_) / (its - sum_), next_.cast("double"))

    range_ = (end(0.75) - end(0.25)) / 1.349
    spread, total = F.max("spread"), F.max("total")
    scale = F.when(range_ > 0, F.least(spread, range_)).otherwise(spread)
    return inside.groupBy(*by).agg(total.alias("total"), F.max("kinds").alias("kinds"), (0.9 * scale * F.pow(total.cast("double"), F.lit(-0.2))).alias("width"))


def _hermite(z: np.ndarray, n: int) -> np.ndarray:
    """The first n derivatives of exp(-z*z/2), without their signs: a row for each."""
    out = [np.exp(-0.5 * z * z)]
    out.append(z * out[0])
    for m in range(1, n - 1):
        out.append(z * out[m] - m * out[m - 1])
    return np.array(out)


def _local(by: list):
    """For a tile's cells and their neighbours: moments of the points in each cell become coefficients of the kernel sum there."""
    away = np.arange(-AROUND, AROUND + 1)
    slopes = _hermite(away / 2, 2 * TERMS)
    # (difference of cells, term of the source, term of the target)
    links = np.array([[slopes[p + q] * (-1) ** q / FACTORIAL[q] for q in range(TERMS)] for p in range(TERMS)]).transpose(2, 0, 1)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        tile, cell = int(rows["tile"].iloc[0]), rows["cell"].to_numpy()
        moments = rows[[f"m{p}" for p in range(TERMS)]].to_numpy()
        own = cell[cell // TILE == tile]
        sums = np.zeros((len(own), TERMS))
        for d, link in zip(away, links):
            at = np.minimum(np.searchsorted(cell, own - d), len(cell) - 1)
            there = cell[at] == own - d
            sums[there] += moments[at[there]] @ link
        out = pd.DataFrame(sums, columns=[f"c{q}" for q in range(TERMS)])
        for c in by:
            out[c] = rows[c].iloc[0]
        out["cell"] = own
        return out

    return run


def length_density(counts: DataFrame, by=KEY) -> DataFrame:
    """Kernel density of each class's length distribution (from lengths): one row for each distinct length.

    As in a fast Gauss transform, lengths are put in cells of half a bandwidth, of which only TERMS moments go on; tiles of
    cells and their neighbours make a polynomial for each cell, and each length takes its own cell's. No group is larger than
    a tile, whatever the number of lengths. A cell reaches a quarter of a bandwidth from its middle, so the terms left out are under
    0.25**TERMS / sqrt(TERMS!) and cells left out (over 9 bandwidths away) under 1e-17 of the kernel's height: together less
    than the rounding of doubles. A class of one length has density 1; one without reads no rows."""
    by, counts = list(by), once(counts)
    kinds = dict(counts.dtypes)
    known = counts.join(bandwidths(counts, by), by)
    half = F.col("width") / 2
    known = known.withColumn("cell", F.when((F.col("kinds") > 1) & (F.col("width") > 0), F.floor(F.col("len") / half)))
    known = known.withColumn("u", (F.col("len") - (F.col("cell") + 0.5) * half) / F.col("width"))
    share = F.col("n") / F.col("total")
    cells = known.where("cell IS NOT NULL").groupBy(*by, "cell").agg(*(F.sum(share * F.pow("u", F.lit(float(p))) / float(FACTORIAL[p])).alias(f"m{p}") for p in range(TERMS)))
    tiles = F.array_distinct(F.transform(F.array(F.lit(-AROUND), F.lit(0), F.lit(AROUND)), lambda d: F.floor((F.col("cell") + d) / TILE)))
    schema = ", ".join([*(f"c{q} double" for q in range(TERMS)), *(f"`{c}` {kinds[c]}" for c in by), "cell long"])
    local = cells.withColumn("tile", F.explode(tiles)).groupBy(*by, "tile").applyInPandas(_local(by), schema)
    found = known.join(local, [*by, "cell"], "left")
    value = F.col(f"c{TERMS - 1}")
    for q in range(TERMS - 2, -1, -1):
        value = value * F.col("u") + F.col(f"c{q}")
    density = F.when(F.col("kinds") == 1, 1.0).otherwise(value / (F.col("width") * math.sqrt(2 * math.pi)))
    return found.select(*by, F.col("len").cast("int").alias("len"), density.alias("density"))
