"""From raw records to reads in sequencing direction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.functions import reads as R
from readqc.functions.errors import alignment_of

#: Columns of a source: every other column is pruned.
RAW = "file string, read_id string, flag int, mapq int, cigar string, seq string, qual string, md string, is_aligned boolean"


def derive(raw: DataFrame, compat: bool = False) -> DataFrame:
    """Drop secondary records and add read_no, mapq_bin, ops, clip5, clip3, seq_o, qual_o, n, n_clipped.

    compat keeps the literal clip rule (only the very first and last operation) and missing qualities as the
    highest one in end and normalised plots. Null sequences and ``*`` are empty; a null or ``*`` quality is missing.
    """
    flag = F.coalesce(F.col("flag"), F.lit(0))
    reverse = R.has(flag, R.REVERSE)
    mapped = R.mapped(F.col("flag"), F.col("is_aligned"))
    seq = F.when(F.col("seq") == "*", "").otherwise(F.coalesce("seq", F.lit("")))
    qual = F.when((F.col("qual") != "*") & (F.length("qual") > 0), F.col("qual"))
    ops = F.when(mapped, R.cigar_ops(F.col("cigar"))).otherwise(F.array().cast("array<struct<len:int,op:string>>"))
    kept = raw.where(~R.has(flag, R.SECONDARY))
    kept = kept.withColumns({"seq": seq, "qual": qual, "flag": flag, "reverse": reverse, "ops": ops})
    c5, c3 = (F.when(mapped, f(F.col("cigar"), compat)).otherwise(0) for f in (R.clip5_of, R.clip3_of))
    kept = kept.withColumns({"_c5": c5, "_c3": c3})
    turned = F.col("reverse")
    out = kept.withColumns(
        {
            "read_no": R.read_no(F.col("flag")),
            "mapq_bin": R.mapq_bin(F.col("flag"), F.col("mapq"), F.col("is_aligned")),
            "clip5": F.when(turned, F.col("_c3")).otherwise(F.col("_c5")),
            "clip3": F.when(turned, F.col("_c5")).otherwise(F.col("_c3")),
            "seq_o": F.when(turned, R.reverse_complement(F.col("seq"))).otherwise(F.col("seq")),
            "qual_o": F.when(turned, F.reverse("qual")).otherwise(F.col("qual")),
            "n": F.length("seq"),
        }
    )
    return out.withColumn("n_clipped", F.greatest(F.col("n") - F.col("clip5") - F.col("clip3"), F.lit(0))).drop("_c5", "_c3")


def alignments(reads: DataFrame) -> DataFrame:
    """read_id and alignment: name, SEQ, CIGAR, MD and the two gapped rows of each mapped read, as text to look at."""

    @F.pandas_udf("string")
    def shown(name: pd.Series, seq: pd.Series, cigar: pd.Series, md: pd.Series) -> pd.Series:
        def one(n, s, c, m):
            genome, marks, read = alignment_of(c, m, s)
            return f"{n}\n{s}\nCIGAR: {c}\n   MD: {m or ''}\n{genome} (genome)\n{marks}\n{read} (read)\n"

        return pd.Series([one(*x) for x in zip(name, seq, cigar, md)])

    mapped = reads.where((F.size("ops") > 0) & F.col("seq").isNotNull())
    return mapped.select("read_id", shown(F.coalesce("read_id", F.lit("")), "seq", "cigar", "md").alias("alignment"))
