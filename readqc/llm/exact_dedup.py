"""Operator 3: exact dedup with a heavy-hitter split.

1. Every row becomes (doc_id, SHA-256 of the text, a number of its own); only these 48 bytes go on, as a table in
   the shared folder.
2. Each partition keeps a Misra-Gries summary of at most ``counters`` digests; the summaries are added up
   (a digest with more than rows/counters rows is in at least one of them) and the ``counters`` largest
   sums are the candidates: a bounded list, whatever the input.
3. One pass with map-side aggregation counts the candidates exactly and finds their winners, a row each. Those
   that are truly frequent are broadcast (at most ``counters`` rows), and their rows are settled without a shuffle.
4. All other digests use an ordinary shuffle by digest: winners and counts by map-side aggregation, joined back. A
   digest there has at most rows/counters rows, which the join reads as a stream; none are sorted or held as a group.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays, a null
doc_id is smaller than any other; of rows that repeat the winner's doc_id and text exactly one stays, in ``dedup`` the first by
all columns (nulls first), however the rows are dealt out;
extra columns of the input are ignored by ``mark`` and carried unchanged by ``dedup``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.store import materialize, spare

#: Misra-Gries counters of one summary; the broadcast never has more rows.
COUNTERS = 1024


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for x in batch.column("digest").value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            if len(held) > counters:
                least = sorted(held.values(), reverse=True)[counters]
                held = {k: v - least for k, v in held.items() if v > least}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["digest", "n"])

    return run


def _settled(digests: DataFrame) -> DataFrame:
    """n, keep_id and keep_row (the number of the row that stays) of each digest; a null doc_id is the least."""
    found = digests.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("keep"))
    return found.select("digest", "n", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"))


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact n, keep_id and keep_row of the frequent digests: those with over rows/counters rows are all here."""
    summed = digests.select("digest").mapInArrow(_summary(counters), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    candidates = summed.where("n > 1").orderBy(F.desc("n"), "digest").limit(counters).select("digest")
    return _settled(digests.join(F.broadcast(candidates), "digest"))


def mark(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row"))
    digests = materialize(numbered)  # read several times, numbered once
    heavy = materialize(heavy_hitters(digests, counters))
    frequent = digests.join(F.broadcast(heavy), "digest")
    rare = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    both = frequent.unionByName(rare.join(_settled(rare).hint("merge"), "digest"))
    return both.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with all their columns; whole copies of a kept row leave only one."""
    id_ = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    own, sha, n = spare(docs, "_id", "_sha", "_n")
    kept = mark(docs, counters).where("kept").select(id_("doc_id").alias(own), F.col("text_sha256").alias(sha))
    keyed = docs.withColumns({own: id_("doc_id"), sha: F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)})
    joined = keyed.join(kept.hint("shuffle_hash"), [own, sha], "left_semi")
    # dealt like the join: rows that repeat the winner; the first by all other columns (maps by their text) stays
    plain = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) if re.search("map|variant", kind) else F.col(f"`{c}`")
    again = Window.partitionBy(own, sha).orderBy(*(plain(c, kind) for c, kind in docs.dtypes))
    return joined.withColumn(n, F.row_number().over(again)).where(F.col(n) == 1).drop(n, own, sha)
