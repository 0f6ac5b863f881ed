"""Operator 5: packing into optimal length buckets.

Documents longer than ``max_len`` tokens are cut into pieces of max_len (the last one shorter), so nothing
is dropped. The global histogram of piece lengths (at most max_len + 1 rows, whatever the input) goes to
the driver, where dynamic programming chooses the ``buckets`` boundaries that minimise the padding of all
pieces together. Inside a bucket, pieces in order of (doc_id, piece, length) fill batches of
``budget // boundary`` slots, each padded to the boundary.

A bucket may hold most rows, so a piece's rank in its bucket is not counted in one task: the (text-free)
rows are range-partitioned and sorted, each task numbers its own, and one offset for each partition and
bucket (at most partitions + buckets rows, broadcast) turns that into ranks.

Defined results: null and empty texts have 0 tokens and one piece that is in no bucket or batch (nulls
there, padding 0); a null doc_id comes first; repeated rows are packed each (rows that tie in the order are alike in every column of the result); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.counting import n_words
from readqc.llm.store import materialize


def boundaries(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding. counts[n]: pieces of n tokens; counts[0] is ignored."""
    lengths = np.flatnonzero(counts[1:]) + 1
    if not len(lengths):
        return []
    pieces = np.concatenate(([0], np.cumsum(counts[lengths])))
    tokens = np.concatenate(([0], np.cumsum(counts[lengths] * lengths)))
    m = len(lengths)
    best = np.where(np.arange(m + 1) == 0, 0.0, np.inf)
    choice = []
    for _ in range(min(buckets, m)):
        now, came = best.copy(), np.arange(m + 1)
        for j in range(1, m + 1):  # the last bucket holds lengths[i:j]
            cost = best[:j] + lengths[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], came[j] = cost[i], i
        best = now
        choice.append(came)
    out, j = [], m
    for came in reversed(choice):
        if j and came[j] < j:
            out.append(int(lengths[j - 1]))
            j = came[j]
    return sorted(out)


def ranked(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows with ``rank``: the number of rows of the same group before it in order; no group meets in one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # broadcast: at most partitions + groups rows, as the rows are sorted by group
    joined = dealt.join(F.broadcast(offsets), dealt[group].eqNullSafe(F.col("_g")) & (part == F.col("_p")))
    return joined.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_g", "_p", "_first", "_before")


def pack(docs: DataFrame, max_len: int = 2048, buckets: int = 8, budget: int = 32_768, tokens: Column | None = None, order: Column | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, n_tokens, bucket_len, batch_id, slot, padding. order: what pieces are placed by before
    doc_id, such as a hash that mixes the sources."""
    if budget < max_len:
        raise ValueError("a batch must hold the longest piece")
    tokens = n_words(F.col("text")) if tokens is None else tokens
    sized = docs.select(F.col("doc_id"), tokens.alias("_t"), (F.lit(0) if order is None else order).alias("_order"))
    last = F.greatest(F.ceil(F.col("_t") / max_len) - 1, F.lit(0)).cast("int")
    pieces = sized.select("doc_id", "_t", "_order", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = materialize(pieces.select("doc_id", "_order", "piece", F.least(F.lit(max_len), F.col("_t") - F.col("piece") * max_len).cast("int").alias("n_tokens")))
    counts = np.zeros(max_len + 1, np.int64)
    for row in pieces.groupBy("n_tokens").count().collect():
        counts[row.n_tokens] = row["count"]
    ends = boundaries(counts, buckets)
    bucket = F.lit(None).cast("int")
    for end in reversed(ends):
        bucket = F.when(F.col("n_tokens") <= end, end).otherwise(bucket)
    placed = ranked(pieces.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, bucket)), "bucket_len", ["_order", "doc_id", "piece", "n_tokens"])
    slots = F.floor(F.lit(budget) / F.col("bucket_len"))
    return placed.select(
        "doc_id",
        "piece",
        "n_tokens",
        "bucket_len",
        F.when(F.col("bucket_len").isNotNull(), F.concat_ws("-", "bucket_len", F.floor(F.col("rank") / slots))).alias("batch_id"),
        F.when(F.col("bucket_len").isNotNull(), F.col("rank") % slots).alias("slot"),
        F.coalesce(F.col("bucket_len") - F.col("n_tokens"), F.lit(0)).alias("padding"),
    )


def oracle(max_len: int, buckets: int, budget: int) -> str:
    """pack() over the table documents as DuckDB SQL: one step of the dynamic programming for each bucket."""
    steps = "".join(
        f"""b{k} AS MATERIALIZED (SELECT j, x.cost AS cost, x.came AS came FROM (SELECT j, min({{'cost': cost, 'new': came < j, 'came': came}}) AS x FROM (
  SELECT l.j, b.cost + l.n * (l.pieces - q.pieces) - (l.tokens - q.tokens) AS cost, b.j AS came FROM l JOIN b{k - 1} b ON b.j < l.j JOIN l q ON q.j = b.j
  UNION ALL SELECT j, cost, j FROM b{k - 1}) GROUP BY j)),
"""
        for k in range(1, buckets + 1)
    )
    back = "".join(f"s{k - 1} AS (SELECT b.j, b.came FROM b{k - 1} b JOIN s{k} ON b.j = s{k}.came),\n" for k in range(buckets, 1, -1))
    found = " UNION ".join(f"SELECT j FROM s{k} WHERE came < j" for k in range(1, buckets + 1))
    return f"""WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::INT AS t FROM documents),
p AS MATERIALIZED (SELECT doc_id, piece, least({max_len}, t - piece * {max_len})::INT AS n FROM (SELECT doc_id, t, unnest(range(0, greatest((t + {max_len - 1}) // {max_len}, 1)))::INT AS piece FROM t)),
l AS MATERIALIZED (SELECT row_number() OVER w AS j, n::BIGINT AS n, (sum(c) OVER w)::BIGINT AS pieces, (sum(c * n) OVER w)::BIGINT AS tokens FROM (SELECT n, count(*) AS c FROM p WHERE n > 0 GROUP BY n) WINDOW w AS (ORDER BY n)
  UNION ALL SELECT 0, 0, 0, 0),
b0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS cost, 0::BIGINT AS came),
{steps}s{buckets} AS (SELECT j, came FROM b{buckets} WHERE j = (SELECT max(j) FROM l)),
{back}ends AS (SELECT n::INT AS e FROM l WHERE j IN ({found})),
q AS (SELECT doc_id, piece, n, CASE WHEN n > 0 THEN (SELECT min(e) FROM ends WHERE e >= n) END AS e FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY doc_id NULLS FIRST, piece, n) - 1 AS k, {budget} // e AS slots FROM q)
SELECT doc_id, piece, n AS n_tokens, e AS bucket_len, CASE WHEN e IS NOT NULL THEN concat(e, '-', k // slots) END AS batch_id,
  CASE WHEN e IS NOT NULL THEN (k % slots)::BIGINT END AS slot, coalesce(e - n, 0)::INT AS padding FROM r"""
