"""Operator 2: document fingerprints by one-permutation MinHash.

A text's set holds its shingles of five words (the whole sequence, if it has fewer). Each shingle is hashed
once: the top bits choose one of BINS bins, the rest is the value, and a bin keeps its least value. Empty bins
are filled by optimal densification: each draws other bins from its own fixed random sequence until one was
filled by a shingle. The low BITS bits of every bin, packed, make the fingerprint (hex). The likeness of two
fingerprints is the share of equal entries, corrected for the chance 2**-BITS of equal low bits, within 0..1.

``compare_with_next`` also fingerprints an edited text made with the next document in ascending doc_id. Rows
are dealt by ranges of doc_id whose bounds (one for each partition) the driver knows; the first row of a range
is also sent to the range before it, so one shuffle brings every document to its successor's start.

Defined results: null text counts as empty; texts without words have the fingerprint "" (likeness 1 among
themselves, 0 with others); a null doc_id comes first; rows with equal doc_id follow each other by the hash of
their text; the only row is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.words import mix, ngrams, inside, slices, word_hashes

SHINGLE, BINS, BITS = 5, 512, 4
SHIFT = np.uint64(64 - BINS.bit_length() + 1)
CHANCE = 2.0**-BITS
FULL = np.uint64(2**64 - 1)
LOWEST = -(2**63)


def sketches(texts: list) -> np.ndarray:
    """Low bits of each text's bins (texts x BINS); texts without words: 255."""
    h, at = word_hashes(texts)
    sizes = np.diff(at)
    starts = inside(at, SHINGLE)
    grams = ngrams(h, SHINGLE)[starts] if len(starts) else np.empty(0, np.uint64)
    rows = np.searchsorted(at, starts, side="right") - 1
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        whole = np.array([ngrams(h[at[i] : at[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)
        grams, rows = np.concatenate((grams, whole)), np.concatenate((rows, short))
    least = np.full(len(texts) * BINS, FULL, np.uint64)
    np.minimum.at(least, rows * BINS + (grams >> SHIFT).astype(np.int64), grams & np.uint64((1 << int(SHIFT)) - 1))
    least = least.reshape(-1, BINS)
    filled = least != FULL
    r, b = np.nonzero(~filled & (sizes > 0)[:, None])
    tries = 0
    while len(r):
        tries += 1
        other = (mix((b * 2_654_435_761 + tries).astype(np.uint64)) >> SHIFT).astype(np.int64)
        ok = filled[r, other]
        least[r[ok], b[ok]] = least[r[ok], other[ok]]
        r, b = r[~ok], b[~ok]
    out = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[sizes == 0] = 255
    return out


def packed(sketch: np.ndarray) -> list:
    """Two entries of four bits in a byte, as hex."""
    both = (sketch[:, 0::2] & 15) << 4 | (sketch[:, 1::2] & 15)
    return ["" if s[0] == 255 else row.tobytes().hex() for s, row in zip(sketch, both)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = (np.equal(a, b).mean(axis=1) - CHANCE) / (1 - CHANCE)
    none = (a[:, 0] == 255).astype(int) + (b[:, 0] == 255)
    return np.where(none == 2, 1.0, np.where(none == 1, 0.0, same.clip(0, 1)))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(sketches(texts)))], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for part in slices(batches):
        rows = list(zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("copy").to_pylist()))
        if held is not None:
            rows.insert(0, held)
        own = [i for i, x in enumerate(rows) if not x[2]]
        held = rows[own[-1]] if own and own[-1] == len(rows) - 1 else None
        pairs = [i for i in own if i + 1 < len(rows)]
        if not pairs:
            continue
        texts = [rows[i][1] for i in pairs] + [rows[pairs[-1] + 1][1]]  # pairs are neighbours: copies come last
        changed = [edited(t, n) for t, n in zip(texts, texts[1:])]
        raw = [t.encode("utf-8", "surrogatepass") for t in changed]
        sketch, other = sketches([t.encode("utf-8", "surrogatepass") for t in texts]), sketches(raw)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in pairs], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in raw]),
                pa.array(packed(sketch[:-1])),
                pa.array(packed(other)),
                pa.array(likeness(sketch[:-1], other)),
                pa.array(likeness(sketch[:-1], sketch[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = keyed.select("doc_id").repartitionByRange(n, "doc_id")
    bounds = np.array(sorted(r[0] for r in ids.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("m")).select("m").collect()), np.int64)

    @F.pandas_udf("array<struct<part: int, copy: boolean>>")
    def dealt(doc_id: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, doc_id.to_numpy(), side="right") - 1
        first = bounds[at] == doc_id.to_numpy()
        return pd.Series([[{"part": int(p), "copy": False}] + ([{"part": int(p - 1) % len(bounds), "copy": True}] if f else []) for p, f in zip(at, first)])

    rows = keyed.withColumn("to", F.explode(dealt("doc_id"))).select("doc_id", "text", F.col("to.part").alias("part"), F.col("to.copy").alias("copy"))
    rows = rows.repartitionById(max(len(bounds), 1), F.col("part")).sortWithinPartitions("copy", "doc_id", F.xxhash64("text"), "text")
    out = rows.select("doc_id", "text", "copy").mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))
