"""Operator 1: exact substring dedup over a compacted De Bruijn graph of token k-mers.

Every window of ``window`` words is an edge between its two (window-1)-grams. Consecutive windows of
a document that have the same anchor (the least hash among the short k-mers inside a window, a choice
that the window's words alone decide) form one nonbranching piece. Equal windows have equal anchors at
equal offsets, so a window can only be repeated inside pieces with the same anchor:

1. pieces meet by anchor in one shuffle (a row for about every seventh word); pieces with an anchor of
   their own leave the graph there;
2. of identical pieces (anchor and span hash, 128 bits) the earliest source coordinate stays, all
   others are repeated as a whole and point to it;
3. only where one anchor has different pieces (the graph branches) are single windows compared, the
   same way;
4. repeated pieces of a document that follow each other, and whose sources do, too, are one nonbranching
   path: a window function compacts them to one row (document, start, length, source coordinate);
5. every path is verified at its two coordinates: SHA-256 of its words there and of those at the source.
   Equal words have equal hashes, so a hash can only say too much; if one did, all is done again with
   another seed. What is removed is therefore equal to an earlier text for certain.

A table with a row for every k-mer edge, compacted by joins, would be some five times the input; pieces
hold the same edges in runs, and runs of the same source are what its nonbranching paths would become.

Equal pieces are resolved inside each slice of text before the shuffle, so a passage that a third of
all documents share adds one row for each slice, not for each document. An anchor with more than
NEIGHBOURS different pieces inside one slice branches for certain: these pieces go to the comparison of
windows at once, dealt by document, and only a sign (two rows without windows) meets the anchor's other
pieces, which then branch, too. So a hot anchor sends at most NEIGHBOURS + 2 rows from each slice to
one task. Rows reach the Python side sorted by Spark (which spills) and are read as a stream; no group
is held in memory.

Defined results: null text: no words; fewer than ``window`` words: nothing removed; coordinates are
(doc_id, start), a null doc_id is the smallest; rows that repeat a doc_id are read each by itself, and
equal coordinates never remove each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.store import materialize
from readqc.llm.words import BASE_B, as_bytes, hashed, inside, mix, ngrams, signed, slices, word_hashes

ANCHOR = 8
LOWEST = -(2**63)
REPEATED, BRANCHING, CANDIDATE = 1, 2, 0
#: Different pieces of one anchor in a slice of text (some 50,000 pieces) up to which they meet the others of the anchor.
NEIGHBOURS = 64
#: Seeds that are tried until all spans are verified.
SEEDS = 4
#: src: CRC and start of the source of what is repeated, in one number; of rows of kind REPEATED span is the source's doc_id.
PIECES = "key long, span long, doc_id long, tag int, start int, n int, kind byte, src long"
SPANS = "doc_id long, tag int, start int, n int, kind byte, src_doc long, src long"
_TYPES = {"key": pa.int64(), "span": pa.int64(), "doc_id": pa.int64(), "tag": pa.int32(), "start": pa.int32(), "n": pa.int32(), "kind": pa.int8(), "src": pa.int64(), "src_doc": pa.int64()}
_OF_PIECES, _OF_SPANS = (tuple(part.split()[0] for part in schema.split(", ")) for schema in (PIECES, SPANS))


def _rows(names: list, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for n, c in zip(names, columns)], names=names)


def _tags(texts: list) -> np.ndarray:
    return (np.array([zlib.crc32(t) for t in texts], np.int64) - 2**31).astype(np.int32)


def _leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` consecutive values, the leftmost of equals."""
    best, size = np.arange(len(v)), 1
    low = v
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        best = np.where(right, best[step:], best[:-step])
        low = np.where(right, low[step:], low[:-step])
        size += step
    return best


def _place(tag: np.ndarray, start: np.ndarray) -> np.ndarray:
    return tag.astype(np.int64) << 32 | start.astype(np.int64)


def _home(doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A key of the document's own, for rows that meet no others."""
    return signed(mix(doc.view(np.uint64) + tag.view(np.uint32).astype(np.uint64)))


def _emit(key, span, doc, tag, start, n, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Resolve equal (key, span) inside this slice, whose rows come in order of coordinates. Of keys with over ``most`` spans
    each piece branches; two spans without windows say so to the key."""
    order = np.lexsort((np.arange(len(key)), span, key))
    k, s = key[order], span[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    first = np.empty(len(key), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    repeated = (doc != doc[first]) | (start != start[first])
    keep = ~repeated
    if most is not None:
        own = k[new]  # once for each of its spans
        ends = np.flatnonzero(np.concatenate((own[1:] != own[:-1], [True])))
        hot = own[ends][np.diff(np.concatenate(([-1], ends))) > most]
        if len(hot):
            away = keep & np.isin(key, hot)
            keep &= ~away
            m, none = int(away.sum()), np.zeros(2 * len(hot), np.int64)
            yield _rows(_OF_PIECES, _home(doc[away], tag[away]), np.zeros(m, np.int64), doc[away], tag[away], start[away], n[away], np.full(m, BRANCHING), np.zeros(m, np.int64))
            yield _rows(_OF_PIECES, signed(np.repeat(hot, 2)), np.tile([0, 1], len(hot)), none, none, none, none, np.full(len(none), CANDIDATE), none)
    yield _rows(_OF_PIECES, signed(key[keep]), signed(span[keep]), doc[keep], tag[keep], start[keep], n[keep], np.full(keep.sum(), CANDIDATE), np.zeros(keep.sum(), np.int64))
    at = np.flatnonzero(repeated)
    if not len(at):
        return
    d, t, s, m, source = doc[at], tag[at], start[at], n[at], first[at]
    sd, st, ss = doc[source], tag[source], start[source]
    joins = (d[1:] == d[:-1]) & (t[1:] == t[:-1]) & (s[:-1] + m[:-1] == s[1:]) & (sd[1:] == sd[:-1]) & (st[1:] == st[:-1]) & (ss[:-1] + m[:-1] == ss[1:])
    heads = np.flatnonzero(np.concatenate(([True], ~joins)))
    total = np.add.reduceat(m, heads)
    d, t, s, sd, st, ss = (x[heads] for x in (d, t, s, sd, st, ss))
    yield _rows(_OF_PIECES, _home(d, t), sd, d, t, s, total, np.full(len(d), REPEATED), _place(st, ss))


def _pieces(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.sort_by("doc_id")
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            texts = as_bytes(part.column("text"))
            h, at = _seeded(texts, seed)
            starts = inside(at, window)
            if not len(starts):
                continue
            small, wide = ngrams(h, ANCHOR), ngrams(h, window)
            anchor = _leftmost_min(small, window - ANCHOR + 1)[starts]
            heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            n = np.diff(np.concatenate((heads, [len(starts)])))
            a, z = starts[heads], starts[heads + n - 1]
            span = mix(wide[a] * np.uint64(3) + mix(wide[z]) + n.astype(np.uint64))
            row = np.searchsorted(at, a, side="right") - 1
            yield from _emit(small[anchor[heads]], span, ids[row], _tags(texts)[row], (a - at[row]).astype(np.int32), n.astype(np.int32), NEIGHBOURS)

    return run


def _seeded(texts: list, seed: int) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(texts)
    return (mix(h ^ np.uint64(seed * BASE_B % 2**64)) if seed else h), at


def _windows(window: int, seed: int):
    """The single windows of the branching pieces; spans come as the two lists starts and ns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.sort_by("doc_id")
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            texts = as_bytes(part.column("text"))
            h, at = _seeded(texts, seed)
            s, n = part.column("starts"), part.column("ns")
            row = np.repeat(np.arange(len(part)), np.diff(s.offsets.to_numpy()))
            s, n = s.flatten().to_numpy(), n.flatten().to_numpy()
            row, each = np.repeat(row, n), np.repeat(s - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            start = each + np.arange(len(each))
            order = np.lexsort((start, row))
            row, start = row[order], start[order]
            where = at[row] + start
            yield from _emit(ngrams(h, window)[where], ngrams(h, window, BASE_B)[where], ids[row], _tags(texts)[row], start.astype(np.int32), np.ones(len(row), np.int32))

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, span, doc_id and start. Gives what is repeated, and the first of each span of a key that has several."""
    names = _OF_SPANS
    last = None  # key, span, doc, start, tag of the span that is open; pending: its first row, while its key has one span
    pending, branched = None, False
    for batch in batches:
        if not len(batch):
            continue
        k, s, d, t, b, n, kind, src = (batch.column(c).to_numpy(zero_copy_only=False) for c in _OF_PIECES)
        through = kind != CANDIDATE
        if through.any():
            yield _rows(names, d[through], t[through], b[through], n[through], kind[through], s[through], src[through])
            k, s, d, t, b, n = (x[~through] for x in (k, s, d, t, b, n))
        if not len(k):
            continue
        new_key = np.concatenate(([last is None or k[0] != last[0]], k[1:] != k[:-1]))
        new = new_key | np.concatenate(([last is None or s[0] != last[1]], s[1:] != s[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        d1, b1, t1 = (np.where(first >= 0, x[first], last[i] if last else 0) for i, x in ((2, d), (3, b), (4, t)))
        later = (d != d1) | (b != b1)
        group = np.cumsum(new_key)  # 0: the key that was open
        spans = np.bincount(group[new], minlength=group[-1] + 1)
        spans[0] += 2 if branched else pending is not None
        many = spans[group] > 1
        none = lambda m: [np.full(m, BRANCHING), np.zeros(m, np.int64), np.zeros(m, np.int64)]
        out = [[x[later] for x in (d, t, b, n)] + [np.full(later.sum(), REPEATED), d1[later], _place(t1[later], b1[later])]]
        once = ~later & many
        if pending is not None and spans[0] > 1:
            out.append([np.array([x]) for x in pending] + none(1))
            pending = None
        if pending is not None and group[-1] > 0:
            pending = None
        out.append([x[once] for x in (d, t, b, n)] + none(once.sum()))
        branched = bool(many[-1])
        if not branched and new[(group == group[-1])].any():
            i = np.flatnonzero(new)[-1]
            pending = (d[i], t[i], b[i], n[i])
        elif branched:
            pending = None
        last = (k[-1], s[-1], d1[-1], b1[-1], t1[-1])
        yield _rows(names, *(np.concatenate(x) for x in zip(*out)))


def _resolved(pieces: DataFrame) -> DataFrame:
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "key").sortWithinPartitions("key", "span", "doc_id", "start").mapInArrow(_resolve, SPANS)


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "n")).alias("s")).select("doc_id", "tag", F.col("s.start").alias("starts"), F.col("s.n").alias("ns"))


def paths(spans: DataFrame) -> DataFrame:
    """doc_id, tag, start, n, src_doc, src_tag, src_start: repeated spans that follow each other, as their sources do, as
    one. A source is an earlier coordinate, of the same slice of text where it has one."""
    spans = spans.select("doc_id", "tag", "start", "n", "src_doc", F.shiftright("src", 32).cast("int").alias("src_tag"), F.col("src").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("src_start"))
    # in one path, the distance from the source stays the same; spans may overlap where rows repeat a text
    line = ("doc_id", "tag", "src_doc", "src_tag", "shift")
    placed = spans.withColumn("shift", F.col("start") - F.col("src_start")).withColumn("end", F.col("start") + F.col("n"))
    before = F.max("end").over(Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = placed.withColumn("head", F.when(before >= F.col("start"), 0).otherwise(1))
    marked = marked.withColumn("path", F.sum("head").over(Window.partitionBy(*line).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*line, "path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return ends.select("doc_id", "tag", "start", (F.col("end") - F.col("start")).alias("n"), "src_doc", "src_tag", (F.col("start") - F.col("shift")).alias("src_start"))


def _digests(window: int):
    """Of each text's spans (lists id, start, n): id and SHA-256 of the words that their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, digests = [], []
            for text, spans in zip(as_bytes(part.column("text")), part.column("spans").to_pylist()):
                words = text.split()
                for x in spans:
                    ids.append(x["id"])
                    digests.append(hashlib.sha256(b" ".join(words[x["start"] : x["start"] + x["n"] + window - 1])).digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], names=["id", "digest"])

    return run


def all_verified(keyed: DataFrame, found: DataFrame, window: int) -> bool:
    """Whether the words of every path (doc_id, tag, start, n, src_doc, src_tag, src_start) are those at its source. A source
    that many paths share is asked once for each of its spans, and hashed once."""
    own = found.select("doc_id", "tag", "start", "n", F.xxhash64("src_doc", "src_tag", "src_start", "n").alias("id"))
    source = found.select(F.col("src_doc").alias("doc_id"), F.col("src_tag").alias("tag"), F.col("src_start").alias("start"), "n", F.xxhash64("src_doc", "src_tag", "src_start", "n").alias("id")).distinct()
    asked = own.unionByName(source).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("id", "start", "n")).alias("spans"))
    texts = keyed.join(asked.hint("shuffle_hash"), ["doc_id", "tag"]).select("text", "spans")
    digests = texts.mapInArrow(_digests(window), "id long, digest binary")
    return not digests.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").limit(1).count()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"),
        (F.crc32(F.coalesce(F.col("text"), F.lit(""))) - F.lit(2**31)).cast("int").alias("tag"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def _strip(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list = []
            for text, starts, ns in zip(as_bytes(part.column("text")), part.column("starts").to_pylist(), part.column("ns").to_pylist()):
                words = text.split()
                total = len(words)
                if starts:
                    step = np.zeros(total + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, np.array(starts) + np.array(ns) + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
                kept = b" ".join(words)
                out.append((total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            n, gone, digest, kept = zip(*out)
            columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)] + ([pa.array(kept)] if with_text else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])

    return run


def repeated_spans(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, tag (CRC of the text), start, n, src_doc, src_tag, src_start: at word ``start`` begin n consecutive windows
    whose words also begin at the earlier source coordinate."""
    if window <= ANCHOR:
        raise ValueError(f"a window needs more than {ANCHOR} words")
    keyed = _keyed(docs)
    for seed in range(SEEDS):
        found = materialize(paths(_found(keyed, window, seed)))
        if all_verified(keyed, found, window):
            return found
    raise RuntimeError(f"words of different spans had the same hashes under {SEEDS} seeds")


def _found(keyed: DataFrame, window: int, seed: int) -> DataFrame:
    found = materialize(_resolved(keyed.select("doc_id", "text").mapInArrow(_pieces(window, seed), PIECES)).where("n > 0"))
    branching = _by_document(found.where(F.col("kind") == BRANCHING))
    texts = keyed.join(branching.hint("shuffle_hash"), ["doc_id", "tag"])
    single = _resolved(texts.mapInArrow(_windows(window, seed), PIECES))
    return found.where(F.col("kind") == REPEATED).unionByName(single.where(F.col("kind") == REPEATED)).drop("kind")


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text (words joined by one space)."""
    spans = _by_document(repeated_spans(docs, window))
    joined = _keyed(docs).join(spans.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "ns")
    out = joined.mapInArrow(_strip(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != LOWEST, F.col("doc_id")))
