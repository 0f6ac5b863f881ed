"""Operator 10: n-gram Jaccard join with a token-group matrix.

Documents link when 100 * |x and y| >= 75 * |x or y| for their sets of 5-word shingles. A matrix entry (token,
group) says that some document of the group has the token; a document can link into a group only if enough of
its tokens have entries there. The matrix is kept sparse and used at two levels.

1. Documents with equal sets are one class from here on (128-bit set hash; copies inside a slice of text are
   resolved before the shuffle, so a class with a third of all rows adds one row for each slice).
2. Level one, the corpus as groups of one class, finds candidates by prefix filtering: tokens meet by hash, and
   each entry learns how many classes have it. A document's overlap with all others together is bounded by its
   tokens that others have too; where that is too little, it is done. Of the rest, the rarest tokens that any link
   must touch are kept (both sides of a link need s common tokens, so one is among the len - s + 1 rarest).
   A token that very many classes have (found by Misra-Gries summaries) never meets in one task: its entries
   take their count from a broadcast list of bounded size, and equal lengths of a token are drawn together before
   the shuffle. Tokens beyond that list are counted in buckets, as streams: a bucket sends on the entries of a token
   that has reached COMMON at once, with that as their count, and holds only what is still rare.
3. Documents that share such a token (and have lengths that can link) are put in one group: no link crosses
   groups. A group too large for one task goes through steps 2 and 3 once more by itself, now with whole sets and
   counts inside the group, which dissolves groups that only a common passage held together. What is still too
   large is cut into chunks of bounded size.
4. Level two: inside each chunk, the union of the tokens of the documents not yet reached is the group's row.
   A document's overlap with it is bounded first, and only if that qualifies is the group opened: exact
   intersections with its members, by postings. The search goes breadth first over documents that are not yet
   in the component, so thousands of near copies take one step, not all pairs.
5. Chunks of one large group: the largest components of the chunks are joined through one member each; what is
   outside the group's largest component is then held against every chunk, in blocks. Nothing is capped.

Tokens of a document in steps 2 and 3 are all its shingles up to SURE, beyond that its n - ceil(3n/4) + SHARED least
shingle hashes. That is exact: of two linked documents' common tokens, at least ceil(3n/4), the SHARED least ones
are among these on both sides, as so many tokens of either are not common at most. Step 4 takes whole sets.

Defined results: null text, or one without words: empty set, linked with nothing; fewer than five words: the
whole sequence is the only shingle; A-Z are lower-cased; a null doc_id is the smallest (a component with one
has a null id); rows that repeat a doc_id
and its text get the same result, different texts under one doc_id may count as linked; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.components import components
from readqc.llm.store import materialize, spare
from readqc.llm.words import as_bytes, mix, ngrams, slices, word_hashes

SHINGLE, SURE, SHARED = 5, 128, 64
LOWEST = -(2**63)
#: Of t entries, the tokens that have over t / k of them are heavy, where k is t / HEAVY, but COUNTERS at least and
#: MAX_COUNTERS at most: fewer than k tokens are broadcast (12 bytes each, 786 KB at any size). Beyond 6.5e10 entries a
#: token that isn't heavy can have over 2 * HEAVY, which its bucket reads as a stream.
HEAVY, COUNTERS, MAX_COUNTERS = 1_000_000, 1_024, 65_536
#: Counts from which all tokens are alike, entries that a bucket holds before it looks for such tokens, and partitions of
#: a shuffle: where there are more buckets, a partition has several, sorted, and takes one at a time.
COMMON, HELD, MAX_PARTS = 65_536, 2_000_000, 20_000
#: Tokens of a packed batch, of a partition, and of a chunk; rows up to which a list of ids is broadcast.
BATCH_TOKENS, PART_TOKENS, CHUNK_TOKENS, BROADCAST_IDS = 250_000, 400_000, 750_000, 1_000_000
NODES = "doc_id long, n int, s1 long, s2 long, first long, tokens binary"


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = word_hashes(texts, lower=True)
    grams = ngrams(h, SHINGLE)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(ngrams(h[a:b], int(b - a)) if b > a else np.empty(0, np.uint64))
    return out


def kept(n: int) -> int:
    """How many of a document's n tokens make candidates."""
    return n if n <= SURE else n + (-3 * n // 4) + SHARED


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        part = part.sort_by("doc_id")
        ids = part.column("doc_id").to_pylist()
        seen: dict = {}
        rows = []
        for d, s in zip(ids, shingle_sets(as_bytes(part.column("text")))):
            if not len(s):
                rows.append((d, 0, d, 0, d, None))
                continue
            key = (len(s), int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)), int(np.add.reduce(s * (s >> np.uint64(7) | np.uint64(1))).view(np.int64)))
            first = seen.setdefault(key, d)
            rows.append((d, len(s), key[1], key[2], None, s[: kept(len(s))].tobytes()) if first == d else (d, len(s), d, 0, first, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n", "s1", "s2", "first", "tokens"])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by s1, s2, n, doc_id; first becomes the class's least doc_id, and only that row keeps its tokens."""
    last, rep = None, None
    for batch in batches:
        doc, n, s1, s2, first = (batch.column(c).to_pylist() for c in ("doc_id", "n", "s1", "s2", "first"))
        keep = []
        for i in range(len(doc)):
            lead = first[i] is None
            if lead:
                key = (n[i], s1[i], s2[i])
                lead = key != last
                if lead:
                    last, rep = key, doc[i]
                first[i] = rep
            keep.append(lead)
        tokens = pa.array([t if k else None for t, k in zip(batch.column("tokens").to_pylist(), keep)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(first, pa.int64()), tokens], names=["doc_id", "n", "first", "tokens"])


def _scatter(bucket: np.ndarray, parts: int, columns: list) -> Iterator[tuple]:
    """(bucket, bytes of each column's entries of that bucket, column after column)."""
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=parts))
    columns = [c[order] for c in columns]
    starts = np.concatenate(([0], ends[:-1]))
    for i in np.flatnonzero(ends > starts).tolist():
        a, b = starts[i], ends[i]
        yield i, b"".join(c[a:b].tobytes() for c in columns)


def _packed(found, kind: int = 0) -> Iterator[pa.RecordBatch]:
    found = list(found)
    for i in range(0, len(found), 500):
        bucket, blob = zip(*found[i : i + 500])
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * len(blob), pa.int8()), pa.array(blob, pa.binary())], names=["bucket", "kind", "blob"])


PACKED = "bucket int, kind byte, blob binary"


def _gathered(batches: Iterator[pa.RecordBatch], types: list) -> list[np.ndarray]:
    width = sum(np.dtype(t).itemsize for t in types)
    held: list = [[] for _ in types]
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            m, at = len(blob) // width, 0
            for column, t in zip(held, types):
                column.append(np.frombuffer(blob, t, m, at))
                at += m * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.empty(0, t) for c, t in zip(held, types)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(tokens, doc_id, n) of some documents, in blocks of about BATCH_TOKENS."""
    held, size = [], 0
    for batch in batches:
        for d, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tokens"))):
            t = np.frombuffer(blob, np.uint64)
            held.append((t, np.full(len(t), d, np.int64), np.full(len(t), n, np.int32)))
            size += len(t)
            if size >= BATCH_TOKENS:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _summary(counters: int):
    """Misra-Gries summary of a task's tokens: each is counted short by its share of all over counters at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for some, _, _ in _blocks(batches):
            own, count = np.unique(some, return_counts=True)
            token, place = np.unique(np.concatenate((token, own)), return_inverse=True)
            n = np.bincount(place, np.concatenate((n, count)), len(token)).astype(np.int64)
            if len(n) > counters:
                n = n - np.partition(n, len(n) - counters - 1)[len(n) - counters - 1]
                token, n = token[n > 0], n[n > 0]
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def heavy_tokens(classes: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The heavy tokens in order (fewer than k, see HEAVY) and what the summaries say of their counts: the same for all
    entries of a token, which is all that an order needs."""
    k = min(MAX_COUNTERS, max(COUNTERS, total // HEAVY + 1))
    summed = classes.select("doc_id", "n", "tokens").mapInArrow(_summary(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = summed.where(F.col("n") > max(total // k, 1)).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.minimum(found["n"].to_numpy(np.int64)[order], 2**31 - 1).astype(np.int32)


ENTRY = [np.uint64, np.int64, np.int32]  # token, doc_id, n
COUNTED = [np.uint64, np.int64, np.int32, np.int32]  # and how many classes have the token


def _by_document(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _entries(parts: int, heavy):
    """Entries to the buckets of their tokens (kind 0); those of heavy tokens, counted, to those of their documents (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = heavy.value
        for tokens, doc, n in _blocks(batches):
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                hot = known[at] == tokens
                if hot.any():
                    yield from _packed(_scatter(_by_document(doc[hot], parts), parts, [tokens[hot], doc[hot], n[hot], count[at[hot]]]), 1)
                    tokens, doc, n = tokens[~hot], doc[~hot], n[~hot]
            yield from _packed(_scatter(((tokens >> np.uint64(24)) % np.uint64(parts)).astype(np.int64), parts, [tokens, doc, n]))

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(bucket, its batches) of rows that come bucket by bucket."""

    def runs():
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield bucket[a], batch.slice(a, b - a)

    for bucket, own in groupby(runs(), key=lambda x: x[0]):
        yield bucket, (batch for _, batch in own)


def _shared(parts: int):
    """Counts the entries of each token (up to COMMON) and sends those that others have, too, to the buckets of their documents."""

    def sent(token, doc, n, df):
        return _packed(_scatter(_by_document(doc, parts), parts, [token, doc, n, np.minimum(df, COMMON).astype(np.int32)]), 1)

    def counted(held):
        token, doc, n = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(token)
        token, doc, n = token[order], doc[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        df = np.diff(np.concatenate((heads, [len(token)])))
        return token, doc, n, np.repeat(df, df)

    def bucket(batches):
        held, size, limit, common = [], 0, HELD, np.empty(0, np.uint64)
        for batch in batches:
            through = batch.filter(pa.compute.equal(batch.column("kind"), 1))
            if len(through):
                yield through
            some = _gathered(iter([batch.filter(pa.compute.equal(batch.column("kind"), 0))]), ENTRY)
            if len(common):
                hot = np.isin(some[0], common)
                yield from sent(*(c[hot] for c in some), np.full(hot.sum(), COMMON))
                some = [c[~hot] for c in some]
            held.append(some)
            size += len(some[0])
            if size >= limit:
                *some, df = counted(held)
                hot = df >= COMMON
                yield from sent(*(c[hot] for c in some), df[hot])
                common = np.union1d(common, some[0][hot])
                held = [[c[~hot] for c in some]]
                size = len(held[0][0])
                limit = size + HELD
        if size:
            found = counted(held)
            keep = found[3] > 1
            yield from sent(*(c[keep] for c in found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _buckets(batches):
            yield from bucket(own)

    return run


def least_shared(n: np.ndarray, whole: bool) -> np.ndarray:
    """Tokens that a document of n shingles and any partner have in common among those that make candidates; whole: these
    are all."""
    all_ = -(-3 * n // 4)
    return all_ if whole else np.where(4 * n // 3 <= SURE, all_, np.minimum(all_, SHARED))


def _rare(whole: bool):
    """The rarest tokens of each document. Of the documents here that have one token and length, the least stands for
    all (up is null); the others are drawn to it (token is a hash of theirs)."""

    def bucket(batches):
        token, doc, n, df = _gathered(batches, COUNTED)
        if not len(token):
            return
        order = np.lexsort((token, df, n, doc))
        token, doc, n = token[order], doc[order], n[order]
        heads = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (n[1:] != n[:-1]))))
        count = np.diff(np.concatenate((heads, [len(token)])))
        spare = count - least_shared(n[heads].astype(np.int64), whole) + 1
        keep = np.arange(len(token)) - np.repeat(heads, count) < np.repeat(spare, count)
        token, doc, n = token[keep], doc[keep], n[keep]
        if not len(token):
            return
        order = np.lexsort((doc, n, token))
        token, doc, n = token[order], doc[order], n[order]
        first = np.concatenate(([True], (token[1:] != token[:-1]) | (n[1:] != n[:-1])))
        up = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        yield from _rare_rows(token[first].view(np.int64), doc[first], n[first], None)
        pairs = np.unique(np.stack((doc, up), axis=1)[doc != up], axis=0)
        yield from _rare_rows(mix(pairs[:, 0].view(np.uint64)).view(np.int64), pairs[:, 0], np.full(len(pairs), -1, np.int32), pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _buckets(batches):
            yield from bucket(own)

    return run


def _rare_rows(token, doc, n, up) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 50_000):
        part = slice(i, i + 50_000)
        last = pa.array(up[part]) if up is not None else pa.nulls(len(doc[part]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(doc[part]), pa.array(n[part]), last], names=["token", "doc_id", "n", "up"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by token, n, doc_id: each document with the first of its token whose length leads to it step by step."""
    last_token = last_n = head = None
    edges = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    for batch in batches:
        drawn = batch.filter(pa.compute.is_valid(batch.column("up")))
        if len(drawn):
            yield edges(drawn.column("doc_id"), drawn.column("up"))
            batch = batch.filter(pa.compute.is_null(batch.column("up")))
        token, doc, n = (batch.column(c).to_numpy() for c in ("token", "doc_id", "n"))
        if not len(token):
            continue
        before = np.concatenate(([last_n if last_n is not None and token[0] == last_token else -1], np.where(token[1:] == token[:-1], n[:-1], -1)))
        new = 4 * before < 3 * n
        at = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
        heads = np.where(at >= 0, doc[at], head if head is not None else 0)
        last_token, last_n, head = token[-1], n[-1], heads[-1]
        pairs = np.unique(np.stack((doc, heads), axis=1)[doc != heads], axis=0)
        yield edges(pairs[:, 0], pairs[:, 1])


def _in_buckets(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by bucket: a partition each, or several in a partition, one after another."""
    most = min(parts, MAX_PARTS)
    dealt = rows.repartitionById(most, F.col("bucket") % most)
    return dealt if most == parts else dealt.sortWithinPartitions("bucket")


def _candidates(classes: DataFrame, whole: bool) -> DataFrame:
    """v, r: the groups of classes (doc_id, n, tokens) that candidates make."""
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = int(classes.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0)
    parts = max(n, total // PART_TOKENS + 1)
    heavy = spark.sparkContext.broadcast(heavy_tokens(classes, total))
    entries = _in_buckets(classes.select("doc_id", "n", "tokens").mapInArrow(_entries(parts, heavy), PACKED), parts)
    shared = _in_buckets(entries.mapInArrow(_shared(parts), PACKED), parts)
    rare = shared.mapInArrow(_rare(whole), "token long, doc_id long, n int, up long")
    near = rare.repartition(n, "token").sortWithinPartitions("token", "n", "doc_id").mapInArrow(_neighbours, "a long, b long")
    return components(near)


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, tokens with all tokens, made different for each group."""
    for part in slices(batches):
        sets = shingle_sets(as_bytes(part.column("text")))
        own = mix(part.column("g").to_numpy().view(np.uint64))
        tokens = [mix(s ^ g).tobytes() for s, g in zip(sets, own)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, sets)), pa.int32()), pa.array(tokens, pa.binary())], names=["doc_id", "n", "tokens"])


class Group:
    """Token rows and postings of some documents."""

    def __init__(self, sets: list, members: np.ndarray) -> None:
        self.members = members
        sizes = [len(sets[i]) for i in members]
        tokens = np.concatenate([sets[i] for i in members])
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(members)), sizes)[order]
        tokens = tokens[order]
        heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.union, self.starts = tokens[heads], np.concatenate((heads, [len(tokens)]))
        self.sizes = np.array(sizes)

    def links(self, query: np.ndarray) -> np.ndarray:
        """Places of the members that link with the query."""
        if not len(query) or not len(self.union):
            return np.empty(0, np.int64)
        at = np.searchsorted(self.union, query)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == query]
        if 4 * len(at) < 3 * len(query):  # the group's bound: not opened
            return np.empty(0, np.int64)
        length = self.starts[at + 1] - self.starts[at]
        first = np.repeat(self.starts[at] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        common = np.bincount(self.owner[first + np.arange(int(length.sum()))], minlength=len(self.members))
        return np.flatnonzero(100 * common >= 75 * (self.sizes + len(query) - common))


def linked_roots(sets: list) -> np.ndarray:
    """Component (least place) of each set, breadth first: only what is not reached yet is searched."""
    root = np.full(len(sets), -1)
    left = np.arange(len(sets))
    group = Group(sets, left)
    for i in range(len(sets)):
        if root[i] >= 0:
            continue
        root[i] = i
        queue = [i]
        while queue:
            q = queue.pop()
            open_ = root[group.members] < 0
            if not open_.any():
                break
            if open_.sum() * 2 < len(group.members):
                group = Group(sets, group.members[open_])
            hits = group.members[group.links(sets[q])]
            hits = hits[root[hits] < 0]
            root[hits] = i
            queue += hits.tolist()
    return root


def _grouped(batches: Iterator[pa.RecordBatch], keys: list) -> Iterator[tuple]:
    """(key, rows without text, sets) of each run of rows with equal keys."""
    key, rows, sets = None, [], []
    for part in slices(batches):
        others = [c for c in part.schema.names if c != "text"]
        for row, s in zip(zip(*(part.column(c).to_pylist() for c in others)), shingle_sets(as_bytes(part.column("text")))):
            row = dict(zip(others, row))
            own = tuple(row[k] for k in keys)
            if own != key:
                if rows:
                    yield key, rows, sets
                key, rows, sets = own, [], []
            rows.append(row)
            sets.append(s)
    if rows:
        yield key, rows, sets


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key and doc_id; gives each document's least linked one in its chunk."""
    names, held = ["doc_id", "root", "g", "chunk"], []

    def batch():
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for (g, chunk), rows, sets in _grouped(batches, ["g", "chunk"]):
        ids = np.array([r["doc_id"] for r in rows], np.int64)
        held.append((ids, ids[linked_roots(sets)], np.full(len(ids), g, np.int64), np.full(len(ids), chunk, np.int32)))
        if len(held) >= 2_000:
            yield batch()
    if held:
        yield batch()


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each outlier with documents of other components, one for each component."""
    for _, rows, sets in _grouped(batches, ["g", "chunk", "block"]):
        ids, label = (np.array([r[c] for r in rows], np.int64) for c in ("doc_id", "root"))
        asked = np.array([r["outlier"] for r in rows], bool)
        if not asked.any():
            continue
        group, found = Group(sets, np.arange(len(sets))), set()
        for i in np.flatnonzero(asked):
            hits = group.links(sets[i])
            hits = hits[label[hits] != label[i]]
            _, one = np.unique(label[hits], return_index=True)
            found |= {(int(ids[i]), int(ids[j])) for j in hits[one]}
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _texts_of(docs: DataFrame, members: DataFrame, rows: int) -> DataFrame:
    """docs joined with members, a list of so many rows, on doc_id: by broadcast while it is small, else by a shuffle."""
    return docs.join(F.broadcast(members) if rows <= BROADCAST_IDS else members.hint("shuffle_hash"), "doc_id")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, "doc_id")


def _members(groups: DataFrame, classes: DataFrame, chunk_tokens: int) -> DataFrame:
    """doc_id, g, chunks, n, chunk of every document in a group (v, r)."""
    sized = groups.join(classes.select(F.col("doc_id").alias("v"), "n").groupBy("v").agg(F.sum("n").alias("n")), "v")
    chunks = sized.groupBy("r").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("chunks"))
    return materialize(sized.join(chunks, "r").select(F.col("v").alias("doc_id"), F.col("r").alias("g"), "chunks", "n", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk")))


def link(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    nodes = keyed.mapInArrow(_nodes, NODES).repartition(n, "s1").sortWithinPartitions("s1", "s2", "n", "doc_id")
    nodes = materialize(nodes.mapInArrow(_classes, "doc_id long, n int, first long, tokens binary"))
    classes = nodes.where("tokens is not null")
    members = _members(_candidates(classes, False), classes, chunk_tokens)
    size, most = members.agg(F.count("*"), F.max("chunks")).first()
    if (most or 0) > 1:
        members = _split(keyed, members, chunk_tokens)
        size, most = members.agg(F.count("*"), F.max("chunks")).first()
    texts = _dealt(_texts_of(keyed, members.select("doc_id", "g", "chunk"), size), "g", "chunk")
    found = texts.mapInArrow(_verify, "doc_id long, root long, g long, chunk int")
    if (most or 0) > 1:
        found = materialize(found)
        found = _across(keyed, found, members, chunk_tokens)
    roots_ = found.groupBy("doc_id").agg(F.min("root").alias("root"))
    leads = nodes.select("doc_id", "n", "first").join(roots_.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", "n", "first", F.coalesce("root", "first").alias("root"))
    return _resolved(leads)


def _split(keyed: DataFrame, members: DataFrame, chunk_tokens: int) -> DataFrame:
    """members, with the groups of several chunks split by whole sets; documents that can link with none leave."""
    large = members.where("chunks > 1")
    texts = _texts_of(keyed, large.select("doc_id", "g"), large.count())
    sets = materialize(texts.mapInArrow(_whole_sets, "doc_id long, n int, tokens binary").where("n > 0"))
    again = _members(_candidates(sets, True), sets, chunk_tokens)
    return materialize(members.where("chunks = 1").unionByName(again))


def _across(keyed: DataFrame, found: DataFrame, members: DataFrame, chunk_tokens: int) -> DataFrame:
    """doc_id, root after the chunks of groups with several of them have been held against each other."""
    many = members.where("chunks > 1").select("g").distinct()
    inside_ = materialize(found.join(many, "g", "left_semi"))
    by_root = inside_.groupBy("g", "chunk", "root").agg(F.count("*").alias("m"))
    best = by_root.groupBy("g", "chunk").agg(F.max(F.struct("m", (-F.col("root")).alias("root"))).alias("x"))
    pivots = best.select((-F.col("x.root")).alias("doc_id"), "g")  # one for each chunk
    edges = inside_.select("doc_id", "root")
    while True:
        joined, levels = _pivots(keyed, pivots, members, chunk_tokens)
        edges = edges.unionByName(joined.select("doc_id", "root"))
        if levels <= 1:
            break
        best = joined.groupBy("g", "chunk", "root").agg(F.count("*").alias("m")).groupBy("g", "chunk").agg(F.max(F.struct("m", (-F.col("root")).alias("root"))).alias("x"))
        pivots = best.select((-F.col("x.root")).alias("doc_id"), "g")
    edges = materialize(edges.where(F.col("doc_id") != F.col("root")))
    first = components(edges)
    labelled = inside_.join(first.toDF("doc_id", "label"), "doc_id", "left").select("doc_id", "g", "chunk", F.coalesce("label", "root").alias("root"))
    largest = labelled.groupBy("g", "root").agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", "root")).alias("x")).select("g", F.col("x.root").alias("main"))
    rows = labelled.join(members.select("doc_id", "n", "chunks").distinct(), "doc_id").join(largest, "g").withColumn("outlier", F.col("root") != F.col("main"))
    blocks = rows.where("outlier").groupBy("g").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("blocks"))
    rows = materialize(rows.join(blocks, "g"))
    all_ = rows.select("doc_id", "root", "g", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("outlier"))
    own = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")
    asked = rows.where("outlier").select("doc_id", "root", "g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), own.alias("block"), F.lit(True).alias("outlier"))
    tasks = all_.unionByName(asked)
    size = rows.agg(F.sum(F.col("blocks").cast("long") + F.when(F.col("outlier"), F.col("chunks")).otherwise(0))).first()[0] or 0  # rows of tasks
    texts = _dealt(_texts_of(keyed, tasks, size), "g", "chunk", "block")
    more = texts.mapInArrow(_outside, "a long, b long")
    final = components(edges.toDF("a", "b").unionByName(more))
    return found.join(final.toDF("doc_id", "label"), "doc_id", "left").select("doc_id", F.coalesce("label", "root").alias("root"))


def _pivots(keyed: DataFrame, pivots: DataFrame, members: DataFrame, chunk_tokens: int) -> tuple[DataFrame, int]:
    """doc_id, root, g, chunk: links among pivots (doc_id, g), in chunks of their own; and the most chunks of a group: half
    as many as its pivots at most, so that these get fewer each time."""
    sized = pivots.join(members.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    chunks = sized.groupBy("g").agg(F.least(F.ceil(F.sum("n") / chunk_tokens), F.ceil(F.count("*") / 2)).cast("int").alias("chunks"))
    rows = materialize(sized.join(chunks, "g").select("doc_id", "g", "chunks", F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("chunks")).cast("int").alias("chunk")))
    size, most = rows.agg(F.count("*"), F.max("chunks")).first()
    texts = _dealt(_texts_of(keyed, rows.select("doc_id", "g", "chunk"), size), "g", "chunk")
    return materialize(texts.mapInArrow(_verify, "doc_id long, root long, g long, chunk int")), most or 0


def _resolved(leads: DataFrame) -> DataFrame:
    """first may be the first copy in a slice, whose own class has an earlier one still."""
    by_doc = leads.groupBy("doc_id").agg(F.min("root").alias("up"))
    out = leads.join(by_doc.withColumnRenamed("doc_id", "first"), "first", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.least("root", "up").alias("component_id"))
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c)).alias(c)
    return out.select(real("doc_id"), "n_shingles", real("component_id"))


def dedup(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The rows of docs that stay, one document (the least doc_id) of each component, with all their columns."""
    own = spare(docs, "_id")[0]
    stay = link(docs, chunk_tokens).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(LOWEST)).alias(own)).distinct()
    keyed = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)))
    return keyed.join(stay.hint("shuffle_hash"), own, "left_semi").drop(own).select(*(F.col(f"`{c}`") for c in docs.columns))
