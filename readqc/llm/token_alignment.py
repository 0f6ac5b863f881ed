"""Operator 12: alignment of two tokenizers over whole texts, with corpus-wide counts of the token pairs that end together.

Three passes, each a plain scan or one shuffle of counts:

1. Each text is tokenised by both (encode), cut into groups at the byte offsets where both have a token end, and its
   links (A and B token that end together) are packed into int64 keys, B's id above A's. A row for each document, with
   its distinct keys and how often it holds them, is written to the shared folder.
2. Every task adds up its keys with np.unique; the partial counts are dealt out by ranges of the key, sorted, and runs
   of one key summed. Each range goes to the shared folder as shards: sorted arrays of keys and counts.
3. Every task maps the shards into memory and looks its documents' keys up by binary search.

What goes through the driver is a line for each shard and each B id's highest count (bounded by the vocabulary). Where the
shared folder can't be opened as files (hdfs and the like), step 3 is a join by key instead (joined), with the same rows.

Texts are tokenised in pieces: neither tokenizer joins what stands before a single space with what follows it, if a visible
character stands on either side, so a piece between such spaces has the same tokens alone as in its text. For B that
holds as no entry has a space mark after another character, which load() verifies (else texts stay whole). Pieces
that a worker has seen are not tokenised again, and a text without any space is one piece.

Defined results: null and empty texts, and texts whose tokens don't give back the text (a literal U+2581, or what B
normalises away), have no tokens: zeros and an empty groups_sha256. Repeated rows and null ids are documents of their own;
extra columns are ignored; the names of helper columns never meet them. No document: no row.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.store import materialize, mounted, own_folder
from readqc.llm.words import slices

#: Pieces that a worker remembers; partial counts and a shard's entries that a task holds at once; pieces hashed at once.
MEMO, PENDING, SHARD, HASHED = 300_000, 2_000_000, 1_000_000, 50_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"
_LOADED: dict = {}  # files -> both tokenizers; these -> the pieces that this worker knows
_KNOWN: dict = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a vocabulary has an entry without bytes")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (list(map(str, range(len(v)))) for v in (self.a_bytes, self.b_bytes))
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def tokens(self, pieces: list[str]) -> tuple[list, list]:
        a = [x.ids for x in self.a.encode_batch([" " + p for p in pieces], add_special_tokens=False)]
        return a, self.b.encode(pieces, num_threads=1)


def load(a_file: str, b_file: str) -> Pair:
    if (a_file, b_file) not in _LOADED:
        _LOADED[a_file, b_file] = Pair(a_file, b_file)
    return _LOADED[a_file, b_file]


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def _listed(ids: np.ndarray, last: np.ndarray, names: list[str]) -> list[str]:
    """The ids of each group as text; a group is what follows the group before it, up to its last token."""
    out = [names[i] for i in ids[last].tolist()]
    first = np.concatenate([[-1], last[:-1]]) + 1
    for g in np.flatnonzero(first < last).tolist():
        out[g] = ",".join([names[i] for i in ids[first[g] : last[g] + 1].tolist()])
    return out


class Known:
    """Alignments of the pieces seen so far: numbers of A's tokens, B's tokens and groups (-1: the bytes differ), the text
    of the groups, and the keys of the links."""

    def __init__(self, pair: Pair) -> None:
        self.pair, self.at = pair, {}
        self.texts: list[str] = []
        self.numbers, self.starts, self.keys = np.zeros((0, 3), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, pieces: list[str]) -> None:
        pair = self.pair
        ids_a, ids_b = pair.tokens(pieces)
        (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
        right = self._right(pieces, a, n_a, b, n_b)
        if not right.all():
            a, b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)]
            n_a, n_b = n_a[right], n_b[right]
        ends_a, ends_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
        _, in_a, in_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        links = np.bincount(np.repeat(np.arange(len(n_a)), n_a)[in_a], minlength=len(n_a)) if len(n_a) else n_a
        numbers = np.full((len(pieces), 3), -1, np.int64)
        numbers[right] = np.stack([n_a, n_b, links], axis=1)
        shown = list(map("|".join, zip(_listed(a, in_a, pair.a_names), _listed(b, in_b, pair.b_names))))
        ends = np.cumsum(np.maximum(numbers[:, 2], 0))
        starts = [0, *ends[:-1].tolist()]
        self.at |= {p: i for i, p in enumerate(pieces, len(self.texts))}
        self.texts += [";".join(shown[x:y]) for x, y in zip(starts, ends.tolist())]
        self.numbers = np.concatenate([self.numbers, numbers])
        self.keys = np.concatenate([self.keys, b[in_b] << 32 | a[in_a]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])

    def _right(self, pieces: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Which pieces both tokenizers give back byte for byte."""
        pair = self.pair
        whole = [(" " + p).encode() for p in pieces]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        bytes_a, bytes_b = ([of[i] for i in ids.tolist()] for of, ids in ((pair.a_bytes, a), (pair.b_bytes, b)))
        owner = np.arange(len(pieces))
        total = lambda of, ids, n: np.bincount(np.repeat(owner, n), of[ids], minlength=len(pieces)).astype(np.int64)
        if (total(pair.a_sizes, a, n_a) == sizes).all() and (total(pair.b_sizes, b, n_b) == sizes).all() and b"".join(bytes_a) == b"".join(whole) == b"".join(bytes_b):
            return np.ones(len(pieces), bool)
        cuts = [np.cumsum(n).tolist() for n in (n_a, n_b)]
        found = [[b"".join(x[end - n : end]) for end, n in zip(c, m.tolist())] for x, c, m in zip((bytes_a, bytes_b), cuts, (n_a, n_b))]
        return np.array([x == w == y for x, w, y in zip(found[0], whole, found[1])], bool)

    def which(self, pieces: list[str]) -> np.ndarray:
        new = [p for p in dict.fromkeys(pieces) if p not in self.at]
        if new:
            self.add(new)
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def links(self, which: np.ndarray) -> np.ndarray:
        sizes = self.starts[which + 1] - self.starts[which]
        return self.keys[np.repeat(self.starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

    def digest(self, which: np.ndarray) -> str:
        found = hashlib.sha256()
        for i in range(0, len(which), HASHED):
            found.update(((";" if i else "") + ";".join([self.texts[k] for k in which[i : i + HASHED].tolist()])).encode())
        return found.hexdigest()


NONE = (0, 0, 0, 0, "", b"", b"")


def _encoded(a_file: str, b_file: str, text: str, kept: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load(a_file, b_file)
        known = _KNOWN.setdefault(pair, Known(pair))
        for batch in slices(batches, text):
            if len(known.at) > MEMO:
                known = _KNOWN[pair] = Known(pair)
            texts = batch.column(text).to_pylist()
            pieces = [_CUT.split(t) if pair.cuts else [t] for t in texts if t]
            which = known.which(list(chain.from_iterable(pieces)))
            rows, at, own = [], 0, iter(pieces)
            for t in texts:
                row = NONE
                if t:
                    mine = which[at : (at := at + len(next(own)))]
                    numbers = known.numbers[mine]
                    if (numbers[:, 2] >= 0).all():
                        n_a, n_b, groups = numbers.sum(axis=0).tolist()
                        keys, held = np.unique(known.links(mine), return_counts=True)
                        row = (n_a, n_b, groups, int(held.sum()), known.digest(mine), keys.tobytes(), held.astype(np.int64).tobytes())
                rows.append(row)
            columns = [batch.column(c) for c in kept] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[len(kept) :])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def encode(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Step 1: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and held (arrays of int64 as bytes)."""
    kinds = dict(docs.dtypes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "held"]
    made = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.null()), *zip(names[2:], made)])
    shown = f"row long, doc_id {kinds[doc_id]}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, held binary"
    return rows.mapInArrow(_encoded(a_file, b_file, "text", names[:2], schema), shown)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and how many each row has."""
    own = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(own), np.int64), np.array([x.size // 8 for x in own], np.int64)


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return found, total


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, waiting = [], [], 0
    given = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])
    for batch in batches:
        keys.append(_numbers(batch.column("pairs"))[0])
        counts.append(_numbers(batch.column("held"))[0])
        waiting += len(keys[-1])
        if waiting > PENDING:
            found, total = _summed(keys, counts)
            if len(found) > PENDING // 2:
                yield given(found, total)
                found, total = found[:0], total[:0]
            keys, counts, waiting = [found], [total], len(found)
    if waiting:
        yield given(*_summed(keys, counts))


def partial_counts(encoded: DataFrame) -> DataFrame:
    """key, n: every task's own counts of its keys."""
    return encoded.select("pairs", "held").mapInArrow(_partial, "key long, n long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the runs of equal keys of sorted rows, in pieces; a run that goes on in the next batch waits for it."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        counts = np.concatenate([counts, batch.column("n").to_numpy()])
        if not len(keys):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        keys, counts = keys[starts], np.add.reduceat(counts, starts)
        if len(keys) > SHARD:
            yield keys[:-1], counts[:-1]
            keys, counts = keys[-1:], counts[-1:]
    if len(keys):
        yield keys, counts


def _sharding(folder: str):
    """Writes the summed counts of a range as shards, and gives a line for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _runs(batches):
            os.makedirs(folder, exist_ok=True)
            name = os.path.join(folder, uuid.uuid4().hex)  # a task that runs again writes files of its own
            np.save(f"{name}-keys.npy", keys)
            np.save(f"{name}-counts.npy", counts)
            own, starts = np.unique(keys >> 32, return_index=True)
            line = [[int(keys[0])], [name], [own.tolist()], [np.maximum.reduceat(counts, starts).tolist()]]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(line, kinds)], names=["first", "name", "ids", "most"])

    return run


def _looked_up(lines: list, ids: np.ndarray, most: np.ndarray):
    """Adds n_best and count_sum to encoded rows, out of the shards."""
    firsts, names = np.array([x[0] for x in lines], np.int64), [x[1] for x in lines]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [None] * len(names)
        for batch in batches:
            keys, sizes = _numbers(batch.column("pairs"))
            held, _ = _numbers(batch.column("held"))
            distinct, where = np.unique(keys, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            cuts = np.searchsorted(distinct, firsts).tolist() + [len(distinct)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    if shards[i] is None:
                        shards[i] = [np.load(f"{names[i]}-{x}.npy", mmap_mode="r") for x in ("keys", "counts")]
                    own, counts = shards[i]
                    n[a:b] = counts[np.searchsorted(own, distinct[a:b])]
            best = n == most[np.searchsorted(ids, distinct >> 32)] if len(distinct) else np.zeros(0, bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            np.add.at(sums[0], row, held * best[where])
            np.add.at(sums[1], row, held * n[where])
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(x, pa.int64()) for x in sums] + [batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "pairs"):
        keys, sizes = _numbers(batch.column("pairs"))
        held, _ = _numbers(batch.column("held"))
        row = np.repeat(batch.column("row").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, keys, held)], names=["row", "key", "held"])


def joined(encoded: DataFrame, partial: DataFrame) -> DataFrame:
    """Step 3 by joins, for shared folders that are no mounted files."""
    id_b = F.shiftright("key", 32)
    counts = materialize(partial.groupBy("key").agg(F.sum("n").alias("n")))
    most = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))  # a row for each entry of B
    counts = counts.join(F.broadcast(most), id_b == F.col("b")).select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    links = encoded.select("row", "pairs", "held").mapInArrow(_unpacked, "row long, key long, held long").join(counts, "key")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("held")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("n")).alias("count_sum"))
    own = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return encoded.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", own("n_best"), own("count_sum"), "groups_sha256")


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document. The vocabulary files must
    stand at these paths on every node."""
    spark = docs.sparkSession
    encoded = materialize(encode(docs, a_file, b_file, text, doc_id))
    partial = materialize(partial_counts(encoded))
    folder = mounted(own_folder(spark))
    if folder is None:
        return joined(encoded, partial)
    shards = partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_sharding(os.path.join(folder, f"shards-{uuid.uuid4().hex}")), "first long, name string, ids array<long>, most array<long>")
    lines = sorted((tuple(x) for x in shards.collect()), key=lambda x: x[0])
    ids, most = _highest(lines)
    kinds = dict(encoded.dtypes)
    shown = f"doc_id {kinds['doc_id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return encoded.mapInArrow(_looked_up([x[:2] for x in lines], ids, most), shown)


def _highest(lines: list) -> tuple[np.ndarray, np.ndarray]:
    """B's ids in order and the highest count of each; an id whose keys run over two shards is in both."""
    ids = np.array([i for x in lines for i in x[2]], np.int64)
    most = np.array([n for x in lines for n in x[3]], np.int64)
    found, where = np.unique(ids, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.maximum.at(out, where, most)
    return found, out
