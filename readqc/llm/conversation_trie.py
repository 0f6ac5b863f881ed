"""Operator 13: the prefix trie of conversations, by MSD radix partitioning over dictionary-encoded turns.

Turns (role, text) get numbers out of a dictionary table, so a conversation is an array of numbers; equal arrays become one
sequence with its members counted. All sequences start in one bucket, the root's. In each round, a bucket of more than LOCAL
sequences or CELLS turns

* goes down as far as all its sequences agree (the common prefix of its least and greatest sequence), which gives a chain of
  nodes at once, however long,
* and is dealt out by the next turn into one bucket for each child.

Smaller buckets are local: each is finished by one task with a multikey quicksort, whose recursion emits the nodes. As
sequences of a bucket differ, a bucket of copies can't be stuck. Totals of subtrees go from local buckets (and chains) to the
buckets above them in one aggregate.

The ids of the conversations that end at a node are written out in pieces by tasks that hold ranges of (sequence, id), and
only these pieces meet, in order, in the task that digests them; it holds one piece at a time. A digest is sequential by
nature. One conversation's turns are one sort group (Spark spills it), and 12 bytes for each turn one array.

SHA-256 of a turn and of a sequence stand for them in joins.

Defined results: null role or text: empty; turns by turn (null first), then role and text; repeated rows are turns of their own;
rows without conv_id belong to no conversation and are left out; extra columns are ignored; no conversation: no node, not even
the root. Ids are taken as long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.store import materialize

#: Sequences and turns of a bucket that one task finishes; ids of a piece.
LOCAL, CELLS, PIECE = 4_096, 1_000_000, 20_000
GROUP, HEAD = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "path array<long>, top boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, leaf binary"
_TYPES = (pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 7, pa.binary())
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: the original turns of each conversation as dictionary numbers, and the UTF-8 bytes of their texts."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    turns = materialize(rows.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(place).alias("at"), said.alias("said"), F.octet_length("text").alias("size")))
    dictionary = materialize(turns.groupBy("said").agg(F.max("size").alias("size")).select("said", "size", F.monotonically_increasing_id().alias("id")))
    coded = turns.select("conv_id", "at", "said").join(dictionary, "said")
    own = coded.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "size"))).alias("t"))
    return own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, ids, sizes after each conversation c took its first h turns from c - c % 5, with h = crc32(c) % 9."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("_base"), *(F.slice(c, 1, HEAD - 1).alias(f"_{c}") for c in ("ids", "sizes")))
    both = own.withColumns({"_h": h, "_base": F.col("conv_id") - F.col("conv_id") % GROUP}).join(heads, "_base", "left")
    none = {"ids": F.array().cast("array<long>"), "sizes": F.array().cast("array<int>")}
    joined = lambda c: F.concat(F.slice(F.coalesce(f"_{c}", none[c]), F.lit(1), F.col("_h")), F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))).alias(c)
    return both.select("conv_id", joined("ids"), joined("sizes"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (leaf, conv_id) as pieces of comma-joined ids."""
    rows = (r for b in batches for r in zip(b.column("leaf").to_pylist(), b.column("conv_id").to_pylist()))
    for leaf, own in groupby(rows, key=lambda r: r[0]):
        ids: list = []
        for _, i in own:
            ids.append(i)
            if len(ids) == PIECE:
                yield _piece(leaf, ids)
                ids = []
        if ids:
            yield _piece(leaf, ids)


def _piece(leaf: bytes, ids: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([leaf], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["leaf", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(b.column("leaf").to_pylist(), b.column("ids").to_pylist()))
    for leaf, pieces in groupby(rows, key=lambda r: r[0]):
        digest = hashlib.sha256()
        for k, (_, ids) in enumerate(pieces):
            digest.update(("," if k else "").encode() + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.binary()), pa.array([digest.hexdigest()])], names=["leaf", "ends_sha256"])


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small batches as larger ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def ends(members: DataFrame) -> DataFrame:
    """leaf, ends_sha256 of (leaf, conv_id): the digest of each sequence's members in order."""
    pieces = members.select("leaf", "conv_id").repartitionByRange("leaf", "conv_id").sortWithinPartitions("leaf", "conv_id").mapInArrow(lambda b: _gathered(_listed(b), 100), "leaf binary, first long, ids string")
    return pieces.repartition("leaf").sortWithinPartitions("leaf", "first").mapInArrow(lambda b: _gathered(_digested(b)), "leaf binary, ends_sha256 string")


def finish(rows: list, depth: int, parent: int | None) -> list[list]:
    """Nodes of the bucket whose sequences (ids, sizes, n, least, leaf) share ``depth`` turns, its own first: columns depth,
    conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, leaf.

    A multikey quicksort: rows are split by their turn at one depth into less, equal and greater than a pivot, and the equal
    ones, which are a node one deeper, go on with the next turn. A stack stands for the recursion."""
    nodes: list[list] = []
    above: list[int] = []

    def node(own: list, depth: int, up: int) -> int:
        n, least = sum(r[2] for r in own), min(r[3] for r in own)
        ended = next((r[4] for r in own if len(r[0]) == depth), None)
        nodes.append([depth, least, nodes[up][1] if up >= 0 else parent, n, 0, 0, (n - 1) * own[0][1][depth - 1] if depth else 0, ended])
        above.append(up)
        return len(nodes) - 1

    stack = [(rows, depth, -1, True)]
    while stack:
        own, depth, up, is_node = stack.pop()
        if is_node:
            up = node(own, depth, up)
            while len(own) == 1 and len(own[0][0]) > depth:  # alone: the rest is a chain
                depth += 1
                up = node(own, depth, up)
            own = [r for r in own if len(r[0]) > depth]
        if own:
            pivot = own[len(own) // 2][0][depth]
            parts = [], [], []
            for r in own:
                t = r[0][depth]
                parts[(t > pivot) - (t < pivot) + 1].append(r)
            stack += [(part, depth, up, False) for part in (parts[0], parts[2]) if part]
            stack.append((parts[1], depth + 1, up, True))
    for i in range(len(nodes) - 1, -1, -1):  # children come after their parent
        x, up = nodes[i], above[i]
        x[5] = x[5] or 1
        if up >= 0:
            nodes[up][4] += 1
            nodes[up][5] += x[5]
            nodes[up][6] += x[6]
    return [list(c) for c in zip(*nodes)]


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket."""
    names = ("path", "depth", "parent", "ids", "sizes", "n", "least", "leaf")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
    for path, own in groupby(rows, key=lambda r: r[0]):
        own = list(own)
        columns = finish([r[3:] for r in own], own[0][1], own[0][2])
        size = len(columns[0])
        data = [[path] * size, [True] + [False] * (size - 1), *columns]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, _TYPES)], names=_NAMES)


def _common(a, b):
    """Number of turns with which both arrays start alike."""
    same = F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(b))), F.slice(b, F.lit(1), F.least(F.size(a), F.size(b))), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _chains(large: DataFrame) -> DataFrame:
    """path, depth, parent, to (the depth down to which a bucket's sequences agree), n, least, sizes (of the chain's turns), leaf
    (of the sequence that ends there)."""
    # the array before the first turn of the chain is the same in all rows, so whole arrays compare like their rests
    found = large.groupBy("path").agg(
        F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.sum("n").alias("n"), F.min("least").alias("least"), F.min(F.struct("ids", "sizes", "leaf")).alias("lo"), F.max("ids").alias("hi")
    )
    to = _common(F.col("lo.ids"), F.col("hi"))
    found = found.withColumn("to", to)
    leaf = F.when(F.size("lo.ids") == F.col("to"), F.col("lo.leaf"))
    return found.select("path", "depth", "parent", "to", "n", "least", F.slice("lo.sizes", F.greatest(F.col("depth"), F.lit(1)), F.col("to") - F.greatest(F.col("depth"), F.lit(1)) + 1).alias("sizes"), leaf.alias("leaf"))


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of chains."""
    names = ("path", "depth", "to", "n", "least", "parent", "sizes", "children", "leaves", "below", "leaf")
    for batch in batches:
        for path, depth, to, n, least, parent, sizes, children, leaves, below, leaf in zip(*(batch.column(c).to_pylist() for c in names)):
            saved, out = below, []
            sizes = ([] if depth else [0]) + sizes
            for d in range(to, depth - 1, -1):
                saved += (n - 1) * sizes[d - depth]
                out.append((path, d == depth, d, least, parent if d == depth else least, n, children if d == to else 1, leaves, saved, leaf if d == to else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], names=_NAMES)


def _above(path):
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i - 1))


def nodes(sequence: DataFrame) -> DataFrame:
    """NODE rows of the trie over (leaf, ids, sizes, n, least), all different."""
    live = sequence.select(F.slice("ids", 1, 0).alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), "ids", "sizes", "n", "least", "leaf")
    local, chains, children = [], [], []
    while True:
        counts = materialize(live.groupBy("path").agg(F.count("*").alias("rows"), F.sum(F.size("ids") - F.col("depth")).alias("cells")))
        if chains:
            children.append(counts.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")))
        large = counts.where((F.col("rows") > LOCAL) | (F.col("rows") > 1) & (F.col("cells") > CELLS)).select("path")
        if large.isEmpty():
            local.append(live)
            break
        local.append(live.join(large, "path", "left_anti"))
        heavy = live.join(large, "path", "left_semi")
        chains.append(materialize(_chains(heavy)))
        down = heavy.select("path", "ids", "sizes", "n", "least", "leaf").join(chains[-1].select("path", "to", F.col("least").alias("parent")), "path").where(F.size("ids") > F.col("to"))
        live = materialize(down.select(F.array_append("path", F.element_at("ids", F.col("to") + 1)).alias("path"), (F.col("to") + 1).alias("depth"), "parent", "ids", "sizes", "n", "least", "leaf"))
    rest = local[0]
    for more in local[1:]:
        rest = rest.unionByName(more)
    found = rest.repartition("path").sortWithinPartitions("path").mapInArrow(lambda b: _gathered(_finished(b)), NODE)
    if not chains:
        return found
    found, upper = materialize(found), chains[0]
    for more in chains[1:]:
        upper = upper.unionByName(more)
    own = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) * (F.col("n") - 1)
    given = found.where("top").select("path", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("below")).unionByName(upper.select("path", F.lit(0).cast("long").alias("leaves"), own.alias("below")))
    totals = given.where(F.size("path") > 0).select(F.explode(_above(F.col("path"))).alias("path"), "leaves", "below").groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("below").alias("below"))
    under = children[0]
    for more in children[1:]:
        under = under.unionByName(more)
    under = under.groupBy("path").agg(F.count("*").alias("children"))
    return upper.join(totals, "path").join(under, "path").mapInArrow(_unfolded, NODE).unionByName(found)


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    leaf = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    members = materialize(rebuilt(materialize(sequences(conversations))).withColumn("leaf", leaf))
    different = members.groupBy("leaf").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    found = materialize(nodes(materialize(different)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = found.where(F.col("leaf").isNotNull()).join(ends(members), "leaf")
    return ended.select(*columns, "ends_sha256").unionByName(found.where(F.col("leaf").isNull()).select(*columns, F.lit(EMPTY).alias("ends_sha256")))


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1))), 4294967295)"
ORACLE = f"""
WITH o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT *, ({_CRC.format("c")} % {HEAD})::INT AS h FROM o),
b AS (SELECT k.c, list_concat(coalesce(p.s, [])[1:k.h], k.s[k.h + 1:]) AS s FROM k LEFT JOIN o p ON p.c = k.c - k.c % {GROUP}),
x AS (SELECT c, len(s) AS size, unnest(range(0, len(s) + 1)) AS d, s FROM b),
n AS (SELECT d, s[1:d] AS p, min(c) AS c, count(*) AS n, list_sort(list(c) FILTER (size = d)) AS own, CASE WHEN d = 0 THEN 0 ELSE any_value(strlen(s[d].t)) END AS size FROM x GROUP BY d, s[1:d]),
up AS (SELECT n.*, n.p[1:n.d - 1] AS q FROM n),
kids AS (SELECT q AS p, count(*) AS k FROM up WHERE d > 0 GROUP BY q),
whole AS (SELECT n.d, n.p, n.n, n.size, coalesce(k, 0) AS k FROM n LEFT JOIN kids USING (p)),
under AS (SELECT p[1:j] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM whole) GROUP BY p[1:j])
SELECT up.c AS conv_id, up.d::BIGINT AS depth, CASE WHEN up.d > 0 THEN a.c END AS parent_conv_id, up.n AS n_convs, whole.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(array_to_string(up.own, ','), '')) AS ends_sha256
FROM up JOIN whole USING (p) JOIN under USING (p) LEFT JOIN n a ON a.p = up.q
"""
