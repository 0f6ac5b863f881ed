import random

import numpy as np
import pyarrow as pa
import pytest

from readqc.llm import ngram_join
from readqc.llm.components import components, roots
from readqc.llm.ngram_join import dedup, link


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = low.encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y:
                common = len(x & y)
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed, n=160, long=False):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    hot = [word() for _ in range(60)]
    rows, texts = [], []
    for d in range(n):
        words = [word() for _ in range(r.choice([1, 3, 6, 20, 60, 120, 700 if long else 150]))]
        if r.random() < 0.3:
            words += hot
        if texts and r.random() < 0.6:
            words = list(r.choice(texts[-25:]))
            for _ in range(int(len(words) * r.choice([0, 0.01, 0.02, 0.04, 0.06]))):
                words[r.randrange(len(words))] = word()
            if r.random() < 0.2:
                words = words[: max(1, int(len(words) * r.choice([0.7, 0.76, 0.8, 0.9])))]
        texts.append(words)
        text = " ".join(words)
        rows.append((d * 2 + 1, text.upper() if r.random() < 0.1 else text))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_tokens", [750_000, 400])
def test_against_brute_force(spark, chunk_tokens):
    for seed in (1, 2):
        rows = corpus(seed, long=seed == 2)
        got = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), chunk_tokens)
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_one_group_in_many_chunks(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(120):
        words = list(base)
        words[r.randrange(100)] = f"x{d}"
        if d % 10 == 0:
            words[40:62] = [f"y{d}.{i}" for i in range(22)]
        rows.append((d, " ".join(words)))
    got = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 900)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_broadcast_bound_counts_the_broadcast_rows(spark, monkeypatch):
    """The list that holds the chunks against each other has a row for each block and chunk, not for each document."""
    r = random.Random(9)
    rows = []
    for d in range(120):
        words = [f"b{i}" for i in range(100)]
        words[r.randrange(100)] = f"x{d}"
        if d % 10 == 0:
            words[40:52] = [f"y{d // 20}.{i}" for i in range(12)]
        rows.append((d, " ".join(words)))
    seen, texts_of = [], ngram_join._texts_of

    def watched(docs, members, n):
        out = texts_of(docs, members, n)
        seen.append((members.count(), n, "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(ngram_join, "_texts_of", watched)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 200)
    got = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 900)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert [(n, broadcast) for _, n, broadcast in seen] == [(m, m <= 200) for m, *_ in seen]
    assert seen[0][0] <= 200 < seen[-1][0]


def test_long_documents_around_the_limit(spark, monkeypatch):
    """Pairs of 300 to 2000 shingles with a Jaccard index next to 0.75, one passage in all, lists never broadcast."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "COUNTERS", 40)
    r = random.Random(11)
    hot = [f"h{i}" for i in range(30)]
    rows = []
    for d in range(0, 60, 2):
        n = r.randrange(300, 2000)
        words = [f"w{d}.{i}" for i in range(n)]
        other = int((n + 34) / 7) + r.randrange(-2, 3)  # so many shingles of either differ at 0.75
        rows += [(d, " ".join(hot + words)), (d + 1, " ".join(hot + words[: n - other] + [f"x{d}.{i}" for i in range(other)]))]
    want = brute(rows)
    assert 5 < sum(c % 2 == 0 and c != d for d, _, c in want) < 25
    assert sorted(map(tuple, link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())) == want


def test_kept_tokens_hold_what_links_share():
    """Of any two sets that link, least_shared() common tokens are kept on both sides, the smallest that may be."""
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 500))
        pool = np.unique(r.integers(0, 2**63, 2 * n + 200, dtype=np.uint64))
        r.shuffle(pool)
        m = int(r.integers(max(1, -(-3 * n // 4)), 4 * n // 3 + 1))
        common = -(-75 * (n + m) // 175)
        if common > min(n, m):
            continue
        x, y = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n : n + m - common])))
        both = np.intersect1d(x[: ngram_join.kept(n)], y[: ngram_join.kept(m)])
        assert len(both) >= ngram_join.least_shared(np.array([n, m]), False).max()


def packed_entries(docs, parts, heavy):
    tokens = [np.sort(np.array(t, np.uint64)).tobytes() for t in docs]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(docs)), pa.int64()), "n": pa.array([len(t) for t in docs], pa.int32()), "tokens": pa.array(tokens, pa.binary())})
    value = type("B", (), {"value": heavy})
    return list(ngram_join._entries(parts, value)(iter([batch])))


def test_a_token_of_all_documents_is_spread(spark):
    """One shingle in every document: no bucket holds its entries, and the counts that all documents see agree."""
    docs = [[7 << 24, (1000 + d) << 24] for d in range(4000)]
    frame = spark.createDataFrame([(d, 2, bytearray(np.array(t, np.uint64).tobytes())) for d, t in enumerate(docs)], "doc_id long, n int, tokens binary").repartition(4)
    token, count = ngram_join.heavy_tokens(frame, 8000)
    assert token.tolist() == [7 << 24] and 3900 < count[0] <= 4000
    for heavy, most in (((token, count), 600), ((token[:0], count[:0]), 4400)):
        sizes = {}
        for batch in packed_entries(docs, 16, heavy):
            for bucket, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sizes[bucket] = sizes.get(bucket, 0) + len(blob) // (24 if kind else 20)
        assert sum(sizes.values()) == 8000 and max(sizes.values()) <= most
        assert heavy[0].size or max(sizes.values()) > 4000


def test_a_common_passage_alone_holds_no_group_together(spark):
    """Documents of 160 shingles that share 104: the kept tokens let them pass, whole sets don't."""
    passage = [f"p{i}" for i in range(108)]
    rows = [(d, " ".join(passage + [f"o{d}.{i}" for i in range(56)])) for d in range(40)] + [(100 + d, " ".join(passage + [f"same{i}" for i in range(56 - d)])) for d in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = frame.repartition(2)
    seen, members = [], ngram_join._members

    def watched(*x):
        out = members(*x)
        seen.append(out.count())
        return out

    ngram_join._members = watched
    try:
        got = sorted(map(tuple, link(keyed, 900).collect()))
    finally:
        ngram_join._members = members
    assert got == brute(rows) and seen[0] > 35 and seen[1] == 3


def test_dedup_carries_clashing_columns(spark):
    names = ["_id", "__id", "_kept", "g", "root", "component_id", "n"]
    rows = [(d, f"{'a b c d e f g' if d < 4 else f'x{d} y z'}", *(f"{c}{d}" for c in names)) for d in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = dedup(frame)
    assert got.columns == frame.columns and sorted(map(tuple, got.collect())) == [rows[0], *rows[4:]]


def test_edges(spark):
    long = " ".join(f"v{i}é" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, long), (9, long + " end"), (10, "a " * 500), (11, "a " * 900), (None, "lone one")]
    frame = spark.createDataFrame([(*x, 1, "f", 2) for x in rows], "doc_id long, text string, n int, first string, g int").repartition(5)
    got = sorted(((d if d is not None else -1, n, c) for d, n, c in map(tuple, link(frame).collect())))
    assert got == [(-1, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 19996, 8), (9, 19997, 8), (10, 1, 10), (11, 1, 10)]
    kept = dedup(frame)
    assert kept.columns == frame.columns and sorted((x.doc_id or -1) for x in kept.collect()) == [-1, 1, 2, 3, 4, 6, 8, 10]
    assert link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(1000, 500 + i) for i in range(50)]
    parent = roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), 1001)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(9)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert {(v, x) for v, x in map(tuple, components(frame.where("a != b")).collect())} == {(v, int(parent[v])) for v in nodes}


def test_a_bucket_streams_what_is_common(monkeypatch):
    """Counts (up to COMMON) do not depend on how a bucket's rows come, and only rare tokens are held."""
    monkeypatch.setattr(ngram_join, "HELD", 300)
    monkeypatch.setattr(ngram_join, "COMMON", 20)
    r = random.Random(4)
    docs = [[(5 << 24) if d % 2 else (9 << 24), *((100 + r.randrange(400)) << 24 for _ in range(2))] for d in range(900)]
    docs = [sorted(set(t)) for t in docs]
    df = {}
    for t in docs:
        for x in t:
            df[x] = df.get(x, 0) + 1
    want = sorted((x, d, len(t), min(df[x], 20)) for d, t in enumerate(docs) for x in t if df[x] > 1)
    monkeypatch.setattr(ngram_join, "BATCH_TOKENS", 100)
    none = np.empty(0, np.uint64), np.empty(0, np.int32)
    rows = [x for batch in packed_entries_of_each(docs, none) for x in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        parts = {b: [x for x in rows if x[0] == b] for b in range(4)}
        streamed, found = [], []
        order = [x for b in parts for x in parts[b]]  # several buckets in one partition
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*order[i : i + 7]), (pa.int32(), pa.int8(), pa.binary()))], names=["bucket", "kind", "blob"]) for i in range(0, len(order), 7)]
        for out in ngram_join._shared(4)(iter(batches)):
            token, doc, n, count = ngram_join._gathered(iter([out]), ngram_join.COUNTED)
            found += list(zip(token.tolist(), doc.tolist(), n.tolist(), count.tolist()))
            streamed.append(int((count == 20).sum()))
        assert sorted(found) == want
        assert sum(x > 0 for x in streamed) >= 3 and max(streamed) < sum(streamed) and streamed[-1] == 0


def packed_entries_of_each(docs, heavy):
    value = type("B", (), {"value": heavy})
    tokens = [np.array(t, np.uint64).tobytes() for t in docs]
    for a in range(0, len(docs), 30):
        part = slice(a, a + 30)
        ids = list(range(len(docs)))[part]
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(t) for t in docs[part]], pa.int32()), "tokens": pa.array(tokens[part], pa.binary())})
        yield from ngram_join._entries(4, value)(iter([batch]))


def test_buckets_beyond_the_partitions(spark, monkeypatch):
    """More buckets than partitions, hardly any counters and a low COMMON change no result."""
    for name, value in {"PART_TOKENS": 100, "MAX_PARTS": 5, "COUNTERS": 8, "MAX_COUNTERS": 8, "HELD": 200, "COMMON": 6}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(5, 120)
    got = link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 600)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_the_broadcast_does_not_follow_the_corpus(spark):
    """However many entries there are, fewer than MAX_COUNTERS tokens are heavy."""
    tokens = np.arange(1, 3001, dtype=np.uint64) << np.uint64(24)
    frame = spark.createDataFrame([(d, 3000, bytearray(tokens.tobytes())) for d in range(4)], "doc_id long, n int, tokens binary").repartition(2)
    asked, summary = [], ngram_join._summary

    def watched(k):
        asked.append(k)
        return summary(k)

    ngram_join._summary = watched
    try:
        for total in (12_000, 10**9, 10**12, 10**16):
            ngram_join.heavy_tokens(frame, total)
    finally:
        ngram_join._summary = summary
    assert asked == [1_024, 1_024, 65_536, 65_536]
