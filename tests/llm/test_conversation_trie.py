import hashlib
import random
import zlib

import pytest

from readqc.llm import conversation_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def plain(rows: list) -> set:
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    whole = {c: tuple(own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :]) for c in own}
    members: dict = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = set()
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in ids if len(whole[c]) == len(p))))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), sum(len(q) == len(p) + 1 for q in under), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows: list, parts: int = 3) -> list:
    return [tuple(r) for r in T.trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)).collect()]


def made(seed: int, n: int, longest: int) -> list:
    r = random.Random(seed)
    says = ["a", "b", "é", "", None, "long text"]
    return [(c, t, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(says[: r.choice([1, 2, 6])])) for c in range(n) if r.random() < 0.9 for t in range(r.randint(1, longest))]


@pytest.mark.parametrize("seed, local, cells", [(1, 4_096, 1_000_000), (2, 3, 1_000_000), (3, 1, 1_000_000), (4, 4_096, 5)])
def test_against_plain(spark, monkeypatch, seed, local, cells):
    monkeypatch.setattr(T, "LOCAL", local)
    monkeypatch.setattr(T, "CELLS", cells)
    monkeypatch.setattr(T, "PIECE", 3)
    rows = made(seed, 40, 12)
    found = run(spark, rows)
    assert len(found) == len(set(found)) and set(found) == plain(rows)


def test_nulls_ties_and_repeats(spark):
    rows = [(5, None, "user", "first"), (5, 1, None, None), (5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "x"), (None, 1, "user", "lost"), (6, 2, "user", "x"), (7, None, None, None)]
    assert set(run(spark, rows)) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(T, "LOCAL", 8)
    monkeypatch.setattr(T, "PIECE", 16)
    rows = [(c, t, "user", "same") for c in range(0, 1_000, 5) for t in range(3)] + [(1, t, "user", f"turn {t}") for t in range(3_000)]
    found = run(spark, rows)
    root = next(r for r in found if r[1] == 0)
    assert root[:4] == (0, 0, None, 201) and len(found) == len(set(found))
    assert max(r[1] for r in found) == zlib.crc32(b"1") % 9 * 0 + 3_000 - max(0, zlib.crc32(b"1") % 9 - 3)
    same = next(r for r in found if r[1] == 3 and r[0] == 0)
    assert same[3] >= 200 and same[7] == hashlib.sha256(",".join(str(c) for c in range(0, 1_000, 5)).encode()).hexdigest()


def test_quicksort_of_deep_sequences():
    long = [(list(range(50_000)), [1] * 50_000, 1, 2, b"x"), (list(range(49_999)) + [7, 8], [1] * 50_001, 2, 1, b"y")]
    depth, least, parent, n, children, leaves, saved, _ = T.finish(long, 0, None)
    assert len(depth) == 50_000 + 3 and leaves[0] == 2 and max(children) == 2 and saved[0] == 2 * 49_999 + 2


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in docs.select("conv_id", "turn", "role", "text").collect()]
    from readqc.llm.queries import QUERIES

    assert {tuple(r) for r in QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.001").collect()} == plain(rows)
