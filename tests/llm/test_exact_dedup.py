import hashlib
import random
from collections import Counter, defaultdict

from readqc.llm.exact_dedup import dedup, heavy_hitters, mark
from readqc.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for t, ids in groups.items():
        low = [d for d in ids if d is not None]
        keep = max(low) if low else None
        first = True
        for d in ids:
            out.append((d, keep, len(ids), d == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and d != keep
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["hot", "hot", "warm é", f"t{r.randrange(60)}", "", None, " hot"])) for i in range(600)]
    rows += [(1000, "hot"), (1000, "hot"), (None, "hot"), (None, "lone"), (7, "x" * 300_000), (8, "x" * 300_000)]
    frame = spark.createDataFrame([(*x, 1, True) for x in rows], "doc_id long, text string, n int, kept boolean").repartition(6)
    for counters in (4, 1024):
        assert sorted(map(tuple, mark(frame, counters).collect()), key=str) == brute(rows)
        kept = [(x.doc_id, x.text or "") for x in dedup(frame, counters).collect()]
        want = [(d, s) for d, _, _, k, s in brute(rows) if k]
        assert sorted((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in kept if d is not None) == sorted(w for w in want if w[0] is not None)
        assert len(kept) == len(want)


def test_clashing_columns_are_carried(spark):
    names = ["_id", "_sha", "_n", "__id", "n", "kept", "keep_id", "digest", "text_sha256"]
    rows = [(i, f"t{i // 3}", *(f"{c}{i}" for c in names)) for i in range(30)] + [(29, "t9", *(f"{c}29" for c in names))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    got = dedup(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == sorted(x for x in set(rows) if x[0] % 3 == 2)


def test_summary_has_every_frequent_digest(spark):
    r = random.Random(1)
    values = [r.choice([b"a", b"b", *(str(r.random()).encode() for _ in range(4))]) for _ in range(3000)]
    frame = spark.createDataFrame([(i, bytearray(v), i) for i, v in enumerate(values)], "doc_id long, digest binary, row long").repartition(7)
    found = {bytes(x.digest): x.n for x in heavy_hitters(frame, 8).collect()}
    for v, n in Counter(values).items():
        if n > len(values) / 8:
            assert found[v] == n


def test_empty(spark):
    assert mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_which_row_stays_does_not_depend_on_partitions(spark):
    rows = [(i % 4, f"text {i % 4}", f"s{i % 3}", i % 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").withColumn("m", X.F.create_map(X.F.lit("k"), X.F.col("n")))
    found = [sorted(map(str, X.dedup(docs.repartition(n)).collect())) for n in (2, 3, 5, 7)]
    assert len(found[0]) == 4 and all(f == found[0] for f in found)
    assert "source='s0', n=0" in found[0][0]


def test_no_group_of_rows_is_sorted(spark, capsys):
    """A document that is repeated as a whole by most rows: one copy stays, and no window gathers the others."""
    rows = [(5, "same")] * 3000 + [(4, "same"), (None, "same")] + [(i, f"t{i}") for i in range(10, 40)] + [(70, "few")] * 9
    marked = mark(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, marked.collect()), key=str) == brute(rows)
    marked.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
