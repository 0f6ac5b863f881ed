import hashlib
import random

from pyspark.sql import functions as F

from readqc.llm import substring_dedup
from readqc.llm.substring_dedup import remove_repeats, repeated_spans


def brute(rows, k=20):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, []
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in texts:
        for i in range(len(words) - k + 1):
            at = (d is not None, d or 0, i)
            key = tuple(words[i : i + k])
            seen[key] = min(seen.get(key, at), at)
    for d, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if seen[tuple(words[i : i + k])] < (d is not None, d or 0, i):
                gone[i : i + k] = [True] * k
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    line = lambda m: [r.choice(vocabulary) for _ in range(m)]
    hot, mid = line(60), [line(25) for _ in range(4)]
    rows, earlier = [], []
    for d in range(n):
        words = line(r.randrange(0, 120))
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(0, len(words) + 1)
            words[at:at] = hot if r.random() < 0.5 else r.choice(mid)[r.randrange(0, 5) :]
        if earlier and r.random() < 0.3:
            words = list(r.choice(earlier))
            if words and r.random() < 0.6:
                words[r.randrange(len(words))] = "edit"
        if r.random() < 0.1:
            words += ["a"] * r.randrange(0, 70)
        earlier.append(words)
        rows.append((d * 3, r.choice([" ", "\n", "\t\v"]).join(words)))
    return rows


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        random.Random(seed).shuffle(rows)
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), with_text=False)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_long_repeat_is_one_path_to_its_source(spark):
    words = lambda name, n: [f"{name}{i}" for i in range(n)]
    shared = words("s", 100)
    rows = [(1, words("a", 30) + shared + words("b", 10)), (2, shared), (5, words("c", 7) + shared + words("d", 50) + shared[:40]), (9, words("e", 200))]
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").coalesce(1)
    got = repeated_spans(frame).select("doc_id", "start", "n", "src_doc", "src_start").collect()
    assert sorted(map(tuple, got)) == [(2, 0, 81, 1, 30), (5, 7, 81, 1, 30), (5, 157, 21, 1, 30)]


def test_words_are_verified_at_the_source(spark, monkeypatch):
    """A path whose words differ at its source fails; hashes that all collide never remove a word."""
    rows = corpus(7, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeated_spans(frame)
    keyed = substring_dedup._keyed(frame)
    assert found.count() > 5 and substring_dedup.all_verified(keyed, found, 20)
    wrong = found.withColumn("src_start", found.src_start + 1)
    assert not substring_dedup.all_verified(keyed, wrong, 20)
    tried, plain = [], substring_dedup.paths

    def once(spans):  # the first seed lies
        tried.append(1)
        return plain(spans).withColumn("start", F.col("start") + F.lit(int(len(tried) == 1)))

    monkeypatch.setattr(substring_dedup, "paths", once)
    got = remove_repeats(frame, with_text=False)
    assert len(tried) == 2 and sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_edges(spark):
    long = " ".join(f"v{i % 977}é" for i in range(30_000))
    rows = [(None, "a " * 50), (1, None), (2, ""), (3, "x y"), (4, "x y"), (5, "a " * 60), (6, long), (7, long), (7, long), (8, "  " + long)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, tag int, n string")
    got = remove_repeats(frame)
    assert sorted(map(tuple, got.drop("kept_text").collect()), key=str) == brute(rows)
    empty = remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0


def hot_anchor(n):
    """Documents around one rare passage of eight words, every one with neighbours of its own, some with a repeat."""
    hot = next(p for p in (" ".join(f"h{k}x{i}" for i in range(8)) for k in range(2000)) if substring_dedup.ngrams(substring_dedup.word_hashes([p.encode()])[0], 8)[0] < 2**54)
    rows = [(d, " ".join(f"a{d}w{i}" for i in range(14)) + f" {hot} " + " ".join(f"b{d}w{i}" for i in range(14))) for d in range(n)]
    return rows + [(n + d, f"start{d} " + rows[d * 7][1]) for d in range(n // 50)]


def test_a_hot_anchor_is_spread(spark, monkeypatch):
    from collections import Counter

    rows = hot_anchor(3000)
    batch = substring_dedup.pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}).to_batches()
    sent = Counter(k for out in substring_dedup._pieces(20, 0)(iter(batch)) for k in out.column("key").to_pylist())
    assert max(sent.values()) <= substring_dedup.NEIGHBOURS + 2
    monkeypatch.setattr(substring_dedup, "NEIGHBOURS", 10**9)
    sent = Counter(k for out in substring_dedup._pieces(20, 0)(iter(batch)) for k in out.column("key").to_pylist())
    assert max(sent.values()) >= 3000  # it would be one task's
    monkeypatch.undo()
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_few_neighbours_a_slice(spark, monkeypatch):
    """With hot anchors in some slices and not in others, results are the same."""
    for most in (1, 2):
        monkeypatch.setattr(substring_dedup, "NEIGHBOURS", most)
        rows = corpus(11 + most) + [(10_000 + d, t) for d, t in hot_anchor(40)]
        got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), with_text=False)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_document_that_is_repeated_as_a_whole_very_often(spark):
    text = " ".join(f"v{i % 700}" for i in range(1000))
    frame = spark.range(20_000).selectExpr("id * 0 + 3 AS doc_id", f"'{text}' AS text").repartition(4)
    one = brute([(3, text)])[0]
    got = remove_repeats(frame, with_text=False).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    assert [tuple(r) for r in got] == [(*one, 20_000)]
