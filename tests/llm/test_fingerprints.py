import hashlib
import random

import numpy as np
import xxhash

from readqc.llm.fingerprints import compare_with_next, edited, fingerprint, likeness, sketches


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


MASK = 2**64 - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_sketch(text):
    """One hash of each shingle; its top nine bits are the bin, the least rest stays; empty bins ask others in turn."""
    words = [xxhash.xxh3_64_intdigest(w) for w in text.split()]
    if not words:
        return [255] * 512
    size = min(5, len(words))
    bins = {}
    for i in range(len(words) - size + 1):
        h = 0
        for w in words[i : i + size]:
            h = (h * 0x9E3779B97F4A7C15 + w) & MASK
        h = plain_mix(h)
        bins[h >> 55] = min(bins.get(h >> 55, MASK), h & 2**55 - 1)
    out = []
    for b in range(512):
        tries, at = 0, b
        while at not in bins:
            tries += 1
            at = plain_mix(b * 2_654_435_761 + tries) >> 55
        out.append(bins[at] & 15)
    return out


def test_sketches_entry_by_entry():
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(60)}é" for _ in range(n)).encode() for n in (0, 1, 3, 4, 5, 6, 20, 80, 900, 4000)] + [b"  \t", b"a a a a a a a a"]
    got = sketches(texts)
    for text, s in zip(texts, got):
        assert s.tolist() == plain_sketch(text)
    for i, a in enumerate(got):  # likeness is the corrected share of equal entries
        for j, b in enumerate(got):
            same = (sum(x == y for x, y in zip(a, b)) / 512 - 1 / 16) / (15 / 16)
            none = [not t.split() for t in (texts[i], texts[j])]
            want = 1.0 if all(none) else 0.0 if any(none) else min(max(same, 0.0), 1.0)
            assert abs(likeness(got[i : i + 1], got[j : j + 1])[0] - want) < 1e-12


def test_likeness_follows_jaccard():
    r = random.Random(1)
    errors = []
    for n in (3, 12, 60, 400, 3000):
        for keep in (0.0, 0.5, 0.8, 0.95, 1.0):
            for _ in range(6):
                a = [f"w{r.randrange(10**6)}" for _ in range(n)]
                b = a[: int(n * keep)] + [f"w{r.randrange(10**6)}" for _ in range(n - int(n * keep))]
                s = sketches([" ".join(a).encode(), " ".join(b).encode()])
                got = likeness(s[:1], s[1:])[0]
                errors.append((got - jaccard(" ".join(a), " ".join(b))) / (0.25 if n < 60 else 0.08))
                assert keep < 1 or got == 1
    errors = np.array(errors)
    assert abs(errors).max() < 1.5 and abs(errors.mean()) < 0.1


def test_compare(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["é", "a", "bb", "🙂c"]) + str(r.randrange(50)) for _ in range(r.randrange(0, 80))) for _ in range(150)]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, "x " * 200_000), (None, "none"), (3000, "   "), (3001, "tail ends"), (3002, texts[5])]
    frame = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, copy boolean").repartition(7)
    got = {x.doc_id: x for x in compare_with_next(frame).collect()}
    rows.sort(key=lambda x: (x[0] is not None, x[0]))
    assert len(got) == len(rows)
    prints = {x.doc_id: x.fingerprint for x in fingerprint(frame).collect()}
    for (d, t), (e, u) in zip(rows, rows[1:] + rows[:1]):
        t, u, x = t or "", u or "", got[d]
        changed = edited(t, u)
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(x.near_edited - jaccard(t, changed)) < 0.4 and abs(x.near_next - jaccard(t, u)) < 0.4
        assert x.fingerprint == prints[d] and len(x.fingerprint) == (512 if t.split() else 0)
        assert (x.near_next == 1) or x.fingerprint != got[e].fingerprint
    assert got[3002].fingerprint == got[35].fingerprint


def test_ties_single_and_empty(spark):
    assert compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = compare_with_next(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one[0].near_next == 1
    tied = spark.createDataFrame([(1, "same one")] * 3 + [(1, "other"), (2, "z")], "doc_id long, text string").repartition(4)
    first, again = (sorted(map(tuple, compare_with_next(f).collect())) for f in (tied, tied.repartition(2)))
    assert len(first) == 5 and first == again
