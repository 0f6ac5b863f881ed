import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from readqc.llm import mixing
from readqc.llm.mixing import find_alpha, mix, relative_entropy, repetitions, weights


def test_alpha():
    totals = {"a": 8000, "b": 1000, "c": 500, "z": 0}
    alpha = find_alpha(totals, repetition=3)
    assert math.isclose(max(repetitions(totals, alpha).values()), 3, rel_tol=1e-9)
    assert math.isclose(1 - alpha, math.log(3) / math.log(16), rel_tol=1e-9)
    alpha = find_alpha(totals, repetition=None, entropy=0.8)
    assert math.isclose(relative_entropy(totals, alpha), 0.8, rel_tol=1e-9)
    assert find_alpha(totals, repetition=1) == pytest.approx(1)
    assert find_alpha(totals, repetition=100) == 0
    assert find_alpha({"z": 0}) == 1.0 and math.isclose(sum(weights(totals, 0.3).values()), 1)


def size(text):
    return len((text or "").split())


def plain(rows, repetition, blocks, seed=7):
    """(doc_id, epoch, mix_order) of every row that is read: block permutations and cuts, one source at a time."""
    sources = defaultdict(lambda: defaultdict(list))
    for d, text, source, *_ in rows:
        m = hashlib.md5(f"{'null' if d is None else d}:{seed}".encode()).hexdigest()
        sources["n" if source is None else f"s{source}"][int(m[16:24], 16) % blocks].append((int(m[:15], 16), d, size(text)))
    totals = {s: sum(t for b in x.values() for *_, t in b) for s, x in sources.items()}
    top = max(totals.values())
    power = math.log(repetition) / math.log(top / min(n for n in totals.values() if n))  # 1 - alpha, in closed form
    out = []
    for s, own in sources.items():
        total = totals[s]
        reps = round(min((top / total) ** power, repetition), 9) if total else 1.0
        for epoch in range(1, math.ceil(reps) + 1):
            budget = total if epoch <= reps else (reps - math.floor(reps)) * total
            before = 0
            for b in sorted(own, key=lambda b: hashlib.md5(f"{s}:{b}:{epoch}:{seed}".encode()).hexdigest()):
                t = sum(x[2] for x in own[b])
                left = budget - before
                span = min(t, left) / max(total, 1.0) / reps
                for h, d, _ in own[b]:
                    if epoch <= reps or t <= left or (left > 0 and sum(x[2] for x in own[b] if x[0] <= h) <= left):
                        out.append((str(d), epoch, round((epoch - 1 + before / max(total, 1.0)) / reps + span * (h % 1_000_003) / 1_000_003, 7)))
                before += t
    return sorted(out)


CLASHING = ["epoch", "_kept", "_s", "_b", "_ks", "_kb", "_kh", "n_tokens", "mix_order", "s", "t", "_cut"]


@pytest.mark.parametrize(("max_sources", "max_plan"), [(100, 200_000), (2, 200_000), (100, 3)])
def test_mix(spark, monkeypatch, max_sources, max_plan):
    monkeypatch.setattr(mixing, "MAX_PLAN", max_plan)
    r = random.Random(8)
    rows = [(i, "w " * r.randrange(0, 30), r.choice(["hot"] * 6 + ["b", "c", None])) for i in range(1500)]
    rows += [(5000, None, "only empty"), (5001, "", "only empty"), (None, "x y", "b"), (7000, "q", "c"), (7000, "q", "c")]
    rows = [(*x, *(f"{c} {x[0]}" for c in CLASHING)) for x in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(5)
    result = mix(docs, repetition=2.5, blocks=16, max_sources=max_sources)
    assert result.columns == [*docs.columns, "_n_tokens", "_epoch", "_mix_order"]
    got = result.collect()
    for x in got:
        assert 0 <= x._mix_order <= 1 and x._n_tokens == size(x.text) and all(x[c] == f"{c} {x.doc_id}" for c in CLASHING)
    part = lambda rows: sorted((str(x.doc_id), x._epoch, round(x._mix_order, 7)) for x in rows)
    assert part(got) == plain(rows, 2.5, 16)
    totals, have = defaultdict(int), Counter()
    for _, t, s, *_ in rows:
        totals[s] += size(t)
    for x in got:
        have[x.source] += x._n_tokens
    want = repetitions(totals, find_alpha(totals, 2.5))
    for s, n in totals.items():
        assert want[s] * n - 30 <= have[s] <= want[s] * n + 1e-6
    assert part(mix(docs.repartition(3), repetition=2.5, blocks=16, max_sources=max_sources).collect()) == part(got)


def test_few_words_beside_many(spark):
    rows = [(i, "w " * 100, "big") for i in range(400)] + [(1000, "one", "tiny")]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), repetition=None, entropy=None)
    assert Counter(x.source for x in got.select("source").collect()) == {"big": 400, "tiny": 40_000}


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
