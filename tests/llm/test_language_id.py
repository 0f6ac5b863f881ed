import math
import random
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from readqc.llm import language_id as L
from readqc.llm.language_id import identify, letter_vector, text_vectors, trigram_vectors, trigrams_of


def test_counts_and_vectors():
    trigrams, text, spot = trigrams_of(["Ab ab, é!", "", "12 .", "z"])
    have = Counter(("".join(map(chr, trigrams[s])), int(t)) for s, t in zip(spot, text))
    assert have == {(" ab", 0): 2, ("ab ", 0): 2, (" é ", 0): 1, (" z ", 3): 1}
    v = trigram_vectors(np.array([[97, 98, 99]], np.uint32))[0]
    assert np.array_equal(v, np.roll(letter_vector(97), 2) * np.roll(letter_vector(98), 1) * letter_vector(99))


def plain_vector(text):
    """Trigrams one by one."""
    total, out = 0, np.zeros(L.DIMENSIONS)
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        code = [32, *map(ord, word), 32]
        for a, b, c in zip(code, code[1:], code[2:]):
            out += np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
            total += 1
    return total, out


def test_prediction_against_a_plain_version(spark, monkeypatch):
    r = random.Random(4)
    word = {"aa": lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))), "bb": lambda: "".join(r.choice("defgçh") for _ in range(r.randrange(1, 7))), "cc": lambda: r.choice(["日本", "語の", "文"])}
    rows = [(i, ", ".join(word[lang]() for _ in range(r.randrange(1, 40))), lang, i % 3 == 0) for i in range(90) for lang in [r.choice(list(word))]]
    for piece, part in ((16_384, 500_000), (7, 20)):  # whole, and cut into small parts and products
        monkeypatch.setattr(L, "PIECE", piece)
        monkeypatch.setattr(L, "PART", part)
        total, vectors = text_vectors([t for _, t, *_ in rows])
        for (_, text, *_), n, v in zip(rows, total, vectors):
            want = plain_vector(text)
            assert n == want[0] and np.allclose(v, want[1], atol=1e-2)
    sums = {lang: sum(v / n for _, t, own, held in rows if own == lang and not held for n, v in [plain_vector(t)]) for lang in word}
    unit = lambda v: v / np.linalg.norm(v)
    prototypes = {k: unit(v) for k, v in sums.items()}
    mean = sum(prototypes.values()) / len(prototypes)
    got = {x.doc_id: x for x in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, held boolean").repartition(3), F.col("held")).collect()}
    for d, text, *_ in rows:
        cosine = {k: unit(unit(plain_vector(text)[1]) - mean) @ unit(p - mean) for k, p in prototypes.items()}
        best = max(cosine, key=cosine.get)
        assert got[d].lang_pred == best
        assert math.isclose(got[d].score, 1 / sum(math.exp(L.SHARPNESS * (c - cosine[best])) for c in cosine.values()), abs_tol=1e-3)


def test_memory_does_not_follow_the_trigrams():
    """A text of 20 MB with some 500,000 different trigrams, and the same letters without any blank."""
    r = np.random.default_rng(1)
    letters = "".join(map(chr, r.integers(0x4E00, 0x6E00, 500_000)))
    for text in (" ".join(letters[i : i + 9] for i in range(0, len(letters), 9)) + " ab" * 6_000_000, letters + letters[:9]):
        tracemalloc.start()
        total, vectors = text_vectors([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total[0] > 400_000 and peak < 400_000_000


def test_held_out_accuracy(spark):
    r = random.Random(6)
    syllables = {"xx": ["ba", "lo", "ti", "qué"], "yy": ["sch", "ung", "ä", "ba"], "zz": ["привет", "до", "ба", "ти"]}
    rows = []
    for i in range(600):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang, i % 4 == 2))
    rows += [(900, None, "xx", True), (901, "123 %%", "xx", True), (902, "", None, False), (903, "bati " * 100_000, None, True), (None, "schung", "yy", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score boolean")
    got = {x.doc_id: x for x in identify(frame, F.coalesce("score", F.lit(False))).collect()}
    held = [(d, lang) for d, _, lang, h in rows[:600] if h]
    assert sum(got[d].lang_pred == lang for d, lang in held) > 0.97 * len(held)
    assert (got[900].lang_pred, got[901].lang_pred, got[902].lang_pred, got[903].lang_pred) == ("und", "und", "und", "xx")
    assert all(0 <= x.score <= 1 for x in got.values()) and len(got) == len(rows)


def test_empty_and_nothing_learned(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(frame, F.lit(False)).count() == 0
    one = spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string")
    assert identify(one, F.lit(True)).first().lang_pred == "und"


def test_cuts_lose_no_trigram(monkeypatch):
    """Runs without a blank, cut anywhere, have the vectors of whole texts."""
    texts = ["".join(chr(0x4E00 + i * i % 97) for i in range(1_000)), "ab, cdé" * 100, "x" * 999, "a b" * 50 + "longrunwithoutblanks" * 30, "...---..." * 40 + "éa"]
    whole = L.text_vectors(texts)
    for part in (7, 50, 333):
        monkeypatch.setattr(L, "PART", part)
        total, vectors = L.text_vectors(texts)
        assert (total == whole[0]).all() and (vectors == whole[1]).all()


def test_long_run_of_another_script():
    text = "".join(chr(0x4E00 + i * 7919 % 5_000) for i in range(1_200_000))
    total, _ = L.text_vectors([text])
    assert len(L.cut(text)) > 3 and total[0] == 1_200_000
