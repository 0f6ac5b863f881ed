import itertools
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from readqc.llm import toxicity as T

BAD = ["idiot", "scum", "worthless"]
GOOD = [a + b for a in ["ta", "ren", "mo", "sil", "er"] for b in ["do", "nes", "ti", "lun", "ga"]]


def rows(seed, n=500):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice(GOOD) for _ in range(r.randrange(5, 40))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


def brute_decode(token, model):
    best = None
    for path in itertools.product(*T.lattice(token), [((0,), 0.0)]):
        cost, state = 0.0, (0, 0, 0)
        out = ""
        for letters, extra in path:
            cost += extra
            for x in letters:
                if x or any(state):
                    cost -= float(model[(*state, x)])
                    out += chr(96 + x) if x else " "
                state = (*state[1:], x) if x else (0, 0, 0)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, out.strip())
    return best


def test_viterbi_finds_the_best_path(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows(1)], "doc_id long, text string")
    model = T.character_model(docs)
    assert np.allclose(np.exp(model.astype(float)).sum(axis=-1), 1, atol=1e-4)
    decode = T.Decoder(model)
    for token in ["1d10t", "i.d.i.o.t", "$cum", "iiidiot", "w0rthle55", "s c u m", "r3n_do", "12", "x", "id-iot", "tado-renes"]:
        cost, want = brute_decode(token, model)
        same = want.split() == T._WORD.findall(token)
        assert decode(token) == (token if same or cost + T.GAIN >= decode._as_it_is(token) else want)
    text = "Ta 1D10T and $cum! i d i o t, w0rthless iiiidiot 12."
    assert T.restore(text, decode) == "ta idiot and scum! idiot, worthless idiot 12."
    assert T.restored_words(text, decode) == "ta idiot and scum idiot worthless idiot".split()


PLAIN = {
    "en": "A well-known state-of-the-art letter (e.g. the U.S.A. of 1990) costs $5 at 12:30; see john.doe@example.com, covid19 or http://example.org/a_b?c=1 !!",
    "fr": "C'est l'après-midi, à l'arrière-plan : « la porte-monnaie » coûte 3,50 € — n'est-ce pas ?",
    "de": "Die Straßen-Bahn fährt z.B. um 8:15 Uhr; Müller & Söhne (GmbH) zahlen 10% mehr, d.h. 3 x 4 = 12 Euro.",
    "es": "El niño-feliz cuesta 20€, ¿no? Sí: años 1990-95, p.ej. ciudad-real y ¡qué más da!",
    "ru": "Жук-носорог по-русски, т.е. 5-й этаж: «какой-то» ёлка... 12:30",
}


def test_plain_text_comes_back_unchanged(spark):
    """Texts of four languages, and Cyrillic, which the model has not seen, keep every character."""
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(list(PLAIN.values())[:4] * 3 + BAD + GOOD)], "doc_id long, text string")
    letters = T.alphabet(docs)
    decode = T.Decoder(T.character_model(docs, letters), letters)
    for text in [*PLAIN.values(), "  blanks \t stay\n\n as they are ", "日本語 テキスト-です", "🙂 3 x 4 = 12", "İstanbul'da"]:
        assert T.restore(text, decode) == text.lower()


def test_lexicon_and_score_against_a_plain_version(spark):
    data = rows(5, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in data], "doc_id long, toxic int")
    model = T.character_model(docs)
    shared = spark.sparkContext.broadcast((model, T.ASCII))
    learned = T.learn(docs, labels, shared)
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).collect()}
    decode = T.Decoder(model)

    def lexicon(part):
        met = {}
        for i, t, x in data:
            if part in (None, half[i]):
                words = ["", *T._WORD.findall(T.restore(t, decode)), ""]
                for a, w, b in zip(words, words[1:], words[2:]):
                    met[w, a, b] = max(x, met.get((w, a, b), 0))
        counts = {}
        for (w, *_), x in met.items():
            for entry in {w + " ", *(w[:n] for n in T.STEMS if n <= len(w))}:
                n = counts.setdefault(entry, [0, 0])
                n[x] += 1
        all0, all1 = (sum(x == y for x in met.values()) for y in (0, 1))
        share, out = all1 / (all0 + all1), {}
        for entry, (n0, n1) in counts.items():
            ratio = sum(n * math.log(n / (n0 + n1) / p) for n, p in ((n1, share), (n0, 1 - share)) if n)
            odds = math.log((n1 + 0.5) / (all1 + 1) / ((n0 + 0.5) / (all0 + 1))) - 2 * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))
            if n1 / (n0 + n1) > share and ratio > T.EVIDENCE and odds > T.LEAST_ODDS:
                out[entry] = odds
        return out

    def evidence(text, entries):
        return sum(max([0.0] + [x for e, x in entries.items() if e == w + " " or (e[-1] != " " and w.startswith(e))]) for w in set(T._WORD.findall(T.restore(text, decode))))

    whole, halves = lexicon(None), [lexicon(0), lexicon(1)]
    assert set(learned["words"]) == set(whole) and {b + " " for b in BAD} <= set(whole)
    assert all(math.isclose(learned["words"][w], whole[w], rel_tol=1e-9) for w in whole)
    found = Counter()
    for i, t, x in data:
        found[round(evidence(t, halves[1 - half[i]]), 1), x] += 1
    at = sorted({x for x, _ in found})
    slope, intercept = T.fit(at, [found[x, 0] + found[x, 1] for x in at], [found[x, 1] for x in at])
    assert math.isclose(slope, learned["slope"], rel_tol=1e-6) and math.isclose(intercept, learned["intercept"], rel_tol=1e-6)
    got = {r.doc_id: r.score for r in T.score(docs, labels, F.lit(False)).collect()}
    for i, t, _ in data:
        assert math.isclose(got[i], 1 / (1 + math.exp(-(slope * evidence(t, whole) + intercept))), rel_tol=1e-6)


def test_held_out_and_disguised(spark):
    data = rows(2)
    extra = [(1000, "tado 1d10t renes s c u m motí", None), (1001, None, None), (1002, "", None), (1003, "tado renes " * 50_000, None), (1004, "a a a a a a a $$$ 12:30 \n", None), (1003, "tado", None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data + extra] + [(None, "tado", "x")], "doc_id long, text string, score string").repartition(5)
    labels = spark.createDataFrame([(i, x) for i, _, x in data] + [(7, None), (None, 1), (88888, 1)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = T.score(docs, labels, held).collect()
    assert len(got) == docs.count() and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    by = {x.doc_id: x for x in got}
    wrong = [i for i, _, x in data if by[i].held_out and by[i].predicted != x]
    assert not wrong and sum(x.held_out for x in got) > 60
    assert by[1000].predicted == 1 and not any(by[i].predicted for i in (1001, 1002, 1003, 1004, None))


def test_disguises_in_four_languages(spark):
    plain = {"en": "idiot scum worthless letter", "fr": "débile crétin façade", "de": "dämlich blödmann größe", "es": "estúpido cabrón niño"}
    docs = spark.createDataFrame([(i, f"{t} {g}") for i, (t, g) in enumerate((t, g) for t in plain.values() for g in GOOD)] + [(999, "жук")], "doc_id long, text string")
    letters = T.alphabet(docs)
    assert letters == T.ASCII + "".join(sorted("éçäößúóñжук"))
    model = T.character_model(docs, letters)
    decode = T.Decoder(model, letters)
    cases = {
        "estúp1do": "estúpido", "cabr0n": "cabrón", "d.é.b.i.l.e": "débile", "cré7in": "crétin", "däml1ch": "dämlich", "gröööße": "größe", "e s t ú p i d o": "estúpido",
        "iidiot": "idiot", "sccum": "scum", "estúúpido": "estúpido", "blödmmann": "blödmann", "letter": "letter", "worthless": "worthless",
        "s**m": "scum", "est**ido": "estúpido", "d*b*le": "débile", "id***t": "idiot", "**scum**": "**scum**", "letter***": "letter***",
        "i  d \t i\u00a0o   t": "idiot", "d  é  b  i  l  e": "débile", "idi0t": "idiot",
    }
    assert {x: T.restore(x, decode) for x in cases} == cases
    for token in ["s**m", "d*b*le", "i*d*i*o*t", "*x*", "a**"]:  # both ways of searching
        positions = [*T.lattice(token, decode.letters), [((0,), 0.0)]]
        assert decode._wide(positions) == decode._narrow(positions)
    rare = T.Decoder(T.character_model(docs), T.ASCII)  # letters without a number of their own stay as they are
    assert T.restore("estúp1do déébile ж.у.к", rare).split()[0] == "estúpido"


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(spark.createDataFrame([], "doc_id long, text string"), none, F.lit(False)).count() == 0
    assert T.score(spark.createDataFrame([(1, "idiot")], "doc_id long, text string"), none, F.lit(False)).first().predicted == 0


def test_the_curve_follows_the_base_rate():
    """Without evidence a score is the share of toxic rows, however high; strong evidence is used as it is."""
    for toxic in (1, 5, 9):
        slope, intercept = T.fit([0.0], [1_000], [100 * toxic])
        assert abs(1 / (1 + math.exp(-intercept)) - toxic / 10) < 0.01
    slope, intercept = T.fit([0.0, 3.0, 5_000.0], [900, 50, 50], [9, 40, 50])
    assert slope > 0 and intercept < -3 and slope * 5_000 + intercept > 10
