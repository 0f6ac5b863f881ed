"""Operator 6: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from a hash of the letter, so all workers agree). A trigram
is bound by multiplying its letters' vectors, each rotated by its place; a text's vector bundles (adds) its
trigrams. A language's prototype is the bundle of its training texts, each with weight one. The mean of the
prototypes, which only says "text", is taken off, and a text goes to the prototype with the largest cosine.

Learning is one pass that adds up each task's partial prototypes: languages x dimensions numbers, whatever
the input. Prediction is map-only with the prototypes broadcast (the same size).

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text when
nothing was learned; null languages are not learned; words are runs of letters, lower-cased, with a blank on
either side; runs of PART characters without a blank are cut, and so are their trigrams there; repeated rows are predicted each; extra columns are ignored. score is the softmax share of the
chosen language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.llm.words import slices

#: Size of the vectors, and the sharpness of the scores.
DIMENSIONS, SHARPNESS = 512, 20.0
#: Trigrams of one matrix product, and characters of a text that are taken at once.
PIECE, PART = 16_384, 500_000

_letters: dict = {}
_alpha: dict = {}


def letter_vector(code: int) -> np.ndarray:
    if code not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        words = [xxhash.xxh64_intdigest(code.to_bytes(4, "little"), seed=i) for i in range(DIMENSIONS // 64)]
        _letters[code] = (np.unpackbits(np.array(words, np.uint64).view(np.uint8)).astype(np.int8) * 2 - 1).astype(np.float32)
    return _letters[code]


def _is_letter(code: int) -> bool:
    if code not in _alpha:
        _alpha[code] = chr(code).isalpha()
    return _alpha[code]


def trigrams_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams (three letter codes each, 32: blank) and, for each that occurs, its text and its place among these."""
    lowered = [t.lower() for t in texts]
    joined = np.frombuffer("".join(f"\0{t}\0" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(joined):
        return np.empty((0, 3), np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    used = np.flatnonzero(np.bincount(joined, minlength=1))  # code points, so at most 0x110000
    place = np.zeros(int(used[-1]) + 1, np.int32)
    place[used] = np.arange(len(used))
    seen = used.astype(np.uint32)
    letter = np.array([c not in (0, 32) and _is_letter(int(c)) for c in seen])
    small = np.zeros(len(seen), np.int64)
    alphabet = np.concatenate(([32], seen[letter]))
    small[letter] = np.arange(1, len(alphabet))
    x = small[place[joined]]
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lowered])
    keep = np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0) | (text[1:] != text[:-1])))  # one blank of each run
    x, text = x[keep], text[keep]
    size = len(alphabet)
    t = (x[:-2] * size + x[1:-1]) * size + x[2:]
    ok = (x[1:-1] != 0) & (text[:-2] == text[2:])
    t, text = t[ok], text[1:-1][ok]
    if size**3 <= 4_000_000:  # cheaper than sorting
        used = np.flatnonzero(np.bincount(t, minlength=1))
        spot = np.zeros((int(used[-1]) if len(used) else 0) + 1, np.int64)
        spot[used] = np.arange(len(used))
        spot = spot[t] if len(t) else t
    else:
        used, spot = np.unique(t, return_inverse=True)
    trigrams = alphabet[np.stack((used // size**2, used // size % size, used % size), axis=1)] if len(used) else np.empty((0, 3), np.uint32)
    return trigrams, text, spot


def cut(text: str) -> list[tuple[str, int]]:
    """(piece, sign): pieces of at most PART characters whose signed trigrams are those of the text. Cut behind a blank nothing is
    lost. Inside a run without one, both pieces hold the two characters around the cut; what that adds (the edges of words where
    there are none) are just the trigrams of these two characters alone, which are taken off again."""
    out, a = [], 0
    while len(text) - a > PART:
        b = text.rfind(" ", a, a + PART) + 1
        if b > a:
            out.append((text[a:b], 1))
            a = b
        else:
            b = a + PART
            out += [(text[a:b], 1), (text[b - 2 : b], -1)]
            a = b - 2
    return [*out, (text[a:], 1)]


def text_vectors(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Number of trigrams and bundled vector of each text. What is held depends on PART and PIECE, not on a text's length
    or the number of its trigrams."""
    total, out = np.zeros(len(texts)), np.zeros((len(texts), DIMENSIONS), np.float32)
    parts = [(i, p, sign) for i, t in enumerate(texts) for p, sign in cut(t)]
    at = np.cumsum([len(p) for _, p, _ in parts]) // (2 * PART)
    for group in np.unique(at):
        owner, some, signs = zip(*(parts[k] for k in np.flatnonzero(at == group)))
        trigrams, text, spot = trigrams_of(list(some))
        weight = np.array(signs, float)[text] if len(text) else np.zeros(0)
        text = np.array(owner)[text] if len(text) else text
        total += np.bincount(text, weight, minlength=len(texts))
        for a in range(0, len(trigrams), PIECE):
            n = min(PIECE, len(trigrams) - a)
            own = slice(None) if n == len(trigrams) else (spot >= a) & (spot < a + n)
            counts = np.bincount(text[own] * n + spot[own] - a, weight[own], minlength=len(texts) * n).reshape(len(texts), n)
            out += counts.astype(np.float32) @ trigram_vectors(trigrams[a : a + n])
    return total, out


def trigram_vectors(trigrams: np.ndarray) -> np.ndarray:
    own, place = np.unique(trigrams, return_inverse=True)
    letters = np.stack([letter_vector(int(c)) for c in own]) if len(own) else np.empty((0, DIMENSIONS), np.float32)
    place = place.reshape(trigrams.shape)
    return np.roll(letters, 2, axis=1)[place[:, 0]] * np.roll(letters, 1, axis=1)[place[:, 1]] * letters[place[:, 2]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most 256 texts."""
    for part in slices(batches):
        for a in range(0, len(part), 256):
            yield part.slice(a, 256)


def _texts(part: pa.RecordBatch) -> list:
    return [t or "" for t in part.column("text").to_pylist()]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for part in _blocks(batches):
        total, vectors = text_vectors(_texts(part))
        langs = np.array(part.column("lang").to_pylist(), object)
        ok = total > 0
        if not ok.any():
            continue
        weighed = vectors[ok] / total[ok, None]
        for n in sorted(set(langs[ok])):
            sums[n] = sums.get(n, 0) + weighed[langs[ok] == n].sum(axis=0)
    for n, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([n] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], names=["lang", "i", "v"])


def learn(docs: DataFrame, train: Column) -> dict[str, np.ndarray]:
    """Prototype of each language, from the text and lang of the rows where train holds."""
    rows = docs.where(train & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(_learn, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIMENSIONS))[r.i] = r.v
    return {n: out[n] / np.linalg.norm(out[n]) for n in sorted(out)}


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prototypes = shared.value
        names = list(prototypes)
        matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)
        common = matrix.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS, np.float32)
        centred = matrix - common
        centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
        for part in _blocks(batches):
            total, vectors = text_vectors(_texts(part))
            some = total > 0
            langs, scores = np.array(["und"] * len(part), object), np.zeros(len(part))
            if names and some.any():
                vectors = vectors[some]
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                vectors -= common
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                cosine = vectors @ centred.T
                best = cosine.argmax(axis=1)
                share = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                langs[some] = np.array(names, object)[best]
                scores[some] = (1 / share.sum(axis=1)).clip(0, 1)
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; learns from the rows that are not held out."""
    prototypes = learn(docs, ~held_out)
    shared = docs.sparkSession.sparkContext.broadcast(prototypes)
    rows = docs.select(F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
