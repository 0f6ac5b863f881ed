"""Operator 8: toxicity of texts whose spelling may be disguised.

1. A character language model: 4-gram counts over the words of all documents, interpolated down to single
   letters. Its alphabet is a-z and the other letters that the documents hold most often, up to OWN in all; the
   rest share one number there, but stay themselves in the text. One shuffle of at most (OWN + 2)**4 keys; with
   the 37 letters of four languages the model has 39**4 numbers (9 MB, broadcast).
2. Deobfuscation: tokens with signs of leetspeak, inner punctuation, doubled or stretched letters or spaced-out
   letters become lattices (each letter as itself, each other character with the letters it may stand for, a run
   of three or more with one or two, a double letter also as one, a separator with nothing or a word break, each
   '*' with any letter); Viterbi decoding finds the likeliest path under the model. A token changes only if that
   is likelier by GAIN than the token as it stands (its letters, KEPT for each sign) and not the same words. In
   tokens of over MASKED characters, which are no words, '*' stays one vowel or separator.
3. A lexicon learned from labelled training rows (at most ``max_train``, those with the least hash of their
   doc_id): words and beginnings of words (inflected forms share them) that occur in significantly more
   different contexts (left and right neighbour) of toxic than of other documents. Contexts, not documents,
   are counted, so copies of one noisily labelled text don't make its words suspicious.
4. score: a text's evidence adds up, over the distinct words of the restored text that are or begin with a
   lexicon entry, the entry's log odds less two standard errors (the strongest entry of each word); a logistic
   curve makes a probability of it. The curve is fitted to evidence of words that come from other rows: each half
   of the training rows is scored with the lexicon of the other half.

Defined results: null and empty texts have no evidence; without training rows every text scores 0.01; null
labels are not learned; repeated rows are scored each; labels of one doc_id that disagree count as toxic; a
null doc_id is never a training row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc.llm.store import materialize
from readqc.llm.words import slices

#: The letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou",
}
#: Characters that may stand between the letters of one word.
SEPARATORS = " .-_*~"
MAX_TRAIN = 20_000
#: Costs in nats of reading a sign as a letter and of dropping one; prior weight of the shorter context; evidence asked of a word.
AS_LETTER, DROPPED, BACKOFF, EVIDENCE = 0.5, 6.0, 2.0, 15.0
#: Costs in nats of reading a double letter as one, '*' as a consonant, and one of several '*' between letters as no letter.
DOUBLED, CONSONANT, UNMASKED = 8.0, 1.0, 3.0
#: Cost in nats of joining what a separator parts, for each side of it that has several characters.
JOINED = 2.0
#: Cost in nats of each sign of a token that is left as it is, and what a decoded token must gain; tokens that a worker
#: remembers, and the longest of these.
KEPT, GAIN, TOKENS, TOKEN = 1.0, 4.0, 100_000, 100
#: Lengths of the beginnings of words that are looked at, and the least log odds (two standard errors off) of an entry.
STEMS, LEAST_ODDS = range(3, 9), 1.5
#: Letters with a number of their own (English, French, German and Spanish have fewer); characters of a token with '*' for any letter.
OWN, MASKED = 52, 64
ASCII = "abcdefghijklmnopqrstuvwxyz"
#: From here on a number is a letter without one of its own, plus this.
REST = 1 << 24

_L, _C, _B = r"[^\W\d_]", r"(?:[^\W_]|[@$!|+€(*])", r"[^\S\r\n]+"
_SIGNS = re.compile(rf"[0-9@$|!+€(*._~-]{_L}|{_L}[0-9@$€|]{{1,2}}(?![^\s.,;:!?])|({_L})\1|(?<!\S){_C}{_B}{_C}{_B}{_C}(?![^\s.,;:!?])")
_SPACED = re.compile(rf"(?:(?<!\S){_C}{_B})+{_C}(?![^\s.,;:!?])")
_MARKS = "\"'()[]{}<>.,;:?…"
_EDGES = re.compile(r"^[\"'(\[{<.,;:?…]+|[\"')\]}>.,;:!?…]+$")
_DECORATION = re.compile(rf"([^\w\s*])\1\1+|(?<!{_L})(?<!\*)\*{{3,}}|\*{{3,}}(?!{_L}|\*)")  # '*' between letters stays
_DOUBLE, _TRIPLE = re.compile(rf"({_L})\1"), re.compile(rf"({_L})\1\1")
_WORD, _TOKEN = re.compile(r"[^\W\d_]+"), re.compile(r"\S+")


def _points(part: pa.RecordBatch) -> np.ndarray:
    """Code points of the texts in lower case, each between zeros."""
    return np.frombuffer(("\0" + "\0".join(_texts(part)).lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for part in slices(batches, most=300_000):
        part = part.filter(pc.invert(pc.fill_null(pc.string_is_ascii(part.column("text")), True)))
        if len(part):
            x = _points(part)
            found.update(dict(zip(*(a.tolist() for a in np.unique(x[x > 127], return_counts=True)))))
    have = [x for x in found if chr(x).isalpha()]
    yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([found[x] for x in have], pa.int64())], names=["letter", "n"])


def alphabet(docs: DataFrame) -> str:
    """a-z and the commonest other letters of docs, OWN in all."""
    counts = docs.select("text").mapInArrow(_letters, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    return ASCII + "".join(sorted(chr(r.letter) for r in counts.orderBy(F.desc("n"), "letter").limit(OWN - len(ASCII)).collect()))


def _count(letters: str):
    size = len(letters) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(0x110000, np.int32)
        number[[ord(c) for c in letters]] = np.arange(1, size - 1)
        total = np.zeros(size**4, np.int64)
        for part in slices(batches, most=500_000):
            points = _points(part)
            x = number[points]
            other = points[(x == 0) & (points > 127)]
            if len(other):
                number[[p for p in np.unique(other).tolist() if chr(p).isalpha()]] = size - 1
                x = number[points]
            keep = np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))
            x = np.concatenate(([0, 0], x[keep]))  # what stands before a word break is not looked at
            a = x[2:-1]
            b = np.where(a != 0, x[1:-2], 0)
            c = np.where(b != 0, x[:-3], 0)
            at = ((c * size + b) * size + a) * size + x[3:]
            np.add.at(total, at[(a != 0) | (x[3:] != 0)], 1)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 50_000].astype(np.int32)), pa.array(total[used[i : i + 50_000]])], names=["gram", "n"])

    return run


def character_model(docs: DataFrame, letters: str = ASCII) -> np.ndarray:
    """Log probability of a letter (0: word break, the last number: any not in letters) after three; [a, b, c, d] is d after a, b, c."""
    size = len(letters) + 2
    counts = np.zeros(size**4)
    # at most size**4 rows reach the driver
    for batch in docs.select("text").mapInArrow(_count(letters), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[batch.column("gram").to_numpy()] = batch.column("n").to_numpy()
    four = counts.reshape((size,) * 4)
    three = four.sum(axis=0)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p = (one + 1) / (one.sum() + size)
    for table in (two, three, four):
        p = (table + BACKOFF * p) / (table.sum(axis=-1, keepdims=True) + BACKOFF)
    return np.log(p).astype(np.float32)


class Letters(dict):
    """The numbers of letters; one that is not in the alphabet has REST and its code point."""

    def __init__(self, letters: str = ASCII) -> None:
        super().__init__((c, i + 1) for i, c in enumerate(letters))
        base = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
        #: What a sign may stand for: its letters with or without accents.
        self.signs = {c: [self[x] for x in letters if base[x] in plain] for c, plain in LEET.items()}
        self.mask = [((i,), AS_LETTER if base[c] in LEET["*"] else CONSONANT) for c, i in self.items()]

    def __missing__(self, letter: str) -> int:
        return REST + ord(letter)


def lattice(token: str, letters: Letters = Letters()) -> list:  # noqa: B008
    """Positions of alternatives (letters as numbers, 0: word break; cost)."""
    out: list = []
    i = 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c.isalpha():
            x = letters[c]
            if j - i > 1:
                out.append([((x,), 0.0), ((x, x), 0.0)] if j - i > 2 else [((x, x), 0.0), ((x,), DOUBLED)])
            else:
                out.append([((x,), 0.0)])
        elif c == "*" and len(token) <= MASKED:
            several = UNMASKED if j - i > 1 and token[i - 1 : i].isalpha() and token[j : j + 1].isalpha() else 0.0
            out += [[*letters.mask, ((), several), ((0,), several)]] * (j - i)
        else:
            for _ in range(1 if c in SEPARATORS else j - i):
                options = [((x,), AS_LETTER) for x in letters.signs.get(c, ())]
                options += [((), _parted(token, i, j) if c in SEPARATORS else DROPPED)]
                if c in SEPARATORS or not options[:-1]:
                    options += [((0,), 0.0)]
                out.append(options)
        i = j
    return out


def _parted(token: str, i: int, j: int) -> float:
    """Cost of reading the separator token[i:j] as nothing: none between single characters."""
    before, after = token[max(i - 2, 0) : i], token[j : j + 2]
    return JOINED * sum(len(x) > 1 and not any(c in SEPARATORS for c in x) for x in (before, after))


class Memo(dict):
    """What a function gave for tokens or words of ordinary length; forgets all when it has TOKENS of them."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, token: str):
        found = self.make(token)
        if len(token) <= TOKEN:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = found
        return found


def lexicon_of(entries: dict) -> Memo:
    """The strongest entry of a word: the word itself (its entry ends in a blank) or a beginning of it."""
    return Memo(lambda word: max(entries.get(x, 0.0) for x in (word + " ", *(word[:n] for n in STEMS if n <= len(word)))))


class Decoder:
    """Viterbi decoding of tokens; remembers what it has decoded."""

    def __init__(self, model: np.ndarray, letters: str = ASCII) -> None:
        self.model, self.size = model.reshape(-1), len(letters) + 2
        self.cost = memoryview(np.ascontiguousarray(-self.model))  # single numbers come faster out of this
        self.letters, self.names = Letters(letters), " " + letters
        self.known = Memo(self._decode)
        self.words = Memo(self.words_of)

    def __call__(self, token: str) -> str:
        return self.known[token]

    def token(self, token: str) -> str:
        """A token between blanks, in lower case, as it is or decoded."""
        if not _SIGNS.search(token):
            return token
        core = _EDGES.sub("", _DECORATION.sub("", token))
        if not core or not _SIGNS.search(core):
            return token
        found = self.known[core]
        return token if found == core else found + token[len(token.rstrip(".,;:!?…")) :]

    def words_of(self, token: str) -> tuple:
        """The words of a token, as it is or decoded."""
        core = token.strip(_MARKS)
        if core.isalpha() and not _DOUBLE.search(core):
            return (core,)  # nothing to decode
        return tuple(_WORD.findall(self.token(token)))

    def _number(self, letter: str) -> int:
        return min(self.letters[letter], self.size - 1)

    def _decode(self, token: str) -> str:
        known = [c in self.letters for c in token if c.isalpha()]
        if 2 * sum(known) < len(known) or self._only_doubles_that_stay(token):  # in the first case the model can't tell
            return token
        options = [*lattice(token, self.letters), [((0,), 0.0)]]
        cost, path = self._wide(options) if token.count("*") > 1 and len(token) <= MASKED else self._narrow(options)
        found = "".join(chr(x - REST) if x >= REST else self.names[x] for x in path).strip()
        same = found.split() == _WORD.findall(token)
        return token if same or cost + GAIN >= self._as_it_is(token) else found

    def _only_doubles_that_stay(self, token: str) -> bool:
        """True where nothing but double letters could change and none can gain enough: what reading one as a single
        letter may save is at most the cost of its second letter and the three after it."""
        if not token.isalpha() or _TRIPLE.search(token):
            return False
        doubles = [m.start() + 1 for m in _DOUBLE.finditer(token)]
        most = DOUBLED + (GAIN if len(doubles) == 1 else 0.0)
        x, cost, size = [0, 0, 0, *map(self._number, token), 0], self.cost, self.size
        four = lambda k: cost[((x[k] * size + x[k + 1]) * size + x[k + 2]) * size + x[k + 3]]
        return all(sum(map(four, range(i, min(i + 4, len(token) + 1)))) <= most for i in doubles)

    def _as_it_is(self, token: str) -> float:
        """Cost of the token's letters, of its signs and of its end; a word may end at any sign."""
        cost, state = 0.0, 0
        for c in token:
            number = self._number(c) if c.isalpha() else 0
            if number:
                cost += self.cost[state * self.size + number]
            elif not c.isspace():
                cost += KEPT
            state = (state % self.size**2) * self.size + number if number else 0
        return cost + (self.cost[state * self.size] if state else 0.0)

    def _narrow(self, positions: list) -> tuple[float, list]:
        model, size = self.cost, self.size
        states = {0: (0.0, None)}  # the last three letters: cost, path
        for options in positions:
            after: dict = {}
            for state, (cost, path) in states.items():
                for letters, extra in options:
                    s, total, way = state, cost + extra, path
                    for x in letters:
                        number = x if x < REST else size - 1
                        if x or s:
                            total += model[s * size + number]
                            way = (x, way)
                        s = (s % size**2) * size + number if x else 0
                    if s not in after or total < after[s][0]:
                        after[s] = (total, way)
            states = after
        cost, path = min(states.values(), key=lambda v: v[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return cost, out[::-1]

    def _wide(self, positions: list) -> tuple[float, list]:
        """The same with all states at once, for tokens where most can be reached."""
        size = self.size
        model, pairs = self.model.reshape(size**3, size), np.arange(size**2)
        cost, came = np.full(size**3, np.inf), []
        cost[0] = 0.0
        for options in positions:
            best, chosen, origin = np.full(size**3, np.inf), np.zeros(size**3, np.int16), np.zeros(size**3, np.int32)
            for k, (letters, extra) in enumerate(options):
                now, source = cost + extra, np.arange(size**3, dtype=np.int32)
                for x in letters:
                    number = x if x < REST else size - 1
                    total = now - model[:, number]
                    to, start = np.full(size**3, np.inf), np.zeros(size**3, np.int32)
                    if x:
                        at = total.reshape(size, size**2).argmin(axis=0) * size**2 + pairs
                        to[number::size], start[number::size] = total[at], source[at]
                    else:
                        total[0] = now[0]
                        at = total.argmin()
                        to[0], start[0] = total[at], source[at]
                    now, source = to, start
                less = now < best
                best[less], chosen[less], origin[less] = now[less], k, source[less]
            came.append((options, chosen, origin))
            cost = best
        s, out = int(cost.argmin()), []
        least = float(cost[s])
        for options, chosen, origin in reversed(came):
            letters, s = options[chosen[s]][0], int(origin[s])
            out += [x for x in reversed(letters) if x or s]
        return least, out[::-1]


def _joined(low: str, decode: Decoder) -> tuple[str, list]:
    """The text with letters that stand apart decoded, and its tokens."""
    tokens = low.split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if any(b - a == 1 for a, b in zip(single, single[1:])):
        low = _SPACED.sub(lambda m: _apart(m[0], decode), low)
        tokens = low.split()
    return low, tokens


def _apart(run: str, decode: Decoder) -> str:
    """Single characters with blanks between, decoded where there are three or more and half of them are letters."""
    parts = run.split()
    if len(parts) < 3 or 2 * sum(map(str.isalpha, parts)) < len(parts):
        return run
    found = decode(" ".join(parts))
    return run if found == " ".join(parts) else found


def restore(text: str, decode: Decoder) -> str:
    """The text in lower case, its disguised tokens decoded; all else stays, blanks included."""
    return _TOKEN.sub(lambda m: decode.token(m[0]), _joined(text.lower(), decode)[0])


def restored_words(text: str, decode: Decoder) -> list:
    """The words of the restored text in order."""
    return [w for t in map(decode.words.__getitem__, _joined(text.lower(), decode)[1]) for w in t]


class Evidence:
    """The evidence of a text by the entries of a lexicon."""

    def __init__(self, decode: Decoder, entries: dict) -> None:
        self.decode, self.weight = decode, lexicon_of(entries)
        heads = {e[: STEMS[0]] for e in entries}
        self.hits = Memo(lambda token: tuple(w for w in decode.words_of(token) if (w + " ")[: STEMS[0]] in heads and self.weight[w]))

    def __call__(self, text: str) -> float:
        tokens = set(_joined(text.lower(), self.decode)[1])
        found: set = set()
        found.update(*filter(None, map(self.hits.__getitem__, tokens)))
        return sum(map(self.weight.__getitem__, sorted(found)))


def _texts(part: pa.RecordBatch) -> list:
    return [t or "" for t in part.column("text").to_pylist()]


def _contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, seen = Decoder(*shared.value), set()

        def batch():
            columns = zip(("word", "context", "toxic", "half"), zip(*seen), (pa.string(), pa.int64(), pa.int32(), pa.int32()))
            out = pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in columns})
            seen.clear()
            return out

        for part in slices(batches):
            for text, toxic, half in zip(_texts(part), part.column("toxic").to_pylist(), part.column("half").to_pylist()):
                words = ["", *restored_words(text, decode), ""]
                seen.update((w, hash64(left + " " + right), toxic, half) for left, w, right in zip(words, words[1:], words[2:]))
                if len(seen) >= 50_000:
                    yield batch()
        if seen:
            yield batch()

    return run


def hash64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def learn(docs: DataFrame, labels: DataFrame, shared, max_train: int = MAX_TRAIN) -> dict:
    """{"words": {entry: log odds}, "slope", "intercept"}; labels (doc_id, toxic) are the training rows."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = F.broadcast(rows.orderBy(order, "doc_id").limit(max_train).withColumn("half", F.pmod(order, F.lit(2)).cast("int")))
    train = materialize(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "toxic", "half"))
    met = train.mapInArrow(_contexts(shared), "word string, context long, toxic int, half int")
    in_half = lambda h: F.max(F.when(F.col("half") == h, F.col("toxic")))
    met = met.groupBy("word", "context").agg(F.max("toxic").alias("t"), in_half(0).alias("t0"), in_half(1).alias("t1"))
    parts = ("t", "t0", "t1")  # all rows, either half
    sums = lambda *c: [F.sum(x).alias(n) for n, x in c]
    by_word = materialize(met.groupBy("word").agg(*sums(*((f"n1_{p}", F.col(p)) for p in parts), *((f"n0_{p}", 1 - F.col(p)) for p in parts))))
    counts = [c for c in by_word.columns if c != "word"]
    totals = by_word.agg(*sums(*((c, F.col(c)) for c in counts))).first()
    # the word itself ends in a blank, so that it isn't the same as a beginning
    entries = F.concat(F.array(F.concat("word", F.lit(" "))), F.transform(F.sequence(F.lit(STEMS[0]), F.least(F.length("word"), F.lit(STEMS[-1]))), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    entries = F.when(F.length("word") >= STEMS[0], entries).otherwise(F.array(F.concat("word", F.lit(" "))))
    by_entry = by_word.select(F.explode(entries).alias("word"), *counts).groupBy("word").agg(*sums(*((c, F.coalesce(c, F.lit(0))) for c in counts)))
    whole, *halves = (_entries(by_entry, p, totals[f"n1_{p}"] or 0, totals[f"n0_{p}"] or 0) for p in parts)
    other = docs.sparkSession.sparkContext.broadcast((shared.value, halves))
    bins = train.mapInArrow(_evidence(other), "x double, toxic int").groupBy("x").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()  # at most max_train rows
    slope, intercept = fit([r.x for r in bins], [r.n for r in bins], [r.t for r in bins])
    return {"words": whole, "slope": slope, "intercept": intercept}


def _entries(by_entry: DataFrame, part: str, all1: int, all0: int) -> dict:
    """Entry -> log odds less two standard errors, of the entries with a log likelihood ratio over EVIDENCE: as many as the
    bounded sample can give."""
    if not all1 or not all0:
        return {}
    share = all1 / (all1 + all0)
    n1, n0 = F.col(f"n1_{part}"), F.col(f"n0_{part}")
    ratio = lambda n, p: F.when(n > 0, n * F.log(n / (n1 + n0) / p)).otherwise(0.0)
    strong = by_entry.where((n1 + n0 > 0) & (n1 > share * (n1 + n0)) & (ratio(n1, share) + ratio(n0, 1 - share) > EVIDENCE))
    return entry_odds([(r.word, r.n1, r.n0) for r in strong.select("word", n1.alias("n1"), n0.alias("n0")).collect()], all1, all0)


def entry_odds(counts: list, all1: int, all0: int) -> dict:
    out = {}
    for word, n1, n0 in counts:
        odds = math.log((n1 + 0.5) / (all1 + 1)) - math.log((n0 + 0.5) / (all0 + 1))
        odds -= 2 * math.sqrt(1 / (n1 + 0.5) + 1 / (n0 + 0.5))  # what is safe to say of it
        if odds > LEAST_ODDS:
            out[word] = odds
    return out


def _evidence(shared):
    """Evidence of training rows by the lexicon of the half that they are not in, to one decimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, halves = shared.value
        decode = Decoder(*language)
        evidence = [Evidence(decode, x) for x in halves]
        for part in slices(batches):
            found = [evidence[1 - half](t) for t, half in zip(_texts(part), part.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([round(x, 1) for x in found], pa.float64()), part.column("toxic")], names=["x", "toxic"])

    return run


def fit(x, n, t) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of t successes in n trials on x, by damped Newton steps."""
    if not sum(n):
        return 1.0, math.log(0.01 / 0.99)
    x, n, t = (np.array(a, float) for a in (x, n, t))
    rate = (t.sum() + 0.5) / (n.sum() + 1)
    w = np.array([0.0, math.log(rate / (1 - rate))])
    rows = np.stack([x, np.ones(len(x))])
    ridge = np.array([0.05, 0.0])

    def loss(w):
        z = w @ rows
        return (n * np.logaddexp(0, z) - t * z).sum() + 0.5 * (ridge * w * w).sum()

    for _ in range(100):
        p = 1 / (1 + np.exp(-(w @ rows)))
        gradient = rows @ (n * p - t) + ridge * w
        step = np.linalg.solve((rows * (n * p * (1 - p))) @ rows.T + np.diag(ridge + 1e-6), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def _logits(shared):
    """A function from texts to their logits."""
    language, learned = shared.value
    evidence = Evidence(Decoder(*language), learned["words"])
    return lambda texts: learned["slope"] * np.array(list(map(evidence, texts)), float) + learned["intercept"]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = _logits(shared)
        for part in slices(batches):
            scores = 1 / (1 + np.exp(-logits(_texts(part))))
            columns = [part.column("doc_id"), part.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    return run


def _reject(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = _logits(shared)
        for part in slices(batches):
            yield part.filter(pa.array(logits(_texts(part)) < 0))

    return run


def _learned(docs: DataFrame, labels: DataFrame, held_out: Column, max_train: int):
    context = docs.sparkSession.sparkContext
    letters = alphabet(docs)
    language = context.broadcast((character_model(docs, letters), letters))
    learned = learn(docs, labels.select("doc_id", "toxic").where(~held_out), language, max_train)
    return context.broadcast((language.value, learned))


def reject(docs: DataFrame, labels: DataFrame, held_out: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; no shuffle of texts."""
    return docs.mapInArrow(_reject(_learned(docs, labels, held_out, max_train)), docs.schema)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. labels: doc_id, toxic; those held out are not learned."""
    shared = _learned(docs, labels, held_out, max_train)
    rows = docs.select(F.col("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
