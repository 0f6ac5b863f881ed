import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readqc.llm import token_alignment as T
from readqc.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
TEXTS = [
    "Le petit chat, et la souris.\nÉté  prochain — 12345", "hello world", "hello world", "", None, " leading and trailing ", "a▁b", "<|endoftext|> </s> <s>x", "日本語のテキスト 中文",
    "\n\n\t x", "it's we'll 'tis", "e" * 5_000, "word " * 3_000, "🙂 🙃🙂", "x   y z", "\x00 \x01a", " ", "tab\tand  two   three",
]


def plain(texts: list) -> list:
    """The contract word for word, on whole texts."""
    pair, out, links = T.load(A, B), [], []
    for text in texts:
        groups, own = [], []
        if text:
            whole = (" " + text).encode()
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            if b"".join(pair.a_bytes[i] for i in a) == whole == b"".join(pair.b_bytes[i] for i in b):
                ends = lambda ids, of: dict(zip(__import__("itertools").accumulate(len(of[i]) for i in ids), range(1, len(ids) + 1)))
                ends_a, ends_b, x, y = ends(a, pair.a_bytes), ends(b, pair.b_bytes), 0, 0
                for at in sorted(ends_a.keys() & ends_b.keys()):
                    groups.append(f"{','.join(map(str, a[x : ends_a[at]]))}|{','.join(map(str, b[y : ends_b[at]]))}")
                    x, y = ends_a[at], ends_b[at]
                    own.append((a[x - 1], b[y - 1]))
        out.append([len(a) if groups else 0, len(b) if groups else 0, len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
        links.append(own)
    counts, best = Counter(x for own in links for x in own), {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(*row[:4], sum(counts[x] == best[x[1]] for x in own), sum(counts[x] for x in own), row[4]) for row, own in zip(out, links)]


def rows(found) -> dict:
    return {r["doc_id"]: tuple(r)[1:] for r in found.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string, row int").repartition(3)


def test_against_whole_texts(spark, docs):
    expected = dict(enumerate(plain(TEXTS)))
    assert rows(T.align(docs, A, B)) == expected


def test_by_join(spark, docs):
    encoded = T.materialize(T.encode(docs, A, B))
    assert rows(T.joined(encoded, T.partial_counts(encoded))) == dict(enumerate(plain(TEXTS)))


def test_small_shards(spark, docs, monkeypatch):
    monkeypatch.setattr(T, "SHARD", 7)
    found = list(T._runs(iter([T.pa.RecordBatch.from_pydict({"key": [1, 1, 2, 3, 4, 5, 6, 7, 8], "n": [1] * 9}), T.pa.RecordBatch.from_pydict({"key": [8, 8, 9], "n": [1, 2, 3]})])))
    assert [x.tolist() for pair in found for x in pair] == [[1, 2, 3, 4, 5, 6, 7], [2, 1, 1, 1, 1, 1, 1], [8, 9], [4, 3]]


def test_empty_and_null_ids(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    found = T.align(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string"), A, B).collect()
    assert sorted((r["doc_id"] is None, r["n_links"] > 0, r["count_sum"]) for r in found)[0] == (False, False, 0)
    assert len(found) == 3


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é'\n\t  s.1日 <>|/"), max_size=40) | st.text(max_size=20))
def test_pieces_have_the_tokens_of_whole_texts(text):
    if not text:
        return
    pair = T.load(A, B)
    known = T.Known(pair)
    which = known.which(T._CUT.split(text))
    numbers = known.numbers[which]
    n_a, n_b, groups, _, _, _, digest = plain([text])[0]
    if (numbers[:, 2] >= 0).all():
        assert (*numbers.sum(axis=0).tolist(), known.digest(which)) == (n_a, n_b, groups, digest)
    else:
        assert not digest


def test_whole_table(spark):
    from readqc.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_token_alignment"](spark, sf)) == dict(zip([i for i, _ in texts], plain([t for _, t in texts])))
