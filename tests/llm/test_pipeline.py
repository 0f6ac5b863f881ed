from collections import Counter, defaultdict

import corpus_pipeline
from readqc.llm.store import materialize
from tests.llm.test_ngram_join import brute, corpus

BAD = ["idiot", "scum", "moron"]


def letters(n):
    return "".join(chr(97 + int(c)) for c in str(n))


def test_stages(spark, tmp_path):
    rows = [(d, t.translate(str.maketrans("0123456789", "bcdfghjklm"))) for d, t in corpus(5, n=150)]
    rows += [(d + 1000, t) for d, t in rows[:20]]
    toxic = {2000 + i for i in range(60)}
    texts = [(d, t, 0) for d, t in rows] + [(d, " ".join(f"{letters(d * 100 + j)} {BAD[(d + j) % 3]}" for j in range(8)), 1) for d in sorted(toxic)]
    texts += [(3000, None, 0), (3001, "", 0)]
    spark.createDataFrame([(d, t, "en", f"s{min(d % 7, 3)}", len(t or "")) for d, t, _ in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, x) for d, _, x in texts if d % 10 != 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == schema.names
    ids = {k: [x.doc_id for x in v] for k, v in seen.items()}
    all_ids = {d for d, *_ in texts}
    assert set(ids["toxicity"]) == all_ids - toxic
    text = {x.doc_id: x.text or "" for x in seen["toxicity"]}
    last = {}
    for d, t in text.items():
        last[t] = max(d, last.get(t, -1))
    assert sorted(ids["exact_dedup"]) == sorted(last.values())
    kept = [(d, text[d]) for d in ids["exact_dedup"]]
    assert sorted(ids["near_dedup"]) == sorted({c for _, _, c in brute(kept)})
    tokens, source = defaultdict(int), {x.doc_id: x.source for x in seen["near_dedup"]}
    for d in ids["near_dedup"]:
        tokens[source[d]] += len(text[d].split())
    times = Counter(ids["mixing"])
    assert set(times) == set(ids["near_dedup"]) and set(times.values()) <= {1, 2}
    least = min(tokens, key=tokens.get)
    read = sum(n * len(text[d].split()) for d, n in times.items() if source[d] == least)
    assert 1.6 * tokens[least] < read <= 2 * tokens[least]
    packed = Counter()
    for x in seen["packing"]:
        packed[x.doc_id] += x.n_tokens
    assert packed == Counter({d: n * len(text[d].split()) for d, n in times.items()})
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen["packing"]))


def tables(spark, folder, rows, labels, extra=""):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeated_rows_and_clashing_columns(spark, tmp_path):
    """Every stage keeps all columns, whatever their names; nulls, repeated rows and ties come through."""
    names = ["_id", "_sha", "_n", "_s", "_b", "_ks", "_kb", "epoch", "n_tokens", "mix_order", "held_out", "g", "root"]
    texts = [(None, None), (None, "lone text here"), (1, None), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "One two three four five six seven"), (5, "one two three four five six seven"), (6, "other words of a text"), (6, "and one more for the id")]
    rows = [(d, t, None, "s" if d != 6 else None, None, *(f"{c}|{t}" for c in names)) for d, t in texts]
    tables(spark, tmp_path, rows, [(3, None, None), (None, 1, 1), (6, 0, 0)], "".join(f", {c} string" for c in names))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    schema = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == schema
        seen[name] = sorted((str(x.doc_id), x.text or "") for x in docs.collect())
        assert all(x[c] == f"{c}|{x.text}" for x in docs.collect() for c in names)
    assert len(seen["toxicity"]) == len(rows)
    same = "one two three four five six seven"
    # of the empty texts 2 stays, of the equal ones 5; then 4 stands for both spellings
    assert seen["exact_dedup"] == sorted([("None", "lone text here"), ("2", ""), ("4", same.capitalize()), ("5", same), ("6", "other words of a text"), ("6", "and one more for the id")])
    assert seen["near_dedup"] == sorted(x for x in seen["exact_dedup"] if x != ("5", same))
    assert set(seen["mixing"]) == set(seen["near_dedup"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(x.n_tokens for x in packed) == sum(len(t.split()) for _, t in seen["mixing"])
