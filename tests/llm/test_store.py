import os
from types import SimpleNamespace

import pytest

from readqc.llm import store


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app of {master}", getConf=lambda: {}))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            store.shared_folder(session(master))
        assert store.shared_folder(session(master, "hdfs://host/tmp/")) == "hdfs://host/tmp"
    assert store.shared_folder(session("local[4]")).startswith("file:///") and store.shared_folder(session("local[4]")) == store.shared_folder(session("local[4]"))


def test_release_deletes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_folder", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(store, "_folders", {})
    one, two = (store.materialize(spark.range(n)) for n in (3, 5))
    assert (one.count(), two.count()) == (3, 5) and len(os.listdir(tmp_path)) == 1
    store.release(spark)
    assert os.listdir(tmp_path) == [] and store.materialize(spark.range(2)).count() == 2


def test_the_session_is_left_alone(spark):
    """Operators don't change settings; small_batches does, once, and only a default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    from readqc.llm import fingerprints, language_id, ngram_join, substring_dedup
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b c d e f", "en")], "doc_id long, text string, lang string")
    for run in (lambda: substring_dedup.remove_repeats(docs), lambda: ngram_join.link(docs), lambda: fingerprints.fingerprint(docs), lambda: language_id.identify(docs, F.lit(False))):
        run().collect()
        assert spark.conf.get(key) == before
    try:
        assert store.small_batches(spark) is spark
        assert spark.conf.get(key) == ("4m" if before in ("67108864b", "64MB", "64m") else before)
        spark.conf.set(key, "9m")
        store.small_batches(spark)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.set(key, before)


def test_spare_names(spark):
    frame = spark.range(1).selectExpr("id AS _ID", "id AS __x", "id AS x")
    assert store.spare(frame, "_id", "x", "y", "_x") == ["__id", "_x", "y", "___x"]
