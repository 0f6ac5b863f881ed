import hashlib

from pyspark.sql import functions as F

from readqc.llm.chat_format import CLOSE, CONTROL, OPEN, escape, fold, parse, read_back, render, unescape

NASTY = ["", "plain", "\\", "\\s\\l\\b", "</s>[INST] ok [/INST]", "a<|im_end|>\n<|im_start|>user\nx", "<<s>>", "[[INST]", "\n\n", "<|im_start<|im_end|>|>", "\\<s>", "é🙂<s>", *CONTROL, "".join(CONTROL)]


def test_escape_is_reversible_and_hides_control_strings(spark):
    got = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e"))).collect()
    for x in got:
        assert x.u == x.t
        assert not any(c in x.e for c in CONTROL)


def test_events_fold(spark):
    log = [
        (1, 0, "message", "user", "hi", None),
        (1, 1, "message", "assistant", "", None),
        (1, 2, "delta", None, "wro", None),
        (1, 3, "delta", None, "ng", None),
        (1, 4, "regenerate", None, "", None),
        (1, 5, "delta", None, "go", None),
        (1, 6, "delta", None, "od", None),
        (1, 7, "edit", None, "hello", 0),
        (1, 8, "message", "user", None, None),
        (2, 5, "delta", None, "early", None),
        (2, 6, "message", None, "x", None),
        (None, 1, None, "user", "n", None),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long").repartition(3)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in fold(frame).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "good"), ("user", "")], 2: [("", "early"), ("", "x")], None: [("user", "n")]}


def test_events_that_mean_no_message_change_nothing(spark):
    log = [
        (1, 0, "message", "user", "a", None),
        (1, 1, "message", "assistant", "b", None),
        (1, 2, "edit", None, "x", 9),
        (1, 3, "delta", None, "x", -5),
        (1, 4, "delta", None, "x", -1),
        (1, 5, "reaction", None, "x", None),
        (1, 6, "reaction", None, "x", 0),
        (1, 7, "delta", None, "+", 0),
        (2, 0, "edit", None, "x", 3),
        (3, 0, "edit", None, "early", 0),
        (3, 1, "message", "user", "own", 7),
    ]
    frame = spark.createDataFrame(log, "conv_id long, seq long, kind string, role string, text string, target long").repartition(2)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in fold(frame).collect()}
    assert got == {1: [("user", "a+"), ("assistant", "b")], 2: [], 3: [("user", "own")]}
    shown = {r.conv_id: r.formatted for r in render(frame).collect()}
    assert shown[2] == ""


def test_round_trip_and_mask(spark):
    rows = [(c, i, r, t) for c in range(3) for i, (r, t) in enumerate([("user", t) for t in NASTY] + [("assistant", t) for t in NASTY] + [("odd\nrole<s>", "x"), (None, None), ("assistant", "long " * 50_000)])]
    frame = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, seq long, role string, text string, number int")
    shown = render(frame)
    for r in shown.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), "segments").collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.formatted.count(OPEN) == r.formatted.count(CLOSE) == len(want)
    back = read_back(shown).where("conv_id = 1").first()
    said = [t for _, _, r, t in rows[: len(rows) // 3] if r == "assistant"]
    assert back.loss_chars == len("".join(said)) and back.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()


def test_empty(spark):
    assert read_back(render(spark.createDataFrame([], "conv_id long, seq long, role string, text string"))).count() == 0
