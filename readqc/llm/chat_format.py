"""Operator 4: chat formatting from event logs, with DataFrame functions only.

Events are (conv_id, seq, kind, role, text[, target]); kind is one of

    message     opens a message, with its role and first text (possibly empty, when it is streamed)
    delta       appends text to a message
    edit        replaces a message's text
    regenerate  drops what was generated for a message and starts again with text

``target`` is the number of the message meant (0 for the first), null for the latest one. The log is dealt
out by conversation once; inside, a running count numbers the messages, each message folds its own events
in order (the last reset and the deltas after it), and the messages are rendered in order:

    <|im_start|>role\\ntext<|im_end|>\\n

Control strings inside texts are escaped reversibly, so no text can forge or end a turn. The result holds
the rendered string and its segments with a loss flag: only assistants' texts are under the loss mask.

Defined results: null text: empty; null role: empty; null kind: message; a null seq comes first; equal seq:
by kind, role and text; repeated rows are events of their own; events before the first message form a
message with an empty role; an event of another kind, and one whose target names no message of its conversation,
changes nothing (nor does one whose target opens only later, as a message starts with its own text); a conversation of
such events alone has no turn; a null conv_id is a conversation of its own; extra columns are ignored. A
conversation is one value of the result, so one conversation is rendered by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates give a meaning; each starts with < or [.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
CODES = {"<": "\\l", "[": "\\b"}


def escape(text: Column) -> Column:
    """Every backslash becomes \\s; the first character of a control string becomes \\l or \\b."""
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(CODES[c[0]] + c[1:]))
    return text


def unescape(text: Column) -> Column:
    for plain, code in CODES.items():
        text = F.replace(text, F.lit(code), F.lit(plain))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turns: array of (number, role, text), the final messages."""
    have = set(events.columns)
    kind = F.coalesce(F.col("kind"), F.lit("message")) if "kind" in have else F.lit("message")
    log = events.select(
        "conv_id",
        F.col("seq").cast("long").alias("seq"),
        kind.alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.col("target").cast("long") if "target" in have else F.lit(None).cast("long")).alias("target"),
    )
    opens = F.col("kind") == "message"
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy("conv_id").orderBy("seq", F.when(opens, 0).otherwise(1), "kind", "role", "text")
    log = log.select(
        "*",
        F.row_number().over(order).alias("at"),
        (F.count(F.when(opens, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("latest"),
        F.count(F.when(opens, 1)).over(order.rowsBetween(*whole)).alias("messages"),
    )
    log = log.withColumn("number", F.when(opens, F.col("latest")).otherwise(F.coalesce("target", "latest")))
    means = F.col("kind").isin("message", "delta", "edit", "regenerate") & (opens | F.col("target").isNull() | F.col("target").between(0, F.col("messages") - 1))
    event = F.when(means, F.struct("at", "kind", "role", "text"))  # collect_list leaves out nulls, the conversation stays
    log = log.withColumn("number", F.when(means, F.col("number")))
    own = log.groupBy("conv_id", "number").agg(F.array_sort(F.collect_list(event)).alias("e"))
    reset = F.coalesce(F.array_max(F.transform("e", lambda x, i: F.when(x["kind"] != "delta", i + 1).otherwise(F.lit(1)))), F.lit(1))
    own = own.select(
        "conv_id",
        "number",
        F.coalesce(F.try_element_at(F.filter("e", lambda x: x["kind"] == "message"), F.lit(1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("e", reset, F.size("e")), lambda x: x["text"]), "").alias("text"),
    )
    turn = F.when(F.col("number").isNotNull(), F.struct("number", "role", "text"))
    return own.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def render(events: DataFrame) -> DataFrame:
    """conv_id, segments: array of (text, loss), formatted: their concatenation."""
    role = lambda t: F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                part(F.concat(F.lit(OPEN), role(t), F.lit("\n")), F.lit(False)),
                part(escape(t["text"]), t["role"] == "assistant"),
                part(F.lit(CLOSE + "\n"), F.lit(False)),
            ),
        )
    )
    shown = fold(events).select("conv_id", segments.alias("segments"))
    return shown.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse(formatted: Column) -> Column:
    """The turns of a rendered string: array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.replace(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, F.length(head) + 2, F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_back(shown: DataFrame) -> DataFrame:
    """What the rendered output says: turns and masked text of each conversation, as digests."""
    turns = shown.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace({}, '\\', '\\s')"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{CODES[_c[0]] + _c[1:]}')"
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(CLOSE) + 2} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
