"""Operator 7: mixing sources to target weights by temperature.

Source weights are token shares to the power ``alpha``, normalised. alpha is found by bisection: the
smallest in 0..1 (the flattest mixture) whose most repeated source is repeated at most ``repetition``
times, or the one whose mixture has entropy ``entropy`` (as a share of the uniform one's).

The mixture is realised without dropping anything: the source with the largest token count for its weight
is read once, the others as often as their weights ask for, (weight / share), in epochs. Each epoch is a
fresh permutation of the source's ``blocks`` blocks of documents; whole blocks are taken while the budget
lasts, and in the block where it ends, documents in hash order until it ends. A document's part is a
function of its source, block and hash (60 bits of an MD5 of doc_id and seed), so the text is not shuffled and
a source with most of the rows is spread over all its blocks. Where the budget ends inside a block is found in
two steps: sums of 4096 ranges of the hash, then the documents of one range, so no task sorts a whole block.

The plan has a row for each source, epoch and block that has documents, so never more rows than the result. Up to
MAX_PLAN rows it is broadcast, beyond that joined by a shuffle.

Defined results: a null source is a source of its own; sources without any token are kept once; a null or
empty text has 0 tokens and goes with its block; a null doc_id hashes like any value; repeated rows share
their part; extra columns are carried unchanged, whatever their names: the new columns n_tokens, epoch and mix_order
get underscores before their names where docs has such columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.counting import n_words
from readqc.llm.store import materialize, spare

HIGHEST, LOWEST = 2**63 - 1, -(2**63)
#: Rows of a plan that is broadcast (some 60 bytes each); steps of the bisection; bits of a hash, and of its ranges.
MAX_PLAN, STEPS, HASH_BITS, RANGE_BITS = 200_000, 60, 60, 12


def repetitions(totals: dict, alpha: float) -> dict:
    """How often each source is read (to nine decimals), the largest once."""
    top = max(totals.values())
    return {s: round((top / n) ** (1 - alpha), 9) if n else 1.0 for s, n in totals.items()}


def weights(totals: dict, alpha: float) -> dict:
    raw = {s: n**alpha if n else 0.0 for s, n in totals.items()}
    whole = sum(raw.values())
    return {s: x / whole if whole else 0.0 for s, x in raw.items()}


def relative_entropy(totals: dict, alpha: float) -> float:
    w = [x for x in weights(totals, alpha).values() if x > 0]
    return -sum(x * math.log(x) for x in w) / math.log(len(w)) if len(w) > 1 else 1.0


def find_alpha(totals: dict, repetition: float | None = 2.0, entropy: float | None = None, steps: int = STEPS) -> float:
    """The smallest alpha in 0..1 that keeps the limits; 1 (natural shares) if none does."""
    if not any(totals.values()):
        return 1.0

    top = max(totals.values())

    def fits(alpha: float) -> bool:
        ok = repetition is None or max((top / n) ** (1 - alpha) for n in totals.values() if n) <= repetition
        return ok and (entropy is None or relative_entropy(totals, alpha) <= entropy)

    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def mix(docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, blocks: int = 256, seed: int = 7, max_sources: int = 2_000, tokens: Column | None = None) -> DataFrame:
    """docs with n_tokens, epoch (from 1) and mix_order, each row as often as the mixture reads it. tokens: the count of
    a row's tokens, if not its words.

    Sorting by mix_order (0..1) interleaves the sources in proportion to their weights.
    """
    if repetition is not None and repetition < 1:
        raise ValueError("every document is read at least once")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    number = lambda first, n: F.conv(F.substring(digest, first, n), 16, 10).cast("long")
    name = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    hashed, block = number(1, HASH_BITS // 4), (number(17, 8) % blocks).cast("int")
    n_tokens = n_words(F.col("text")) if tokens is None else tokens
    sized = materialize(docs.select(name.alias("s"), block.alias("b"), hashed.alias("h"), n_tokens.alias("t")))
    by_block = materialize(sized.groupBy("s", "b").agg(F.sum("t").alias("t")))
    by_source = by_block.groupBy("s").agg(F.sum("t").alias("t"))
    few = by_source.limit(max_sources + 1).collect()
    if len(few) > max_sources:
        reps = _reps_at_scale(by_source, repetition, entropy)
    else:
        totals = {r.s: r.t for r in few}
        found = repetitions(totals, find_alpha(totals, repetition, entropy)) if totals else {}
        reps = docs.sparkSession.createDataFrame([(s, float(totals[s]), float(found[s])) for s in sorted(totals)], "s string, total double, reps double")
    plan = materialize(_plan(by_block, reps, sized, seed))
    n_name, e_name, o_name, s, b, cut, epoch, start, span, ks, kb, kh = spare(docs, "n_tokens", "epoch", "mix_order", "_s", "_b", "_cut", "_e", "_start", "_span", "_ks", "_kb", "_kh")
    plan = plan.toDF(s, b, epoch, cut, start, span)
    if plan.limit(MAX_PLAN + 1).count() <= MAX_PLAN:
        plan = F.broadcast(plan)
    keyed = docs.withColumns({ks: name, kb: block, kh: hashed, n_name: n_tokens})
    joined = keyed.join(plan, (F.col(ks) == F.col(s)) & (F.col(kb) == F.col(b)) & (F.col(kh) <= F.col(cut)))
    order = F.col(start) + F.col(span) * (F.col(kh) % 1_000_003) / 1_000_003
    return joined.withColumns({e_name: F.col(epoch), o_name: order}).drop(ks, kb, kh, s, b, cut, epoch, start, span)


def _plan(by_block: DataFrame, reps: DataFrame, sized: DataFrame, seed: int) -> DataFrame:
    """s, b, epoch, cut (the largest hash taken), start and span (the block's place in its source, 0..1)."""
    each = by_block.join(reps, "s").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil("reps").cast("int"))))
    shuffled = Window.partitionBy("s", "epoch").orderBy(F.md5(F.concat_ws(":", "s", "b", "epoch", F.lit(str(seed)))), "b")
    each = each.withColumn("before", F.coalesce(F.sum("t").over(shuffled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    budget = F.when(F.col("epoch") <= F.col("reps"), F.col("total")).otherwise((F.col("reps") - F.floor("reps")) * F.col("total"))
    each = each.withColumn("left", budget - F.col("before"))
    whole = (F.col("epoch") <= F.col("reps")) | (F.col("t") <= F.col("left"))
    each = each.withColumn("cut", F.when(whole, F.lit(HIGHEST)).when(F.col("left") > 0, F.lit(None).cast("long")).otherwise(F.lit(LOWEST)))
    each = materialize(each.where(F.col("cut").isNull() | (F.col("cut") > LOWEST)))
    full = each.where("cut is not null").withColumn("last", F.lit(None).cast("long"))
    part = each.where("cut is null").join(_cuts(sized, each.where("cut is null").select("s", "b", "left")), ["s", "b"])
    size = F.greatest(F.col("total"), F.lit(1.0))
    start = (F.col("epoch") - 1 + F.col("before") / size) / F.col("reps")
    return full.unionByName(part).select("s", "b", "epoch", F.coalesce("cut", "last").alias("cut"), start.alias("start"), (F.least("t", "left") / size / F.col("reps")).alias("span"))


def _cuts(sized: DataFrame, ends: DataFrame) -> DataFrame:
    """s, b, last: the largest hash up to which a block's documents fit into what is left (one block of each source)."""
    step = 1 << HASH_BITS - RANGE_BITS
    rows = sized.join(ends, ["s", "b"]).withColumn("range", F.floor(F.col("h") / step).cast("int"))
    ranges = rows.groupBy("s", "b", "left", "range").agg(F.sum("t").alias("t"))
    place = Window.partitionBy("s", "b").orderBy("range")  # at most 2**RANGE_BITS rows
    ranges = ranges.withColumn("upto", F.sum("t").over(place)).where(F.col("upto") > F.col("left"))
    ending = ranges.groupBy("s", "b").agg(F.min(F.struct("range", "upto", "t")).alias("x"))
    ending = materialize(ending.select("s", "b", F.col("x.range").alias("range"), (F.col("x.upto") - F.col("x.t")).alias("before")))
    inside = rows.join(ending, ["s", "b", "range"])
    inside = inside.withColumn("sum", F.col("before") + F.sum("t").over(Window.partitionBy("s", "b").orderBy("h")))
    last = inside.where(F.col("sum") <= F.col("left")).groupBy("s", "b").agg(F.max("h").alias("h"))
    return ending.join(last, ["s", "b"], "left").select("s", "b", F.coalesce("h", F.col("range").cast("long") * step - 1).alias("last"))


def _reps_at_scale(by_source: DataFrame, repetition, entropy) -> DataFrame:
    """The same for more sources than the driver should hold: each step of the bisection is one aggregate."""
    have = materialize(by_source)
    top, low = have.where("t > 0").agg(F.max("t"), F.min("t")).first()
    if top is None:
        return have.select("s", F.lit(0.0).alias("total"), F.lit(1.0).alias("reps"))

    def fits(alpha: float) -> bool:
        if repetition is not None and (top / low) ** (1 - alpha) > repetition:
            return False
        if entropy is None:
            return True
        x = F.pow("t", F.lit(alpha))
        w, wl, n = have.where("t > 0").agg(F.sum(x), F.sum(x * F.log(x)), F.count("*")).first()
        return n < 2 or (math.log(w) - wl / w) / math.log(n) <= entropy

    a, b = 0.0, 1.0
    if fits(a):
        b = a
    else:
        for _ in range(STEPS):
            m = (a + b) / 2
            a, b = (a, m) if fits(m) else (m, b)
    reps = F.round(F.pow(F.lit(float(top)) / F.col("t"), F.lit(1 - b)), 9)
    return have.select("s", F.col("t").cast("double").alias("total"), F.when(F.col("t") > 0, reps).otherwise(1.0).alias("reps"))


def oracle(repetition: float, blocks: int = 256, seed: int = 7) -> str:
    """mix() over the table documents as DuckDB SQL, mix_order to nine decimals."""
    return f"""WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS s, md5(concat(coalesce(doc_id::VARCHAR, 'null'), ':{seed}')) AS m,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS t FROM documents),
e AS (SELECT *, ('0x' || substring(m, 1, {HASH_BITS // 4}))::BIGINT AS h, ('0x' || substring(m, 17, 8))::BIGINT % {blocks} AS b FROM d),
f AS (SELECT *, sum(t) OVER (PARTITION BY s, b ORDER BY h) AS upto FROM e),
by_block AS (SELECT s, b, sum(t)::BIGINT AS t FROM e GROUP BY ALL),
src AS (SELECT s, sum(t)::BIGINT AS total FROM by_block GROUP BY s),
x AS (SELECT max(total)::DOUBLE AS top, (min(total) FILTER (total > 0))::DOUBLE AS low FROM src),
alpha(k, a, z) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN top / low <= {repetition} THEN 0.0 ELSE 1.0 END::DOUBLE FROM x
  UNION ALL SELECT k + 1, CASE WHEN pow(top / low, 1 - (a + z) / 2) <= {repetition} THEN a ELSE (a + z) / 2 END, CASE WHEN pow(top / low, 1 - (a + z) / 2) <= {repetition} THEN (a + z) / 2 ELSE z END
  FROM alpha, x WHERE k < {STEPS}),
reps AS (SELECT s, total::DOUBLE AS total, CASE WHEN total > 0 THEN round(pow(top / total, 1 - z), 9) ELSE 1.0 END AS reps FROM src, x, alpha WHERE k = {STEPS}),
each AS (SELECT s, b, t, total, reps, unnest(range(1, ceil(reps)::INT + 1))::INT AS epoch FROM by_block JOIN reps USING (s)),
placed AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY s, epoch ORDER BY md5(concat_ws(':', s, b, epoch, '{seed}')), b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM each),
plan AS (SELECT s, b, epoch, reps, before, t AS block, greatest(total, 1.0) AS size, CASE WHEN epoch <= reps THEN total ELSE (reps - floor(reps)) * total END - before AS budget FROM placed)
SELECT doc_id, source, t AS n_tokens, epoch, round((epoch - 1 + before / size) / reps + least(block, budget) / size / reps * (h % 1000003) / 1000003, 9) AS mix_order
FROM f JOIN plan USING (s, b) WHERE epoch <= reps OR block <= budget OR (budget > 0 AND upto <= budget)"""
