"""Operator 9: URL allow and block lists as a trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and every subdomain of it when the URL's path starts with the
rule's path. The trie's inner keys are host labels from the top-level domain down; each host node holds a
second trie over whole path segments whose nodes end in the rules' last, possibly partial, segments. The
longest match wins: the deepest host, then the longest path; of two rules with the same host and path,
block wins.

The trie is broadcast. Its size follows the rule list, not the pages, and is checked: above
``max_broadcast_rules`` the rules are joined instead, by shuffling (host suffix) keys.

Defined results: null URL or one without ``://``: host and path are empty and no rule fits; URLs without
a fitting rule get ``default``; repeated rows are judged each by itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readqc.llm.store import materialize

MAX_BROADCAST_RULES = 200_000
#: Parts into which each join key of pages and rules is dealt, as all pages of a top-level domain share some.
SALT = 16
#: The rules of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are [children by label, path trie or None]; path nodes are [children by segment, {last part: (verdict, rule)}, lengths of last parts]."""

    def __init__(self, rules) -> None:
        self.root: list = [{}, None]
        for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):  # block comes last and stays
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node[0].setdefault(label, [{}, None])
            at = node[1] = node[1] or [{}, {}, []]
            *whole, last = path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}, []])
            at[1][last] = (verdict, host.lower() + path)
            at[2][:] = sorted({len(x) for x in at[1]}, reverse=True)

    def match(self, host: str, path: str):
        """(verdict, rule) of the longest fitting rule, or None."""
        node, found, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None:
                found = self._path(node[1], segments) or found
        return found

    @staticmethod
    def _path(at: list, segments: list):
        found = None
        for i, segment in enumerate(segments):
            rest = segment if i == len(segments) - 1 else segment + "/"
            for n in at[2]:
                if n <= len(rest) and (hit := at[1].get(rest[:n])):
                    found = hit
                    break
            at = at[0].get(segment) if i < len(segments) - 1 else None
            if at is None:
                break
        return found


def _judge(shared, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            hits = [trie.match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            columns = [*batch.columns, pa.array([h and h[1] for h in hits], pa.string()), pa.array([h[0] if h else default for h in hits], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules=RULES, default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages. rules: (verdict, host, path) rows or a DataFrame of them."""
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        few = rules.limit(max_broadcast_rules + 1).collect()
        if len(few) > max_broadcast_rules:
            return _joined(urls, rules, default)
        rules = [tuple(r) for r in few]
    elif len(rules) > max_broadcast_rules:
        return _joined(urls, spark.createDataFrame(list(rules), "verdict string, host string, path string"), default)
    shared = spark.sparkContext.broadcast(Trie(rules))
    kind = dict(pages.dtypes)["page_id"]
    return urls.mapInArrow(_judge(shared, default), f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a shuffle: each page's host suffixes meet the rules of that host; the longest fitting one stays."""
    rules = rules.toDF("_verdict", "_host", "_path").withColumn("_host", F.lower("_host"))
    best = Window.partitionBy("_host", "_path").orderBy(F.desc("_verdict"))
    rules = rules.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    # one level of the trie at a time: a rule's host and its path up to the last slash is the join key
    cut = lambda c: F.regexp_replace(c, "[^/]*$", "")
    rules = rules.withColumn("_stem", cut(F.col("_path")))
    labels = F.split("host", r"\.")
    parts = F.split("path", "/")
    keyed = materialize(urls.withColumn("_row", F.monotonically_increasing_id()))  # read twice, numbered once
    keys = keyed.select("_row", "path", F.posexplode(labels).alias("_i", "_l"), labels.alias("_labels"), parts.alias("_parts"))
    keys = keys.select("_row", "path", F.array_join(F.slice("_labels", F.col("_i") + 1, F.size("_labels")), ".").alias("_host"), F.explode(F.sequence(F.lit(0), F.size("_parts") - 1)).alias("_j"), "_parts")
    keys = keys.select("_row", "path", "_host", F.when(F.col("_j") == 0, "").otherwise(F.concat(F.array_join(F.slice("_parts", 1, F.col("_j")), "/"), F.lit("/"))).alias("_stem"))
    keys = keys.withColumn("_salt", F.pmod("_row", F.lit(SALT)).cast("int"))
    rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hits = keys.join(rules, ["_host", "_stem", "_salt"]).where(F.col("path").startswith(F.col("_path")))
    order = F.struct(F.length("_host"), F.length("_path"), F.concat("_host", "_path").alias("rule"), "_verdict")
    found = hits.groupBy("_row").agg(F.max(order).alias("_m")).select("_row", F.col("_m.rule").alias("rule"), F.col("_m._verdict").alias("verdict"))
    return keyed.join(found, "_row", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, v, h || p AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
