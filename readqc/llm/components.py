"""Connected components of a distributed edge table.

Large-star and small-star steps alternate (each node hands its larger, then its smaller neighbours to the least
one it knows) until nothing changes; a union-find over each task's own edges shortens every round. The table of
a round is written to the shared folder. Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readqc.llm.store import materialize

#: Edges that one union-find takes at once.
BLOCK = 500_000


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component, for edges between nodes 0..n-1, by hooking and pointer jumping."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    for batch in [*_numpy(batches), None]:
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(len(x[0]) for x in held) >= BLOCK):
            a, b = (np.concatenate(x) for x in zip(*held))
            held = []
            nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            root = roots(place[: len(a)], place[len(a) :], len(nodes))
            child = root != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["v", "r"])


def _numpy(batches):
    for batch in batches:
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy()


def components(edges: DataFrame) -> DataFrame:
    """v, r for every node of edges (two columns of longs, none null): r is the least node of v's component."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = lambda rows: materialize(rows.repartition(n, "v").mapInArrow(_contract, "v long, r long"))
    # no contraction before the shuffle: edges often come out of Python, and two Python steps in a task take two workers
    now = forest(edges.toDF("v", "r"))
    said = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "r").cast("decimal(38,0)"))).first())
        if state == said:
            break
        said = state
        # the least neighbours are tables of their own, so that Spark can split a join's hot node
        both = now.unionByName(now.select(F.col("r").alias("v"), F.col("v").alias("r")))
        least = materialize(both.groupBy("v").agg(F.min("r").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = both.join(least, "v").where(F.col("r") > F.col("v")).select(F.col("r").alias("v"), F.col("m").alias("r"))
        large = materialize(large)
        low = materialize(large.groupBy("v").agg(F.min("r").alias("m")))
        small = large.join(low, "v").where(F.col("r") > F.col("m")).select(F.col("r").alias("v"), F.col("m").alias("r")).unionByName(low.select("v", F.col("m").alias("r")))
        now = forest(small.where(F.col("v") != F.col("r")))
    return now.unionByName(now.select(F.col("r").alias("v"), F.col("r")).distinct())
