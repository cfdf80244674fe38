"""Connected components by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.runtime import cut


def _local_stars(batches):
    """Edges of one partition contracted to stars, by union-find over bounded batches."""
    for b in batches:
        up: dict[int, int] = {}

        def find(x):
            root = x
            while up.setdefault(root, root) != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
        keys = list(up)
        roots = [find(k) for k in keys]
        own = [(k, r) for k, r in zip(keys, roots) if k != r]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    edges: (u long, v long). Alternating large and small stars, each round written to the
    shared checkpoint folder, until nothing changes; batches are contracted locally first.
    """
    e = edges.filter(F.col("u") != F.col("v")).select("u", "v").mapInArrow(_local_stars, "u long, v long").distinct()
    e, before = cut(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        state = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state["n"], state["x"]) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (state["n"], state["x"])
