"""Connected components over an edge table, without gathering the graph anywhere.

First ranges of nodes are joined by themselves, one task each, and only what links their roots
is left. Then alternating large-star and small-star steps: every step attaches neighbours to the
least neighbour seen, so paths shrink geometrically and stars are left. Each round writes its
edges to the shared folder, which cuts the lineage; minima are partially aggregated before the
shuffle and the joins are ordinary shuffled joins that the engine can split when skewed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize, prepare, shuffled_join

#: Graphs of at most so many edges (16 bytes each) are joined by one union-find task.
SMALL_GRAPH = 1_000_000
#: Edges of a larger graph that a task joins at once.
CHUNK = 500_000


def joined_in_task(table: pa.Table) -> pa.Table:
    """Union-find over one bounded table of edges."""
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    names, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(names.size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    # names are sorted, so the lesser number is the lesser node
    for x, y in zip(index[: a.size].tolist(), index[a.size :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return pa.table({"node": names, "component": names[[find(k) for k in range(names.size)]]})


def starred(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b). large: neighbours above a node move to its least neighbour;
    else neighbours below it, and the node itself, do."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = shuffled_join(both, least, "a")
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def chunk_roots(edges: DataFrame, n: int, chunk: int) -> DataFrame:
    """node, root, prev: the least node that each chunk of the n edges connects a node with; prev is the
    root before it among the node's roots, null for the least. Ranges of nodes keep neighbours together
    where ids tell of nearness; the order within makes a repeated task cut the same chunks."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield from joined_in_task(pa.Table.from_batches(held)).to_batches()
                held, rows = [], 0
        if rows:
            yield from joined_in_task(pa.Table.from_batches(held)).to_batches()

    prepare(edges.sparkSession)
    dealt = edges.repartitionByRange(-(-n // chunk), "a").sortWithinPartitions("a", "b")
    rows = dealt.mapInArrow(joined, "node bigint, component bigint").withColumnRenamed("component", "root")
    return rows.withColumn("prev", F.lag("root").over(Window.partitionBy("node").orderBy("root")))


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL_GRAPH, chunk: int = CHUNK) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Nodes without edges do not appear. Self-loops and repeated edges are allowed. chunk: edges that
    a task joins before the rounds; 0 leaves this out."""
    spark = edges.sparkSession
    current = materialize(spark, edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").distinct())
    n = current.count()
    if n <= small:
        prepare(spark)
        return current.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(joined_in_task, "node bigint, component bigint")
    if chunk:
        rows = materialize(spark, chunk_roots(current, n, chunk))
        discard(current)
        # a node of two chunks links their roots; the least of all nodes is a root wherever it occurs
        links = rows.where("prev <> root").select(F.col("root").alias("a"), F.col("prev").alias("b"))
        roots = connected_components(links, max_rounds, small, 0).withColumnRenamed("node", "root")
        joined = shuffled_join(rows.where("prev is null").select("node", "root"), roots, "root", "left")
        return joined.select("node", F.coalesce("component", "root").alias("component"))
    state = None
    for _ in range(max_rounds):
        last, current = current, materialize(spark, starred(starred(current, True), False))
        discard(last)
        after = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (after.n, after.s) == state:
            break
        state = (after.n, after.s)
    else:
        raise RuntimeError("components did not settle")
    ones = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ones.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
