"""Sharding by a k-d tree over document metadata, in DataFrame expressions only.

A node is split at the weighted median (weight: bytes) along its widest dimension until each
leaf is down to the target. Dimensions come from the text (length, bytes per character, lines),
scaled to a common integer range; a hash of the text breaks ties. Equal texts have equal keys
and no cut separates equal keys, so they always share a shard.

Medians are found by radix histograms: each pass sums bytes by (node, digit) and picks each node's
digit on the executors. The driver holds the tree alone, one row per node, and every row carries
its node as a column, to which the cuts of a level are joined.

Defined results: a null text has size 1 and groups with the empty text; an empty table gives no
rows; one group heavier than the target fills its leaf alone; null ids sort first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE_BITS, HASH_BITS, DIGIT = 18, 24, 14
PASSES = (SCALE_BITS + HASH_BITS) // DIGIT
DIMENSIONS = ("chars", "density", "lines")
#: Rows that share one numbering window when slots are dealt.
CELL_ROWS = 40_000


@dataclass
class Node:
    """A node of the tree: its number, the leaves below it, and two sides unless it is a leaf."""

    number: int
    leaves: int
    sides: tuple[Node, Node] | None = None

    def walk(self) -> list[Node]:
        """Leaves from left to right."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.sides is None:
                out.append(x)
            else:
                todo += [x.sides[1], x.sides[0]]
        return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, raw dimensions and tie-breaking hash of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    octets, chars = F.octet_length(text).cast("long"), F.char_length(text)
    return docs.select(
        "doc_id", (octets + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.log2(chars + F.lit(1.0)).alias("chars"),
        F.when(chars > 0, octets / chars).otherwise(F.lit(1.0)).alias("density"),
        F.log2(F.lit(1.0) + chars - F.char_length(F.translate(text, "\n", ""))).alias("lines"),
        F.pmod(F.xxhash64(text), F.lit(1 << HASH_BITS)).alias("tie"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Replace raw dimensions by integer keys: scaled value in the high bits, hash below."""
    ends = rows.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]).first()
    top = (1 << SCALE_BITS) - 1

    def key(d: str) -> Column:
        low, high = ends[f"min_{d}"], ends[f"max_{d}"]
        if low is None or high <= low:
            return F.col("tie")
        return F.floor((F.col(d) - F.lit(low)) * F.lit(top / (high - low))).cast("long") * (1 << HASH_BITS) + F.col("tie")

    return rows.select("doc_id", "size", "text_crc32", *[key(d).alias(f"key_{d}") for d in DIMENSIONS])


def small(rows: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of one row per open node, parsed from one literal; there are fewer nodes than
    two per shard."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, x, strict=True)) for x in values])
    kind = "array<struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in schema.split(", ")) + ">>"
    return F.broadcast(rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind))))


def split_level(rows: DataFrame, open_nodes: list[Node], number: int) -> DataFrame:
    """The rows (node, size, keys, ...) one level further down: every open node is split at its weighted
    median along its widest dimension, into nodes numbered from `number` on."""
    known = {x.number: x for x in open_nodes}
    inside = rows.where(F.col("node") >= min(known))
    ends = inside.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(f"key_{d}") - F.min(f"key_{d}")).alias(d) for d in DIMENSIONS])
    plan = {r.node: (max(DIMENSIONS, key=lambda d, r=r: (r[d], d)), r.bytes * (known[r.node].leaves // 2) / known[r.node].leaves) for r in ends.collect() if r.node in known}
    state = {n: (0, 0) for n in plan}
    for p in range(PASSES):
        shift = DIGIT * (PASSES - 1 - p)
        aims = small(rows, [(n, d, goal, *state[n]) for n, (d, goal) in plan.items()], "node long, dimension string, goal double, prefix long, below long")
        key = F.coalesce(*[F.when(F.col("dimension") == d, F.col(f"key_{d}")) for d in DIMENSIONS])
        digits = inside.join(aims, "node").withColumn("key", key).where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        digits = digits.groupBy("node", F.shiftright("key", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("size").alias("n"), F.first("goal").alias("goal"), F.first("below").alias("below"))
        earlier = Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        digits = digits.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("before") + F.col("n") >= F.col("goal"))
        for r in digits.groupBy("node").agg(F.min(F.struct("digit", "n", "before")).alias("at")).collect():
            # the last cut stands before or after its key, whichever leaves the sides nearer the goal
            over = p == PASSES - 1 and plan[r.node][1] - r["at"].before > r["at"].n / 2
            state[r.node] = ((state[r.node][0] << DIGIT) + r["at"].digit + over, r["at"].before)
    cuts = []
    for x in open_nodes:
        x.sides = (Node(number, x.leaves // 2), Node(number + 1, x.leaves - x.leaves // 2))
        if x.number in plan:
            cuts.append((x.number, plan[x.number][0], state[x.number][0], number))
        number += 2
    cut = small(rows, cuts, "node long, dimension string, cut long, low long")
    key = F.coalesce(*[F.when(F.col("dimension") == d, F.col(f"key_{d}")) for d in DIMENSIONS])
    side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("low") + F.when(key < F.col("cut"), 0).otherwise(1))
    return rows.join(cut, "node", "left").withColumn("node", side).select(*rows.columns)


def plan_tree(rows: DataFrame, leaves: int) -> tuple[DataFrame, Node]:
    """The rows with the leaf each falls into, and the k-d tree with the given number of leaves."""
    spark = rows.sparkSession
    root, number = Node(0, leaves), 1
    rows = materialize(spark, rows.withColumn("node", F.lit(0).cast("long")))
    while open_nodes := [x for x in root.walk() if x.leaves > 1]:
        after = materialize(spark, split_level(rows, open_nodes, number))
        discard(rows)
        rows, number = after, number + 2 * len(open_nodes)
    return rows, root


def kd_shards(docs: DataFrame, target_bytes: int | None = None, leaves: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document. target_bytes, if given, sets the
    number of leaves. Slots are gapless from 0 in each shard and dealt by cells of about
    CELL_ROWS rows, so no task numbers a whole shard."""
    rows = materialize(docs.sparkSession, keyed(materialize(docs.sparkSession, measured(docs))))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if target_bytes:
        leaves = max(1, -(-(total.bytes or 0) // target_bytes))
    rows, root = plan_tree(rows, leaves)
    cells = max(1, -(-total.n // (CELL_ROWS * leaves)))
    shards = small(rows, [(x.number, k) for k, x in enumerate(root.walk())], "node long, shard int")
    placed = rows.join(shards, "node").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("row", F.row_number().over(own) - 1)
    return numbered.join(offsets, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("row")).alias("slot"))
