"""Watertightness of runs: vertex degrees, open ends, stitching and the audit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import GridOptions
from ..functions import vectors as v
from ..runtime import materialize, prepare, shuffled_join
from .graph import connected_components

#: Rounds of mutually nearest ends before the rest is paired group by group.
PAIR_ROUNDS = 4


def with_ids(runs: DataFrame) -> DataFrame:
    """Number runs by their content, so that ties break alike on every layout."""
    name = [F.round(c, 6) for p in "ab" for c in v.of(p)]
    return runs.withColumn("run_id", F.xxhash64("kind", "source", *[F.coalesce(c, F.lit(-1)) for c in ("grid_id", "killer_id", "comp")], *name))


def endpoints(runs: DataFrame, eps: float) -> DataFrame:
    """Both ends of every run with their vertex (coordinates in units of eps)."""
    both = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), *v.named(v.of(p), "p")) for e, p in enumerate("ab")]))
    rows = runs.select("*", both.alias("_e")).select(*[c for c in runs.columns], F.col("_e.end").alias("end"), *[F.col(f"_e.p{k}") for k in "xyz"])
    return rows.select("*", *[F.floor(F.col(f"p{k}") / eps + 0.5).alias(f"k{k}") for k in "xyz"])


def vertex_degrees(runs: DataFrame, eps: float = 0.05) -> DataFrame:
    return endpoints(runs, eps).groupBy("kx", "ky", "kz").agg(F.count("*").alias("degree"))


def open_ends(runs: DataFrame, eps: float = 0.05) -> DataFrame:
    """Ends at vertices that only one run touches (a three-way junction is closed)."""
    rows = endpoints(runs, eps)
    one = rows.groupBy("kx", "ky", "kz").agg(F.count("*").alias("degree")).where("degree = 1")
    return shuffled_join(rows, one.drop("degree"), ["kx", "ky", "kz"])


def audit(runs: DataFrame, eps: float = 0.05, samples: int = 12) -> DataFrame:
    """One row per kind and one for all: runs, open ends and up to `samples` of their places."""
    labelled = runs.withColumn("scope", F.explode(F.array(F.col("kind"), F.lit("all"))))
    ends_ = endpoints(labelled, eps)
    degree = ends_.groupBy("scope", "kx", "ky", "kz").agg(F.count("*").alias("degree"), F.min(F.struct("px", "py", "pz")).alias("at")).where("degree = 1")
    few = degree.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("kx", "ky", "kz")))
    opened = few.groupBy("scope").agg(F.count("*").alias("open_ends"), F.sort_array(F.collect_list(F.when(F.col("n") <= samples, F.struct("n", "at")))).alias("sample"))
    total = labelled.groupBy("scope").agg(F.count("*").alias("runs"))
    return shuffled_join(total, opened, "scope", "left").select("scope", "runs", F.coalesce("open_ends", F.lit(0)).alias("open_ends"), F.coalesce(F.transform("sample", lambda s: s["at"]), F.array()).alias("sample"))


def stitch_candidates(ends_: DataFrame, gap: float) -> DataFrame:
    """Pairs of open ends within the gap; i < j by vertex. Buckets as wide as the gap bound the join."""
    # an open end is the only one at its vertex, so the vertex names it
    rows = ends_.withColumn("key", F.struct("kx", "ky", "kz"))
    cell = [F.floor(F.col(f"p{k}") / gap) for k in "xyz"]
    left = rows.select(F.col("key").alias("i"), *v.named(v.of("p"), "p"), *[c.alias(f"g{k}") for c, k in zip(cell, "xyz", strict=True)])
    spread = F.explode(F.array(*[F.struct(*[F.lit(o).alias(k) for o, k in zip((x, y, z), "xyz", strict=True)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]))
    right = rows.select(F.col("key").alias("j"), *v.named(v.of("p"), "q"), *[c.alias(f"h{k}") for c, k in zip(cell, "xyz", strict=True)], spread.alias("o"))
    right = right.select("j", "qx", "qy", "qz", *[(F.col(f"h{k}") + F.col(f"o.{k}")).alias(f"g{k}") for k in "xyz"])
    pairs = shuffled_join(left, right, ["gx", "gy", "gz"]).where("i < j")
    pairs = pairs.withColumn("d", v.length(v.sub(v.of("p"), v.of("q"))))
    return pairs.where((F.col("d") <= gap) & (F.col("d") > 1e-6)).select("i", "j", "d")


def stitch_pairs(candidates: DataFrame) -> DataFrame:
    """Greedy nearest pairing under the order (d, i, j), as rounds of mutually nearest ends.

    The least candidate of all is mutual in every round, so the rounds end. Where a round has few
    pairs, as along a chain of falling gaps, the ends that candidates connect are paired group by
    group instead."""
    spark = candidates.sparkSession
    left = materialize(spark, candidates.select(F.round("d", 9).alias("o"), "d", "i", "j"))
    chosen: DataFrame | None = None
    for _ in range(PAIR_ROUNDS):
        if left.isEmpty():
            break
        sides = left.select(F.col("i").alias("e"), "o", "d", "i", "j").unionByName(left.select(F.col("j").alias("e"), "o", "d", "i", "j"))
        best = sides.groupBy("e").agg(F.min(F.struct("o", "i", "j", "d")).alias("b"))
        mutual = best.groupBy("b").agg(F.count("*").alias("n")).where("n = 2").select("b.o", "b.d", "b.i", "b.j")
        mutual = materialize(spark, mutual)
        chosen = mutual if chosen is None else chosen.unionByName(mutual)
        used = mutual.select(F.col("i").alias("e")).unionByName(mutual.select(F.col("j").alias("e")))
        for e in "ij":
            left = shuffled_join(left, used.withColumnRenamed("e", e), e, "left_anti")
        left = materialize(spark, left.select("o", "d", "i", "j"))
    rest = greedy_pairs(left)
    return rest if chosen is None else chosen.unionByName(rest)


def greedy_pairs(candidates: DataFrame) -> DataFrame:
    """The same pairing, one group of ends that candidates connect at a time."""
    spark = candidates.sparkSession
    name = lambda e: F.xxhash64(*[F.col(f"{e}.k{k}") for k in "xyz"])
    roots = connected_components(candidates.select(name("i").alias("a"), name("j").alias("b")))
    flat = candidates.select("o", "d", *[F.col(f"{e}.k{k}").alias(f"{e}{k}") for e in "ij" for k in "xyz"], name("i").alias("node"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["d"]).to_pylist()
        order = sorted(range(len(rows)), key=lambda n: (rows[n]["o"], *(rows[n][f"{e}{k}"] for e in "ij" for k in "xyz")))
        used, keep = set(), []
        for n in order:
            i, j = (tuple(rows[n][f"{e}{k}"] for k in "xyz") for e in "ij")
            if i not in used and j not in used:
                used |= {i, j}
                keep.append(n)
        return table.take(pa.array(keep, pa.int64())).drop_columns(["node", "component"])

    prepare(spark)
    ends = [f"{e}{k}" for e in "ij" for k in "xyz"]
    kept = shuffled_join(flat, roots, "node").select("node", "component", "o", "d", *ends).groupBy("component").applyInArrow(run, "o double, d double, " + ", ".join(f"{c} bigint" for c in ends))
    return kept.select("o", "d", *[F.struct(*[F.col(f"{e}{k}").alias(f"k{k}") for k in "xyz"]).alias(e) for e in "ij"])


def tee_targets(ends_: DataFrame, runs: DataFrame, gap: float) -> DataFrame:
    """For each open end the nearest other run that passes within the gap at an inner point:
    end key, run_id, t and d. Runs are copied to the buckets around them, ends to their own."""
    pitch = gap * 2
    low = [F.floor((F.least(F.col(f"a{k}"), F.col(f"b{k}")) - gap) / pitch) for k in "xz"]
    high = [F.floor((F.greatest(F.col(f"a{k}"), F.col(f"b{k}")) + gap) / pitch) for k in "xz"]
    spread = runs.select("run_id", *v.named(v.of("a"), "a"), *v.named(v.of("b"), "b"), F.explode(F.sequence(low[0], high[0])).alias("gx"), low[1].alias("_l"), high[1].alias("_h"))
    spread = spread.withColumn("gz", F.explode(F.sequence("_l", "_h"))).drop("_l", "_h")
    rows = ends_.select(F.struct("kx", "ky", "kz").alias("e"), F.col("run_id").alias("own"), *v.named(v.of("p"), "p"), F.floor(F.col("px") / pitch).alias("gx"), F.floor(F.col("pz") / pitch).alias("gz"))
    pairs = shuffled_join(rows, spread, ["gx", "gz"]).where("own <> run_id")
    ab = v.sub(v.of("b"), v.of("a"))
    size = v.dot(ab, ab)
    t = v.clamp(v.dot(v.sub(v.of("p"), v.of("a")), ab) / size, 0.0, 1.0)
    pairs = pairs.where(size > 1e-6).withColumn("t", t).where("t > 0.02 and t < 0.98")
    at = v.add(v.of("a"), v.scale(ab, F.col("t")))
    pairs = pairs.withColumn("d", v.length(v.sub(at, v.of("p")))).where(F.col("d") < gap)
    # of equally near runs the one cut earliest, then the one that begins least
    place = F.struct(F.round("d", 9).alias("o"), F.round("t", 9).alias("p"), *[f"{p}{k}" for p in "ab" for k in "xyz"], "run_id", "t", "d")
    best = pairs.groupBy("e").agg(F.min(place).alias("b"))
    return best.select("e", "b.run_id", "b.t", "b.d")


def stitch(runs: DataFrame, options: GridOptions = GridOptions()) -> DataFrame:
    """Runs with open ends closed: connectors between mutually nearest ends, then connectors onto
    the inside of other runs, which are split there in the order of t. Every end looks at the runs
    as they were before any split."""
    spark = runs.sparkSession
    runs = materialize(spark, with_ids(runs))
    opened = materialize(spark, open_ends(runs, options.vertex_eps))
    paired = materialize(spark, stitch_pairs(stitch_candidates(opened, options.stitch_gap)))
    info = opened.select(F.struct("kx", "ky", "kz").alias("e"), "run_id", "kind", "comp", *v.named(v.of("p"), "p"), *v.named(v.of("o"), "o"))
    left = info.select(F.col("e").alias("i"), F.col("kind").alias("kind_i"), "comp", *v.named(v.of("p"), "a"), *v.named(v.of("o"), "o"))
    right = info.select(F.col("e").alias("j"), F.col("kind").alias("kind_j"), *v.named(v.of("p"), "b"))
    both = F.when((F.col("kind_i") == "wall") & (F.col("kind_j") == "wall"), "wall").otherwise("dropoff")
    null = F.lit(None).cast("bigint")
    rest = ["grid_id", "killer_id"]
    bridges = shuffled_join(shuffled_join(paired, left, "i"), right, "j").select(both.alias("kind"), F.lit("stitch").alias("source"), *[null.alias(c) for c in rest], "comp", *[f"{p}{k}" for p in "abo" for k in "xyz"], F.lit(0).cast("bigint").alias("cells"), F.col("d").alias("length"))

    used = paired.select(F.col("i").alias("e")).unionByName(paired.select(F.col("j").alias("e")))
    lone = shuffled_join(opened, used, F.struct("kx", "ky", "kz") == F.col("e"), "left_anti")
    tees = materialize(spark, tee_targets(lone, runs, options.stitch_gap))
    cuts = tees.groupBy("run_id").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    whole = shuffled_join(runs, cuts, "run_id", "left").withColumn("ts", F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    spans = F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda n: F.struct(F.element_at("ts", n).alias("s"), F.element_at("ts", n + 1).alias("e")))
    split = whole.withColumn("_p", F.explode(spans))
    ab = v.sub(v.of("b"), v.of("a"))
    whole_run = (F.col("_p.s") == 0.0) & (F.col("_p.e") == 1.0)
    begin = tuple(F.when(F.col("_p.s") == 0.0, x).otherwise(x + d * F.col("_p.s")) for x, d in zip(v.of("a"), ab, strict=True))
    stop = tuple(F.when(F.col("_p.e") == 1.0, y).otherwise(x + d * F.col("_p.e")) for x, y, d in zip(v.of("a"), v.of("b"), ab, strict=True))
    pieces = split.select("kind", "source", *rest, "comp", *v.named(begin, "a"), *v.named(stop, "b"), "ox", "oy", "oz", F.when(whole_run, F.col("cells")).alias("cells"))
    pieces = pieces.withColumn("length", v.length(v.sub(v.of("b"), v.of("a"))))

    target = runs.select(F.col("run_id").alias("to_run"), *v.named(v.of("a"), "s"), *v.named(v.of("b"), "t_"))
    joint = shuffled_join(shuffled_join(tees, info.drop("run_id"), "e"), target, F.col("run_id") == F.col("to_run"))
    at = v.add(v.of("s"), v.scale(v.sub(v.of("t_"), v.of("s")), F.col("t")))
    onto = joint.select("kind", F.lit("stitch").alias("source"), *[null.alias(c) for c in rest], "comp", *v.named(v.of("p"), "a"), *v.named(at, "b"), "ox", "oy", "oz", F.lit(0).cast("bigint").alias("cells"), F.col("d").alias("length"))
    return pieces.unionByName(bridges).unionByName(onto)
