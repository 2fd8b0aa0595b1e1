"""Deterministic scenes derived from the relational test tables, and the queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators.octree import Root

#: World cube of the box scene, on whole units so that no face lies on a cell border.
BOX_ROOT = Root(-8.0, -8.0, -8.0, 1.0, 7)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return rows.withColumn("h", (F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % 100)


def world_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface samples on a world lattice with three levels: sid, p, clearance, blocked, slope."""
    k, c, h = F.col("o_orderkey"), F.col("o_custkey"), F.col("h")
    return orders(spark, sf_dir).where("h < 72").select(
        k.alias("sid"), (k % 100 + 0.5).alias("px"), F.when(h < 50, 0.0).when(h < 64, 1.5).otherwise(5.0).alias("py"), (F.expr("o_orderkey div 100") + 0.5).alias("pz"),
        (1.0 + c % 8).alias("clearance"), (c % 16).cast("int").alias("blocked"), ((c * 11 + k * 3) % 70).cast("double").alias("slope"),
    )


def grid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of the part-aligned grids with their state and frame."""
    rows = orders(spark, sf_dir).withColumn("grid_id", F.expr("o_orderkey div 256")).withColumn("ui", F.col("o_orderkey") % 16).withColumn("vi", F.expr("(o_orderkey % 256) div 16"))
    g = F.col("grid_id")
    turned = g % 5 == 3
    rows = rows.withColumn("ux", F.when(turned, 0.6).otherwise(1.0)).withColumn("uz", F.when(turned, 0.8).otherwise(0.0))
    rows = rows.withColumn("ox", (g % 8) * 16 + F.when(turned, 0.013).otherwise(0.0)).withColumn("oz", F.expr("grid_id div 8") * 16 + F.when(turned, 0.007).otherwise(0.0))
    rows = rows.withColumn("py", F.when(g % 7 == 6, 3.0).when(g % 7 == 2, 0.125).otherwise(0.0))
    s, t = F.col("ui") + 0.5, F.col("vi") + 0.5
    rows = rows.withColumn("px", F.col("ox") + s * F.col("ux") - t * F.col("uz")).withColumn("pz", F.col("oz") + s * F.col("uz") + t * F.col("ux"))
    block = (F.expr("ui div 4") * 5 + F.expr("vi div 4") * 3 + g * 2) % 9
    h = F.col("h")
    state = F.when(block == 0, "dead").when(block == 1, "absent").when(h < 94, "live").when(h < 97, "dead").otherwise("absent")
    zero = F.lit(0.0)
    return rows.select(
        F.col("o_orderkey").alias("cell_id"), "grid_id", "ui", "vi", "px", "py", "pz", *v.named((F.col("ux"), zero, F.col("uz")), "u"), *v.named((-F.col("uz"), zero, F.col("ux")), "v"),
        *v.named((zero, F.lit(1.0), zero), "n"), state.alias("state"), (g * 4 + F.expr("ui div 8") * 2 + F.expr("vi div 8")).alias("killer_id"),
    )


def live_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_samples(spark, sf_dir).where("state = 'live'").drop("state", "killer_id")


def dead_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_samples(spark, sf_dir).where("state = 'dead'").select("cell_id", "grid_id", "ui", "vi", "px", "py", "pz", "killer_id")


def foot_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint samples of the killers; of two at one place the lower, then the lesser id, stays."""
    rows = dead_cells(spark, sf_dir).select(F.col("killer_id").alias("part_id"), F.floor("px").alias("ui"), F.floor("pz").alias("vi"), "cell_id", F.col("px").alias("bx"), (F.col("py") + F.when(F.col("cell_id") % 4 == 0, 2.5).otherwise(0.5)).alias("by"), F.col("pz").alias("bz"))
    best = rows.groupBy("part_id", "ui", "vi").agg(F.min(F.struct("by", "cell_id", "bx", "bz")).alias("f"))
    return best.select("part_id", "ui", "vi", "f.bx", "f.by", "f.bz", *v.named(v.lit(1, 0, 0), "u"), *v.named(v.lit(0, 0, 1), "v"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis-aligned block parts from the suppliers."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("s"))
    s = F.col("s")
    size = (2 * (1.5 + s % 4), 2 * (0.5 + (s % 3) * 0.5), 2 * (1.5 + F.expr("(s div 4) % 4")))
    centre = ((s * 37) % 56 + 4.25, ((s * 11) % 4) * 3 + 1.25, (s * 53) % 56 + 4.25)
    return rows.select(
        s.alias("part_id"), F.when(s % 9 == 0, F.concat(F.lit("ClipRamp-"), s.cast("string"))).otherwise(F.concat(F.lit("Block-"), s.cast("string"))).alias("name"),
        F.lit("Part").alias("class"), F.lit("Block").alias("shape"), F.lit(True).alias("can_collide"), F.lit(False).alias("is_character"),
        *v.named(tuple(c.cast("double") for c in centre), "p"), *v.named(v.lit(1, 0, 0), "r"), *v.named(v.lit(0, 1, 0), "u"), *v.named(v.lit(0, 0, 1), "l"), *v.named(tuple(c.cast("double") for c in size), "s"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing points over the box scene: sid, p, and q at half height."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return orders(spark, sf_dir).select(
        k.alias("sid"), (k % 60 + 0.5).alias("px"), ((c % 4) * 3.0 + 1.0).alias("py"), (F.expr("(o_orderkey div 60) % 60") + 0.5).alias("pz"),
        (k % 60 + 0.5).alias("qx"), ((c % 12) + 0.5).alias("qy"), (F.expr("(o_orderkey div 60) % 60") + 0.5).alias("qz"),
    )


#: Two small blocks that give the scene of solids its extent at every scale.
ANCHORS = ((-1, 0.5, 60.5), (-2, 60.5, 0.5))


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of three kinds: octahedra (no readable shape), upright blocks and blocks turned by a 3-4-5
    angle. Centres lie off every border, so no test depends on rounding."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("bigint").alias("s"))
    s = F.col("s")
    kind = s % 3
    centre = ((s * 29) % 50 + 4.263, ((s * 7) % 4) * 4 + 2.25, (s * 43) % 50 + 4.271)
    size = [F.when(kind == 0, F.lit(3.0) + s % 4 * 2).otherwise(x.cast("double")) for x in (3.0 + s % 4 * 2, 1.0 + s % 3, 3.0 + F.expr("(s div 4) % 3") * 2)]
    turned = lambda a, b: F.when(kind == 2, a).otherwise(b).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    parts = rows.select(
        s.alias("part_id"), F.concat(F.lit("Solid-"), s.cast("string")).alias("name"), F.lit("Part").alias("class"), F.when(kind != 0, "Block").alias("shape"),
        F.lit(True).alias("can_collide"), F.lit(False).alias("is_character"), *v.named(tuple(c.cast("double") for c in centre), "p"),
        *v.named((turned(0.6, 1.0), zero, turned(0.8, 0.0)), "r"), *v.named((zero, one, zero), "u"), *v.named((turned(-0.8, 0.0), zero, turned(0.6, 1.0)), "l"), *v.named(tuple(size), "s"),
    )
    fixed = [(k, f"Anchor{k}", "Part", "Block", True, False, x, 0.5, z, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0) for k, x, z in ANCHORS]
    return parts.unionByName(spark.createDataFrame(fixed, parts.schema))


def solid_triangles(parts: DataFrame) -> DataFrame:
    """The eight faces of every octahedron: part_id, a, b, c."""
    tips = F.explode(F.array(*[F.struct(*[F.lit(float(t)).alias(k) for t, k in zip((x, y, z), "xyz", strict=True)]) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]))
    rows = parts.where("shape is null").select("part_id", *[f"p{k}" for k in "xyz"], (F.col("sx") * 0.5).alias("reach"), tips.alias("t"))
    corner = lambda k: [(F.col(f"p{x}") + (F.col(f"t.{x}") * F.col("reach") if x == k else F.lit(0.0))) for x in "xyz"]
    return rows.select("part_id", *v.named(tuple(corner("x")), "a"), *v.named(tuple(corner("y")), "b"), *v.named(tuple(corner("z")), "c"))


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance tree with models, some of which have a humanoid: instance_id, parent_id, class."""
    k = F.col("o_orderkey")
    kind = F.when(k % 41 == 5, "Humanoid").when(k % 5 == 1, "Model").otherwise("Part")
    return orders(spark, sf_dir).select(k.alias("instance_id"), F.when(k > 0, F.expr("(o_orderkey - 1) div 3")).alias("parent_id"), F.when(k == 0, "Workspace").otherwise(kind).alias("class"))


def crossing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lines with whole points and directions, some of them parallel."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    whole = {"ax": k % 10, "az": c % 10, "adx": 1 + k % 3, "adz": c % 4 - 1, "bx": k * 7 % 10, "bz": c * 3 % 10, "bdx": c % 3 - 1, "bdz": 1 + k % 2}
    return orders(spark, sf_dir).select(k.alias("pair_id"), *[x.cast("double").alias(n) for n, x in whole.items()])


def grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the grids; some are marked as fallback, some have no axes."""
    g = F.col("grid_id")
    frame = grid_samples(spark, sf_dir).select("grid_id", *[f"{a}{x}" for a in "uvn" for x in "xyz"]).distinct()
    lost = g % 11 == 4
    return frame.select("grid_id", *[F.when(~lost, F.col(f"{a}{x}")).alias(f"{a}{x}") for a in "uv" for x in "xyz"], "nx", "ny", "nz", F.when(g % 7 != 0, g % 6 == 5).alias("fallback"))
