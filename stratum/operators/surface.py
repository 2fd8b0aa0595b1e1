"""Walkable surface of a part scene: scan filter, surface samples by ray joins, part-aligned grids
with their killed samples, and footprints of the parts that kill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FloorOptions, GridOptions
from ..functions import geometry as g
from ..functions import vectors as v
from ..runtime import discard, materialize, shuffled_join
from .bucket import copies, least_but, two_least
from .octree import Root, build, in_solid, is_block, leaf_boxes

#: Width of the horizontal buckets that vertical rays and boxes meet in.
PITCH = 4.0
BOX = [f"{a}{k}" for a in "pruls" for k in "xyz"]


def characters(instances: DataFrame) -> DataFrame:
    """instance_id of everything below a model that has a humanoid child. instances: instance_id,
    parent_id, class. Climbs by pointer jumping until every pointer has left the tree, so depth
    costs a logarithm of joins; instances that are their own ancestors are an error."""
    spark = instances.sparkSession
    models = instances.where("class = 'Humanoid'").select(F.col("parent_id").alias("instance_id")).distinct()
    models = shuffled_join(models, instances.where("class = 'Model'").select("instance_id"), "instance_id")
    marked = shuffled_join(instances.select("instance_id", "parent_id"), models.select(F.col("instance_id").alias("parent_id"), F.lit(True).alias("hit")), "parent_id", "left")
    marked = materialize(spark, marked.select("instance_id", F.col("parent_id").alias("up"), F.coalesce("hit", F.lit(False)).alias("hit")))
    for _ in range(64):
        climbing = marked.where("up is not null")
        if climbing.isEmpty():
            return marked.where("hit").select("instance_id")
        above = marked.select(F.col("instance_id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("more"))
        after = shuffled_join(climbing, above, "up", "left").select("instance_id", F.col("next").alias("up"), (F.col("hit") | F.coalesce("more", F.lit(False))).alias("hit"))
        # rows that have arrived would all meet under one null key
        after = materialize(spark, after.unionByName(marked.where("up is null")))
        discard(marked)
        marked = after
    raise ValueError("instances that are their own ancestors")


def gather_parts(parts: DataFrame, options: FloorOptions = FloorOptions()) -> DataFrame:
    """Collidable parts that are no terrain, no character and no huge ground slab. The flags are
    plain columns, so the filter reaches the Parquet scan."""
    wide = F.greatest(F.col("sx"), F.col("sz"))
    return parts.where(F.col("can_collide") & (F.col("class") != "Terrain") & ~F.col("is_character") & (wide <= options.max_ground_footprint))


def spread_boxes(parts: DataFrame, extra: float = 0.0, more: tuple[str, ...] = ()) -> DataFrame:
    """Copy each box to every horizontal bucket that its bounding box touches."""
    half = g.box_half(v.of("r"), v.of("u"), v.of("l"), v.of("s"))
    span = lambda k, i: F.sequence(F.floor((F.col(f"p{k}") - half[i] - extra) / PITCH), F.floor((F.col(f"p{k}") + half[i] + extra) / PITCH))
    rows = parts.select("part_id", "name", *more, *[F.col(c).alias(f"B{c}") for c in BOX], F.explode(span("x", 0)).alias("bx"), span("z", 2).alias("_z"))
    return rows.select("*", F.explode("_z").alias("bz")).drop("_z")


def first_hits(rays: DataFrame, boxes: DataFrame, key: list[str], direction: v.Vec, reach) -> DataFrame:
    """First box that each vertical ray (q) enters: key, part_id, name, t, normal h; ties by part_id."""
    rows = rays.withColumn("bx", F.floor(F.col("qx") / PITCH)).withColumn("bz", F.floor(F.col("qz") / PITCH)).join(boxes, ["bx", "bz"])
    axes = (v.of("Br"), v.of("Bu"), v.of("Bl"))
    t, face = g.ray_entry(v.of("q"), direction, reach, v.of("Bp"), axes, v.scale(v.of("Bs"), 0.5))
    rows = rows.withColumn("t", t).withColumn("face", face).where("t is not null")
    axis = tuple(F.when(F.col("face") == 0, a).when(F.col("face") == 1, b).otherwise(c) for a, b, c in zip(*axes, strict=True))
    turn = F.when(v.dot(axis, direction) > 0, -1.0).otherwise(1.0)
    best = rows.groupBy(*key).agg(F.min_by(F.struct("part_id", "name", "t", *v.named(v.scale(axis, turn), "h")), F.struct(F.round("t", 9), "part_id")).alias("b"))
    return best.select(*key, "b.*")


def extract(parts: DataFrame, leaves: DataFrame, root: Root, options: FloorOptions = FloorOptions()) -> DataFrame:
    """Surface samples: every open unit cell on top of a leaf, dropped onto the first box below, kept
    by slope (or by name), with the headroom above. Rows: depth, ix, iy, iz, i, j, p, n, slope,
    clearance, part_id. Samples are not deduplicated and headroom never filters."""
    boxed = leaf_boxes(leaves, root)
    cells = boxed.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor(F.col("half") * 2).cast("int") - 1)))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("half") * 2).cast("int") - 1)))
    top = F.col("cy") + F.col("half")
    key = ["depth", "ix", "iy", "iz", "i", "j"]
    cells = cells.select(*key, "half", (F.col("cx") - F.col("half") + 0.5 + F.col("i")).alias("qx"), top.alias("top"), (F.col("cz") - F.col("half") + 0.5 + F.col("j")).alias("qz"))
    shut = in_solid(cells.select(*key, "qx", (F.col("top") + 0.5).alias("qy"), "qz"), leaves, root).select(*key)
    rays = cells.join(shut, key, "left_anti").select(*key, "qx", (F.col("top") + 1.0).alias("qy"), "qz", (F.col("half") * 2 + 2).alias("reach"))
    boxes = spread_boxes(parts)
    down = first_hits(rays.select("*"), boxes, [*key, "qx", "qy", "qz"], v.lit(0, -1, 0), F.col("reach"))
    slope = F.degrees(F.acos(v.clamp(F.col("hy"), -1.0, 1.0)))
    kept = down.withColumn("slope", slope).where((F.col("slope") <= options.max_slope) | F.contains("name", F.lit(options.always_walkable)))
    kept = kept.select(*key, F.col("qx").alias("px"), (F.col("qy") - F.col("t")).alias("py"), F.col("qz").alias("pz"), *[F.col(f"h{k}").alias(f"n{k}") for k in "xyz"], "slope", "part_id")
    kept = materialize(parts.sparkSession, kept)
    up = first_hits(kept.select(*key, F.col("px").alias("qx"), (F.col("py") + 0.15).alias("qy"), F.col("pz").alias("qz")), boxes, key, v.lit(0, 1, 0), F.lit(options.clear_cap))
    return kept.join(up.select(*key, F.col("t").alias("clearance")), key, "left").withColumn("clearance", F.coalesce("clearance", F.lit(options.clear_cap)))


def bake_floor(parts: DataFrame, triangles: DataFrame | None = None, options: FloorOptions = FloorOptions()) -> tuple[DataFrame, DataFrame, Root]:
    """Scan filter, octree and surface samples in one call: samples, leaves, root."""
    scene = materialize(parts.sparkSession, gather_parts(parts, options))
    leaves, root = build(scene, triangles, options.leaf, options.margin)
    return extract(scene, leaves, root, options), leaves, root


def top_faces(parts: DataFrame) -> DataFrame:
    """Part-aligned frames: for a block the face that looks up most (ties: up, right, look axis), its
    in-plane axes and extents; other shapes fall back to the world frame over their bounds."""
    axes = {"r": v.of("r"), "u": v.of("u"), "l": v.of("l")}
    steep = {a: F.abs(axes[a][1]) for a in axes}
    pick = F.when((steep["u"] >= steep["r"]) & (steep["u"] >= steep["l"]), "u").when(steep["r"] >= steep["l"], "r").otherwise("l")
    size = {"r": F.col("sx"), "u": F.col("sy"), "l": F.col("sz")}
    block = is_block(F.col("shape"))
    half = g.box_half(v.of("r"), v.of("u"), v.of("l"), v.of("s"))
    plane = {"u": ("r", "l"), "r": ("u", "l"), "l": ("r", "u")}

    def choose(of) -> v.Vec | object:
        return F.when(F.col("top") == "u", of("u")).when(F.col("top") == "r", of("r")).otherwise(of("l"))

    rows = parts.withColumn("top", pick)
    sign = lambda a: F.when(axes[a][1] < 0, -1.0).otherwise(1.0)
    world = {"u": (1.0, 0.0, 0.0), "v": (0.0, 0.0, 1.0), "n": (0.0, 1.0, 0.0)}
    out = []
    for k, x in enumerate("xyz"):
        out.append(F.when(block, choose(lambda a, k=k: axes[plane[a][0]][k])).otherwise(F.lit(world["u"][k])).alias(f"u{x}_"))
        out.append(F.when(block, choose(lambda a, k=k: axes[plane[a][1]][k])).otherwise(F.lit(world["v"][k])).alias(f"v{x}_"))
        out.append(F.when(block, choose(lambda a, k=k: axes[a][k] * sign(a))).otherwise(F.lit(world["n"][k])).alias(f"n{x}_"))
        centre = F.col(f"p{x}") + choose(lambda a, k=k: axes[a][k] * sign(a) * size[a] * 0.5)
        out.append(F.when(block, centre).otherwise(F.col(f"p{x}") + (half[1] if x == "y" else 0.0)).alias(f"c{x}_"))
    out.append(F.when(block, choose(lambda a: size[plane[a][0]])).otherwise(half[0] * 2).alias("du"))
    out.append(F.when(block, choose(lambda a: size[plane[a][1]])).otherwise(half[2] * 2).alias("dv"))
    rows = rows.select("part_id", (~block).alias("fallback"), *out)
    return rows.select("part_id", "fallback", "du", "dv", *[F.col(f"{a}{x}_").alias(f"{a}{x}") for a in "uvnc" for x in "xyz"])


def local_grids(parts: DataFrame, options: GridOptions = GridOptions(), floor: FloorOptions = FloorOptions()) -> tuple[DataFrame, DataFrame]:
    """Live cells and killed samples of every part's top face, in the part's own lattice.

    A sample is killed by the least part_id among the other boxes that overlap the upright probe
    cube above it, tested before any ray because a ray cannot see a box it starts in, or by the
    first box overhead when that is nearer than the least clearance. Faces too steep to walk give
    no samples unless the part is always walkable."""
    faces = shuffled_join(top_faces(parts), parts.select("part_id", "name"), "part_id")
    slope = F.degrees(F.acos(v.clamp(F.col("ny"), -1.0, 1.0)))
    faces = faces.withColumn("slope", slope).where((F.col("slope") <= floor.max_slope) | F.contains("name", F.lit(floor.always_walkable)))
    count = lambda c: F.greatest(F.floor(F.col(c) / options.step).cast("int"), F.lit(1))
    rows = faces.withColumn("nu", count("du")).withColumn("nv", count("dv"))
    rows = rows.withColumn("ui", F.explode(F.sequence(F.lit(0), F.col("nu") - 1))).withColumn("vi", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    along = lambda i, n: (F.col(i) + 0.5 - F.col(n) / 2) * options.step
    p = v.add(v.of("c"), v.add(v.scale(v.of("u"), along("ui", "nu")), v.scale(v.of("v"), along("vi", "nv"))))
    samples = rows.select(F.col("part_id").alias("grid_id"), F.col("ui").cast("bigint").alias("ui"), F.col("vi").cast("bigint").alias("vi"), *v.named(p, "p"), *[f"{a}{x}" for a in "uvn" for x in "xyz"], "slope", "fallback")
    samples = materialize(parts.sparkSession, samples)
    # equal boxes and equal places meet once, however many parts and samples lie there
    alike = materialize(parts.sparkSession, copies(parts, BOX, "part_id"))
    boxes = spread_boxes(alike.withColumn("part_id", F.col("first")).withColumn("name", F.lit(None).cast("string")), 1.0, ("first", "second"))
    key, place = ["grid_id", "ui", "vi"], ["px", "py", "pz"]
    places = samples.select(*place).distinct()
    reach = options.step / 2 - 0.05
    near = places.withColumn("bx", F.floor(F.col("px") / PITCH)).withColumn("bz", F.floor(F.col("pz") / PITCH))
    near = shuffled_join(near, boxes, ["bx", "bz"])
    axes = (v.of("Br"), v.of("Bu"), v.of("Bl"))
    centre = (F.col("px"), F.col("py") + reach + 0.1, F.col("pz"))
    near = near.where(g.box_hits_cube(v.of("Bp"), axes, v.scale(v.of("Bs"), 0.5), centre, F.lit(reach)))
    killed = near.groupBy(*place).agg(two_least(F.lit(0)).alias("two"))
    above = first_hits(places.select(*place, F.col("px").alias("qx"), (F.col("py") + 0.15).alias("qy"), F.col("pz").alias("qz")), boxes, place, v.lit(0, 1, 0), F.lit(floor.clear_cap))
    rows = shuffled_join(shuffled_join(samples, killed, place, "left"), above.select(*place, "t", F.col("part_id").alias("roof")), place, "left")
    rows = rows.withColumn("overlap", least_but(F.col("two"), F.col("grid_id"))["hit"]).drop("two")
    killer = F.coalesce("overlap", F.when(F.col("t") + 0.15 < options.min_clearance, F.col("roof")))
    rows = materialize(parts.sparkSession, rows.withColumn("killer_id", killer).withColumn("clearance", F.coalesce("t", F.lit(floor.clear_cap))))
    # unique for part ids below 2^31 and faces of at most 2^16 steps
    cell = F.shiftleft("grid_id", 32) + F.shiftleft("ui", 16) + F.col("vi")
    live = rows.where("killer_id is null").select(cell.alias("cell_id"), *key, *[f"{a}{x}" for a in "puvn" for x in "xyz"], "slope", "clearance")
    dead = rows.where("killer_id is not null").select(*key, "px", "py", "pz", "killer_id")
    return live, dead


def footprints(parts: DataFrame, dead: DataFrame, options: GridOptions = GridOptions()) -> DataFrame:
    """Underside samples of the killing blocks in their yaw frame: part_id, ui, vi, b, u, v.

    The yaw frame is the part's right axis laid flat; each lattice place under the bounding square
    sends a ray upward from below, and what it enters first is the underside."""
    killers = dead.where("killer_id is not null").select(F.col("killer_id").alias("part_id")).distinct()
    rows = shuffled_join(parts.where("shape = 'Block'"), killers, "part_id", "left_semi")
    flat = F.sqrt(F.col("rx") * F.col("rx") + F.col("rz") * F.col("rz"))
    ux = F.when(flat > 1e-6, F.col("rx") / flat).otherwise(F.lit(1.0))
    uz = F.when(flat > 1e-6, F.col("rz") / flat).otherwise(F.lit(0.0))
    rows = rows.withColumn("yaw_x", ux).withColumn("yaw_z", uz)  # the part's own up axis keeps its name
    half = g.box_half(v.of("r"), v.of("u"), v.of("l"), v.of("s"))
    spread = lambda a, b: 0.5 * sum((F.abs(F.col(f"{e}x") * a + F.col(f"{e}z") * b) * F.col(f"s{k}") for e, k in zip("rul", "xyz", strict=True)), F.lit(0.0))
    n = lambda c: F.ceil(c / options.step).cast("int")
    rows = rows.withColumn("nu", n(spread(F.col("yaw_x"), F.col("yaw_z")))).withColumn("nv", n(spread(-F.col("yaw_z"), F.col("yaw_x")))).withColumn("low", F.col("py") - half[1] - 1.0).withColumn("tall", half[1] * 2 + 2.0)
    rows = rows.withColumn("ui", F.explode(F.sequence(-F.col("nu"), F.col("nu") - 1))).withColumn("vi", F.explode(F.sequence(-F.col("nv"), F.col("nv") - 1)))
    s, t = (F.col("ui") + 0.5) * options.step, (F.col("vi") + 0.5) * options.step
    qx, qz = F.col("px") + F.col("yaw_x") * s - F.col("yaw_z") * t, F.col("pz") + F.col("yaw_z") * s + F.col("yaw_x") * t
    hit, _ = g.ray_entry((qx, F.col("low"), qz), v.lit(0, 1, 0), F.col("tall"), v.of("p"), (v.of("r"), v.of("u"), v.of("l")), v.scale(v.of("s"), 0.5))
    rows = rows.withColumn("t", hit).where("t is not null")
    zero = F.lit(0.0)
    return rows.select("part_id", F.col("ui").cast("bigint").alias("ui"), F.col("vi").cast("bigint").alias("vi"), *v.named((qx, F.col("low") + F.col("t"), qz), "b"), *v.named((F.col("yaw_x"), zero, F.col("yaw_z")), "u"), *v.named((-F.col("yaw_z"), zero, F.col("yaw_x")), "v"))
