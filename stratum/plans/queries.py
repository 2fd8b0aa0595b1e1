"""Registered queries: one per operator, over the scenes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AgentOptions, FloorOptions, GridOptions, LatticeOptions
from ..functions import geometry as g
from ..functions import vectors as v
from ..operators import agents, closure, contour, gridbounds, lattice, octree, surface
from ..operators.bucket import covering_cell
from ..runtime import materialize, scratch_path
from ..sources import snapshot
from . import scenes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GRID, LATTICE, AGENT = GridOptions(), LatticeOptions(), AgentOptions()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def r6s(*names: str) -> list[Column]:
    return [r6(n).alias(n) for n in names]


# --- part-aligned grids ------------------------------------------------------


def edges_of(spark: SparkSession, d: str, comps: bool = False) -> DataFrame:
    live = scenes.live_cells(spark, d)
    if not comps:
        return gridbounds.classify(live, scenes.dead_cells(spark, d), GRID)
    live = materialize(spark, live)
    covered = materialize(spark, gridbounds.covered_sides(live, GRID))
    return gridbounds.classify(live, scenes.dead_cells(spark, d), GRID, gridbounds.components(live, GRID, covered), covered)


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.merge_edges(gridbounds.boundary(edges_of(spark, d, True)))


@query
def boundary_length_by_grid(spark: SparkSession, d: str) -> DataFrame:
    """Wall and dropoff length of every grid: the flagship."""
    runs = gridbounds.merge_edges(gridbounds.boundary(edges_of(spark, d)))
    return runs.groupBy("grid_id", "kind").agg(F.count("*").alias("runs"), r6(F.sum("length")).alias("length"))


@query
def edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).groupBy("kind").agg(F.count("*").alias("edges"))


@query
def edge_kinds_by_grid(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).groupBy("grid_id", "kind").agg(F.count("*").alias("edges"))


@query
def classified_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).select("cell_id", "du", "dv", "kind", F.when(F.col("kind") == "wall", F.col("killer_id")).alias("killer_id"), *r6s("ax", "az", "bx", "bz"))


@query
def boundary_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(spark, d).select("kind", "grid_id", "killer_id", "comp", *r6s("ax", "ay", "az", "bx", "by", "bz"), "cells", r6("length").alias("length"))


@query
def run_length_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.run_stats(runs_of(spark, d)).select("kind", "runs", r6("length").alias("length"))


@query
def longest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The twenty longest runs, a report."""
    rows = runs_of(spark, d).select("kind", "grid_id", "cells", *r6s("ax", "az", "ox", "oz"))
    return rows.orderBy(F.desc("cells"), "grid_id", "kind", "ax", "az", "ox", "oz").limit(20)


def cover_probes(cells: DataFrame) -> DataFrame:
    rows = gridbounds.sided(cells)
    return rows.select("cell_id", "du", "dv", *v.named(v.add(v.of("p"), v.of("o")), "q"))


@query
def covering_cells(spark: SparkSession, d: str) -> DataFrame:
    live = scenes.live_cells(spark, d)
    probes = cover_probes(live).withColumnRenamed("cell_id", "probe_id")
    found = covering_cell(probes, live, ["probe_id", "du", "dv"], 0.25, 0.25, 0.08, 1.0, F.col("probe_id"))
    return found.select("probe_id", "du", "dv", "hit", r6("off").alias("off"))


@query
def seam_pairs(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(spark, d).where("kind = 'seam'").select("cell_id", "du", "dv", "hit")


@query
def grid_components(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.components(scenes.live_cells(spark, d), GRID)


@query
def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.components(scenes.live_cells(spark, d), GRID).groupBy("comp").agg(F.count("*").alias("cells"))


@query
def killer_tally(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.killer_tally(edges_of(spark, d))


@query
def cut_by(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.cut_by(edges_of(spark, d))


def cutting(spark: SparkSession, d: str) -> DataFrame:
    feet = scenes.foot_cells(spark, d)
    return gridbounds.cutting_cells(feet, gridbounds.floor_under(feet, scenes.live_cells(spark, d), scenes.dead_cells(spark, d), GRID), GRID)


def frontier(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    cut = materialize(spark, cutting(spark, d))
    edges = edges_of(spark, d) if edges is None else edges
    return materialize(spark, gridbounds.cut_frontier(cut, scenes.live_cells(spark, d), gridbounds.cut_by(edges), GRID))


@query
def floor_under(spark: SparkSession, d: str) -> DataFrame:
    feet = scenes.foot_cells(spark, d)
    return gridbounds.floor_under(feet, scenes.live_cells(spark, d), scenes.dead_cells(spark, d), GRID)


@query
def cut_cells(spark: SparkSession, d: str) -> DataFrame:
    return cutting(spark, d).groupBy("part_id").agg(F.count("*").alias("cells"))


@query
def cut_frontier(spark: SparkSession, d: str) -> DataFrame:
    return frontier(spark, d).select("part_id", "ui", "vi", "du", "dv", "hit")


@query
def cut_outline_runs(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.cut_outlines(frontier(spark, d), GRID).select("killer_id", "cells", *r6s("ax", "ay", "az", "bx", "by", "bz", "length"))


@query
def wall_selection(spark: SparkSession, d: str) -> DataFrame:
    edges = materialize(spark, gridbounds.boundary(edges_of(spark, d, True)))
    runs = gridbounds.wall_geometry(edges, frontier(spark, d, edges), GRID)
    return gridbounds.run_stats(runs).select("kind", "source", "runs", r6("length").alias("length"))


@query
def open_ends(spark: SparkSession, d: str) -> DataFrame:
    return closure.open_ends(runs_of(spark, d)).select("kind", "kx", "ky", "kz")


@query
def endpoint_degree(spark: SparkSession, d: str) -> DataFrame:
    return closure.vertex_degrees(runs_of(spark, d)).groupBy("degree").agg(F.count("*").alias("vertices"))


@query
def audit_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return closure.audit(runs_of(spark, d)).select("scope", "runs", "open_ends", F.size("sample").cast("bigint").alias("samples"))


def opened(spark: SparkSession, d: str, runs: DataFrame | None = None) -> DataFrame:
    runs = closure.with_ids(runs_of(spark, d)) if runs is None else runs
    return materialize(spark, closure.open_ends(runs))


@query
def stitch_candidates(spark: SparkSession, d: str) -> DataFrame:
    pairs = closure.stitch_candidates(opened(spark, d), GRID.stitch_gap)
    return pairs.select(*[F.col(f"{e}.k{k}").alias(f"{e}{k}") for e in "ij" for k in "xyz"], r6("d").alias("d"))


@query
def stitch_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = closure.stitch_pairs(closure.stitch_candidates(opened(spark, d), GRID.stitch_gap))
    return pairs.select(*[F.col(f"{e}.k{k}").alias(f"{e}{k}") for e in "ij" for k in "xyz"], r6("d").alias("d"))


@query
def stitch_tees(spark: SparkSession, d: str) -> DataFrame:
    """Nearest inner point of another run for every open end."""
    runs = materialize(spark, closure.with_ids(runs_of(spark, d)))
    tees = closure.tee_targets(opened(spark, d, runs), runs, GRID.stitch_gap)
    return tees.select("e.kx", "e.ky", "e.kz", r6("t").alias("t"), r6("d").alias("d"))


@query
def stitched_audit(spark: SparkSession, d: str) -> DataFrame:
    """Runs by source after stitching, with the open ends left of each kind."""
    runs = materialize(spark, closure.stitch(runs_of(spark, d), GRID))
    return closure.audit(runs).select("scope", "runs", "open_ends")


@query
def debug_bars(spark: SparkSession, d: str) -> DataFrame:
    return gridbounds.debug_bars(runs_of(spark, d)).groupBy("colour").agg(F.count("*").alias("bars"), r6(F.sum("length")).alias("length"), r6(F.min("my")).alias("lowest"))


# --- world lattice -----------------------------------------------------------


def lattice_cells(spark: SparkSession, d: str) -> DataFrame:
    nodes = lattice.lattice(scenes.world_lattice(spark, d))
    return materialize(spark, lattice.cells(nodes, lattice.components(nodes, LATTICE)))


@query
def lattice_components(spark: SparkSession, d: str) -> DataFrame:
    return lattice.components(lattice.lattice(scenes.world_lattice(spark, d)), LATTICE)


@query
def lattice_component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return lattice_components(spark, d).groupBy("comp").agg(F.count("*").alias("cells"))


@query
def column_distance(spark: SparkSession, d: str) -> DataFrame:
    return lattice.run_distance(lattice_cells(spark, d), ["comp", "ix"], "iz", "gz").select("sid", "gz")


@query
def edt_squared(spark: SparkSession, d: str) -> DataFrame:
    return lattice.distance_field(lattice_cells(spark, d)).select("sid", "d2", r6("d").alias("d"))


@query
def thickness(spark: SparkSession, d: str) -> DataFrame:
    return lattice.distance_field(lattice_cells(spark, d)).groupBy("comp").agg(F.count("*").alias("cells"), F.max("d2").alias("d2"))


@query
def severance(spark: SparkSession, d: str) -> DataFrame:
    return lattice.severance(materialize(spark, lattice.distance_field(lattice_cells(spark, d))), LATTICE)


@query
def half_width(spark: SparkSession, d: str) -> DataFrame:
    """Thickness of the floor behind every crack edge, along its inward axis."""
    cells = lattice_cells(spark, d)
    field = materialize(spark, lattice.distance_field(cells))
    side = F.col("dir")
    mx = F.when(side == 1, -1.0).when(side == 2, 1.0).otherwise(0.0)
    mz = F.when(side == 4, -1.0).when(side == 8, 1.0).otherwise(0.0)
    points = lattice.crack_edges(cells).select("edge_id", "comp", (F.col("ix") + 0.5).alias("qx"), (F.col("iz") + 0.5).alias("qz"), mx.alias("mx"), mz.alias("mz"))
    return lattice.half_width(points, field, ["edge_id"]).select("edge_id", r6("half_width").alias("half_width"))


@query
def crack_edges(spark: SparkSession, d: str) -> DataFrame:
    return lattice.crack_edges(lattice_cells(spark, d)).select("edge_id", "comp", "ax", "az", "bx", "bz", "wall")


@query
def crack_successor(spark: SparkSession, d: str) -> DataFrame:
    return lattice.successors(lattice.crack_edges(lattice_cells(spark, d)))


def loops_of(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    cells = lattice_cells(spark, d) if cells is None else cells
    return materialize(spark, lattice.loops(materialize(spark, lattice.crack_edges(cells))))


@query
def loop_lengths(spark: SparkSession, d: str) -> DataFrame:
    return loops_of(spark, d).groupBy("loop_id").agg(F.count("*").alias("edges"))


@query
def label_closing(spark: SparkSession, d: str) -> DataFrame:
    return contour.trace(loops_of(spark, d), LATTICE).select("loop_id", "pos", "edge_id", "wall", "label")


@query
def loop_points(spark: SparkSession, d: str) -> DataFrame:
    return contour.loop_points(contour.trace(loops_of(spark, d), LATTICE)).select("loop_id", "pos", "x", "z", "label")


def points_of(spark: SparkSession, d: str, cells: DataFrame | None = None) -> DataFrame:
    return materialize(spark, contour.loop_points(contour.trace(loops_of(spark, d, cells), LATTICE)))


@query
def tls_moments(spark: SparkSession, d: str) -> DataFrame:
    """Total-least-squares line through the samples of each lattice row."""
    rows = scenes.world_lattice(spark, d).select(F.floor("pz").alias("iz"), F.col("px").alias("x"), (F.col("pz") + F.col("py")).alias("z"))
    m = rows.groupBy("iz").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("z").alias("cz"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("x") * F.col("z")).alias("xz"))
    n, cx, cz = F.col("n"), F.col("cx"), F.col("cz")
    angle = g.principal_angle(F.col("xx") - n * cx * cx, F.col("zz") - n * cz * cz, F.col("xz") - n * cx * cz)
    return m.select("iz", "n", r6("cx").alias("cx"), r6("cz").alias("cz"), r6(angle).alias("angle"))


@query
def fit_segments(spark: SparkSession, d: str) -> DataFrame:
    return contour.fit_segments(points_of(spark, d), LATTICE).select("loop_id", "seg", "label", "n", *r6s("cx", "cz", "dx", "dz", "nx", "nz", "length", "bias"))


def offsets_of(spark: SparkSession, d: str) -> DataFrame:
    cells = lattice_cells(spark, d)
    return contour.offset_lines(points_of(spark, d, cells), materialize(spark, lattice.distance_field(cells)), LATTICE)


@query
def offset_segments(spark: SparkSession, d: str) -> DataFrame:
    width = F.when(F.col("label"), F.col("half_width")).alias("half_width")
    return offsets_of(spark, d).withColumn("half_width", width).select("loop_id", "seg", "part", "label", "n", *r6s("half_width", "offset", "ox", "oz"), "narrow")


@query
def polygons(spark: SparkSession, d: str) -> DataFrame:
    return contour.polygons(offsets_of(spark, d), LATTICE).select("loop_id", F.size("verts").alias("vertices"), "bevels", "steps")


@query
def lattice_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the whole lattice bake in one row."""
    return contour.bake(scenes.world_lattice(spark, d), LATTICE)[1]


@query
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as snapshot lines and parsed again."""
    return snapshot.parse_lines(snapshot.snapshot_lines(scenes.world_lattice(spark, d))).select("px", "py", "pz", "clearance", "blocked")


# --- boxes -------------------------------------------------------------------


def leaves_of(spark: SparkSession, d: str) -> DataFrame:
    nodes = octree.insert_boxes(scenes.boxes(spark, d), scenes.BOX_ROOT)
    return materialize(spark, octree.collapse(nodes, scenes.BOX_ROOT))


@query
def gather_parts(spark: SparkSession, d: str) -> DataFrame:
    return surface.gather_parts(scenes.boxes(spark, d)).select("part_id", "name", "sx", "sz")


@query
def obb_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Box tests of every part, turned by a 3-4-5 angle, against the unit cube at its own corner."""
    b = scenes.boxes(spark, d)
    axes = (v.lit(0.6, 0, 0.8), v.lit(0, 1, 0), v.lit(-0.8, 0, 0.6))
    half = v.scale(v.of("s"), 0.5)
    at = (F.floor(F.col("px") + F.col("sx") * 0.5) + 0.5, F.floor("py") + 0.5, F.floor(F.col("pz") + F.col("sz") * 0.25) + 0.5)
    around = g.box_half(*axes, v.of("s"))
    return b.select(
        "part_id", *[r6(x).alias(f"h{k}") for x, k in zip(around, "xyz", strict=True)], g.point_in_box(at, v.of("p"), axes, half).alias("centre_inside"),
        g.cube_in_box(at, F.lit(0.5), v.of("p"), axes, half).alias("cube_inside"), g.box_hits_cube(v.of("p"), axes, half, at, F.lit(0.5)).alias("touches"),
    )


@query
def svo_cells(spark: SparkSession, d: str) -> DataFrame:
    """Unit cells that the leaves cover, by leaf depth."""
    return leaves_of(spark, d).groupBy("depth").agg(F.count("*").alias("leaves"))


@query
def svo_leaves(spark: SparkSession, d: str) -> DataFrame:
    return leaves_of(spark, d).select("depth", "ix", "iy", "iz")


@query
def svo_stats(spark: SparkSession, d: str) -> DataFrame:
    return octree.stats(leaves_of(spark, d), scenes.BOX_ROOT)


@query
def point_solid(spark: SparkSession, d: str) -> DataFrame:
    return octree.in_solid(scenes.probes(spark, d), leaves_of(spark, d), scenes.BOX_ROOT).select("sid")


@query
def blocked_mask(spark: SparkSession, d: str) -> DataFrame:
    leaves = leaves_of(spark, d)
    return lattice.blocked_mask(scenes.probes(spark, d), lambda q: octree.in_solid(q, leaves, scenes.BOX_ROOT))


@query
def surfels(spark: SparkSession, d: str) -> DataFrame:
    rows = surface.extract(scenes.boxes(spark, d), leaves_of(spark, d), scenes.BOX_ROOT)
    return rows.select("px", "py", "pz", r6("slope").alias("slope"), r6("clearance").alias("clearance"), "part_id")


@query
def floor_area_by_part(spark: SparkSession, d: str) -> DataFrame:
    rows = surface.extract(scenes.boxes(spark, d), leaves_of(spark, d), scenes.BOX_ROOT)
    return rows.groupBy("part_id").agg(F.count("*").alias("samples"), r6(F.min("clearance")).alias("lowest"))


@query
def local_grid_samples(spark: SparkSession, d: str) -> DataFrame:
    """Live and killed samples of the part-aligned grids of all boxes."""
    live, dead = surface.local_grids(scenes.boxes(spark, d))
    both = live.select("grid_id", "ui", "vi", F.lit(None).cast("bigint").alias("killer_id")).unionByName(dead.select("grid_id", "ui", "vi", "killer_id"))
    return both


@query
def footprint_cells(spark: SparkSession, d: str) -> DataFrame:
    """Underside samples of the boxes that kill floor."""
    parts = scenes.boxes(spark, d)
    _, dead = surface.local_grids(parts)
    return surface.footprints(parts, dead).select("part_id", "ui", "vi", *r6s("bx", "by", "bz"))


@query
def bake_runs(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid bake of the box scene: grids, footprints, classes, runs."""
    parts = scenes.boxes(spark, d)
    live, dead = surface.local_grids(parts)
    runs = gridbounds.bake(live, dead, surface.footprints(parts, dead))
    return gridbounds.run_stats(runs).select("kind", "source", "runs", r6("length").alias("length"))


@query
def bake_floor_samples(spark: SparkSession, d: str) -> DataFrame:
    """Scan filter, octree around the parts' own bounds and surface samples in one call."""
    rows, _, _ = surface.bake_floor(scenes.boxes(spark, d))
    return rows.select("px", "py", "pz", r6("slope").alias("slope"), r6("clearance").alias("clearance"), "part_id")


@query
def bake_tree(spark: SparkSession, d: str) -> DataFrame:
    """Leaves by depth of the tree that a bake builds, with its root."""
    leaves, root = octree.build(scenes.boxes(spark, d))
    at = [F.lit(x).alias(f"root_{k}") for x, k in zip((root.x, root.y, root.z), "xyz", strict=True)]
    return leaves.groupBy("depth").agg(F.count("*").alias("leaves")).select("depth", "leaves", *at, F.lit(root.edge).alias("edge"))


@query
def solid_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of upright and turned blocks and of octahedra, whose inside is filled."""
    parts = scenes.solids(spark, d)
    return octree.build(parts, scenes.solid_triangles(parts))[0].select("depth", "ix", "iy", "iz")


@query
def block_parts(spark: SparkSession, d: str) -> DataFrame:
    return scenes.solids(spark, d).select("part_id", octree.is_block(F.col("shape")).alias("is_block"))


@query
def character_parts(spark: SparkSession, d: str) -> DataFrame:
    return surface.characters(scenes.instances(spark, d))


@query
def character_scan(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that are no character by the instance tree and pass the scan filter."""
    found = surface.characters(scenes.instances(spark, d)).select(F.col("instance_id").alias("part_id"), F.lit(True).alias("found"))
    parts = scenes.boxes(spark, d).drop("is_character").join(found, "part_id", "left").withColumn("is_character", F.coalesce("found", F.lit(False)))
    return surface.gather_parts(parts, FloorOptions(max_ground_footprint=8.0)).select("part_id", "name")


# --- small operators ---------------------------------------------------------


@query
def floor_columns(spark: SparkSession, d: str) -> DataFrame:
    """Samples and lowest floor of every floor cell."""
    rows = lattice.lattice(scenes.world_lattice(spark, d).withColumn("px", F.col("px") - 0.25))
    return rows.groupBy("ix", "iz").agg(F.count("*").alias("samples"), F.min("y").alias("lowest"))


@query
def grid_axes(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the axes of their grid; grids without usable ones take the world's."""
    cells = scenes.live_cells(spark, d).select("cell_id", "grid_id")
    return gridbounds.framed(cells, scenes.grid_frames(spark, d)).select("cell_id", *r6s("ux", "uz", "vx", "vz", "ny"))


@query
def line_crossings(spark: SparkSession, d: str) -> DataFrame:
    names = ("ax", "az", "adx", "adz", "bx", "bz", "bdx", "bdz")
    x, z = g.line_intersection(*[F.col(c) for c in names])
    return scenes.crossing_lines(spark, d).select("pair_id", r6(x).alias("x"), r6(z).alias("z"))


@query
def row_lines(spark: SparkSession, d: str) -> DataFrame:
    """The line through each lattice row with its greatest deviation and its extent."""
    rows = scenes.world_lattice(spark, d).select(F.floor("pz").alias("iz"), F.col("px").alias("x"), (F.col("pz") + F.col("py")).alias("z"))
    return contour.line_stats(rows, "iz").select("iz", "n", *r6s("cx", "cz", "dx", "dz", "deviation", "extent"))


@query
def merged_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of the three bakes with some fields overridden, one row per number."""
    given = {"floor": FloorOptions().over(max_slope=50.0), "lattice": LATTICE.over(radius=2.0, min_run_len=6), "grid": GRID.over(step=2.0)}
    rows = [(stage, k, float(x)) for stage, o in given.items() for k, x in vars(o).items() if isinstance(x, (int, float))]
    return spark.createDataFrame(rows, "stage string, name string, value double")


@query
def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as snapshot files of both versions and read back."""
    rows, out = scenes.world_lattice(spark, d), None
    for version in (1, 2):
        path = scratch_path(spark)
        snapshot.write_snapshot(rows, path, version)
        back = snapshot.read_snapshot(spark, path).withColumn("version", F.lit(version))
        out = back if out is None else out.unionByName(back)
    return out.select("version", "px", "py", "pz", "clearance", "blocked")


# --- agents ------------------------------------------------------------------


@query
def agent_filter(spark: SparkSession, d: str) -> DataFrame:
    ok = agents.fits(AGENT.over(height=4.0), F.col("clearance"), F.when(F.col("sid") % 3 == 0, F.col("clearance") / 2), F.col("blocked").cast("double"))
    return scenes.world_lattice(spark, d).where(ok).select("sid", "clearance")


@query
def movement_mode(spark: SparkSession, d: str) -> DataFrame:
    return scenes.world_lattice(spark, d).groupBy(F.coalesce(agents.movement_mode(F.col("clearance")), F.lit("none")).alias("mode")).agg(F.count("*").alias("samples"))


@query
def giant_floor(spark: SparkSession, d: str) -> DataFrame:
    return agents.giant_floor(scenes.world_lattice(spark, d), AGENT.over(giant=7.0)).select("sid")


@query
def slope_split(spark: SparkSession, d: str) -> DataFrame:
    return agents.walkable_by(scenes.world_lattice(spark, d)).groupBy("npc", "player").agg(F.count("*").alias("samples"))


@query
def floor_rectangles(spark: SparkSession, d: str) -> DataFrame:
    rows = lattice_cells(spark, d).join(scenes.world_lattice(spark, d).select("sid", "clearance"), "sid")
    return agents.floor_rectangles(rows)
