"""The world lattice: components of surface samples, exact distance transform, thickness, severance
and crack edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LatticeOptions
from ..runtime import materialize, prepare
from .graph import connected_components

#: Directions as (dx, dz, mask bit).
SIDES = ((1, 0, 1), (-1, 0, 2), (0, 1, 4), (0, -1, 8))


def lattice(surfels: DataFrame) -> DataFrame:
    """Samples with their lattice place: sid, ix, iz, y, blocked (null counts as 0)."""
    return surfels.select(
        "sid", F.floor("px").alias("ix"), F.floor("pz").alias("iz"), F.col("py").alias("y"), F.coalesce("blocked", F.lit(0)).alias("blocked")
    )


def neighbour_edges(nodes: DataFrame, step_tol: float) -> DataFrame:
    """(a, b): samples of adjacent columns no more than step_tol apart in height."""
    # two directions find every pair once
    ahead = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((1, 0), (0, 1))]))
    left = nodes.select(F.col("sid").alias("a"), F.col("y").alias("ya"), "ix", "iz", ahead.alias("o")).select("a", "ya", (F.col("ix") + F.col("o.x")).alias("ix"), (F.col("iz") + F.col("o.z")).alias("iz"))
    right = nodes.select(F.col("sid").alias("b"), F.col("y").alias("yb"), "ix", "iz")
    return left.join(right, ["ix", "iz"]).where(F.abs(F.col("ya") - F.col("yb")) <= step_tol).select("a", "b")


def components(nodes: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """sid, comp for every sample; comp is the least sid."""
    roots = connected_components(neighbour_edges(nodes, options.step_tol))
    return nodes.select("sid").join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("comp"))


def cells(nodes: DataFrame, comps: DataFrame, by_level: bool = False) -> DataFrame:
    """One sample per component and column, the least sid: comp, ix, iz, sid, y, blocked. by_level
    keeps every sample of a column that lies on another level instead."""
    rows = nodes.join(comps, "sid")
    key = ["comp", "ix", "iz"] + (["y"] if by_level else [])
    first = rows.groupBy(*key).agg(F.min(F.struct("sid", *([] if by_level else ["y"]), "blocked")).alias("f"))
    return first.select("comp", "ix", "iz", "f.sid", "y" if by_level else "f.y", "f.blocked")


def run_distance(rows: DataFrame, key: list[str], along: str, name: str) -> DataFrame:
    """Distance of each cell to the nearest place outside its run along one axis."""
    order = Window.partitionBy(*key).orderBy(along)
    rows = rows.withColumn("_g", F.col(along) - F.row_number().over(order))
    run = Window.partitionBy(*key, "_g")
    near = F.least(F.col(along) - F.min(along).over(run), F.max(along).over(run) - F.col(along)) + 1
    return rows.withColumn(name, near).drop("_g")


def row_distances(side: list[int]) -> list[int]:
    """For each cell of an unbroken row the least k * k + side * side over the cells k away, and the
    places just outside the row, whose side is 0.

    The parabolas of the cells are kept as a lower envelope, so the row costs linear time."""
    heights = [0, *(g * g for g in side), 0]
    owners, begins = [0], [0]
    for u in range(1, len(heights)):
        begin = 0
        while owners:
            i = owners[-1]
            # the first place where u is lower than i
            begin = max(0, (u * u - i * i + heights[u] - heights[i]) // (2 * (u - i)) + 1)
            if begin > begins[-1]:
                break
            owners.pop()
            begins.pop()
        if not owners:
            begin = 0
        if begin < len(heights):
            owners.append(u)
            begins.append(begin)
    out, k = [], 0
    for x in range(1, len(heights) - 1):
        while k + 1 < len(owners) and begins[k + 1] <= x:
            k += 1
        out.append((x - owners[k]) ** 2 + heights[owners[k]])
    return out


#: Cells whose rows one task of the distance field takes.
ROW_CELLS = 200_000


def distance_field(cell_table: DataFrame) -> DataFrame:
    """Cells with d2, the exact squared distance to the nearest column outside the component, and d,
    the clearance from the cell's centre to that column's edge.

    Column distances come from window runs, then every row is one linear pass."""
    spark = cell_table.sparkSession
    base = materialize(spark, run_distance(cell_table, ["comp", "ix"], "iz", "gz"))
    groups = max(1, -(-base.count() // ROW_CELLS))

    def passed(table: pa.Table) -> pa.Table:
        comp, ix, iz, gz = (table.column(c).to_numpy() for c in ("comp", "ix", "iz", "gz"))
        order = np.lexsort((ix, iz, comp))
        comp, ix, iz, gz = comp[order], ix[order], iz[order], gz[order]
        broken = (comp[1:] != comp[:-1]) | (iz[1:] != iz[:-1]) | (ix[1:] != ix[:-1] + 1)
        cuts = np.flatnonzero(np.concatenate(([True], broken, [True])))
        side = gz.tolist()
        d2 = [d for s, e in zip(cuts, cuts[1:], strict=False) for d in row_distances(side[s:e])]
        return pa.table({"comp": comp, "ix": ix, "iz": iz, "d2": pa.array(d2, pa.int64())})

    prepare(spark)
    rows = base.select("comp", "ix", "iz", F.col("gz").cast("bigint").alias("gz"), F.pmod(F.xxhash64("comp", "iz"), F.lit(groups)).alias("pid"))
    found = rows.groupBy("pid").applyInArrow(passed, "comp bigint, ix bigint, iz bigint, d2 bigint")
    return base.join(found, ["comp", "ix", "iz"]).withColumn("d", F.greatest(F.sqrt("d2") - 0.5, F.lit(0.0)))


def half_width(points: DataFrame, field: DataFrame, key: list[str], cap: float = 12.0) -> DataFrame:
    """Thickness of the region behind each point (key, comp, qx, qz, mx, mz): march along the inward
    normal (mx, mz) in half units until the component is left, and take the greatest clearance."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(int(cap * 2))))
    rows = points.select(*key, "comp", "qx", "qz", "mx", "mz", steps.alias("n")).withColumn("t", F.col("n") * 0.5)
    rows = rows.withColumn("ix", F.floor(F.col("qx") + F.col("mx") * F.col("t"))).withColumn("iz", F.floor(F.col("qz") + F.col("mz") * F.col("t")))
    seen = rows.join(field.select("comp", "ix", "iz", "d"), ["comp", "ix", "iz"], "left")
    # clearances in marching order, the greatest before the first miss
    per = seen.groupBy(*key).agg(F.min(F.when(F.col("d").isNull(), F.col("n"))).alias("stop"), *[F.max(F.when(F.col("n") == k, F.col("d"))).alias(f"d{k}") for k in range(int(cap * 2) + 1)])
    inside = [F.when(F.col("stop").isNull() | (F.col("stop") > k), F.col(f"d{k}")) for k in range(int(cap * 2) + 1)]
    return per.select(*key, F.coalesce(F.greatest(*inside), F.lit(0.0)).alias("half_width"))


def severance(field: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Whether taking the agent's radius off a component leaves it in pieces: comp, cells_before,
    cells_after, pieces_after, severed, erased."""
    kept = field.where(F.col("d") >= options.radius).select("comp", "sid", "ix", "iz", "y")
    # samples of two components may share columns; pairs must stay inside one
    ahead = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z")) for x, z in ((1, 0), (0, 1))]))
    left = kept.select("comp", F.col("sid").alias("a"), F.col("y").alias("ya"), "ix", "iz", ahead.alias("o"))
    left = left.select("comp", "a", "ya", (F.col("ix") + F.col("o.x")).alias("ix"), (F.col("iz") + F.col("o.z")).alias("iz"))
    right = kept.select("comp", F.col("sid").alias("b"), F.col("y").alias("yb"), "ix", "iz")
    pairs = left.join(right, ["comp", "ix", "iz"]).where(F.abs(F.col("ya") - F.col("yb")) <= options.step_tol).select("a", "b")
    roots = connected_components(pairs)
    rooted = kept.join(roots, F.col("sid") == F.col("node"), "left").select("comp", F.coalesce("component", "sid").alias("piece"))
    after = rooted.groupBy("comp").agg(F.count("*").alias("cells_after"), F.countDistinct("piece").alias("pieces_after"))
    before = field.groupBy("comp").agg(F.count("*").alias("cells_before"))
    out = before.join(after, "comp", "left").na.fill(0, ["cells_after", "pieces_after"])
    return out.select("comp", "cells_before", "cells_after", "pieces_after", (F.col("pieces_after") > 1).alias("severed"), (F.col("cells_after") == 0).alias("erased"))


def crack_edges(cell_table: DataFrame) -> DataFrame:
    """Directed unit edges between a cell and a missing neighbour, interior on the left of travel:
    edge_id, comp, sid, dir (mask bit), ix, iz, ax, az, bx, bz, wall."""
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"), F.lit(d).alias("d")) for x, z, d in SIDES]))
    rows = cell_table.select("comp", "sid", "ix", "iz", "blocked", side.alias("s"))
    rows = rows.select("comp", "sid", "ix", "iz", "blocked", F.col("s.d").alias("dir"), (F.col("ix") + F.col("s.x")).alias("_x"), (F.col("iz") + F.col("s.z")).alias("_z"))
    there = cell_table.select("comp", F.col("ix").alias("_x"), F.col("iz").alias("_z"))
    rows = rows.join(there, ["comp", "_x", "_z"], "left_anti")
    x, z, d = F.col("ix"), F.col("iz"), F.col("dir")
    begin = F.when(d == 8, F.struct(x.alias("x"), z.alias("z"))).when(d == 1, F.struct((x + 1).alias("x"), z.alias("z"))).when(d == 4, F.struct((x + 1).alias("x"), (z + 1).alias("z"))).otherwise(F.struct(x.alias("x"), (z + 1).alias("z")))
    stop = F.when(d == 8, F.struct((x + 1).alias("x"), z.alias("z"))).when(d == 1, F.struct((x + 1).alias("x"), (z + 1).alias("z"))).when(d == 4, F.struct(x.alias("x"), (z + 1).alias("z"))).otherwise(F.struct(x.alias("x"), z.alias("z")))
    number = F.when(d == 1, 0).when(d == 2, 1).when(d == 4, 2).otherwise(3)
    return rows.select(
        (F.col("sid") * 4 + number).alias("edge_id"), "comp", "sid", "dir", "ix", "iz", begin["x"].alias("ax"), begin["z"].alias("az"),
        stop["x"].alias("bx"), stop["z"].alias("bz"), (F.col("blocked").bitwiseAND(d) != 0).alias("wall"),
    )


def successors(edges: DataFrame) -> DataFrame:
    """edge_id, next_id: at a vertex with a choice, the most clockwise turn. Every edge has one."""
    after = edges.select("comp", F.col("edge_id").alias("next_id"), F.col("ax").alias("bx"), F.col("az").alias("bz"), (F.col("bx") - F.col("ax")).alias("ex"), (F.col("bz") - F.col("az")).alias("ez"))
    pairs = edges.select("comp", "edge_id", "bx", "bz", (F.col("bx") - F.col("ax")).alias("dx"), (F.col("bz") - F.col("az")).alias("dz")).join(after, ["comp", "bx", "bz"])
    turn = F.col("dx") * F.col("ez") - F.col("dz") * F.col("ex")
    ahead = F.col("dx") * F.col("ex") + F.col("dz") * F.col("ez")
    # unit edges: the angle of (-turn, ahead) ranks right, straight, left
    score = F.when(turn < 0, 3).when((turn == 0) & (ahead > 0), 2).when(turn > 0, 1).otherwise(4)
    return pairs.groupBy("edge_id").agg(F.max_by("next_id", F.struct(score, -F.col("next_id"))).alias("next_id"))


def loops(edges: DataFrame) -> DataFrame:
    """Crack edges with loop_id (the least edge_id of the cycle) and next_id."""
    step = materialize(edges.sparkSession, successors(edges))
    roots = connected_components(step.select(F.col("edge_id").alias("a"), F.col("next_id").alias("b")))
    return edges.join(step, "edge_id").join(roots.select(F.col("node").alias("edge_id"), F.col("component").alias("loop_id")), "edge_id")


def blocked_mask(surfels: DataFrame, solid, heights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """sid, blocked: a bit for every side whose neighbouring column is solid at some probe height.

    solid(probes) keeps the probes (qx, qy, qz) that lie in solid space."""
    side = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"), F.lit(d).alias("d")) for x, z, d in SIDES]))
    tall = F.explode(F.array(*[F.lit(float(h)) for h in heights]))
    rows = surfels.select("sid", "px", "py", "pz", side.alias("s")).select("*", tall.alias("h"))
    probes = rows.select("sid", F.col("s.d").alias("dir"), (F.floor("px") + F.col("s.x") + 0.5).alias("qx"), (F.col("py") + F.col("h")).alias("qy"), (F.floor("pz") + F.col("s.z") + 0.5).alias("qz"))
    hit = solid(probes).groupBy("sid").agg(F.bit_or("dir").alias("blocked"))
    return surfels.select("sid").join(hit, "sid", "left").select("sid", F.coalesce("blocked", F.lit(0)).alias("blocked"))
