"""Loops to polygons: label closing, loop points, greedy line fit, graded offsets, mitred corners.

These are folds along a loop, so each loop is handled by one call over an Arrow table; the size
of a group is the length of one boundary loop."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LatticeOptions
from ..runtime import materialize, prepare
from .lattice import cells, components, crack_edges, distance_field, half_width, lattice, loops


def ordered(edge: np.ndarray, after: np.ndarray, start: int) -> list[int]:
    """Row numbers along a cycle of successors."""
    row = {int(e): i for i, e in enumerate(edge)}
    out, i = [], start
    while True:
        out.append(i)
        i = row[int(after[i])]
        if i == start:
            return out


def closed_labels(wall: list[bool], least: int) -> list[bool]:
    """Cyclic run lengths: dropoff runs shorter than `least` between walls turn into wall."""
    n = len(wall)
    change = next((i for i in range(n) if wall[i] != wall[i - 1]), None)
    if n < 3 or change is None:
        return list(wall)
    out, i = list(wall), 0
    while i < n:
        j = i
        while j < n and wall[(change + j) % n] == wall[(change + i) % n]:
            j += 1
        if not wall[(change + i) % n] and j - i < least:
            for k in range(i, j):
                out[(change + k) % n] = True
        i = j
    return out


#: Rows of loops that one task takes at a time; a longer loop is a group of its own.
LOOP_ROWS = 50_000


def slices(table: pa.Table) -> dict[int, pa.Table]:
    """The rows of each loop."""
    loop = table.column("loop_id").to_numpy()
    order = np.argsort(loop, kind="stable")
    table, loop = table.take(pa.array(order)), loop[order]
    cuts = np.flatnonzero(np.concatenate(([True], loop[1:] != loop[:-1], [True]))) if loop.size else []
    return {int(loop[s]): table.slice(s, e - s) for s, e in zip(cuts, cuts[1:], strict=False)}


def dealt(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("pid", F.pmod(F.xxhash64("loop_id"), F.lit(groups)))


def by_loop(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply run to the rows of each loop; a task takes many loops at once."""
    prepare(rows.sparkSession)
    groups = max(1, -(-rows.count() // LOOP_ROWS))
    return dealt(rows, groups).groupBy("pid").applyInArrow(lambda table: pa.concat_tables([run(t) for t in slices(table).values()]), schema)


def trace(loop_table: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Order each loop from its least (az, ax, dir) and close its labels: loop_id, pos, edge_id,
    comp, sid, dir, wall, label, ix, iz, inx, inz (inward, to the left of travel)."""

    def run(table: pa.Table) -> pa.Table:
        cols = {k: table.column(k).to_numpy(zero_copy_only=False) for k in table.column_names}
        start = int(np.lexsort((cols["dir"], cols["ax"], cols["az"]))[0])
        order = ordered(cols["edge_id"], cols["next_id"], start)
        if len(order) < 4:
            order = []
        label = closed_labels([bool(cols["wall"][i]) for i in order], options.label_min_run)
        pick = {k: cols[k][order] for k in ("loop_id", "edge_id", "comp", "sid", "dir", "wall", "ix", "iz")}
        return pa.table(
            pick | {"pos": np.arange(len(order)), "label": np.array(label, bool), "inx": -(cols["bz"] - cols["az"])[order], "inz": (cols["bx"] - cols["ax"])[order]}
        ).select(["loop_id", "pos", "edge_id", "comp", "sid", "dir", "wall", "label", "ix", "iz", "inx", "inz"])

    return by_loop(loop_table, run, "loop_id bigint, pos bigint, edge_id bigint, comp bigint, sid bigint, dir int, wall boolean, label boolean, ix bigint, iz bigint, inx bigint, inz bigint")


def loop_points(traced: DataFrame) -> DataFrame:
    """Centres of the owning cells along each loop; a cell repeats only where its label changes."""
    from pyspark.sql import Window

    order = Window.partitionBy("loop_id").orderBy("pos")
    same = (F.lag("ix").over(order) == F.col("ix")) & (F.lag("iz").over(order) == F.col("iz")) & (F.lag("label").over(order) == F.col("label"))
    rows = traced.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same")
    return rows.select("loop_id", "pos", "comp", "sid", (F.col("ix") + 0.5).alias("x"), (F.col("iz") + 0.5).alias("z"), "inx", "inz", "label")


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    sides = []
    for order in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides


class Line:
    """Total-least-squares line with running moments. The point farthest from any line is a corner of
    the convex hull, which stays small for points that one line fits."""

    def __init__(self) -> None:
        self.x: list[float] = []
        self.z: list[float] = []
        self.sums = [0.0] * 5
        self.corners: list[tuple[float, float]] = []
        self.before = self.corners

    def push(self, x: float, z: float) -> None:
        self.x.append(x)
        self.z.append(z)
        # moments about the first point, which keeps them small and exact on a lattice
        u, w = x - self.x[0], z - self.z[0]
        for k, t in enumerate((u, w, u * u, w * w, u * w)):
            self.sums[k] += t
        self.before, self.corners = self.corners, hull([*self.corners, (x, z)])

    def fit(self, n: int | None = None) -> tuple[float, float, float, float]:
        """Centre and unit direction."""
        n = n or len(self.x)
        su, sw, suu, sww, suw = self.sums
        angle = 0.5 * math.atan2(2 * (suw - su * sw / n), (suu - su * su / n) - (sww - sw * sw / n))
        return self.x[0] + su / n, self.z[0] + sw / n, math.cos(angle), math.sin(angle)

    def deviation(self) -> float:
        cx, cz, dx, dz = self.fit()
        return max(abs((x - cx) * -dz + (z - cz) * dx) for x, z in self.corners)

    def pop(self) -> None:
        """Take back the last push."""
        x, z = self.x.pop(), self.z.pop()
        u, w = x - self.x[0], z - self.z[0]
        for k, t in enumerate((u, w, u * u, w * w, u * w)):
            self.sums[k] -= t
        self.corners = self.before


def greedy_fit(x: list[float], z: list[float], label: list[bool], tol: float) -> list[tuple[int, int]]:
    """Ranges of points that one line fits within tol; never across a change of label. A single
    point that fits nothing is a range of its own."""
    out, i, n = [], 0, len(x)
    while i < n:
        line, j = Line(), i + 1
        line.push(x[i], z[i])
        while j < n and label[j] == label[i]:
            line.push(x[j], z[j])
            if line.deviation() > tol:
                line.pop()
                break
            j += 1
        out.append((i, i + len(line.x)))
        i += len(line.x)
    return out


def joined_line(x: list[float], z: list[float], rows: list[int]) -> Line:
    line = Line()
    for i in rows:
        line.push(x[i], z[i])
    return line


def merged_segments(x: list[float], z: list[float], label: list[bool], parts: list[tuple[int, int]], options: LatticeOptions) -> list[tuple[int, int]]:
    """Join neighbours of one label that are nearly collinear, or short, while one line still fits."""
    limit = math.cos(math.radians(options.collinear_deg))
    out: list[tuple[int, int]] = []
    for s, e in parts:
        if out:
            p, q = out[-1]
            if q - p >= 2 and e - s >= 2 and label[p] == label[s]:
                a, b = joined_line(x, z, [*range(p, q)]), joined_line(x, z, [*range(s, e)])
                _, _, ax, az = a.fit()
                cx, cz, bx, bz = b.fit()
                along = [(b.x[k] - cx) * bx + (b.z[k] - cz) * bz for k in range(e - s)]
                if abs(ax * bx + az * bz) >= limit or max(along) - min(along) < options.min_seg_len:
                    if joined_line(x, z, [*range(p, e)]).deviation() <= options.fit_tol:
                        out[-1] = (p, e)
                        continue
        out.append((s, e))
    return out


def line_stats(points: DataFrame, key: str) -> DataFrame:
    """The least-squares line through the points (x, z) of each key: key, n, centre, direction, greatest
    deviation and extent along the line."""

    def run(table: pa.Table) -> pa.Table:
        x, z = (list(c) for c in zip(*sorted(zip(table.column("x").to_pylist(), table.column("z").to_pylist(), strict=True)), strict=True))
        line = joined_line(x, z, [*range(len(x))])
        cx, cz, dx, dz = line.fit()
        along = [(a - cx) * dx + (b - cz) * dz for a, b in zip(x, z, strict=True)]
        row = {key: table.column(key)[0].as_py(), "n": len(x), "cx": cx, "cz": cz, "dx": dx, "dz": dz, "deviation": line.deviation(), "extent": max(along) - min(along)}
        return pa.Table.from_pylist([row])

    prepare(points.sparkSession)
    return points.groupBy(key).applyInArrow(run, f"{key} bigint, n bigint, cx double, cz double, dx double, dz double, deviation double, extent double")


SEGMENTS = "loop_id bigint, seg bigint, comp bigint, label boolean, n bigint, first_pos bigint, last_pos bigint, cx double, cz double, dx double, dz double, nx double, nz double, length double, bias double"


def fit_segments(points: DataFrame, options: LatticeOptions = LatticeOptions(), merge: bool = True) -> DataFrame:
    """Line segments of each loop of three points or more, with normals turned inward and the inward
    bias that puts no accepted centre outside the line. Single points have a null line."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(k).to_pylist() for k in ("pos", "x", "z", "inx", "inz", "label", "comp", "loop_id")), strict=True))
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        out = []
        if len(rows) >= 3:
            pos, x, z, inx, inz, label, comp, loop = (list(c) for c in zip(*rows, strict=True))
            parts = greedy_fit(x, z, label, options.fit_tol)
            if merge:
                parts = merged_segments(x, z, label, parts, options)
            for k, (s, e) in enumerate(parts):
                line = (None,) * 8
                if e - s >= 2:
                    cx, cz, dx, dz = joined_line(x, z, [*range(s, e)]).fit()
                    nx, nz = -dz, dx
                    if nx * sum(inx[s:e]) + nz * sum(inz[s:e]) < 0:
                        nx, nz = -nx, -nz
                    along = [(x[i] - cx) * dx + (z[i] - cz) * dz for i in range(s, e)]
                    bias = max(0.0, max((x[i] - cx) * nx + (z[i] - cz) * nz for i in range(s, e)))
                    line = (cx, cz, dx, dz, nx, nz, max(along) - min(along), bias)
                out.append((loop[0], k, comp[0], label[s], e - s, pos[s], pos[e - 1], *line))
        kinds = [pa.bool_() if n == "label" else pa.int64() if k < 7 else pa.float64() for k, n in enumerate(names)]
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return by_loop(points, run, SEGMENTS)


def point_widths(points: DataFrame, segments: DataFrame, field: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Half width behind every point of a fitted wall segment: loop_id, seg, pos, x, z, half_width."""
    from pyspark.sql import Window

    # segments part all points of a loop, so a point's segment is the last one begun
    begun = F.struct("seg", "nx", "nz", F.col("label").alias("wall")).alias("begun")
    begins = segments.select("loop_id", F.col("first_pos").alias("pos"), begun)
    order = Window.partitionBy("loop_id").orderBy("pos")
    own = points.join(begins, ["loop_id", "pos"], "left").withColumn("begun", F.last("begun", ignorenulls=True).over(order))
    own = own.where("begun.wall and begun.nx is not null").select("loop_id", "pos", "comp", "x", "z", "begun.seg", "begun.nx", "begun.nz")
    rows = own.select("loop_id", "seg", "pos", "comp", F.col("x").alias("qx"), F.col("z").alias("qz"), F.col("nx").alias("mx"), F.col("nz").alias("mz"))
    wide = half_width(rows, field, ["loop_id", "seg", "pos"], options.probe_cap)
    return rows.select("loop_id", "seg", "pos", F.col("qx").alias("x"), F.col("qz").alias("z")).join(wide, ["loop_id", "seg", "pos"])


def band(h: float, options: LatticeOptions) -> int:
    return math.floor(min(max(h - options.narrow_margin, 0.0), options.radius) / max(options.offset_band, 0.05) + 1e-9)


def graded(widths: list[float], options: LatticeOptions) -> list[tuple[int, int, float]]:
    """(first, end, least half width) of stretches in one offset band: a sliding minimum keeps a
    pinch local, then stretches split where the band changes; single points join the one before."""
    w = max(options.min_run_len // 2, 1)
    smooth = [min(widths[max(0, i - w) : i + w + 1]) for i in range(len(widths))]
    out: list[tuple[int, int, float]] = []
    i = 0
    while i < len(smooth):
        j = i
        while j < len(smooth) and band(smooth[j], options) == band(smooth[i], options):
            j += 1
        least = min(smooth[i:j])
        if out and j - i < 2:
            s, _, m = out[-1]
            out[-1] = (s, j, min(m, least))
        else:
            out.append((i, j, least))
        i = j
    return out


OFFSETS = (
    "loop_id bigint, seg bigint, part bigint, label boolean, n bigint, first_x double, first_z double, last_x double, last_z double, cx double, cz double, "
    "dx double, dz double, nx double, nz double, half_width double, width double, bias double, offset double, narrow boolean, ox double, oz double"
)


def offset_segments(points: DataFrame, segments: DataFrame, widths: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Sub-segments with their offset line through (ox, oz). Walls move inward by the clamped half
    width behind them, dropoffs outward to the floor's true edge; single points have no line."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pts = {r["pos"]: r for r in left.to_pylist()}
        places = sorted(pts)
        out = []
        for s in sorted(right.to_pylist(), key=lambda r: r["seg"]):
            own = [pts[p] for p in places[bisect_left(places, s["first_pos"]) : bisect_right(places, s["last_pos"])]]
            ends = lambda q: (q[0]["x"], q[0]["z"], q[-1]["x"], q[-1]["z"])
            if s["nx"] is None:
                out.append((s["loop_id"], s["seg"], 0, s["label"], len(own), *ends(own), *(None,) * 13))
                continue
            dx, dz, nx, nz = s["dx"], s["dz"], s["nx"], s["nz"]
            if not s["label"]:
                offset = -options.dropoff_outset
                out.append((s["loop_id"], s["seg"], 0, False, len(own), *ends(own), s["cx"], s["cz"], dx, dz, nx, nz, math.inf, None, 0.0, offset, False, s["cx"] + nx * offset, s["cz"] + nz * offset))
                continue
            for k, (i, j, least) in enumerate(graded([q["half_width"] for q in own], options)):
                sub = own[i:j]
                cx, cz = sum(q["x"] for q in sub) / len(sub), sum(q["z"] for q in sub) / len(sub)
                bias = max(0.0, max((q["x"] - cx) * nx + (q["z"] - cz) * nz for q in sub))
                cx, cz = cx + nx * bias, cz + nz * bias
                offset = min(max(least - options.narrow_margin, 0.0), options.radius)
                out.append((s["loop_id"], s["seg"], k, True, len(sub), *ends(sub), cx, cz, dx, dz, nx, nz, least, 2 * least, bias, offset, offset < options.radius - 1e-6, cx + nx * offset, cz + nz * offset))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    names = [c.split()[0] for c in OFFSETS.split(", ")]
    kinds = [{"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in OFFSETS.split(", ")]
    with_width = points.join(widths.select("loop_id", "pos", "half_width"), ["loop_id", "pos"], "left").select("loop_id", "pos", "x", "z", "half_width")
    groups = max(1, -(-points.count() // LOOP_ROWS))
    empty = pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    def many(left: pa.Table, right: pa.Table) -> pa.Table:
        of_loop = slices(left)
        return pa.concat_tables([empty, *(run(of_loop[k], t) for k, t in slices(right).items())])

    prepare(points.sparkSession)
    return dealt(with_width, groups).groupBy("pid").cogroup(dealt(segments, groups).groupBy("pid")).applyInArrow(many, OFFSETS)


def polygons(offsets: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """One polygon per loop with three offset lines or more: loop_id, verts (array of x, z), bevels, steps.

    Neighbouring lines meet at their intersection unless it lies beyond the miter limit from the
    first line's last point (a bevel) or the lines are parallel (a step)."""
    from pyspark.sql import Window

    rows = offsets.where("ox is not null")
    order = Window.partitionBy("loop_id").orderBy("seg", "part")
    whole = Window.partitionBy("loop_id").orderBy("seg", "part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.struct(*[F.col(c) for c in ("ox", "oz", "dx", "dz", "nx", "nz", "offset", "first_x", "first_z")])
    rows = rows.withColumn("nxt", F.coalesce(F.lead(after).over(order), F.first(after).over(whole))).withColumn("lines", F.count("*").over(Window.partitionBy("loop_id"))).where("lines >= 3")
    from ..functions.geometry import line_intersection

    x, z = line_intersection(*[F.col(c) for c in ("ox", "oz", "dx", "dz")], *[F.col(f"nxt.{c}") for c in ("ox", "oz", "dx", "dz")])
    limit = options.miter_limit * max(options.radius, 1e-3)
    rows = rows.withColumn("x", x).withColumn("z", z)
    far = F.sqrt((F.col("x") - F.col("last_x")) ** 2 + (F.col("z") - F.col("last_z")) ** 2) > limit
    point = lambda a, b: F.struct(a.alias("x"), b.alias("z"))
    corner = point(F.col("last_x") + F.col("nx") * F.col("offset"), F.col("last_z") + F.col("nz") * F.col("offset"))
    follow = point(F.col("nxt.first_x") + F.col("nxt.nx") * F.col("nxt.offset"), F.col("nxt.first_z") + F.col("nxt.nz") * F.col("nxt.offset"))
    verts = F.when(F.col("x").isNull() | far, F.array(corner, follow)).otherwise(F.array(point(F.col("x"), F.col("z"))))
    rows = rows.select("loop_id", F.struct("seg", "part", verts.alias("v")).alias("p"), F.when(F.col("x").isNotNull() & far, 1).otherwise(0).alias("bevel"), F.when(F.col("x").isNull(), 1).otherwise(0).alias("step"))
    return rows.groupBy("loop_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["v"])).alias("verts"), F.sum("bevel").alias("bevels"), F.sum("step").alias("steps"))


def offset_lines(points: DataFrame, field: DataFrame, options: LatticeOptions = LatticeOptions()) -> DataFrame:
    """Fitted and offset lines of loop points over a distance field."""
    spark = points.sparkSession
    segments = materialize(spark, fit_segments(points, options))
    return materialize(spark, offset_segments(points, segments, point_widths(points, segments, field, options), options))


def bake(surfels: DataFrame, options: LatticeOptions = LatticeOptions()) -> tuple[DataFrame, DataFrame]:
    """The lattice pipeline in one call: polygons of every loop, and one row of counters (cells,
    components, loops, segments, narrow, wall_segments, dropoff_segments, polygons, bevels, steps)."""
    spark = surfels.sparkSession
    nodes = lattice(surfels)
    cell_table = materialize(spark, cells(nodes, components(nodes, options)))
    traced = trace(materialize(spark, loops(materialize(spark, crack_edges(cell_table)))), options)
    points = materialize(spark, loop_points(traced))
    offsets = offset_lines(points, materialize(spark, distance_field(cell_table)), options)
    shapes = materialize(spark, polygons(offsets, options))
    some = lambda c: F.count(F.when(c, 1))
    lines = offsets.where("ox is not null").agg(
        F.count("*").alias("segments"), some(F.col("narrow")).alias("narrow"), some(F.col("label")).alias("wall_segments"), some(~F.col("label")).alias("dropoff_segments")
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    # each of these is one row
    counters = cell_table.agg(F.count("*").alias("cells"), F.countDistinct("comp").alias("components")).crossJoin(points.agg(F.countDistinct("loop_id").alias("loops")))
    return shapes, counters.crossJoin(lines).crossJoin(shapes.agg(F.count("*").alias("polygons"), zero("bevels"), zero("steps")))
