"""A linear octree: one row per solid leaf, addressed by depth and integer coordinates.

Boxes are rasterised in two steps: the blocks of 8 x 8 x 8 unit cells that a box reaches are
enumerated inside its bounding range, missed ones are dropped, contained ones are emitted whole and
only the rest is split into unit cells, so a large box never explodes into all its cells. A node is
filled when the filled cells below it add up to its volume; leaves are filled nodes without a
filled parent. That gives the same canonical tree for any insert order, in one job."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import vectors as v
from ..runtime import materialize


#: Levels above the unit leaves at which rasterising starts.
COARSE = 3


@dataclass(frozen=True)
class Root:
    """The root cube: lower corner, edge of a unit leaf and depth (edge = leaf * 2^depth)."""

    x: float
    y: float
    z: float
    leaf: float
    depth: int

    @property
    def edge(self) -> float:
        return self.leaf * (1 << self.depth)

    def corner(self) -> v.Vec:
        return v.lit(self.x, self.y, self.z)


def root_of(boxes: DataFrame, leaf: float = 1.0, margin: float = 2.0) -> Root:
    """Root cube around boxes (centre p, axes r u l, full size s), padded by margin."""
    half = g.box_half(v.of("r"), v.of("u"), v.of("l"), v.of("s"))
    low, high = v.sub(v.of("p"), half), v.add(v.of("p"), half)
    ends = boxes.agg(*[F.min(x).alias(f"l{k}") for x, k in zip(low, "xyz", strict=True)], *[F.max(x).alias(f"h{k}") for x, k in zip(high, "xyz", strict=True)]).first()
    if ends.lx is None:
        raise ValueError("no parts")
    lo = [ends[f"l{k}"] - margin for k in "xyz"]
    hi = [ends[f"h{k}"] + margin for k in "xyz"]
    extent = max(h - x for x, h in zip(lo, hi, strict=True))
    depth = max(0, math.ceil(math.log2(extent / leaf)))
    edge = leaf * (1 << depth)
    return Root(*[(x + h) / 2 - edge / 2 for x, h in zip(lo, hi, strict=True)], leaf, depth)


def node_centre(root: Root, depth: int) -> tuple[v.Vec, float]:
    """Centre of the node (ix, iy, iz) at a depth, and half its edge."""
    edge = root.edge / (1 << depth)
    return v.add(root.corner(), v.scale((F.col("ix") + 0.5, F.col("iy") + 0.5, F.col("iz") + 0.5), edge)), edge / 2


def unit_cells(blocks: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """The cells of a block, `levels` further down."""
    bits = [F.expr(f"shiftright(_n, {levels * k}) & {(1 << levels) - 1}") for k in range(3)]
    rows = blocks.select(*keep, "ix", "iy", "iz", F.explode(F.sequence(F.lit(0), F.lit(8**levels - 1))).alias("_n"))
    return rows.select(*keep, *[(F.shiftleft(f"i{k}", levels) + n).alias(f"i{k}") for k, n in zip("xyz", bits, strict=True)])


def coarse_nodes(shapes: DataFrame, root: Root, low: v.Vec, high: v.Vec, depth: int) -> DataFrame:
    """Shapes with every node of a depth that their bounds touch; outside the root there is none."""
    edge, top = root.edge / (1 << depth), (1 << depth) - 1
    out = shapes
    for k, (a, b) in zip("xyz", zip(low, high, strict=True), strict=True):
        first = F.greatest(F.ceil((a - getattr(root, k)) / edge) - 1, F.lit(0))
        last = F.least(F.floor((b - getattr(root, k)) / edge), F.lit(top))
        out = out.withColumn(f"i{k}", F.explode(F.when(first <= last, F.sequence(first, last))))
    return out


def rasterize(shapes: DataFrame, root: Root, low: v.Vec, high: v.Vec, hits, inside=None) -> DataFrame:
    """depth, ix, iy, iz of the nodes that shapes fill. hits(at, reach) and inside(at, reach) are
    conditions over a shape's columns; a touched unit leaf counts as filled. The search starts with
    blocks, whose number stays small even for large shapes."""
    keep = shapes.columns
    start = max(0, root.depth - COARSE)
    at, reach = node_centre(root, start)
    blocks = coarse_nodes(shapes, root, low, high, start).where(hits(at, F.lit(reach)))
    name = lambda rows, depth: rows.select(F.lit(depth).alias("depth"), "ix", "iy", "iz").distinct()
    if root.depth == start:
        return name(blocks, start)
    whole = None
    if inside is not None:
        blocks = blocks.withColumn("_in", inside(at, F.lit(reach)))
        whole, blocks = blocks.where("_in"), blocks.where("not _in")
    at, reach = node_centre(root, root.depth)
    cells = name(unit_cells(blocks, keep, root.depth - start).where(hits(at, F.lit(reach))), root.depth)
    return cells if whole is None else cells.unionByName(name(whole, start))


def insert_boxes(boxes: DataFrame, root: Root) -> DataFrame:
    """Nodes filled by oriented boxes (centre p, axes r u l, full size s)."""
    half = v.scale(v.of("s"), 0.5)
    axes = (v.of("r"), v.of("u"), v.of("l"))
    keep = boxes.select(*[f"{a}{k}" for a in "pruls" for k in "xyz"])
    around = g.box_half(*axes, v.of("s"))
    return rasterize(keep, root, v.sub(v.of("p"), around), v.add(v.of("p"), around), lambda at, reach: g.box_hits_cube(v.of("p"), axes, half, at, reach), lambda at, reach: g.cube_in_box(at, reach, v.of("p"), axes, half))


def insert_triangles(triangles: DataFrame, root: Root) -> DataFrame:
    """Nodes touched by the triangles (a, b, c) of parts that are no boxes."""
    keep = triangles.select(*[f"{p}{k}" for p in "abc" for k in "xyz"])
    ends = [tuple(f(F.col(f"a{k}"), F.col(f"b{k}"), F.col(f"c{k}")) for k in "xyz") for f in (F.least, F.greatest)]
    return rasterize(keep, root, *ends, lambda at, reach: g.triangle_hits_cube(v.of("a"), v.of("b"), v.of("c"), at, reach))


def fill_meshes(triangles: DataFrame, root: Root) -> DataFrame:
    """Unit cells whose centre lies inside a closed mesh (part_id, triangles a, b, c), by the parity of
    the upright line through the column: every second stretch between its crossings is inside."""
    grid = lambda k, f: f(*[F.col(f"{p}{k}") for p in "abc"])
    top = (1 << root.depth) - 1
    rows = triangles.select("part_id", *[f"{p}{k}" for p in "abc" for k in "xyz"])
    for k in "xz":
        low = F.greatest(F.ceil((grid(k, F.least) - getattr(root, k)) / root.leaf - 0.5), F.lit(0))
        high = F.least(F.floor((grid(k, F.greatest) - getattr(root, k)) / root.leaf - 0.5), F.lit(top))
        rows = rows.withColumn(f"i{k}", F.explode(F.when(low <= high, F.sequence(low, high))))
    x, z = (F.lit(getattr(root, k)) + (F.col(f"i{k}") + 0.5) * root.leaf for k in "xz")

    def crosses(p: str, q: str):
        """Half-open, so that a line through a shared edge counts for one of its triangles only."""
        px, pz, qx, qz = (F.col(c) for c in (f"{p}x", f"{p}z", f"{q}x", f"{q}z"))
        return ((pz > z) != (qz > z)) & (x < px + F.try_divide((qx - px) * (z - pz), qz - pz))

    hits = sum((F.when(crosses(p, q), 1).otherwise(0) for p, q in ("ab", "bc", "ca")), F.lit(0))
    n = v.cross(v.sub(v.of("b"), v.of("a")), v.sub(v.of("c"), v.of("a")))
    y = F.col("ay") - F.try_divide(n[0] * (x - F.col("ax")) + n[2] * (z - F.col("az")), n[1])
    lines = rows.where(hits == 1).groupBy("part_id", "ix", "iz").agg(F.sort_array(F.collect_list(y)).alias("ys"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("ys") / 2).cast("int")), lambda m: F.struct(F.element_at("ys", 2 * m - 1).alias("s"), F.element_at("ys", 2 * m).alias("e")))
    spans = lines.where(F.size("ys") > 1).select("ix", "iz", F.explode(pairs).alias("p"))
    cell = lambda c: (F.col(c) - root.y) / root.leaf - 0.5
    low, high = F.greatest(F.ceil(cell("p.s")), F.lit(0)), F.least(F.floor(cell("p.e")), F.lit(top))
    return spans.select(F.lit(root.depth).alias("depth"), "ix", F.explode(F.when(low <= high, F.sequence(low, high))).alias("iy"), "iz").distinct()


def filled_nodes(nodes: DataFrame, depth: int, lowest: int) -> DataFrame:
    """All nodes from depths `lowest` to `depth` that are filled by distinct nodes (depth, ix, iy, iz) that
    do not overlap: their volumes, in cells of `depth`, add up to that of the node."""
    up = F.explode(F.sequence(F.lit(0), F.col("depth") - lowest)).alias("up")
    volume = F.expr(f"shiftleft(1L, 3 * ({depth} - depth))").alias("volume")
    rows = nodes.select("depth", "ix", "iy", "iz", volume, up)
    rows = rows.select((F.col("depth") - F.col("up")).alias("depth"), *[F.expr(f"shiftright(i{k}, up)").alias(f"i{k}") for k in "xyz"], "volume")
    full = rows.groupBy("depth", "ix", "iy", "iz").agg(F.sum("volume").alias("volume"))
    return full.where(F.expr(f"volume = shiftleft(1L, 3 * ({depth} - depth))")).drop("volume")


def collapse(nodes: DataFrame, root: Root) -> DataFrame:
    """Canonical leaves: complete octets become their parent, and nodes below a filled ancestor go.

    Sums up to the blocks come first, so that only filled blocks are summed up to the root."""
    if root.depth > 20:
        raise ValueError("a tree of more than 20 levels has volumes beyond 64 bits")
    block = max(0, root.depth - COARSE)
    nodes = absorbed(nodes.select("depth", "ix", "iy", "iz").distinct(), root)
    low = filled_nodes(nodes.where(F.col("depth") > block), root.depth, block)
    high = nodes.where(F.col("depth") <= block).unionByName(low.where(F.col("depth") == block)).distinct()
    full = low.where(F.col("depth") > block).unionByName(filled_nodes(high, block, 0) if block else high)
    parent = full.select((F.col("depth") + 1).alias("depth"), *[F.col(f"i{k}").alias(f"j{k}") for k in "xyz"])
    rows = full.select("depth", "ix", "iy", "iz", *[F.shiftright(f"i{k}", 1).alias(f"j{k}") for k in "xyz"])
    return rows.join(parent, ["depth", "jx", "jy", "jz"], "left_anti").select("depth", "ix", "iy", "iz")


def absorbed(nodes: DataFrame, root: Root) -> DataFrame:
    """Drop nodes that lie below a filled node of any smaller depth."""
    up = F.explode(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1))))
    below = nodes.where("depth > 0").select("depth", "ix", "iy", "iz", up.alias("up"))
    below = below.select("depth", "ix", "iy", "iz", (F.col("depth") - F.col("up")).alias("d"), *[F.expr(f"shiftright(i{k}, up)").alias(f"j{k}") for k in "xyz"])
    over = nodes.where(F.col("depth") < root.depth).select(F.col("depth").alias("d"), *[F.col(f"i{k}").alias(f"j{k}") for k in "xyz"])
    bad = below.join(over, ["d", "jx", "jy", "jz"], "left_semi").select("depth", "ix", "iy", "iz")
    return nodes.join(bad, ["depth", "ix", "iy", "iz"], "left_anti")


def is_block(shape: Column) -> Column:
    """Whether a part is a plain box; a part without a readable shape is not."""
    return F.coalesce(shape == "Block", F.lit(False))


def build(parts: DataFrame, triangles: DataFrame | None = None, leaf: float = 1.0, margin: float = 2.0) -> tuple[DataFrame, Root]:
    """Canonical leaves of all parts: boxes by their frame, other shapes by their triangles (part_id,
    a, b, c) and the inside of the closed meshes that these form."""
    root = root_of(parts, leaf, margin)
    nodes = insert_boxes(parts.where(is_block(F.col("shape"))), root)
    if triangles is not None:
        other = triangles.join(parts.where(~is_block(F.col("shape"))).select("part_id"), "part_id", "left_semi")
        nodes = nodes.unionByName(insert_triangles(other, root)).unionByName(fill_meshes(other, root))
    return materialize(parts.sparkSession, collapse(nodes, root)), root


def leaf_boxes(leaves: DataFrame, root: Root) -> DataFrame:
    """Every leaf with its centre c and half edge."""
    edge = F.lit(root.edge) / F.expr("shiftleft(1L, depth)")
    return leaves.select("*", (edge / 2).alias("half"), *[(F.lit(getattr(root, k)) + (F.col(f"i{k}") + 0.5) * edge).alias(f"c{k}") for k in "xyz"])


def stats(leaves: DataFrame, root: Root) -> DataFrame:
    """solid_leaves, internal_nodes, max_depth, min_leaf, max_leaf (0 when empty), leaf."""
    up = F.explode(F.sequence(F.lit(1), F.col("depth")))
    above = leaves.where("depth > 0").select("depth", "ix", "iy", "iz", up.alias("up"))
    above = above.select((F.col("depth") - F.col("up")).alias("d"), *[F.expr(f"shiftright(i{k}, up)").alias(f"i{k}") for k in "xyz"]).distinct()
    edge = F.lit(root.edge) / F.expr("shiftleft(1L, depth)")
    one = leaves.agg(F.count("*").alias("solid_leaves"), F.coalesce(F.min(edge), F.lit(0.0)).alias("min_leaf"), F.coalesce(F.max(edge), F.lit(0.0)).alias("max_leaf"))
    # an empty tree still has its root, which is no internal node
    return one.crossJoin(above.agg(F.count("*").alias("internal_nodes"))).select("solid_leaves", "internal_nodes", F.lit(root.depth).alias("max_depth"), "min_leaf", "max_leaf", F.lit(root.leaf).alias("leaf"))


def in_solid(probes: DataFrame, leaves: DataFrame, root: Root, prefix: str = "q") -> DataFrame:
    """The probes that lie in solid space; places outside the root count as its nearest cell.

    A probe looks at the depths that have leaves, of which there are at most root.depth + 1."""
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())
    top = (1 << root.depth) - 1
    cell = [v.clamp(F.floor((F.col(f"{prefix}{k}") - getattr(root, k)) / root.leaf), 0, top).alias(f"_{k}") for k in "xyz"]
    rows = probes.select("*", *cell).withColumn("_d", F.explode(F.array(*[F.lit(d) for d in depths]).cast("array<int>")))
    rows = rows.select("*", *[F.expr(f"shiftright(_{k}, {root.depth} - _d)").alias(f"_i{k}") for k in "xyz"])
    there = leaves.select(F.col("depth").alias("_d"), *[F.col(f"i{k}").alias(f"_i{k}") for k in "xyz"])
    return rows.join(there, ["_d", "_ix", "_iy", "_iz"], "left_semi").select(*probes.columns)
