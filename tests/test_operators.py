"""Micro-scenes and brute-force checks."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.config import FloorOptions, GridOptions, LatticeOptions
from stratum.functions import geometry as g
from stratum.functions import vectors as v
from stratum.operators import closure, contour, gridbounds, lattice, octree, surface
from stratum.operators.graph import connected_components
from stratum.sources import snapshot


def cells_of(spark, places, blocked=0):
    rows = [(k, 0, x, z, 0.0, blocked) for k, (x, z) in enumerate(places)]
    return spark.createDataFrame([(c, x, z, s, y, b) for s, c, x, z, y, b in rows], "comp bigint, ix bigint, iz bigint, sid bigint, y double, blocked int")


def grid_cells(spark, rows):
    """rows: (cell_id, grid_id, ui, vi, x, y, z, angle)."""
    out = [(c, gr, ui, vi, x, y, z, math.cos(t), 0.0, math.sin(t), -math.sin(t), 0.0, math.cos(t), 0.0, 1.0, 0.0) for c, gr, ui, vi, x, y, z, t in rows]
    return spark.createDataFrame(out, "cell_id bigint, grid_id bigint, ui bigint, vi bigint, px double, py double, pz double, ux double, uy double, uz double, vx double, vy double, vz double, nx double, ny double, nz double")


def no_dead(spark):
    return spark.createDataFrame([], "grid_id bigint, ui bigint, vi bigint, px double, py double, pz double, killer_id bigint")


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_match_union_find(spark, small):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(1, 1), (7, 8), (7, 8)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), small=small).collect()
    assert {r.node: r.component for r in got} == want


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_distance_field_is_exact(spark):
    rnd = random.Random(5)
    places = {(x, z) for x in range(14) for z in range(11) if rnd.random() < 0.85}
    got = {(r.ix, r.iz): r.d2 for r in lattice.distance_field(cells_of(spark, sorted(places))).collect()}
    outside = [(x, z) for x in range(-1, 15) for z in range(-1, 12) if (x, z) not in places]
    assert got == {p: min((p[0] - x) ** 2 + (p[1] - z) ** 2 for x, z in outside) for p in places}


def test_one_cell_has_one_loop_of_four(spark):
    loops = lattice.loops(lattice.crack_edges(cells_of(spark, [(2, 3)])))
    assert loops.groupBy("loop_id").count().collect()[0]["count"] == 4


def test_hole_gives_two_loops_and_every_crack_one(spark):
    places = [(x, z) for x in range(3) for z in range(3) if (x, z) != (1, 1)]
    edges = lattice.crack_edges(cells_of(spark, places))
    loops = lattice.loops(edges)
    assert sorted(r["count"] for r in loops.groupBy("loop_id").count().collect()) == [4, 12]
    assert edges.count() == loops.count() == 16


def test_corridor_half_width_and_offset(spark):
    options = LatticeOptions()
    for width, want in ((1, 0.25), (2, 0.25), (3, 1.25), (4, 1.25), (5, 1.5)):
        cells = cells_of(spark, [(x, z) for x in range(30) for z in range(width)], blocked=15)
        points = spark.createDataFrame([(1, 0, 15.5, 0.5, 0.0, 1.0)], "k int, comp bigint, qx double, qz double, mx double, mz double")
        half = lattice.half_width(points, lattice.distance_field(cells), ["k"]).first().half_width
        assert min(max(half - options.narrow_margin, 0), options.radius) == want


def test_severed_by_a_doorway(spark):
    places = [(x, z) for x in range(7) for z in range(7)] + [(7, 3), (8, 3)] + [(x, z) for x in range(9, 16) for z in range(7)]
    row = lattice.severance(lattice.distance_field(cells_of(spark, places))).first()
    assert (row.pieces_after, row.severed, row.erased) == (2, True, False)


def test_label_closing():
    assert contour.closed_labels([True, True, False, False, True, True], 3) == [True] * 6
    assert contour.closed_labels([True, False, False, False, True], 3) == [True, False, False, False, True]
    assert contour.closed_labels([False, True, True, False], 3) == [True] * 4
    assert contour.closed_labels([False] * 5, 3) == [False] * 5


def test_line_and_greedy_fit():
    x, z = [0.5, 1.5, 2.5, 3.5, 3.5, 3.5, 3.5, 3.5], [0.5, 0.5, 0.5, 0.5, 1.5, 2.5, 3.5, 4.5]
    parts = contour.greedy_fit(x, z, [True] * 8, 0.3)
    assert parts[0][0] == 0 and parts[-1][1] == 8 and all(a[1] == b[0] for a, b in itertools.pairwise(parts))
    line = contour.joined_line(x, z, [0, 1, 2, 3])
    assert abs(line.fit()[3]) < 1e-9 and line.deviation() < 1e-9


def test_graded_offsets_keep_a_pinch_local():
    widths = [2.5] * 20
    widths[10] = 0.5
    runs = contour.graded(widths, LatticeOptions())
    assert [(s, e) for s, e, _ in runs] == [(0, 8), (8, 13), (13, 20)]
    assert [m for *_, m in runs] == [2.5, 0.5, 2.5]


def test_polygon_of_a_room(spark):
    cells = cells_of(spark, [(x, z) for x in range(12) for z in range(12)], blocked=15)
    traced = contour.trace(lattice.loops(lattice.crack_edges(cells)))
    points = contour.loop_points(traced)
    segments = contour.fit_segments(points)
    widths = contour.point_widths(points, segments, lattice.distance_field(cells))
    polygon = contour.polygons(contour.offset_segments(points, segments, widths)).first()
    assert len(polygon.verts) >= 4
    # no corner lies outside the outermost cell centres
    assert all(0.5 <= p.x <= 11.5 and 0.5 <= p.z <= 11.5 for p in polygon.verts) and polygon.bevels == 0


def test_two_abutting_cells_merge_into_runs(spark):
    live = grid_cells(spark, [(1, 1, 0, 0, 0.5, 0.0, 0.5, 0.0), (2, 1, 1, 0, 1.5, 0.0, 0.5, 0.0)])
    runs = gridbounds.merge_edges(gridbounds.classify(live, no_dead(spark))).collect()
    assert sorted(r.cells for r in runs) == [1, 1, 2, 2] and all(r.kind == "dropoff" for r in runs)


def test_seam_between_rotated_grids(spark):
    t = math.atan2(0.8, 0.6)
    live = grid_cells(spark, [(1, 1, 0, 0, 0.5, 0.0, 0.5, 0.0), (2, 2, 0, 0, 1.55, 0.0, 0.55, t)])
    kinds = {(r.cell_id, r.du, r.dv): r.kind for r in gridbounds.classify(live, no_dead(spark)).collect()}
    assert kinds[1, 1, 0] == "seam" and kinds[1, -1, 0] == "dropoff"


def test_wall_without_killer_stays_a_wall(spark):
    live = grid_cells(spark, [(1, 1, 0, 0, 0.5, 0.0, 0.5, 0.0)])
    dead = spark.createDataFrame([(1, 1, 0, 1.5, 0.0, 0.5, None)], no_dead(spark).schema)
    edges = gridbounds.classify(live, dead)
    assert edges.where("kind = 'wall'").count() == 1 and gridbounds.cut_by(edges).count() == 0


def runs_table(spark, lines, kind="wall"):
    rows = [(kind, "floor-frame", 1, None, 1, *map(float, a), *map(float, b), 0.0, 0.0, 1.0, 1, math.dist(a, b)) for a, b in lines]
    names = ", ".join(f"{p}{k} double" for p in "abo" for k in "xyz")
    return spark.createDataFrame(rows, f"kind string, source string, grid_id bigint, killer_id bigint, comp bigint, {names}, cells bigint, length double")


def test_closed_square_has_no_open_end_and_a_gap_is_stitched(spark):
    p = [(0, 0, 0), (4, 0, 0), (4, 0, 4), (0, 0, 4)]
    closed = runs_table(spark, list(itertools.pairwise([*p, p[0]])))
    assert closure.audit(closed).where("scope = 'all'").first().open_ends == 0
    gap = runs_table(spark, [(p[0], p[1]), (p[1], p[2]), (p[2], p[3]), (p[3], (0, 0, 1))])
    assert closure.audit(gap).where("scope = 'all'").first().open_ends == 2
    fixed = closure.stitch(gap)
    assert fixed.where("source = 'stitch'").count() == 1 and closure.audit(fixed).where("scope = 'all'").first().open_ends == 0


def test_end_on_the_middle_of_a_run_becomes_a_junction(spark):
    tee = runs_table(spark, [((0, 0, 0), (10, 0, 0)), ((5, 0, 1), (5, 0, 9))])
    fixed = closure.stitch(tee, GridOptions())
    assert fixed.where("source = 'stitch'").count() == 1 and fixed.where("source <> 'stitch'").count() == 3


def test_box_tests_match_sampling(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for k in range(40):
        q, _ = np.linalg.qr(rnd.normal(size=(3, 3)))
        rows.append((k, *map(float, [*rnd.uniform(-1, 1, 3), *q.T.ravel(), *rnd.uniform(0.2, 2, 3), *rnd.uniform(-2, 2, 3)])))
    names = ", ".join(f"{p}{a} double" for p in "prulsq" for a in "xyz")
    df = spark.createDataFrame(rows, f"k int, {names}")
    axes, half = (v.of("r"), v.of("u"), v.of("l")), v.scale(v.of("s"), 0.5)
    got = df.select("k", g.box_hits_cube(v.of("p"), axes, half, v.of("q"), F.lit(0.5)).alias("hit"), g.cube_in_box(v.of("q"), F.lit(0.5), v.of("p"), axes, half).alias("inside")).collect()
    steps = np.linspace(-0.5, 0.5, 41)
    grid = np.stack(np.meshgrid(steps, steps, steps), -1).reshape(-1, 3)
    for r, row in zip(got, rows, strict=True):
        p, m, s, q = np.array(row[1:4]), np.array(row[4:13]).reshape(3, 3), np.array(row[13:16]), np.array(row[16:19])
        inside = (np.abs((grid + q - p) @ m.T) <= s / 2).all(axis=1)
        assert not inside.any() or r.hit
        assert r.inside == bool((np.abs((grid + q - p) @ m.T) <= s / 2 + 1e-4).all())


def part(k, p, s, name="Block", shape="Block", collide=True, character=False, cls="Part"):
    return (k, name, cls, shape, collide, character, *map(float, p), 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, *map(float, s))


PARTS = "part_id bigint, name string, class string, shape string, can_collide boolean, is_character boolean, " + ", ".join(f"{a}{k} double" for a in "pruls" for k in "xyz")


def test_scan_filter(spark):
    rows = [part(1, (0, 0, 0), (4, 1, 4)), part(2, (0, 0, 0), (500, 1, 4)), part(3, (0, 0, 0), (1, 1, 1), collide=False), part(4, (0, 0, 0), (1, 1, 1), character=True), part(5, (0, 0, 0), (1, 1, 1), cls="Terrain")]
    assert [r.part_id for r in surface.gather_parts(spark.createDataFrame(rows, PARTS)).collect()] == [1]


def test_characters_by_ancestor(spark):
    rows = [(1, None, "Workspace"), (2, 1, "Model"), (3, 2, "Humanoid"), (4, 2, "Part"), (5, 4, "Part"), (6, 1, "Part")]
    got = surface.characters(spark.createDataFrame(rows, "instance_id bigint, parent_id bigint, class string"))
    assert sorted(r.instance_id for r in got.collect()) == [3, 4, 5]


def test_floor_bake_with_headroom(spark):
    parts = spark.createDataFrame([part(1, (0.25, 0.25, 0.25), (8, 1, 8)), part(2, (0.25, 4.25, 0.25), (3, 1, 3))], PARTS)
    samples, leaves, root = surface.bake_floor(parts)
    low = samples.where("part_id = 1").collect()
    assert len(low) >= 49 and all(abs(r.py - 0.75) < 1e-9 and r.slope < 1e-6 for r in low)
    under = [r for r in low if abs(r.px - 0.25) < 1 and abs(r.pz - 0.25) < 1]
    assert under and all(abs(r.clearance - (3.75 - 0.75 - 0.15)) < 1e-9 for r in under)
    with pytest.raises(ValueError):
        FloorOptions(leaf=0.5)


def test_local_grid_kills_samples_under_a_wall(spark):
    parts = spark.createDataFrame([part(1, (0, 0, 0), (8, 1, 8)), part(2, (0, 2, 0), (1.5, 3, 8))], PARTS)
    live, dead = surface.local_grids(parts)
    assert dead.where("grid_id = 1 and killer_id = 2").count() >= 8 and live.where("grid_id = 1").count() >= 40
    feet = surface.footprints(parts, dead)
    assert feet.where("part_id = 2").count() > 0 and abs(feet.agg(F.min("by")).first()[0] - 0.5) < 1e-9
    kinds = {(r.kind, r.source) for r in gridbounds.bake(live, dead, feet).collect()}
    assert ("wall", "footprint") in kinds and ("dropoff", "floor-frame") in kinds


def test_octree_is_canonical_and_triangles_fill_what_they_touch(spark):
    root = octree.Root(0.0, 0.0, 0.0, 1.0, 4)
    cube = spark.createDataFrame([part(1, (4, 4, 4), (7.9, 7.9, 7.9))], PARTS)
    leaves = octree.collapse(octree.insert_boxes(cube, root), root)
    assert [(r.depth, r.ix, r.iy, r.iz) for r in leaves.collect()] == [(1, 0, 0, 0)]
    tri = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 3.5, 0.5, 0.5, 0.5, 0.5, 3.5)], "part_id bigint, " + ", ".join(f"{a}{k} double" for a in "abc" for k in "xyz"))
    got = {(r.ix, r.iy, r.iz) for r in octree.insert_triangles(tri, root).collect()}
    assert (0, 0, 0) in got and (3, 0, 0) in got and (3, 0, 3) not in got and all(y == 0 for _, y, _ in got)
    far = spark.createDataFrame([(1, -5.0, 2.0, 2.0), (2, 12.0, 2.0, 2.0)], "k int, qx double, qy double, qz double")
    assert [r.k for r in octree.in_solid(far, leaves, root).collect()] == [1]
    assert octree.stats(leaves.limit(0), root).first().solid_leaves == 0


def test_snapshot_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 1.25, 2.0, 3.5, 5), (2, 1.0, 2.0, 3.0, 4.0, None)], "sid bigint, px double, py double, pz double, clearance double, blocked int")
    for version, masks in ((2, [0, 5]), (1, [0, 0])):
        path = f"file://{tmp_path}/v{version}"
        snapshot.write_snapshot(rows, path, version)
        back = snapshot.read_snapshot(spark, path).collect()
        assert sorted(r.blocked for r in back) == masks and sorted(r.px for r in back) == [0.5, 1.0]
    plain = tmp_path / "old.txt"
    plain.write_text("NVGNSURF1\n1\n\n0.5 1 2 3.00\n")
    assert snapshot.read_snapshot(spark, f"file://{plain}").first().clearance == 3.0
    plain.write_text("other\n")
    with pytest.raises(ValueError):
        snapshot.read_snapshot(spark, f"file://{plain}")


def test_chain_of_falling_gaps_is_paired_to_the_end(spark):
    places = [0.0]
    for k in range(40):
        places.append(places[-1] + 2.4 - k * 0.03)
    rows = [(round(x * 1000), 0, 0, x, 0.0, 0.0) for x in places]
    ends = spark.createDataFrame(rows, "kx bigint, ky bigint, kz bigint, px double, py double, pz double")
    got = {(r.i.kx, r.j.kx) for r in closure.stitch_pairs(closure.stitch_candidates(ends, 2.5)).collect()}
    left = sorted((round(b[3] - a[3], 9), a[0], b[0]) for a, b in itertools.combinations(rows, 2) if b[3] - a[3] <= 2.5)
    used, want = set(), set()
    for _, a, b in left:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want and len(want) > closure.PAIR_ROUNDS * 2


def test_characters_at_any_depth(spark):
    rows = [(0, None, "Model"), (1, 0, "Humanoid")] + [(k, k - 1 if k > 2 else 0, "Part") for k in range(2, 200)]
    schema = "instance_id bigint, parent_id bigint, class string"
    assert surface.characters(spark.createDataFrame(rows, schema)).count() == 199
    with pytest.raises(ValueError):
        surface.characters(spark.createDataFrame([(1, 2, "Part"), (2, 1, "Part")], schema))


def test_closed_meshes_are_filled(spark):
    corner = [(x, y, z) for x in (1.2, 6.7) for y in (0.3, 4.6) for z in (2.4, 7.9)]
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    rows = [(1, *corner[a], *corner[b], *corner[c]) for q in quads for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    triangles = spark.createDataFrame(rows, "part_id bigint, " + ", ".join(f"{p}{k} double" for p in "abc" for k in "xyz"))
    root = octree.Root(0.0, 0.0, 0.0, 1.0, 3)
    inside = {(r.ix, r.iy, r.iz) for r in octree.fill_meshes(triangles, root).collect()}
    assert inside == {(x, y, z) for x in range(8) for y in range(8) for z in range(8) if 1.2 < x + 0.5 < 6.7 and 0.3 < y + 0.5 < 4.6 and 2.4 < z + 0.5 < 7.9}
    shell = octree.insert_triangles(triangles, root).select("ix", "iy", "iz")
    all_cells = {(r.ix, r.iy, r.iz) for r in shell.collect()} | inside
    assert all_cells == {(x, y, z) for x in range(1, 7) for y in range(5) for z in range(2, 8)}


def test_collapse_takes_nodes_of_any_depth(spark):
    rnd = random.Random(11)
    root = octree.Root(0.0, 0.0, 0.0, 1.0, 4)
    nodes = [(2, 0, 0, 0), (1, 1, 1, 1), (4, 15, 15, 15), (4, 1, 1, 1)] + [(3, x, y, z) for x in (2, 3) for y in (0, 1) for z in (0, 1)]
    nodes += [(4, rnd.randrange(16), rnd.randrange(16), rnd.randrange(16)) for _ in range(900)]
    unit = set()
    for d, x, y, z in nodes:
        e = 1 << (4 - d)
        unit |= {(x * e + i, y * e + j, z * e + k) for i in range(e) for j in range(e) for k in range(e)}
    want, filled = set(), {4: unit}
    for d in range(3, -1, -1):
        below = filled[d + 1]
        filled[d] = {(x, y, z) for x, y, z in {(a // 2, b // 2, c // 2) for a, b, c in below} if all((2 * x + i, 2 * y + j, 2 * z + k) in below for i in (0, 1) for j in (0, 1) for k in (0, 1))}
    for d in range(5):
        want |= {(d, *c) for c in filled[d] if d == 0 or tuple(v // 2 for v in c) not in filled[d - 1]}
    got = octree.collapse(spark.createDataFrame(nodes, "depth int, ix bigint, iy bigint, iz bigint"), root)
    assert {(r.depth, r.ix, r.iy, r.iz) for r in got.collect()} == want


def test_triangle_and_box_tests_match_sampling(spark):
    rnd = np.random.default_rng(8)
    rows = [(k, *map(float, rnd.uniform(-1.2, 1.2, 12))) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{p}{a} double" for p in "abcq" for a in "xyz"))
    got = {r.k: r.hit for r in df.select("k", g.triangle_hits_cube(v.of("a"), v.of("b"), v.of("c"), v.of("q"), F.lit(0.5)).alias("hit")).collect()}
    s, t = np.meshgrid(np.linspace(0, 1, 120), np.linspace(0, 1, 120))
    s, t = s[s + t <= 1], t[s + t <= 1]
    agree = 0
    for row in rows:
        a, b, c, q = (np.array(row[1 + 3 * n : 4 + 3 * n]) for n in range(4))
        reach = np.abs(a + s[:, None] * (b - a) + t[:, None] * (c - a) - q).max(axis=1).min()
        # samples lie within a fiftieth of any place of the triangle
        if reach <= 0.5:
            assert got[row[0]]
        if got[row[0]]:
            assert reach <= 0.53
        agree += got[row[0]]
    assert 30 < agree < 270


def test_farthest_point_is_a_corner_of_the_hull():
    rnd = random.Random(4)
    for _ in range(100):
        line = contour.Line()
        for _ in range(rnd.randrange(2, 40)):
            line.push(rnd.randrange(30) + 0.5, rnd.randrange(3) + 0.5)
        cx, cz, dx, dz = line.fit()
        assert abs(line.deviation() - max(abs((x - cx) * -dz + (z - cz) * dx) for x, z in zip(line.x, line.z, strict=True))) < 1e-12


def test_wide_open_field_costs_linear_time(spark):
    import time

    size = 400
    cells = spark.range(size * size).select(F.lit(0).cast("bigint").alias("comp"), (F.col("id") % size).alias("ix"), F.expr(f"id div {size}").alias("iz"), F.col("id").alias("sid"), F.lit(0.0).alias("y"), F.lit(0).alias("blocked"))
    began = time.time()
    found = lattice.distance_field(cells).agg(F.max("d2").alias("most"), F.sum(F.when(F.col("d2") != F.pow(F.least(F.col("ix") + 1, F.col("iz") + 1, size - F.col("ix"), size - F.col("iz")), 2), 1).otherwise(0)).alias("wrong")).first()
    assert (found.most, found.wrong) == ((size // 2) ** 2, 0) and time.time() - began < 60


def test_scratch_folder_is_shared_or_refused():
    from types import SimpleNamespace

    from stratum import runtime

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=SimpleNamespace(master=master))

    assert runtime.scratch_dir(session("yarn", "hdfs://a/b/")) == "hdfs://a/b"
    assert runtime.scratch_dir(session("local[4]", None)).startswith("file:///tmp/")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            runtime.scratch_dir(session(master, None))


def test_archive_holds_the_package():
    import zipfile

    from stratum import runtime

    names = zipfile.ZipFile(runtime.archive()).namelist()
    assert "stratum/__init__.py" in names and "stratum/operators/octree.py" in names
