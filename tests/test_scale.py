"""Plans at scale: nothing that grows with the input is gathered on the driver."""

import os
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from stratum import runtime
from stratum.operators import bucket, graph, gridbounds, surface
from stratum.plans import queries

from test_operators import PARTS, grid_cells, no_dead, part

SF = "/root/testdata/sf0.001"
#: Queries whose joins are all between tables that grow with the input.
SHUFFLED = [
    "covering_cells", "grid_components", "boundary_runs", "stitch_candidates", "longest_runs",
    "wall_selection", "stitch_tees", "character_parts", "cut_frontier", "cut_outline_runs", "audit_by_kind",
    "component_sizes", "stitch_pairs", "stitched_audit", "debug_bars", "endpoint_degree", "open_ends",
    "run_length_by_kind",
]


@pytest.mark.parametrize("name", SHUFFLED)
def test_no_table_is_broadcast_by_its_estimated_size(spark, monkeypatch, name):
    plans, write = [], DataFrameWriter.parquet
    plan_of = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def noted(self, *args, **kwargs):
        plan_of(self._df)
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    plan_of(queries.QUERIES[name](spark, SF))
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastExchange" in p or "BroadcastNestedLoop" in p for p in plans)


def test_scratch_tables_are_part_files_only(spark):
    table = runtime.materialize(spark, spark.range(100, numPartitions=3))
    names = os.listdir(table._scratch.removeprefix("file://"))
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    assert sorted(r.id for r in table.collect()) == list(range(100))


def counted(monkeypatch, module):
    """The numbers of rows that the joins of a module make."""
    rows, join = [], module.shuffled_join

    def noted(*args, **kwargs):
        out = join(*args, **kwargs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(module, "shuffled_join", noted)
    return rows


def test_copies_of_a_box_meet_once(spark, monkeypatch):
    made = counted(monkeypatch, surface)
    n = 40
    places = [(k, (0, 0, 0), (4, 1, 4)) for k in range(n, 0, -1)] + [(n + k, (0, 2, 0), (1.5, 3, 4)) for k in range(n, 0, -1)]
    live, dead = surface.local_grids(spark.createDataFrame([part(*p) for p in places], PARTS))
    # every wall but the least is killed by nothing but itself, so walls stay under the sky; floors die by the least wall
    killers = {(r.grid_id, r.killer_id) for r in dead.select("grid_id", "killer_id").distinct().collect()}
    assert killers == {(k, n + 1) for k in range(1, n + 1)}
    assert dead.where(f"grid_id <= {n}").count() + live.where(f"grid_id <= {n}").count() == 16 * n
    # 20 places at most see two boxes in a bucket; samples are joined back one to one
    assert made and max(made) <= 24 * n


def test_a_killer_is_the_least_other_part(spark):
    """Three equal boxes that overlap each other's probes: the least kills the others, the next one kills it."""
    parts = spark.createDataFrame([part(k, (0, 0, 0), (2, 1, 2)) for k in (7, 3, 5)] + [part(k, (0, 1.2, 0), (2, 1, 2)) for k in (4, 9)], PARTS)
    _, dead = surface.local_grids(parts)
    assert {(r.grid_id, r.killer_id) for r in dead.collect()} == {(7, 4), (3, 4), (5, 4)}


def test_copies_of_a_cell_meet_once(spark, monkeypatch):
    made = counted(monkeypatch, bucket)
    n = 40
    cells = grid_cells(spark, [(k, k, 0, 0, 0.5, 0.0, 0.5, 0.0) for k in range(n, 0, -1)] + [(n + k, n + k, 0, 0, 1.5, 0.0, 0.5, 0.0) for k in range(n, 0, -1)])
    covered = gridbounds.covered_sides(cells).collect()
    assert {(r.cell_id, r.du, r.dv, r.hit, r.close) for r in covered} == {(k, 1, 0, n + 1, n + 1) for k in range(1, n + 1)} | {(n + k, -1, 0, 1, 1) for k in range(1, n + 1)}
    assert max(made) <= 4 * 2 * n
    # a probe that its own cell covers takes the next copy, or the next tile
    probes = cells.where("cell_id in (1, 2)").selectExpr("cell_id", "px as qx", "py as qy", "pz as qz")
    skip = bucket.covering_cell(probes, cells, ["cell_id"], 0.25, 0.25, 0.6, 1.0, F.col("cell_id")).collect()
    assert {(r.cell_id, r.hit, r.off) for r in skip} == {(1, 2, 0.0), (2, 1, 0.0)}
    few = cells.where(f"cell_id in (1, {n + 1})")
    skip = bucket.covering_cell(probes.where("cell_id = 1"), few, ["cell_id"], 0.25, 0.25, 0.6, 1.0, F.col("cell_id")).collect()
    assert {(r.cell_id, r.hit, r.off) for r in skip} == {(1, n + 1, 1.0)}


def test_copies_of_a_killer_cost_one_footprint(spark):
    n = 20
    parts = spark.createDataFrame([part(k, (0, 0, 0), (4, 1, 4)) for k in range(1, n + 1)] + [part(n + k, (0, 2, 0), (1.5, 3, 4)) for k in range(1, n + 1)], PARTS)
    _, dead = surface.local_grids(parts)
    feet = surface.footprints(parts, dead)
    plan = feet._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert {r.part_id for r in feet.select("part_id").distinct().collect()} == {n + 1}


def test_floor_under_copies_of_a_foot(spark, monkeypatch):
    made = counted(monkeypatch, gridbounds)
    n = 30
    cells = grid_cells(spark, [(k, k, 0, 0, 0.5, y, 0.5, 0.0) for k in range(n) for y in (0.0, 1.0)])
    feet = spark.createDataFrame([(k, 0, 0, 0.5, 1.5, 0.5) for k in range(n)], "part_id bigint, ui bigint, vi bigint, bx double, by double, bz double")
    floors = gridbounds.floor_under(feet, cells, no_dead(spark)).collect()
    assert sorted((r.part_id, r.floor_y) for r in floors) == [(k, 1.0) for k in range(n)]
    assert max(made) <= n


@pytest.mark.parametrize("chunk", [0, 7])
def test_components_of_a_graph_beyond_one_task(spark, chunk):
    rnd = random.Random(4)
    edges = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(5, k) for k in range(200, 230)] + [(1, 1), (7, 8), (7, 8)]
    least = {n: n for a, b in edges if a != b for n in (a, b)}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), small=0, chunk=chunk).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(least.items())


def test_near_nodes_are_joined_without_rounds(spark, monkeypatch):
    """Chunks leave so few links between their roots that one task joins them."""
    monkeypatch.setattr(graph, "starred", None)
    # two chains, of even and of odd nodes
    got = graph.connected_components(spark.range(2000).selectExpr("id as a", "id + 2 as b"), small=100, chunk=150)
    assert [(r.component, r["count"]) for r in got.groupBy("component").count().orderBy("component").collect()] == [(0, 1001), (1, 1001)]
