"""The registered queries as DuckDB SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from .contour_sql import FIT, OFFSETS, POINTS, POLYGONS, RINGS, TRACE, deviation, extent, lines

ORACLES: dict[str, str] = {}


def with_(*parts: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(p.strip() for p in parts) + "\n" + body.strip()


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


# --- part-aligned grids ------------------------------------------------------

GRID = """
s2 AS (
  SELECT o_orderkey AS cell_id, o_orderkey // 256 AS grid_id, o_orderkey % 16 AS ui, (o_orderkey % 256) // 16 AS vi,
         (o_custkey * 7 + o_orderkey * 13) % 100 AS h
  FROM orders),
s2f AS (
  SELECT *, (CASE WHEN grid_id % 5 = 3 THEN 0.6 ELSE 1 END)::DOUBLE AS ux, (CASE WHEN grid_id % 5 = 3 THEN 0.8 ELSE 0 END)::DOUBLE AS uz,
         ((grid_id % 8) * 16)::DOUBLE + (CASE WHEN grid_id % 5 = 3 THEN 0.013 ELSE 0 END)::DOUBLE AS gx,
         ((grid_id // 8) * 16)::DOUBLE + (CASE WHEN grid_id % 5 = 3 THEN 0.007 ELSE 0 END)::DOUBLE AS gz,
         (CASE WHEN grid_id % 7 = 6 THEN 3.0 WHEN grid_id % 7 = 2 THEN 0.125 ELSE 0 END)::DOUBLE AS py,
         ((ui // 4) * 5 + (vi // 4) * 3 + grid_id * 2) % 9 AS blk
  FROM s2),
s2p AS (
  SELECT cell_id, grid_id, ui, vi, ux, uz, py, gx + (ui + 0.5::DOUBLE) * ux - (vi + 0.5::DOUBLE) * uz AS px, gz + (ui + 0.5::DOUBLE) * uz + (vi + 0.5::DOUBLE) * ux AS pz,
         CASE WHEN blk = 0 THEN 'dead' WHEN blk = 1 THEN 'absent' WHEN h < 94 THEN 'live' WHEN h < 97 THEN 'dead' ELSE 'absent' END AS state,
         grid_id * 4 + (ui // 8) * 2 + vi // 8 AS killer_id
  FROM s2f),
live AS (SELECT * FROM s2p WHERE state = 'live'),
dead AS (SELECT * FROM s2p WHERE state = 'dead'),
sides(du, dv) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
sided AS (SELECT l.*, du, dv, ux * du - uz * dv AS ox, uz * du + ux * dv AS oz FROM live l CROSS JOIN sides)
"""


def cover(name: str, probes: str, key: str, down: float, up: float, pad: float, skip: str = "true") -> str:
    """Covering cell of each probe (key, qx, qy, qz) through unnested three-by-three buckets."""
    near = f"0.5 + {pad}::DOUBLE"
    return f"""
{name}_near AS (
  SELECT p.*, floor(qx) + i.i AS bx, floor(qz) + j.j AS bz FROM {probes} p CROSS JOIN (VALUES (-1), (0), (1)) i(i) CROSS JOIN (VALUES (-1), (0), (1)) j(j)),
{name}_hits AS (
  SELECT {key}, c.cell_id AS hit,
         abs((qx - c.px) * c.ux + (qz - c.pz) * c.uz) AS du_, abs((qz - c.pz) * c.ux - (qx - c.px) * c.uz) AS dv_, qy - c.py AS dn_
  FROM {name}_near n JOIN live c ON floor(c.px) = n.bx AND floor(c.pz) = n.bz WHERE {skip}),
{name} AS (
  SELECT {key}, arg_min(hit, (round(du_ + dv_ + abs(dn_), 9), hit)) AS hit, min(round(du_ + dv_ + abs(dn_), 9)) AS off
  FROM {name}_hits WHERE du_ <= {near} AND dv_ <= {near} AND dn_ <= {down} AND dn_ >= -{up} GROUP BY {key})"""


EDGES = (
    """
outer_sides AS (
  SELECT s.* FROM sided s LEFT JOIN live n ON n.grid_id = s.grid_id AND n.ui = s.ui + s.du AND n.vi = s.vi + s.dv WHERE n.cell_id IS NULL),
e0 AS (
  SELECT s.*, k.killer_id AS killer, k.cell_id IS NOT NULL AS killed FROM outer_sides s
  LEFT JOIN dead k ON k.grid_id = s.grid_id AND k.ui = s.ui + s.du AND k.vi = s.vi + s.dv),
eq AS (SELECT cell_id, du, dv, px + ox AS qx, py AS qy, pz + oz AS qz FROM e0 WHERE NOT killed),"""
    + cover("seam", "eq", "n.cell_id, du, dv", 0.25, 0.25, 0.08, "c.cell_id <> n.cell_id").replace("GROUP BY n.cell_id", "GROUP BY cell_id").replace("SELECT n.cell_id, du, dv, arg_min", "SELECT cell_id, du, dv, arg_min")
    + """,
edges AS (
  SELECT e.*, CASE WHEN killed THEN 'wall' WHEN s.hit IS NOT NULL THEN 'seam' ELSE 'dropoff' END AS kind, s.hit,
         px + ox * 0.5 - (CASE WHEN du <> 0 THEN -uz ELSE ux END) * 0.5 AS ax, pz + oz * 0.5 - (CASE WHEN du <> 0 THEN ux ELSE uz END) * 0.5 AS az,
         px + ox * 0.5 + (CASE WHEN du <> 0 THEN -uz ELSE ux END) * 0.5 AS bx, pz + oz * 0.5 + (CASE WHEN du <> 0 THEN ux ELSE uz END) * 0.5 AS bz
  FROM e0 e LEFT JOIN seam s USING (cell_id, du, dv))"""
)

COMPS = (
    "cq AS (SELECT cell_id AS a, du, dv, px + ox AS qx, py AS qy, pz + oz AS qz FROM sided),"
    + cover("link", "cq", "a, du, dv", 0.25, 0.25, 0.001, "c.cell_id <> n.a")
    + """,
pairs AS (SELECT a, hit AS b FROM link UNION SELECT hit, a FROM link),
comps(node, comp) USING KEY (node) AS (
  SELECT cell_id, cell_id FROM live
  UNION
  SELECT p.b, min(c.comp) FROM comps c JOIN pairs p ON p.a = c.node JOIN recurring.comps r ON r.node = p.b WHERE c.comp < r.comp GROUP BY p.b)"""
)

RUNS = """
rowed AS (
  SELECT e.*, c.comp, CASE WHEN du <> 0 THEN ui ELSE vi END AS row_, CASE WHEN du <> 0 THEN vi ELSE ui END AS cross_
  FROM edges e JOIN comps c ON c.node = e.cell_id WHERE kind <> 'seam'),
marked AS (
  SELECT *, cross_ - row_number() OVER (PARTITION BY grid_id, du, dv, row_, kind, killer, comp ORDER BY cross_) AS isle FROM rowed),
runs AS (
  SELECT kind, grid_id, killer AS killer_id, comp, du, dv, arg_min(ax, cross_) AS ax, min(py) AS ay, arg_min(az, cross_) AS az, arg_max(bx, cross_) AS bx, min(py) AS by_, arg_max(bz, cross_) AS bz,
         min(ox) AS ox, min(oz) AS oz, count(*) AS cells
  FROM marked GROUP BY grid_id, du, dv, row_, kind, killer, comp, isle),
sized AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)) AS length FROM runs)
"""

VERTICES = """
ends AS (
  SELECT kind, ax AS px, ay AS py, az AS pz FROM runs UNION ALL SELECT kind, bx, by_, bz FROM runs),
vertices AS (
  SELECT *, floor(px / 0.05::DOUBLE + 0.5)::BIGINT AS kx, floor(py / 0.05::DOUBLE + 0.5)::BIGINT AS ky, floor(pz / 0.05::DOUBLE + 0.5)::BIGINT AS kz FROM ends),
opened AS (SELECT kx, ky, kz, any_value(kind) AS kind, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz FROM vertices GROUP BY kx, ky, kz HAVING count(*) = 1)
"""

FEET = """
foot0 AS (
  SELECT killer_id AS part_id, floor(px)::BIGINT AS ui, floor(pz)::BIGINT AS vi, cell_id, px AS bx, py + CASE WHEN cell_id % 4 = 0 THEN 2.5 ELSE 0.5 END AS b_y, pz AS bz FROM dead),
feet AS (SELECT part_id, ui, vi, min(b_y) AS b_y, arg_min(bx, (b_y, cell_id)) AS bx, arg_min(bz, (b_y, cell_id)) AS bz FROM foot0 GROUP BY part_id, ui, vi),
grounds AS (SELECT px, py, pz FROM live UNION ALL SELECT px, py, pz FROM dead),
foot_near AS (
  SELECT f.*, floor(bx) + i.i AS hx, floor(bz) + j.j AS hz FROM feet f CROSS JOIN (VALUES (-1), (0), (1)) i(i) CROSS JOIN (VALUES (-1), (0), (1)) j(j)),
floors AS (
  SELECT part_id, ui, vi, max(g.py) AS floor_y FROM foot_near f JOIN grounds g ON floor(g.px) = f.hx AND floor(g.pz) = f.hz
  WHERE abs(g.px - f.bx) <= 0.58 AND abs(g.pz - f.bz) <= 0.58 AND g.py <= f.b_y + 0.1 GROUP BY part_id, ui, vi),
cuts AS (SELECT f.*, floor_y FROM feet f JOIN floors USING (part_id, ui, vi) WHERE b_y - floor_y < 1.5)
"""

FRONTIER = (
    """
cut_cells_by AS (SELECT DISTINCT cell_id, killer AS killer_id FROM edges WHERE kind = 'wall' AND killer IS NOT NULL),
rim AS (
  SELECT c.*, du, dv FROM cuts c CROSS JOIN sides
  WHERE NOT EXISTS (SELECT 1 FROM cuts o WHERE o.part_id = c.part_id AND o.ui = c.ui + du AND o.vi = c.vi + dv)),
rim_probes AS (
  SELECT part_id, ui AS fu, vi AS fv, du, dv, n AS probe, bx + du * t AS qx, floor_y AS qy, bz + dv * t AS qz
  FROM rim CROSS JOIN (VALUES (0, 0.6::DOUBLE), (1, 1.0::DOUBLE), (2, 1.4::DOUBLE)) p(n, t)),"""
    + cover("rim_hit", "rim_probes", "part_id, fu, fv, du, dv, probe", 3.0, 1.0, 0.08)
    + """,
frontier AS (
  SELECT part_id, fu AS ui, fv AS vi, du, dv, arg_min(h.hit, probe) AS hit FROM rim_hit h
  JOIN cut_cells_by k ON k.cell_id = h.hit AND k.killer_id = h.part_id GROUP BY part_id, fu, fv, du, dv)"""
)

OUTLINES = """
rim_rows AS (
  SELECT f.*, c.bx AS mx, c.bz AS mz, floor_y, CASE WHEN du <> 0 THEN f.ui ELSE f.vi END AS row_, CASE WHEN du <> 0 THEN f.vi ELSE f.ui END AS cross_
  FROM frontier f JOIN cuts c USING (part_id, ui, vi)),
rim_marked AS (SELECT *, cross_ - row_number() OVER (PARTITION BY part_id, du, dv, row_ ORDER BY cross_) AS isle FROM rim_rows),
outlines AS (
  SELECT part_id AS killer_id, count(*) AS cells,
    arg_min(mx + du * 0.5 - (du = 0)::INT * 0.5, cross_) AS ax, arg_min(floor_y, cross_) AS ay, arg_min(mz + dv * 0.5 - (du <> 0)::INT * 0.5, cross_) AS az,
    arg_max(mx + du * 0.5 + (du = 0)::INT * 0.5, cross_) AS bx, arg_max(floor_y, cross_) AS by_, arg_max(mz + dv * 0.5 + (du <> 0)::INT * 0.5, cross_) AS bz
  FROM rim_marked GROUP BY part_id, du, dv, row_, isle),
outline_runs AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) + (bz - az) * (bz - az)) AS length FROM outlines)
"""

NO_COMPS = "comps(node, comp) AS (SELECT cell_id, 0 FROM live)"

ORACLES["boundary_length_by_grid"] = with_(GRID, EDGES, NO_COMPS, RUNS, body=f"SELECT grid_id, kind, count(*) AS runs, {r6('sum(length)', 'length')} FROM sized GROUP BY grid_id, kind")
ORACLES["edge_kinds"] = with_(GRID, EDGES, body="SELECT kind, count(*) AS edges FROM edges GROUP BY kind")
ORACLES["edge_kinds_by_grid"] = with_(GRID, EDGES, body="SELECT grid_id, kind, count(*) AS edges FROM edges GROUP BY grid_id, kind")
ORACLES["classified_edges"] = with_(GRID, EDGES, body=f"SELECT cell_id, du::INT AS du, dv::INT AS dv, kind, CASE WHEN kind = 'wall' THEN killer END AS killer_id, {', '.join(map(r6, ('ax', 'az', 'bx', 'bz')))} FROM edges")
ORACLES["boundary_runs"] = with_(GRID, EDGES, COMPS, RUNS, body=f"SELECT kind, grid_id, killer_id, comp, {', '.join(map(r6, ('ax', 'ay', 'az', 'bx')))}, {r6('by_', 'by')}, {r6('bz')}, cells, {r6('length')} FROM sized")
ORACLES["run_length_by_kind"] = with_(GRID, EDGES, COMPS, RUNS, body=f"SELECT kind, count(*) AS runs, {r6('sum(length)', 'length')} FROM sized GROUP BY kind")
ORACLES["longest_runs"] = with_(GRID, EDGES, COMPS, RUNS, "tops AS (SELECT kind, grid_id, cells, round(ax, 6) + 0.0 AS ax, round(az, 6) + 0.0 AS az, round(ox, 6) + 0.0 AS ox, round(oz, 6) + 0.0 AS oz FROM sized)", body="SELECT * FROM tops ORDER BY cells DESC, grid_id, kind, ax, az, ox, oz LIMIT 20")
ORACLES["covering_cells"] = with_(GRID, "cp AS (SELECT cell_id AS probe_id, du, dv, px + ox AS qx, py AS qy, pz + oz AS qz FROM sided)", cover("found", "cp", "probe_id, du, dv", 0.25, 0.25, 0.08, "c.cell_id <> n.probe_id"), body=f"SELECT probe_id, du::INT AS du, dv::INT AS dv, hit, {r6('off')} FROM found")
ORACLES["seam_pairs"] = with_(GRID, EDGES, body="SELECT cell_id, du::INT AS du, dv::INT AS dv, hit FROM edges WHERE kind = 'seam'")
ORACLES["grid_components"] = with_(GRID, COMPS, body="SELECT node AS cell_id, comp FROM comps")
ORACLES["component_sizes"] = with_(GRID, COMPS, body="SELECT comp, count(*) AS cells FROM comps GROUP BY comp")
ORACLES["killer_tally"] = with_(GRID, EDGES, body="SELECT killer AS killer_id, count(*) AS edges FROM edges WHERE kind = 'wall' GROUP BY killer")
ORACLES["cut_by"] = with_(GRID, EDGES, body="SELECT DISTINCT cell_id, killer AS killer_id FROM edges WHERE kind = 'wall'")
ORACLES["floor_under"] = with_(GRID, FEET, body="SELECT part_id, ui, vi, floor_y FROM floors")
ORACLES["cut_cells"] = with_(GRID, FEET, body="SELECT part_id, count(*) AS cells FROM cuts GROUP BY part_id")
ORACLES["cut_frontier"] = with_(GRID, EDGES, FEET, FRONTIER, body="SELECT part_id, ui, vi, du::INT AS du, dv::INT AS dv, hit FROM frontier")
ORACLES["cut_outline_runs"] = with_(GRID, EDGES, FEET, FRONTIER, OUTLINES, body=f"SELECT killer_id, cells, {', '.join(map(r6, ('ax', 'ay', 'az', 'bx')))}, {r6('by_', 'by')}, {r6('bz')}, {r6('length')} FROM outline_runs")
WALLS_LEFT = "edges_all AS (SELECT e.* FROM edges e WHERE kind = 'dropoff' OR kind = 'wall' AND NOT EXISTS (SELECT 1 FROM frontier f WHERE f.hit = e.cell_id AND f.part_id = e.killer))"
ORACLES["wall_selection"] = with_(
    GRID, EDGES, COMPS, FEET, FRONTIER, OUTLINES, WALLS_LEFT, RUNS.replace("FROM edges e", "FROM edges_all e"),
    body=f"""SELECT kind, 'floor-frame' AS source, count(*) AS runs, {r6('sum(length)', 'length')} FROM sized GROUP BY kind
UNION ALL SELECT 'wall', 'footprint', count(*), round(sum(length), 6) + 0.0 FROM outline_runs""",
)
ORACLES["open_ends"] = with_(GRID, EDGES, COMPS, RUNS, VERTICES, body="SELECT kind, kx, ky, kz FROM opened")
ORACLES["endpoint_degree"] = with_(GRID, EDGES, COMPS, RUNS, VERTICES, body="SELECT degree, count(*) AS vertices FROM (SELECT count(*) AS degree FROM vertices GROUP BY kx, ky, kz) GROUP BY degree")
ORACLES["audit_by_kind"] = with_(
    GRID, EDGES, COMPS, RUNS, VERTICES,
    "scoped AS (SELECT kind AS scope, kx, ky, kz FROM vertices UNION ALL SELECT 'all', kx, ky, kz FROM vertices)",
    "one AS (SELECT scope, count(*) AS open_ends FROM (SELECT scope FROM scoped GROUP BY scope, kx, ky, kz HAVING count(*) = 1) GROUP BY scope)",
    "total AS (SELECT kind AS scope, count(*) AS runs FROM runs GROUP BY kind UNION ALL SELECT 'all', count(*) FROM runs)",
    body="SELECT t.scope, runs, coalesce(open_ends, 0) AS open_ends, least(coalesce(open_ends, 0), 12)::BIGINT AS samples FROM total t LEFT JOIN one USING (scope)",
)
CLOSE = """
cube AS (SELECT *, floor(px / 2.5) AS gx, floor(py / 2.5) AS gy, floor(pz / 2.5) AS gz FROM opened),
near_ends AS (
  SELECT a.kx AS ix, a.ky AS iy, a.kz AS iz, b.kx AS jx, b.ky AS jy, b.kz AS jz, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) + (a.pz - b.pz) * (a.pz - b.pz)) AS d
  FROM cube a CROSS JOIN (VALUES (-1), (0), (1)) x(x) CROSS JOIN (VALUES (-1), (0), (1)) y(y) CROSS JOIN (VALUES (-1), (0), (1)) z(z)
  JOIN cube b ON b.gx = a.gx + x AND b.gy = a.gy + y AND b.gz = a.gz + z
  WHERE (a.kx, a.ky, a.kz) < (b.kx, b.ky, b.kz)),
close AS (SELECT * FROM near_ends WHERE d <= 2.5 AND d > 1e-6)
"""
ORACLES["stitch_candidates"] = with_(GRID, EDGES, COMPS, RUNS, VERTICES, CLOSE, body=f"SELECT ix, iy, iz, jx, jy, jz, {r6('d')} FROM close")
#: Runs with numbers, their open ends, and the pairing one candidate at a time in order.
NUMBERED = """
numbered AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM runs),
ends AS (SELECT rid, kind, ax AS px, ay AS py, az AS pz FROM numbered UNION ALL SELECT rid, kind, bx, by_, bz FROM numbered),
vertices AS (
  SELECT *, floor(px / 0.05::DOUBLE + 0.5)::BIGINT AS kx, floor(py / 0.05::DOUBLE + 0.5)::BIGINT AS ky, floor(pz / 0.05::DOUBLE + 0.5)::BIGINT AS kz FROM ends),
opened AS MATERIALIZED (
  SELECT kx, ky, kz, any_value(rid) AS rid, any_value(kind) AS kind, any_value(px) AS px, any_value(py) AS py, any_value(pz) AS pz FROM vertices GROUP BY kx, ky, kz HAVING count(*) = 1)
"""
GREEDY = """
ranked AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY round(d, 9), ix, iy, iz, jx, jy, jz) AS n, concat_ws(':', ix, iy, iz) AS i, concat_ws(':', jx, jy, jz) AS j, * FROM close),
walked(n, used, taken) AS (
  SELECT 0::BIGINT, []::VARCHAR[], false
  UNION ALL
  SELECT n, CASE WHEN free THEN list_concat(used, [i, j]) ELSE used END, free
  FROM (SELECT r.n, used, i, j, NOT list_contains(used, i) AND NOT list_contains(used, j) AS free FROM walked w JOIN ranked r ON r.n = w.n + 1)),
paired AS MATERIALIZED (SELECT r.* FROM ranked r JOIN walked w ON w.n = r.n WHERE taken)
"""


def tees(source: str) -> str:
    """Nearest inner point of another run for every end of the source."""
    return f"""
tee_pairs AS (
  SELECT e.kx, e.ky, e.kz, r.*, e.px, e.py, e.pz, bx - ax AS dx, by_ - ay AS dy, bz - az AS dz, dx * dx + dy * dy + dz * dz AS size,
    least(greatest(((px - ax) * dx + (py - ay) * dy + (pz - az) * dz) / nullif(size, 0), 0.0::DOUBLE), 1.0::DOUBLE) AS t,
    ax + dx * t - px AS ex, ay + dy * t - py AS ey, az + dz * t - pz AS ez, sqrt(ex * ex + ey * ey + ez * ez) AS d
  FROM {source} e JOIN numbered r ON r.rid <> e.rid AND e.px BETWEEN least(ax, bx) - 3 AND greatest(ax, bx) + 3 AND e.pz BETWEEN least(az, bz) - 3 AND greatest(az, bz) + 3),
targets AS MATERIALIZED (
  SELECT kx, ky, kz, arg_min(rid, (round(d, 9), round(t, 9), ax, ay, az, bx, by_, bz)) AS rid, arg_min(t, (round(d, 9), round(t, 9), ax, ay, az, bx, by_, bz)) AS t,
    arg_min(d, (round(d, 9), round(t, 9), ax, ay, az, bx, by_, bz)) AS d
  FROM tee_pairs WHERE size > 1e-6 AND t > 0.02 AND t < 0.98 AND d < 2.5 GROUP BY kx, ky, kz)
"""


STITCH_BASE = (GRID, EDGES, COMPS, RUNS, NUMBERED, CLOSE, GREEDY)
ORACLES["stitch_pairs"] = with_(*STITCH_BASE, body=f"SELECT ix, iy, iz, jx, jy, jz, {r6('d')} FROM paired")
ORACLES["stitch_tees"] = with_(GRID, EDGES, COMPS, RUNS, NUMBERED, tees("opened"), body=f"SELECT kx, ky, kz, {r6('t')}, {r6('d')} FROM targets")
ORACLES["stitched_audit"] = with_(
    *STITCH_BASE,
    "lone AS (SELECT * FROM opened WHERE (kx, ky, kz) NOT IN (SELECT (ix, iy, iz) FROM paired) AND (kx, ky, kz) NOT IN (SELECT (jx, jy, jz) FROM paired))",
    tees("lone"),
    "stops AS (SELECT rid, t FROM targets UNION SELECT rid, 0.0::DOUBLE FROM numbered UNION SELECT rid, 1.0::DOUBLE FROM numbered)",
    "spans AS (SELECT rid, t AS s, lead(t) OVER (PARTITION BY rid ORDER BY t) AS e FROM stops)",
    """stitched AS (
  SELECT kind, CASE WHEN s = 0 THEN ax ELSE ax + (bx - ax) * s END AS ax, CASE WHEN s = 0 THEN ay ELSE ay + (by_ - ay) * s END AS ay, CASE WHEN s = 0 THEN az ELSE az + (bz - az) * s END AS az,
    CASE WHEN e = 1 THEN bx ELSE ax + (bx - ax) * e END AS bx, CASE WHEN e = 1 THEN by_ ELSE ay + (by_ - ay) * e END AS b_y, CASE WHEN e = 1 THEN bz ELSE az + (bz - az) * e END AS bz
  FROM spans JOIN numbered USING (rid) WHERE e IS NOT NULL
  UNION ALL
  SELECT CASE WHEN i.kind = 'wall' AND j.kind = 'wall' THEN 'wall' ELSE 'dropoff' END, i.px, i.py, i.pz, j.px, j.py, j.pz
  FROM paired p JOIN opened i ON (i.kx, i.ky, i.kz) = (p.ix, p.iy, p.iz) JOIN opened j ON (j.kx, j.ky, j.kz) = (p.jx, p.jy, p.jz)
  UNION ALL
  SELECT o.kind, o.px, o.py, o.pz, n.ax + (n.bx - n.ax) * t.t, n.ay + (n.by_ - n.ay) * t.t, n.az + (n.bz - n.az) * t.t
  FROM targets t JOIN lone o ON (o.kx, o.ky, o.kz) = (t.kx, t.ky, t.kz) JOIN numbered n ON n.rid = t.rid)""",
    "tips AS (SELECT kind, ax AS px, ay AS py, az AS pz FROM stitched UNION ALL SELECT kind, bx, b_y, bz FROM stitched)",
    "scoped AS (SELECT scope, floor(px / 0.05::DOUBLE + 0.5) AS kx, floor(py / 0.05::DOUBLE + 0.5) AS ky, floor(pz / 0.05::DOUBLE + 0.5) AS kz FROM tips CROSS JOIN LATERAL (SELECT unnest([kind, 'all']) AS scope))",
    "one AS (SELECT scope, count(*) AS open_ends FROM (SELECT scope FROM scoped GROUP BY scope, kx, ky, kz HAVING count(*) = 1) GROUP BY scope)",
    "total AS (SELECT kind AS scope, count(*) AS runs FROM stitched GROUP BY kind UNION ALL SELECT 'all', count(*) FROM stitched)",
    body="SELECT t.scope, runs, coalesce(open_ends, 0) AS open_ends FROM total t LEFT JOIN one USING (scope)",
)
ORACLES["debug_bars"] = with_(
    GRID, EDGES, COMPS, RUNS,
    body=f"SELECT CASE WHEN kind = 'wall' THEN 'wall-fallback' ELSE 'dropoff' END AS colour, count(*) AS bars, {r6('sum(length)', 'length')}, {r6('min(ay + 0.25)', 'lowest')} FROM sized WHERE length > 1e-3 GROUP BY kind",
)

# --- world lattice -----------------------------------------------------------

LATTICE = """
s1 AS (
  SELECT o_orderkey AS sid, o_orderkey % 100 AS ix, o_orderkey // 100 AS iz, (o_custkey * 7 + o_orderkey * 13) % 100 AS h, o_custkey % 16 AS blocked,
         1.0::DOUBLE + o_custkey % 8 AS clearance, ((o_custkey * 11 + o_orderkey * 3) % 70)::DOUBLE AS slope FROM orders),
nodes AS MATERIALIZED (SELECT *, (CASE WHEN h < 50 THEN 0 WHEN h < 64 THEN 1.5 ELSE 5 END)::DOUBLE AS y FROM s1 WHERE h < 72),
steps(sx, sz, bit) AS (VALUES (1, 0, 1), (-1, 0, 2), (0, 1, 4), (0, -1, 8)),
near AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b FROM nodes a CROSS JOIN steps JOIN nodes b ON b.ix = a.ix + sx AND b.iz = a.iz + sz WHERE abs(a.y - b.y) <= 2.0)
"""
LCOMPS = """
parts(node, comp) USING KEY (node) AS (
  SELECT sid, sid FROM nodes
  UNION
  SELECT p.b, min(c.comp) FROM parts c JOIN near p ON p.a = c.node JOIN recurring.parts r ON r.node = p.b WHERE c.comp < r.comp GROUP BY p.b),
cells AS MATERIALIZED (SELECT n.*, p.comp FROM nodes n JOIN parts p ON p.node = n.sid)
"""
RUN_Z = """
zrun AS (SELECT *, iz - row_number() OVER (PARTITION BY comp, ix ORDER BY iz) AS gi FROM cells),
zdist AS MATERIALIZED (SELECT *, least(iz - min(iz) OVER (PARTITION BY comp, ix, gi), max(iz) OVER (PARTITION BY comp, ix, gi) - iz) + 1 AS gz FROM zrun)
"""
#: Row pass by the definition: every column of the row, the padding column on either side included.
EDT = """
box AS (SELECT comp, min(ix) - 1 AS x0, max(ix) + 1 AS x1 FROM cells GROUP BY comp),
rowed AS (
  SELECT z.sid, min((z.ix - c.x) * (z.ix - c.x) + coalesce(o.gz * o.gz, 0))::BIGINT AS d2
  FROM zdist z JOIN box USING (comp) CROSS JOIN LATERAL (SELECT unnest(range(greatest(x0, z.ix - z.gz), least(x1, z.ix + z.gz) + 1)) AS x) c
  LEFT JOIN zdist o ON o.comp = z.comp AND o.iz = z.iz AND o.ix = c.x GROUP BY z.sid),
field AS MATERIALIZED (SELECT c.*, d2, greatest(sqrt(d2) - 0.5, 0) AS d FROM cells c JOIN rowed USING (sid))
"""
CRACKS = """
cracks AS MATERIALIZED (
  SELECT c.sid * 4 + CASE bit WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS edge_id, c.comp, c.ix, c.iz, bit,
    c.ix + CASE WHEN bit IN (1, 4) THEN 1 ELSE 0 END AS ax, c.iz + CASE WHEN bit IN (4, 2) THEN 1 ELSE 0 END AS az,
    c.ix + CASE WHEN bit IN (8, 1) THEN 1 ELSE 0 END AS bx, c.iz + CASE WHEN bit IN (1, 4) THEN 1 ELSE 0 END AS bz, (c.blocked & bit) <> 0 AS wall
  FROM cells c CROSS JOIN steps LEFT JOIN cells n ON n.comp = c.comp AND n.ix = c.ix + sx AND n.iz = c.iz + sz WHERE n.sid IS NULL)
"""
NEXT = """
turns AS (
  SELECT a.edge_id, b.edge_id AS next_id,
    atan2(-((a.bx - a.ax) * (b.bz - b.az) - (a.bz - a.az) * (b.bx - b.ax))::DOUBLE, ((a.bx - a.ax) * (b.bx - b.ax) + (a.bz - a.az) * (b.bz - b.az))::DOUBLE) AS score
  FROM cracks a JOIN cracks b ON b.comp = a.comp AND b.ax = a.bx AND b.az = a.bz),
follow AS MATERIALIZED (SELECT edge_id, arg_max(next_id, (round(score, 6), -next_id)) AS next_id FROM turns GROUP BY edge_id)
"""

ORACLES["lattice_components"] = with_(LATTICE, LCOMPS, body="SELECT sid, comp FROM cells")
ORACLES["lattice_component_sizes"] = with_(LATTICE, LCOMPS, body="SELECT comp, count(*) AS cells FROM cells GROUP BY comp")
ORACLES["column_distance"] = with_(LATTICE, LCOMPS, RUN_Z, body="SELECT sid, gz FROM zdist")
ORACLES["edt_squared"] = with_(LATTICE, LCOMPS, RUN_Z, EDT, body=f"SELECT sid, d2, {r6('d')} FROM field")
ORACLES["thickness"] = with_(LATTICE, LCOMPS, RUN_Z, EDT, body="SELECT comp, count(*) AS cells, max(d2) AS d2 FROM field GROUP BY comp")
ORACLES["severance"] = with_(
    LATTICE, LCOMPS, RUN_Z, EDT,
    "kept AS MATERIALIZED (SELECT * FROM field WHERE d >= 1.5)",
    "kept_near AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b FROM kept a CROSS JOIN steps JOIN kept b ON b.comp = a.comp AND b.ix = a.ix + sx AND b.iz = a.iz + sz WHERE abs(a.y - b.y) <= 2.0)",
    """pieces(node, piece) USING KEY (node) AS (
  SELECT sid, sid FROM kept
  UNION
  SELECT p.b, min(c.piece) FROM pieces c JOIN kept_near p ON p.a = c.node JOIN recurring.pieces r ON r.node = p.b WHERE c.piece < r.piece GROUP BY p.b)""",
    "after AS (SELECT comp, count(*) AS cells_after, count(DISTINCT piece) AS pieces_after FROM kept k JOIN pieces p ON p.node = k.sid GROUP BY comp)",
    "before AS (SELECT comp, count(*) AS cells_before FROM cells GROUP BY comp)",
    body="SELECT b.comp, cells_before, coalesce(cells_after, 0) AS cells_after, coalesce(pieces_after, 0) AS pieces_after, coalesce(pieces_after, 0) > 1 AS severed, coalesce(cells_after, 0) = 0 AS erased FROM before b LEFT JOIN after USING (comp)",
)
ORACLES["half_width"] = with_(
    LATTICE, LCOMPS, RUN_Z, EDT, CRACKS,
    "march AS (SELECT c.edge_id, c.comp, n, floor(c.ix + 0.5 - sx * n * 0.5)::BIGINT AS x, floor(c.iz + 0.5 - sz * n * 0.5)::BIGINT AS z FROM cracks c JOIN steps USING (bit) CROSS JOIN (SELECT unnest(range(25)) AS n))",
    "seen AS (SELECT m.edge_id, n, f.d FROM march m LEFT JOIN field f ON f.comp = m.comp AND f.ix = m.x AND f.iz = m.z)",
    "stops AS (SELECT edge_id, min(CASE WHEN d IS NULL THEN n END) AS stop FROM seen GROUP BY edge_id)",
    body=f"SELECT edge_id, {r6('coalesce(max(CASE WHEN stop IS NULL OR n < stop THEN d END), 0)', 'half_width')} FROM seen JOIN stops USING (edge_id) GROUP BY edge_id",
)
ORACLES["crack_edges"] = with_(LATTICE, LCOMPS, CRACKS, body="SELECT edge_id, comp, ax, az, bx, bz, wall FROM cracks")
ORACLES["crack_successor"] = with_(LATTICE, LCOMPS, CRACKS, NEXT, body="SELECT edge_id, next_id FROM follow")
ORACLES["loop_lengths"] = with_(LATTICE, LCOMPS, CRACKS, NEXT, RINGS, body="SELECT ring AS loop_id, count(*) AS edges FROM rings GROUP BY ring")
LOOPS = (LATTICE, LCOMPS, CRACKS, NEXT, RINGS, TRACE)
ORACLES["label_closing"] = with_(*LOOPS, body="SELECT loop_id, pos, edge_id, wall, label FROM closed")
ORACLES["loop_points"] = with_(*LOOPS, POINTS, body="SELECT loop_id, pos, x, z, label FROM points")
ORACLES["fit_segments"] = with_(*LOOPS, POINTS, FIT, body=f"SELECT loop_id, seg, label, n, {', '.join(map(r6, ('cx', 'cz', 'dx', 'dz', 'nx', 'nz', 'length', 'bias')))} FROM segments")
SHAPES = (*LOOPS, POINTS, FIT, RUN_Z, EDT, OFFSETS)
ORACLES["offset_segments"] = with_(*SHAPES, body=f"SELECT loop_id, seg, part, label, n, {r6('half_width')}, round(\"offset\", 6) + 0.0 AS \"offset\", {r6('ox')}, {r6('oz')}, narrow FROM offsets")
ORACLES["polygons"] = with_(*SHAPES, POLYGONS, body="SELECT loop_id, vertices::INT AS vertices, bevels::BIGINT AS bevels, steps::BIGINT AS steps FROM polygons")
ORACLES["lattice_stats"] = with_(
    *SHAPES, POLYGONS,
    body="""SELECT (SELECT count(*) FROM cells) AS cells, (SELECT count(DISTINCT comp) FROM cells) AS components, (SELECT count(DISTINCT ring) FROM rings) AS loops,
  count(*) AS segments, count(*) FILTER (narrow) AS narrow, count(*) FILTER (label) AS wall_segments, count(*) FILTER (NOT label) AS dropoff_segments,
  (SELECT count(*) FROM polygons) AS polygons, (SELECT coalesce(sum(bevels), 0)::BIGINT FROM polygons) AS bevels, (SELECT coalesce(sum(steps), 0)::BIGINT FROM polygons) AS steps
FROM offsets WHERE ox IS NOT NULL""",
)
ORACLES["tls_moments"] = with_(
    LATTICE, "pts AS (SELECT iz, ix + 0.5::DOUBLE AS x, iz + 0.5::DOUBLE + y AS z FROM nodes)",
    "mom AS (SELECT iz, count(*) AS n, avg(x) AS cx, avg(z) AS cz, sum(x * x) AS xx, sum(z * z) AS zz, sum(x * z) AS xz FROM pts GROUP BY iz)",
    body=f"SELECT iz, n, {r6('cx')}, {r6('cz')}, {r6('0.5 * atan2(2 * (xz - n * cx * cz), (xx - n * cx * cx) - (zz - n * cz * cz))', 'angle')} FROM mom",
)
ORACLES["snapshot_roundtrip"] = with_(LATTICE, body="SELECT (ix + 0.5)::DOUBLE AS px, y AS py, (iz + 0.5)::DOUBLE AS pz, clearance, blocked::INT AS blocked FROM nodes")
ORACLES["agent_filter"] = with_(LATTICE, body="SELECT sid, clearance FROM nodes WHERE clearance >= 4 AND (sid % 3 <> 0 OR clearance / 2 >= 2) AND blocked >= 2")
ORACLES["movement_mode"] = with_(LATTICE, body="SELECT CASE WHEN clearance >= 5 THEN 'walk' WHEN clearance >= 3 THEN 'crouch' WHEN clearance >= 1.5 THEN 'crawl' ELSE 'none' END AS mode, count(*) AS samples FROM nodes GROUP BY 1")
ORACLES["giant_floor"] = with_(LATTICE, body="SELECT sid FROM nodes WHERE clearance >= 7")
ORACLES["slope_split"] = with_(LATTICE, body="SELECT slope <= 65 AS npc, slope <= 40 AS player, count(*) AS samples FROM nodes GROUP BY 1, 2")
MODE = "CASE WHEN clearance >= 5 THEN 'walk' WHEN clearance >= 3 THEN 'crouch' WHEN clearance >= 1.5 THEN 'crawl' ELSE 'none' END"
ORACLES["floor_rectangles"] = with_(
    LATTICE, LCOMPS,
    "levelled AS (SELECT *, floor(y / 2) AS level FROM cells)",
    "row_isles AS (SELECT *, ix - row_number() OVER (PARTITION BY comp, iz, clearance, level ORDER BY ix) AS isle FROM levelled)",
    "row_runs AS (SELECT comp, iz, clearance, level, min(ix) AS x0, max(ix) AS x1 FROM row_isles GROUP BY comp, iz, clearance, level, isle)",
    "piles AS (SELECT *, iz - row_number() OVER (PARTITION BY comp, clearance, level, x0, x1 ORDER BY iz) AS pile FROM row_runs)",
    body=f"SELECT comp, clearance, {MODE} AS mode, x0, x1, min(iz) AS z0, max(iz) AS z1, (x1 - x0 + 1) * (max(iz) - min(iz) + 1) AS cells FROM piles GROUP BY comp, clearance, level, x0, x1, pile",
)

# --- boxes -------------------------------------------------------------------

BOXES = """
parts AS (
  SELECT s_suppkey::BIGINT AS part_id, CASE WHEN s_suppkey % 9 = 0 THEN 'ClipRamp-' ELSE 'Block-' END || s_suppkey AS name,
    ((s_suppkey * 37) % 56 + 4.25)::DOUBLE AS px, (((s_suppkey * 11) % 4) * 3 + 1.25)::DOUBLE AS py, ((s_suppkey * 53) % 56 + 4.25)::DOUBLE AS pz,
    (1.5 + s_suppkey % 4)::DOUBLE AS hx, (0.5 + (s_suppkey % 3) * 0.5)::DOUBLE AS hy, (1.5 + (s_suppkey // 4) % 4)::DOUBLE AS hz FROM supplier),
filled AS (
  SELECT DISTINCT x.x + 8 AS ix, y.y + 8 AS iy, z.z + 8 AS iz FROM parts
  CROSS JOIN LATERAL (SELECT unnest(range(floor(px - hx)::BIGINT, floor(px + hx)::BIGINT + 1)) AS x) x
  CROSS JOIN LATERAL (SELECT unnest(range(floor(py - hy)::BIGINT, floor(py + hy)::BIGINT + 1)) AS y) y
  CROSS JOIN LATERAL (SELECT unnest(range(floor(pz - hz)::BIGINT, floor(pz + hz)::BIGINT + 1)) AS z) z),
f7 AS (SELECT ix, iy, iz FROM filled)
"""
LEVELS = ",\n".join(f"f{k} AS (SELECT ix // 2 AS ix, iy // 2 AS iy, iz // 2 AS iz FROM f{k + 1} GROUP BY 1, 2, 3 HAVING count(*) = 8)" for k in range(6, -1, -1))
LEAVES = "leaves AS (" + " UNION ALL ".join(
    f"SELECT {k} AS depth, c.* FROM f{k} c" + (f" WHERE NOT EXISTS (SELECT 1 FROM f{k - 1} p WHERE p.ix = c.ix // 2 AND p.iy = c.iy // 2 AND p.iz = c.iz // 2)" if k else "") for k in range(8)
) + ")"
PROBES = "probes AS (SELECT o_orderkey AS sid, o_orderkey % 60 AS x, (o_custkey % 4) * 3 + 1 AS y, (o_orderkey // 60) % 60 AS z, o_custkey % 12 AS qy FROM orders)"
SURFELS = """
tops AS (
  SELECT depth, ix, iy, iz, 128 // (1 << depth) AS e, (iy + 1) * (128 // (1 << depth)) - 8 AS top FROM leaves),
columns_ AS (
  SELECT t.*, ix * e - 8 + i AS x, iz * e - 8 + j AS z FROM tops t CROSS JOIN LATERAL (SELECT unnest(range(e)) AS i) CROSS JOIN LATERAL (SELECT unnest(range(e)) AS j)),
open_columns AS (SELECT * FROM columns_ c WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.ix = c.x + 8 AND f.iy = c.top + 8 AND f.iz = c.z + 8)),
landed AS (
  SELECT c.depth, c.ix, c.iy, c.iz, c.x, c.z, max(p.py + p.hy) AS y, arg_min(p.part_id, (-(p.py + p.hy), p.part_id)) AS part_id FROM open_columns c
  JOIN parts p ON abs(c.x + 0.5 - p.px) <= p.hx AND abs(c.z + 0.5 - p.pz) <= p.hz AND p.py + p.hy <= c.top + 1 AND c.top + 1 - (p.py + p.hy) <= c.e + 2
  GROUP BY c.depth, c.ix, c.iy, c.iz, c.x, c.z),
samples AS (
  SELECT l.*, (SELECT min(p.py - p.hy) FROM parts p WHERE abs(l.x + 0.5 - p.px) <= p.hx AND abs(l.z + 0.5 - p.pz) <= p.hz AND p.py - p.hy >= l.y + 0.15 AND p.py - p.hy - l.y - 0.15 <= 20) - l.y - 0.15 AS roof
  FROM landed l)
"""
ORACLES["gather_parts"] = with_(BOXES, body="SELECT part_id, name, 2 * hx AS sx, 2 * hz AS sz FROM parts WHERE greatest(2 * hx, 2 * hz) <= 400")
ORACLES["obb_geometry"] = with_(
    BOXES,
    "corner AS (SELECT *, floor(px + hx) + 0.5 AS qx, floor(py) + 0.5 AS qy, floor(pz + hz * 0.5) + 0.5 AS qz FROM parts)",
    "turned AS (SELECT *, (qx - px) * 0.6::DOUBLE + (qz - pz) * 0.8::DOUBLE AS a, qy - py AS b, (qz - pz) * 0.6::DOUBLE - (qx - px) * 0.8::DOUBLE AS c FROM corner)",
    body=f"""SELECT part_id, {r6('0.6::DOUBLE * hx + 0.8::DOUBLE * hz', 'hx')}, {r6('hy')}, {r6('0.8::DOUBLE * hx + 0.6::DOUBLE * hz', 'hz')},
  abs(a) <= hx + 1e-4 AND abs(b) <= hy + 1e-4 AND abs(c) <= hz + 1e-4 AS centre_inside,
  abs(a) + 0.7 <= hx + 1e-4 AND abs(b) + 0.5 <= hy + 1e-4 AND abs(c) + 0.7 <= hz + 1e-4 AS cube_inside,
  NOT (abs(a) > hx + 0.7 OR abs(b) > hy + 0.5 OR abs(c) > hz + 0.7 OR abs(qx - px) > 0.6::DOUBLE * hx + 0.8::DOUBLE * hz + 0.5 OR abs(qz - pz) > 0.8::DOUBLE * hx + 0.6::DOUBLE * hz + 0.5) AS touches
FROM turned""",
)
ORACLES["svo_leaves"] = with_(BOXES, LEVELS, LEAVES, body="SELECT depth::INT AS depth, ix, iy, iz FROM leaves")
ORACLES["svo_cells"] = with_(BOXES, LEVELS, LEAVES, body="SELECT depth::INT AS depth, count(*) AS leaves FROM leaves GROUP BY depth")
ORACLES["svo_stats"] = with_(
    BOXES, LEVELS, LEAVES, "above AS (SELECT DISTINCT depth - up AS depth, ix >> up AS ix, iy >> up AS iy, iz >> up AS iz FROM leaves CROSS JOIN LATERAL (SELECT unnest(range(1, depth + 1)) AS up))",
    body="SELECT count(*) AS solid_leaves, (SELECT count(*) FROM above) AS internal_nodes, 7 AS max_depth, min(128.0::DOUBLE / (1 << depth)) AS min_leaf, max(128.0::DOUBLE / (1 << depth)) AS max_leaf, 1.0::DOUBLE AS leaf FROM leaves",
)
ORACLES["point_solid"] = with_(BOXES, PROBES, body="SELECT sid FROM probes p WHERE EXISTS (SELECT 1 FROM filled f WHERE f.ix = p.x + 8 AND f.iy = p.qy + 8 AND f.iz = p.z + 8)")
ORACLES["blocked_mask"] = with_(
    BOXES, PROBES, "steps(sx, sz, bit) AS (VALUES (1, 0, 1), (-1, 0, 2), (0, 1, 4), (0, -1, 8))",
    "hits AS (SELECT sid, bit_or(bit) AS blocked FROM probes p CROSS JOIN steps CROSS JOIN (VALUES (1), (2), (3)) h(h) JOIN filled f ON f.ix = p.x + sx + 8 AND f.iy = p.y + h + 8 AND f.iz = p.z + sz + 8 GROUP BY sid)",
    body="SELECT sid, coalesce(blocked, 0)::INT AS blocked FROM probes LEFT JOIN hits USING (sid)",
)
ORACLES["surfels"] = with_(BOXES, LEVELS, LEAVES, SURFELS, body=f"SELECT x + 0.5::DOUBLE AS px, y AS py, z + 0.5::DOUBLE AS pz, 0.0::DOUBLE AS slope, {r6('coalesce(roof, 20)', 'clearance')}, part_id FROM samples")
ORACLES["floor_area_by_part"] = with_(BOXES, LEVELS, LEAVES, SURFELS, body=f"SELECT part_id, count(*) AS samples, {r6('min(coalesce(roof, 20))', 'lowest')} FROM samples GROUP BY part_id")

# --- part-aligned grids of the boxes ------------------------------------------

LOCAL = """
grid_cells AS MATERIALIZED (
  SELECT part_id AS grid_id, ui, vi, px + (ui + 0.5::DOUBLE - floor(2 * hx) / 2) AS x, py + hy AS y, pz + (vi + 0.5::DOUBLE - floor(2 * hz) / 2) AS z FROM parts
  CROSS JOIN LATERAL (SELECT unnest(range(floor(2 * hx)::BIGINT)) AS ui) CROSS JOIN LATERAL (SELECT unnest(range(floor(2 * hz)::BIGINT)) AS vi)),
shut_in AS (
  SELECT grid_id, ui, vi, min(part_id) AS killer FROM grid_cells c JOIN parts p ON p.part_id <> c.grid_id
    AND abs(p.px - x) <= hx + 0.45 AND abs(p.py - (y + 0.45::DOUBLE + 0.1::DOUBLE)) <= hy + 0.45 AND abs(p.pz - z) <= hz + 0.45 GROUP BY grid_id, ui, vi),
roofs AS (
  SELECT grid_id, ui, vi, -hy - (y + 0.15::DOUBLE - p.py) AS t, part_id FROM grid_cells c JOIN parts p ON abs(x - p.px) <= hx AND abs(z - p.pz) <= hz
  WHERE -hy - (y + 0.15::DOUBLE - p.py) BETWEEN 0 AND 20),
first_roof AS (SELECT grid_id, ui, vi, arg_min(t, (round(t, 9), part_id)) AS t, arg_min(part_id, (round(t, 9), part_id)) AS roof FROM roofs GROUP BY grid_id, ui, vi),
judged AS MATERIALIZED (
  SELECT c.*, coalesce(killer, CASE WHEN t + 0.15::DOUBLE < 1.5 THEN roof END) AS killer_id FROM grid_cells c LEFT JOIN shut_in USING (grid_id, ui, vi) LEFT JOIN first_roof USING (grid_id, ui, vi))
"""
UNDERSIDES = """
feet AS MATERIALIZED (
  SELECT part_id, ui, vi, px + (ui + 0.5::DOUBLE) AS bx, py - hy AS b_y, pz + (vi + 0.5::DOUBLE) AS bz FROM parts
  CROSS JOIN LATERAL (SELECT unnest(range(-ceil(hx)::BIGINT, ceil(hx)::BIGINT)) AS ui) CROSS JOIN LATERAL (SELECT unnest(range(-ceil(hz)::BIGINT, ceil(hz)::BIGINT)) AS vi)
  WHERE part_id IN (SELECT killer_id FROM judged) AND abs(ui + 0.5) <= hx AND abs(vi + 0.5) <= hz)
"""
BOX_CELLS = """
live AS MATERIALIZED (
  SELECT grid_id * 4294967296 + ui * 65536 + vi AS cell_id, grid_id, ui, vi, x AS px, y AS py, z AS pz, 1.0::DOUBLE AS ux, 0.0::DOUBLE AS uz FROM judged WHERE killer_id IS NULL),
dead AS (SELECT grid_id * 4294967296 + ui * 65536 + vi AS cell_id, grid_id, ui, vi, x AS px, y AS py, z AS pz, killer_id FROM judged WHERE killer_id IS NOT NULL),
sides(du, dv) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
sided AS (SELECT l.*, du, dv, ux * du - uz * dv AS ox, uz * du + ux * dv AS oz FROM live l CROSS JOIN sides)
"""
ORACLES["local_grid_samples"] = with_(BOXES, LOCAL, body="SELECT grid_id, ui, vi, killer_id FROM judged")
ORACLES["footprint_cells"] = with_(BOXES, LOCAL, UNDERSIDES, body=f"SELECT part_id, ui, vi, {r6('bx')}, {r6('b_y', 'by')}, {r6('bz')} FROM feet")
FLOORS = FEET[FEET.index("grounds AS"):]
ORACLES["bake_runs"] = with_(
    BOXES, LOCAL, UNDERSIDES, BOX_CELLS, EDGES, COMPS, FLOORS, FRONTIER, OUTLINES, WALLS_LEFT, RUNS.replace("FROM edges e", "FROM edges_all e"),
    body=f"""SELECT kind, 'floor-frame' AS source, count(*) AS runs, {r6('sum(length)', 'length')} FROM sized GROUP BY kind
UNION ALL SELECT 'wall', 'footprint', count(*), round(sum(length), 6) + 0.0 FROM outline_runs HAVING count(*) > 0""",
)

# --- trees around the parts' own bounds ----------------------------------------

ROOT = """
bounds AS (
  SELECT min(px - ax) - 2 AS x0, max(px + ax) + 2 AS x1, min(py - ay) - 2 AS y0, max(py + ay) + 2 AS y1, min(pz - az) - 2 AS z0, max(pz + az) + 2 AS z1 FROM spread),
root AS (
  SELECT pow(2, ceil(log2(greatest(x1 - x0, y1 - y0, z1 - z0)))) AS edge, (x0 + x1) / 2 - edge / 2 AS rx, (y0 + y1) / 2 - edge / 2 AS ry, (z0 + z1) / 2 - edge / 2 AS rz FROM bounds),
reached AS (
  SELECT s.*, rx, ry, rz, ix, iy, iz FROM spread s CROSS JOIN root
  CROSS JOIN LATERAL (SELECT unnest(range(ceil(px - ax - rx)::BIGINT - 1, floor(px + ax - rx)::BIGINT + 1)) AS ix)
  CROSS JOIN LATERAL (SELECT unnest(range(ceil(py - ay - ry)::BIGINT - 1, floor(py + ay - ry)::BIGINT + 1)) AS iy)
  CROSS JOIN LATERAL (SELECT unnest(range(ceil(pz - az - rz)::BIGINT - 1, floor(pz + az - rz)::BIGINT + 1)) AS iz))
"""
BOXES_ONLY = BOXES[: BOXES.index("filled AS")].rstrip().rstrip(",")
UPRIGHT = "spread AS (SELECT part_id, px, py, pz, hx AS ax, hy AS ay, hz AS az FROM parts)"
FILLED = "filled AS MATERIALIZED (SELECT DISTINCT ix, iy, iz FROM reached), f7 AS (SELECT * FROM filled)"
ROOTED_SURFELS = (
    SURFELS.replace("(iy + 1) * (128 // (1 << depth)) - 8 AS top FROM leaves", "(iy + 1) * (128 // (1 << depth)) + ry AS top, rx, rz, (iy + 1) * (128 // (1 << depth)) AS cell_y FROM leaves CROSS JOIN root")
    .replace("ix * e - 8 + i AS x, iz * e - 8 + j AS z", "ix * e + rx + i AS x, iz * e + rz + j AS z, ix * e + i AS cell_x, iz * e + j AS cell_z")
    .replace("f.ix = c.x + 8 AND f.iy = c.top + 8 AND f.iz = c.z + 8", "f.ix = c.cell_x AND f.iy = c.cell_y AND f.iz = c.cell_z")
)
ORACLES["bake_floor_samples"] = with_(
    BOXES_ONLY, UPRIGHT, ROOT, FILLED, LEVELS, LEAVES, ROOTED_SURFELS,
    body=f"SELECT x + 0.5::DOUBLE AS px, y AS py, z + 0.5::DOUBLE AS pz, 0.0::DOUBLE AS slope, {r6('coalesce(roof, 20)', 'clearance')}, part_id FROM samples",
)
ORACLES["bake_tree"] = with_(
    BOXES_ONLY, UPRIGHT, ROOT, FILLED, LEVELS, LEAVES,
    body="SELECT (depth + log2(edge) - 7)::INT AS depth, count(*) AS leaves, rx AS root_x, ry AS root_y, rz AS root_z, edge FROM leaves CROSS JOIN root GROUP BY ALL",
)
SOLIDS = """
solid_rows AS (
  SELECT s_suppkey::BIGINT AS part_id, s_suppkey % 3 AS kind, ((s_suppkey * 29) % 50 + 4.263)::DOUBLE AS px, (((s_suppkey * 7) % 4) * 4 + 2.25)::DOUBLE AS py, ((s_suppkey * 43) % 50 + 4.271)::DOUBLE AS pz,
    (1.5 + s_suppkey % 4)::DOUBLE AS hx, (0.5 + (s_suppkey % 3) * 0.5)::DOUBLE AS hy, (1.5 + (s_suppkey // 4) % 3)::DOUBLE AS hz FROM supplier
  UNION ALL SELECT -1, 1, 0.5, 0.5, 60.5, 0.5, 0.5, 0.5
  UNION ALL SELECT -2, 1, 60.5, 0.5, 0.5, 0.5, 0.5, 0.5),
spread AS (
  SELECT *, CASE kind WHEN 2 THEN 0.6::DOUBLE * hx + 0.8::DOUBLE * hz ELSE hx END AS ax, CASE kind WHEN 0 THEN hx ELSE hy END AS ay, CASE kind WHEN 0 THEN hx WHEN 2 THEN 0.8::DOUBLE * hx + 0.6::DOUBLE * hz ELSE hz END AS az FROM solid_rows)
"""
ORACLES["solid_leaves"] = with_(
    SOLIDS, ROOT,
    "centred AS (SELECT *, ix + 0.5 + rx - px AS dx, iy + 0.5 + ry - py AS dy, iz + 0.5 + rz - pz AS dz FROM reached)",
    """filled AS MATERIALIZED (
  SELECT DISTINCT ix, iy, iz FROM centred WHERE CASE kind
    WHEN 0 THEN greatest(abs(dx) - 0.5, 0) + greatest(abs(dy) - 0.5, 0) + greatest(abs(dz) - 0.5, 0) <= hx
    WHEN 1 THEN abs(dx) <= hx + 0.5 AND abs(dy) <= hy + 0.5 AND abs(dz) <= hz + 0.5
    ELSE abs(dx) <= ax + 0.5 AND abs(dy) <= hy + 0.5 AND abs(dz) <= az + 0.5 AND abs(dx * 0.6 + dz * 0.8) <= hx + 0.7 AND abs(dz * 0.6 - dx * 0.8) <= hz + 0.7 END)""",
    "f7 AS (SELECT * FROM filled)", LEVELS, LEAVES,
    body="SELECT depth::INT AS depth, ix, iy, iz FROM leaves",
)
ORACLES["block_parts"] = with_(SOLIDS, body="SELECT part_id, kind <> 0 AS is_block FROM solid_rows")
INSTANCES = """
tree AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN (o_orderkey - 1) // 3 END AS parent,
    CASE WHEN o_orderkey = 0 THEN 'Workspace' WHEN o_orderkey % 41 = 5 THEN 'Humanoid' WHEN o_orderkey % 5 = 1 THEN 'Model' ELSE 'Part' END AS class FROM orders),
bodies AS (SELECT DISTINCT m.id FROM tree m JOIN tree h ON h.parent = m.id WHERE m.class = 'Model' AND h.class = 'Humanoid'),
under(id) AS (SELECT t.id FROM tree t JOIN bodies b ON t.parent = b.id UNION SELECT t.id FROM tree t JOIN under u ON t.parent = u.id)
"""
ORACLES["character_parts"] = with_(INSTANCES, body="SELECT id AS instance_id FROM under")
ORACLES["character_scan"] = with_(BOXES_ONLY, INSTANCES, body="SELECT part_id, name FROM parts WHERE greatest(2 * hx, 2 * hz) <= 8 AND part_id NOT IN (SELECT id FROM under)")

# --- small operators -------------------------------------------------------------

ORACLES["floor_columns"] = with_(LATTICE, body="SELECT ix, iz, count(*) AS samples, min(y) AS lowest FROM nodes GROUP BY ix, iz")
ORACLES["grid_axes"] = with_(
    GRID, "world AS (SELECT *, grid_id % 11 = 4 OR grid_id % 7 <> 0 AND grid_id % 6 = 5 AS plain FROM live)",
    body="SELECT cell_id, CASE WHEN plain THEN 1 ELSE ux END::DOUBLE AS ux, CASE WHEN plain THEN 0 ELSE uz END::DOUBLE AS uz, CASE WHEN plain THEN 0 ELSE -uz END::DOUBLE + 0.0 AS vx, CASE WHEN plain THEN 1 ELSE ux END::DOUBLE AS vz, 1.0::DOUBLE AS ny FROM world",
)
ORACLES["line_crossings"] = with_(
    """lines AS (
  SELECT o_orderkey AS pair_id, (o_orderkey % 10)::DOUBLE AS ax, (o_custkey % 10)::DOUBLE AS az, (1 + o_orderkey % 3)::DOUBLE AS adx, (o_custkey % 4 - 1)::DOUBLE AS adz,
    (o_orderkey * 7 % 10)::DOUBLE AS bx, (o_custkey * 3 % 10)::DOUBLE AS bz, (o_custkey % 3 - 1)::DOUBLE AS bdx, (1 + o_orderkey % 2)::DOUBLE AS bdz FROM orders)""",
    "met AS (SELECT *, adx * bdz - adz * bdx AS den, ((bx - ax) * bdz - (bz - az) * bdx) / nullif(den, 0) AS t FROM lines)",
    body=f"SELECT pair_id, {r6('ax + adx * t', 'x')}, {r6('az + adz * t', 'z')} FROM met",
)
ORACLES["row_lines"] = with_(
    LATTICE, "rows_ AS (SELECT iz, list(ix + 0.5::DOUBLE ORDER BY ix) AS xs, list(iz + 0.5::DOUBLE + y ORDER BY ix) AS zs FROM nodes GROUP BY iz)",
    f"fits AS (SELECT *, {deviation('')} AS deviation, {extent('')} AS extent FROM ({lines('SELECT * FROM rows_', ('1', 'len(xs)', ''))}))",
    body=f"SELECT iz, n, {', '.join(map(r6, ('cx', 'cz', 'dx', 'dz', 'deviation', 'extent')))} FROM fits",
)
ORACLES["merged_options"] = """
SELECT stage, name, value::DOUBLE AS value FROM (VALUES
  ('floor', 'leaf', 1), ('floor', 'max_slope', 50), ('floor', 'agent_height', 5), ('floor', 'clear_cap', 20), ('floor', 'max_ground_footprint', 400), ('floor', 'margin', 2),
  ('lattice', 'radius', 2), ('lattice', 'fit_tol', 1), ('lattice', 'step_tol', 2), ('lattice', 'narrow_margin', 0.25), ('lattice', 'miter_limit', 4), ('lattice', 'min_seg_len', 2), ('lattice', 'collinear_deg', 8),
  ('lattice', 'probe_cap', 12), ('lattice', 'offset_band', 0.5), ('lattice', 'min_run_len', 6), ('lattice', 'dropoff_outset', 0.5), ('lattice', 'label_min_run', 3),
  ('grid', 'step', 2), ('grid', 'surface_eps', 0.25), ('grid', 'seam_pad', 0.08), ('grid', 'cover_pad', 0.001), ('grid', 'wall_drop', 3), ('grid', 'wall_rise', 1), ('grid', 'min_clearance', 1.5),
  ('grid', 'stitch_gap', 2.5), ('grid', 'vertex_eps', 0.05)) t(stage, name, value)"""
ORACLES["snapshot_files"] = with_(
    LATTICE, body="SELECT v::INT AS version, (ix + 0.5)::DOUBLE AS px, y AS py, (iz + 0.5)::DOUBLE AS pz, clearance, CASE v WHEN 2 THEN blocked ELSE 0 END::INT AS blocked FROM nodes CROSS JOIN (VALUES (1), (2)) f(v)"
)
