"""SQL of the contour pipeline: loop order, closed labels, points, greedy fit, offsets, polygons.

The folds are recursive queries that take one point, or one segment, of every loop at a time."""

from __future__ import annotations

import math

from ..config import LatticeOptions

OPTIONS = LatticeOptions()

#: Loops are ranked by doubling; a loop may have two to this power edges.
DOUBLINGS = 16


def doubled() -> str:
    steps = [
        """j0 AS MATERIALIZED (
  SELECT edge_id AS e, CASE WHEN next_id <> first_edge THEN next_id END AS nx, CASE WHEN next_id = first_edge THEN 0 ELSE 1 END AS d
  FROM follow JOIN rings ON node = edge_id JOIN heads USING (ring))"""
    ]
    steps += [f"j{k + 1} AS MATERIALIZED (SELECT a.e, b.nx, a.d + coalesce(b.d, 0) AS d FROM j{k} a LEFT JOIN j{k} b ON b.e = a.nx)" for k in range(DOUBLINGS)]
    return ",\n".join(steps)


RINGS = """
both_ways AS MATERIALIZED (SELECT edge_id AS a, next_id AS b FROM follow UNION ALL SELECT next_id, edge_id FROM follow),
rings(node, ring) USING KEY (node) AS (
  SELECT edge_id, edge_id FROM follow
  UNION
  SELECT p.b, min(c.ring) FROM rings c JOIN both_ways p ON p.a = c.node JOIN recurring.rings r ON r.node = p.b WHERE c.ring < r.ring GROUP BY p.b)
"""

TRACE = (
    "heads AS MATERIALIZED (SELECT ring, arg_min(edge_id, (az, ax, bit)) AS first_edge FROM rings JOIN cracks ON edge_id = node GROUP BY ring),\n"
    + doubled()
    + f""",
traced AS MATERIALIZED (
  SELECT ring AS loop_id, (max(d) OVER (PARTITION BY ring) - d)::BIGINT AS pos, c.*, az - bz AS inx, bx - ax AS inz
  FROM j{DOUBLINGS} JOIN rings ON node = e JOIN cracks c ON c.edge_id = e),
flagged AS (
  SELECT *, wall <> coalesce(lag(wall) OVER (PARTITION BY loop_id ORDER BY pos), last_value(wall) OVER (PARTITION BY loop_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS turn
  FROM traced),
stretched AS (
  SELECT *, sum(turn::INT) OVER (PARTITION BY loop_id ORDER BY pos) AS stretch, sum(turn::INT) OVER (PARTITION BY loop_id) AS turns FROM flagged),
closed AS MATERIALIZED (
  SELECT *, wall OR turns > 0 AND count(*) OVER (PARTITION BY loop_id, CASE WHEN turns > 0 THEN stretch % turns ELSE 0 END) < {OPTIONS.label_min_run} AS label FROM stretched)
"""
)

POINTS = """
before AS (
  SELECT *, lag(ix) OVER w AS last_x, lag(iz) OVER w AS last_z, lag(label) OVER w AS last_label FROM closed WINDOW w AS (PARTITION BY loop_id ORDER BY pos)),
points AS MATERIALIZED (
  SELECT loop_id, pos, comp, ix + 0.5::DOUBLE AS x, iz + 0.5::DOUBLE AS z, inx, inz, label FROM before
  WHERE NOT coalesce(last_x = ix AND last_z = iz AND last_label = label, false))
"""


def lines(source: str, *spans: tuple[str, str, str]) -> str:
    """The source with the least-squares line of each span (first point, last point, tag) of the lists xs,
    zs: points px, pz, their number n, centre cx, cz and direction dx, dz. One level for each step, as
    an expression that a lambda uses would be worked out again for every element."""
    each = lambda text: ", ".join(text.replace("{t}", t).replace("{p}", p).replace("{q}", q) for p, q, t in spans)
    inner = f"SELECT *, {each('xs[{p}:{q}] AS px{t}, zs[{p}:{q}] AS pz{t}')} FROM ({source})"
    inner = f"SELECT *, {each('len(px{t}) AS n{t}, px{t}[1] AS ox{t}, pz{t}[1] AS oz{t}')} FROM ({inner})"
    inner = f"SELECT *, {each('[v - ox{t} for v in px{t}] AS u{t}, [v - oz{t} for v in pz{t}] AS w{t}')} FROM ({inner})"
    sums = "list_sum(u{t}) AS su{t}, list_sum(w{t}) AS sw{t}, list_sum([v * v for v in u{t}]) AS uu{t}, list_sum([v * v for v in w{t}]) AS ww{t}, list_sum(list_transform(u{t}, lambda v, i: v * w{t}[i])) AS uw{t}"
    inner = f"SELECT *, {each(sums)} FROM ({inner})"
    angle = "0.5::DOUBLE * atan2(2 * (uw{t} - su{t} * sw{t} / n{t}), (uu{t} - su{t} * su{t} / n{t}) - (ww{t} - sw{t} * sw{t} / n{t})) AS angle{t}, ox{t} + su{t} / n{t} AS cx{t}, oz{t} + sw{t} / n{t} AS cz{t}"
    inner = f"SELECT *, {each(angle)} FROM ({inner})"
    return f"SELECT *, {each('cos(angle{t}) AS dx{t}, sin(angle{t}) AS dz{t}')} FROM ({inner})"


def deviation(t: str) -> str:
    return f"list_max(list_transform(px{t}, lambda v, i: abs((v - cx{t}) * -dz{t} + (pz{t}[i] - cz{t}) * dx{t})))"


def extent(t: str) -> str:
    along = f"list_transform(px{t}, lambda v, i: (v - cx{t}) * dx{t} + (pz{t}[i] - cz{t}) * dz{t})"
    return f"(list_max({along}) - list_min({along}))"


FIT = f"""
lists AS MATERIALIZED (
  SELECT loop_id, any_value(comp) AS comp, count(*) AS m, list(x ORDER BY pos) AS xs, list(z ORDER BY pos) AS zs, list(label ORDER BY pos) AS ls, list(pos ORDER BY pos) AS ps,
    list(inx::DOUBLE ORDER BY pos) AS nxs, list(inz::DOUBLE ORDER BY pos) AS nzs FROM points GROUP BY loop_id HAVING count(*) >= 3),
grown(loop_id, s, e) AS (
  SELECT loop_id, 1::BIGINT, 1::BIGINT FROM lists
  UNION ALL
  SELECT loop_id, CASE WHEN same AND {deviation("")} <= {OPTIONS.fit_tol}::DOUBLE THEN s ELSE e + 1 END, e + 1
  FROM ({lines("SELECT loop_id, s, e, xs, zs, ls[e + 1] = ls[s] AS same FROM grown JOIN lists USING (loop_id) WHERE e < m", ("s", "e + 1", ""))})),
fitted AS MATERIALIZED (SELECT loop_id, s, max(e) AS e, row_number() OVER (PARTITION BY loop_id ORDER BY s) AS q FROM grown GROUP BY loop_id, s),
folded(loop_id, q, p, e) AS (
  SELECT loop_id, q, s, e FROM fitted WHERE q = 1
  UNION ALL
  SELECT loop_id, q + 1, CASE WHEN n1 >= 2 AND n2 >= 2 AND same AND (abs(dx1 * dx2 + dz1 * dz2) >= {math.cos(math.radians(OPTIONS.collinear_deg))!r}::DOUBLE OR {extent("2")} < {OPTIONS.min_seg_len}::DOUBLE)
      AND {deviation("3")} <= {OPTIONS.fit_tol}::DOUBLE THEN p ELSE s2 END, e2
  FROM ({lines("SELECT f.loop_id, f.q, f.p, f.e, n.s AS s2, n.e AS e2, xs, zs, ls[f.p] = ls[n.s] AS same FROM folded f JOIN fitted n ON n.loop_id = f.loop_id AND n.q = f.q + 1 JOIN lists l ON l.loop_id = f.loop_id", ("p", "e", "1"), ("s2", "e2", "2"), ("p", "e2", "3"))})),
kept_parts AS (SELECT loop_id, p, max(e) AS e FROM folded GROUP BY loop_id, p),
oriented AS (
  SELECT *, -dz_ * list_sum(nxs[p:e]) + dx_ * list_sum(nzs[p:e]) < 0 AS turned
  FROM ({lines("SELECT * FROM kept_parts JOIN lists USING (loop_id)", ("p", "e", "_"))})),
turned_in AS (SELECT *, CASE WHEN turned THEN dz_ ELSE -dz_ END AS nx_, CASE WHEN turned THEN -dx_ ELSE dx_ END AS nz_ FROM oriented),
lined AS (
  SELECT loop_id, comp, row_number() OVER (PARTITION BY loop_id ORDER BY p) - 1 AS seg, ls[p] AS label, e - p + 1 AS n, ps[p] AS first_pos, ps[e] AS last_pos, xs[p] AS first_x, zs[p] AS first_z, xs[e] AS last_x, zs[e] AS last_z,
    cx_, cz_, dx_, dz_, nx_, nz_, {extent("_")} AS length_, greatest(0::DOUBLE, list_max(list_transform(px_, lambda v, i: (v - cx_) * nx_ + (pz_[i] - cz_) * nz_))) AS bias_
  FROM turned_in),
segments AS MATERIALIZED (
  SELECT loop_id, comp, seg, label, n, first_pos, last_pos, first_x, first_z, last_x, last_z,
    {", ".join(f"CASE WHEN n >= 2 THEN {c}_ END AS {c}" for c in ("cx", "cz", "dx", "dz", "nx", "nz", "length", "bias"))} FROM lined)
"""

OFFSETS = f"""
behind AS MATERIALIZED (
  SELECT s.loop_id, s.seg, p.pos, p.x, p.z, s.comp, s.nx, s.nz FROM segments s JOIN points p ON p.loop_id = s.loop_id AND p.pos BETWEEN s.first_pos AND s.last_pos WHERE s.label AND s.nx IS NOT NULL),
marched AS (
  SELECT b.loop_id, b.pos, n, f.d FROM (SELECT *, unnest(range({int(OPTIONS.probe_cap * 2) + 1})) AS n FROM behind) b
  LEFT JOIN field f ON f.comp = b.comp AND f.ix = floor(b.x + b.nx * (n * 0.5::DOUBLE))::BIGINT AND f.iz = floor(b.z + b.nz * (n * 0.5::DOUBLE))::BIGINT),
stopped AS (SELECT loop_id, pos, min(CASE WHEN d IS NULL THEN n END) AS stop FROM marched GROUP BY loop_id, pos),
widths AS MATERIALIZED (
  SELECT loop_id, pos, coalesce(max(CASE WHEN stop IS NULL OR n < stop THEN d END), 0::DOUBLE) AS half_width FROM marched JOIN stopped USING (loop_id, pos) GROUP BY loop_id, pos),
smooth AS (
  SELECT b.*, min(half_width) OVER (PARTITION BY b.loop_id, seg ORDER BY pos ROWS BETWEEN {max(OPTIONS.min_run_len // 2, 1)} PRECEDING AND {max(OPTIONS.min_run_len // 2, 1)} FOLLOWING) AS least
  FROM behind b JOIN widths USING (loop_id, pos)),
banded AS (SELECT *, floor(least(greatest(least - {OPTIONS.narrow_margin}::DOUBLE, 0), {OPTIONS.radius}::DOUBLE) / {max(OPTIONS.offset_band, 0.05)}::DOUBLE + 1e-9::DOUBLE) AS band FROM smooth),
changed AS (SELECT *, coalesce(band <> lag(band) OVER (PARTITION BY loop_id, seg ORDER BY pos), true)::INT AS fresh FROM banded),
bands AS (SELECT *, sum(fresh) OVER (PARTITION BY loop_id, seg ORDER BY pos) AS stretch FROM changed),
long_bands AS (SELECT *, count(*) OVER (PARTITION BY loop_id, seg, stretch) AS size FROM bands),
graded AS (SELECT *, sum(CASE WHEN fresh = 1 AND (stretch = 1 OR size >= 2) THEN 1 ELSE 0 END) OVER (PARTITION BY loop_id, seg ORDER BY pos) - 1 AS part FROM long_bands),
runs_of_walls AS (
  SELECT loop_id, seg, part, count(*) AS n, min(least) AS half_width, sum(x) / count(*) AS mx, sum(z) / count(*) AS mz, list(x ORDER BY pos) AS xs, list(z ORDER BY pos) AS zs, any_value(nx) AS nx, any_value(nz) AS nz
  FROM graded GROUP BY loop_id, seg, part),
wall_lines AS (
  SELECT *, greatest(0::DOUBLE, list_max(list_transform(xs, lambda v, i: (v - mx) * nx + (zs[i] - mz) * nz))) AS bias, least(greatest(half_width - {OPTIONS.narrow_margin}::DOUBLE, 0), {OPTIONS.radius}::DOUBLE) AS off FROM runs_of_walls),
offsets AS MATERIALIZED (
  SELECT w.loop_id, w.seg, w.part::BIGINT AS part, true AS label, w.n, half_width, off AS "offset", off < {OPTIONS.radius} - 1e-6 AS narrow, mx + w.nx * w.bias + w.nx * off AS ox, mz + w.nz * w.bias + w.nz * off AS oz,
    s.dx, s.dz, s.nx, s.nz, xs[1] AS first_x, zs[1] AS first_z, xs[-1] AS last_x, zs[-1] AS last_z FROM wall_lines w JOIN segments s USING (loop_id, seg)
  UNION ALL
  SELECT loop_id, seg, 0::BIGINT, label, n, NULL, CASE WHEN nx IS NOT NULL THEN -{OPTIONS.dropoff_outset}::DOUBLE END, CASE WHEN nx IS NOT NULL THEN false END, cx + nx * -{OPTIONS.dropoff_outset}::DOUBLE, cz + nz * -{OPTIONS.dropoff_outset}::DOUBLE,
    dx, dz, nx, nz, first_x, first_z, last_x, last_z FROM segments WHERE NOT label OR nx IS NULL)
"""

POLYGONS = f"""
ringed AS (
  SELECT *, count(*) OVER (PARTITION BY loop_id) AS lines, row_number() OVER (PARTITION BY loop_id ORDER BY seg, part) AS k FROM offsets WHERE ox IS NOT NULL),
cornered AS (
  SELECT a.loop_id, a.dx * b.dz - a.dz * b.dx AS den, ((b.ox - a.ox) * b.dz - (b.oz - a.oz) * b.dx) / nullif(den, 0) AS t, a.ox + a.dx * t AS x, a.oz + a.dz * t AS z,
    sqrt((x - a.last_x) * (x - a.last_x) + (z - a.last_z) * (z - a.last_z)) > {OPTIONS.miter_limit * OPTIONS.radius}::DOUBLE AS far
  FROM ringed a JOIN ringed b ON b.loop_id = a.loop_id AND b.k = a.k % a.lines + 1 WHERE a.lines >= 3),
polygons AS (
  SELECT loop_id, sum(CASE WHEN abs(den) < 1e-9 OR far THEN 2 ELSE 1 END) AS vertices, sum(CASE WHEN abs(den) >= 1e-9 AND far THEN 1 ELSE 0 END) AS bevels, sum(CASE WHEN abs(den) < 1e-9 THEN 1 ELSE 0 END) AS steps
  FROM cornered GROUP BY loop_id)
"""
