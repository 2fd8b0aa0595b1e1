"""Boxes, cubes, rays and lines as column expressions; everything stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as v
from .vectors import Vec

#: Slack of containment tests, and squared length under which a cross axis says nothing.
CONTAIN, DEGENERATE = 1e-4, 1e-8


def box_half(right: Vec, up: Vec, look: Vec, size: Vec) -> Vec:
    """Half extent of the axis-aligned box around an oriented one."""
    return tuple(0.5 * (F.abs(right[k]) * size[0] + F.abs(up[k]) * size[1] + F.abs(look[k]) * size[2]) for k in range(3))


def point_in_box(p: Vec, centre: Vec, axes: tuple[Vec, Vec, Vec], half: Vec) -> Column:
    d = v.sub(p, centre)
    return reduce(Column.__and__, (F.abs(v.dot(d, a)) <= half[k] + CONTAIN for k, a in enumerate(axes)))


def cube_in_box(at: Vec, reach, centre: Vec, axes: tuple[Vec, Vec, Vec], half: Vec) -> Column:
    """All corners of a cube inside an oriented box, by the farthest corner along each axis."""
    d = v.sub(at, centre)
    return reduce(Column.__and__, (F.abs(v.dot(d, a)) + reach * (F.abs(a[0]) + F.abs(a[1]) + F.abs(a[2])) <= half[k] + CONTAIN for k, a in enumerate(axes)))


def box_hits_cube(centre: Vec, axes: tuple[Vec, Vec, Vec], half: Vec, at: Vec, reach) -> Column:
    """Separating-axis test over the three world axes, the box's axes and their nine cross
    products. Touching counts as a hit; near-parallel cross products are skipped.

    axes: orthonormal. So the box reaches, along the cross product of world axis i and its axis j,
    as far as its two other axes do along i with their halves exchanged, which keeps the terms short."""
    d = v.sub(centre, at)
    size = [[F.abs(x) for x in a] for a in axes]
    apart = [F.abs(d[i]) > half[0] * size[0][i] + half[1] * size[1][i] + half[2] * size[2][i] + reach for i in range(3)]
    apart += [F.abs(v.dot(d, a)) > half[j] + reach * (size[j][0] + size[j][1] + size[j][2]) for j, a in enumerate(axes)]
    for i in range(3):
        p, q = (i + 1) % 3, (i + 2) % 3
        for j, a in enumerate(axes):
            k, m = (j + 1) % 3, (j + 2) % 3
            beyond = F.abs(d[q] * a[p] - d[p] * a[q]) > half[k] * size[m][i] + half[m] * size[k][i] + reach * (size[j][p] + size[j][q])
            apart.append((a[p] * a[p] + a[q] * a[q] >= DEGENERATE) & beyond)
    return ~reduce(Column.__or__, apart)


def triangle_hits_cube(a: Vec, b: Vec, c: Vec, at: Vec, reach) -> Column:
    """Separating-axis test of a triangle and a cube: cube faces, triangle plane, nine edge products.
    Along an edge product both ends of the edge lie at one place, so two corners tell its range."""
    corner = [v.sub(x, at) for x in (a, b, c)]
    edge = [v.sub(b, a), v.sub(c, b), v.sub(a, c)]
    outside = lambda xs, r: (F.least(*xs) > r) | (F.greatest(*xs) < -r)
    apart = [outside([p[k] for p in corner], reach) for k in range(3)]
    n = v.cross(edge[0], edge[1])
    apart.append((v.dot(n, n) >= DEGENERATE) & (F.abs(v.dot(n, corner[0])) > reach * (F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2]))))
    for i in range(3):
        p, q = (i + 1) % 3, (i + 2) % 3
        for k, e in enumerate(edge):
            ends = [x[q] * e[p] - x[p] * e[q] for x in (corner[k], corner[(k + 2) % 3])]
            apart.append((e[p] * e[p] + e[q] * e[q] >= DEGENERATE) & outside(ends, reach * (F.abs(e[p]) + F.abs(e[q]))))
    return ~reduce(Column.__or__, apart)


def ray_entry(origin: Vec, direction: Vec, reach, centre: Vec, axes: tuple[Vec, Vec, Vec], half: Vec) -> tuple[Column, Column]:
    """Entry distance of a unit ray into an oriented box and the number of the entered face's axis,
    both null on a miss. A ray that starts inside hits nothing."""
    d = v.sub(origin, centre)
    near, far = [], []
    for k, a in enumerate(axes):
        start, step = v.dot(d, a), v.dot(direction, a)
        flat = F.abs(step) < 1e-12
        t1, t2 = (-half[k] - start) / step, (half[k] - start) / step
        inside = F.abs(start) <= half[k]
        near.append(F.when(flat, F.when(inside, F.lit(-1e300)).otherwise(F.lit(1e300))).otherwise(F.least(t1, t2)))
        far.append(F.when(flat, F.when(inside, F.lit(1e300)).otherwise(F.lit(-1e300))).otherwise(F.greatest(t1, t2)))
    enter, leave = F.greatest(*near), F.least(*far)
    hit = (enter <= leave) & (enter >= 0.0) & (enter <= reach)
    face = F.when(near[0] == enter, F.lit(0)).when(near[1] == enter, F.lit(1)).otherwise(F.lit(2))
    return F.when(hit, enter), F.when(hit, face)


def line_intersection(ax: Column, az: Column, adx: Column, adz: Column, bx: Column, bz: Column, bdx: Column, bdz: Column) -> tuple[Column, Column]:
    """Where two lines meet, null for near-parallel ones."""
    den = adx * bdz - adz * bdx
    t = F.when(F.abs(den) >= 1e-9, F.try_divide((bx - ax) * bdz - (bz - az) * bdx, den))
    return ax + adx * t, az + adz * t


def principal_angle(sxx: Column, szz: Column, sxz: Column) -> Column:
    """Direction of the total-least-squares line from centred second moments."""
    return 0.5 * F.atan2(2 * sxz, sxx - szz)
