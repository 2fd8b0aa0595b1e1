"""Column layouts of the tables that stages hand to each other. Vectors are flat columns, so that
pruning and code generation see them."""

VEC = "{0}x double, {0}y double, {0}z double"


def vec(name: str) -> str:
    return VEC.format(name)


PARTS = f"part_id bigint, name string, class string, shape string, can_collide boolean, is_character boolean, {vec('p')}, {vec('r')}, {vec('u')}, {vec('l')}, {vec('s')}"
SURFELS = f"sid bigint, {vec('p')}, {vec('n')}, slope double, clearance double, part_id bigint, blocked int"
CELLS = f"cell_id bigint, grid_id bigint, ui bigint, vi bigint, {vec('p')}, {vec('u')}, {vec('v')}, {vec('n')}"
DEAD = f"grid_id bigint, ui bigint, vi bigint, {vec('p')}, killer_id bigint"
FOOT_CELLS = f"part_id bigint, ui bigint, vi bigint, {vec('b')}, {vec('u')}, {vec('v')}"
EDGES = f"cell_id bigint, grid_id bigint, du int, dv int, kind string, killer_id bigint, comp bigint, ui bigint, vi bigint, {vec('a')}, {vec('b')}, {vec('o')}"
TRIANGLES = f"part_id bigint, {vec('a')}, {vec('b')}, {vec('c')}"
