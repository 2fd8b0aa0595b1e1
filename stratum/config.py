"""Options of the bakes; each stage takes one of these and never a loose map of values."""

from __future__ import annotations

from dataclasses import dataclass, replace


class Options:
    """Defaults that single fields may override."""

    def over(self, **changes):
        return replace(self, **changes)


@dataclass(frozen=True)
class FloorOptions(Options):
    """leaf: voxel edge; max_slope: degrees; clear_cap: headroom that counts as open air;
    max_ground_footprint: larger slabs are dropped at the scan; margin: padding of the world box;
    always_walkable: name part that exempts from the slope limit."""

    leaf: float = 1.0
    max_slope: float = 65.0
    agent_height: float = 5.0
    clear_cap: float = 20.0
    max_ground_footprint: float = 400.0
    margin: float = 2.0
    always_walkable: str = "ClipRamp"

    def __post_init__(self) -> None:
        if self.leaf < 1:
            raise ValueError("leaf must be 1 or more: tops are sampled in whole units")


@dataclass(frozen=True)
class LatticeOptions(Options):
    """Options of the world-lattice boundary pipeline."""

    radius: float = 1.5
    fit_tol: float = 1.0
    step_tol: float = 2.0
    narrow_margin: float = 0.25
    miter_limit: float = 4.0
    min_seg_len: float = 2.0
    collinear_deg: float = 8.0
    probe_cap: float = 12.0
    offset_band: float = 0.5
    min_run_len: int = 4
    dropoff_outset: float = 0.5
    probe_heights: tuple[float, ...] = (1.0, 2.0, 3.0)
    label_min_run: int = 3


@dataclass(frozen=True)
class GridOptions(Options):
    """Options of the part-aligned-grid boundary pipeline."""

    step: float = 1.0
    surface_eps: float = 0.25
    seam_pad: float = 0.08
    cover_pad: float = 1e-3
    wall_drop: float = 3.0
    wall_rise: float = 1.0
    min_clearance: float = 1.5
    stitch_gap: float = 2.5
    vertex_eps: float = 0.05
    outline_probes: tuple[float, ...] = (0.6, 1.0, 1.4)


@dataclass(frozen=True)
class AgentOptions(Options):
    """An agent's body and the headroom of each way of moving."""

    height: float = 5.0
    radius: float = 1.0
    walk: float = 5.0
    crouch: float = 3.0
    crawl: float = 1.5
    giant: float = 9.0
    npc_slope: float = 65.0
    player_slope: float = 40.0
    floor_deviation: float = 2.0
