"""Query-time use of the bake: who fits where, how they move, and rectangles of like floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AgentOptions
from .islands import with_island


def fits(options: AgentOptions, clearance: Column, width: Column | None = None, portal: Column | None = None) -> Column:
    """Whether an agent passes: headroom, annotated width where there is one, and portal length."""
    ok = clearance >= options.height
    if width is not None:
        ok = ok & (width.isNull() | (width >= 2 * options.radius))
    if portal is not None:
        ok = ok & (portal >= 2 * options.radius)
    return ok


def movement_mode(clearance: Column, options: AgentOptions = AgentOptions()) -> Column:
    """walk, crouch, crawl, or null where nothing gets through."""
    return F.when(clearance >= options.walk, "walk").when(clearance >= options.crouch, "crouch").when(clearance >= options.crawl, "crawl")


def giant_floor(surfels: DataFrame, options: AgentOptions = AgentOptions()) -> DataFrame:
    """Floor with headroom for the coarse tier."""
    return surfels.where(F.col("clearance") >= options.giant)


def walkable_by(surfels: DataFrame, options: AgentOptions = AgentOptions()) -> DataFrame:
    """Samples with flags for the slope limits of the two kinds of agent."""
    return surfels.withColumn("npc", F.col("slope") <= options.npc_slope).withColumn("player", F.col("slope") <= options.player_slope)


def floor_rectangles(cells: DataFrame, options: AgentOptions = AgentOptions()) -> DataFrame:
    """Convex pieces of a component: maximal row runs of one clearance and floor band, merged downwards
    while the next row has the same run. cells: comp, ix, iz, y, clearance.

    Pieces end wherever the clearance changes; a band is floor_deviation high, so no rectangle's floor
    varies by more. comp, clearance, mode, x0, x1, z0, z1, cells."""
    rows = cells.withColumn("level", F.floor(F.col("y") / options.floor_deviation))
    rows = with_island(rows, ["comp", "iz", "clearance", "level"], "ix", [])
    runs = rows.groupBy("comp", "iz", "clearance", "level", "island").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"))
    runs = with_island(runs.drop("island"), ["comp", "clearance", "level", "x0", "x1"], "iz", [])
    out = runs.groupBy("comp", "clearance", "level", "x0", "x1", "island").agg(F.min("iz").alias("z0"), F.max("iz").alias("z1"))
    mode = F.coalesce(movement_mode(F.col("clearance"), options), F.lit("none")).alias("mode")
    return out.select("comp", "clearance", mode, "x0", "x1", "z0", "z1", ((F.col("x1") - F.col("x0") + 1) * (F.col("z1") - F.col("z0") + 1)).alias("cells"))
