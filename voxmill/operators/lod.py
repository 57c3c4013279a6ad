"""Levels of detail: how many, in what grid, in which fragments, in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from . import mesh

TARGET_FACES = 25_000
MAX_PADDING = 2.0
LEAST_FACES = 1_000


def decimation_targets(meshes: DataFrame, lods: int, factor: int) -> DataFrame:
    """(segment_id, lod, n_faces, target) for the levels from 1 on."""
    levels = meshes.withColumn("lod", F.explode(F.sequence(F.lit(1), F.lit(max(1, lods - 1)))))
    return levels.filter(F.lit(lods > 1)).withColumn("target", F.greatest(F.floor(F.col("n_faces") / F.pow(F.lit(factor), F.col("lod"))), F.lit(LEAST_FACES)).cast("long"))


def truncated(levels: DataFrame) -> DataFrame:
    """Levels (segment_id, lod, n_faces) before the first that is missing or has no fewer faces than the one before."""
    order = Window.partitionBy("segment_id").orderBy("lod")
    bad = (F.col("lod") != F.row_number().over(order) - 1) | (F.coalesce(F.col("n_faces") >= F.lag("n_faces").over(order), F.lit(False)))
    return levels.withColumn("_bad", bad.cast("int")).withColumn("_worst", F.max("_bad").over(order)).filter("_worst = 0").drop("_bad", "_worst")


def auto_box(meshes: DataFrame, target: int = TARGET_FACES) -> DataFrame:
    """Edge of a fragment along each axis from the faces and the extent of level 0."""
    k = F.greatest(F.lit(1), F.ceil(F.sqrt(F.ceil(F.col("n_faces") / target))))
    return meshes.withColumns({f"box_{a}": (F.ceil(F.ceil(F.col(f"max_{a}") - F.col(f"min_{a}")) / k) + 1).cast("long") for a in "xyz"})


def kept_levels(meshes: DataFrame, limit: float = MAX_PADDING) -> DataFrame:
    """The most levels, up to n_lods, whose coarsest grid pads no axis (chunks_x, ...) beyond the limit."""
    tried = meshes.withColumn("c", F.explode(F.expr("sequence(1, greatest(1, n_lods))")))
    step = F.pow(F.lit(2), F.col("c") - 1)
    worst = F.greatest(*(F.ceil(F.col(f"chunks_{a}") / step) * step / F.col(f"chunks_{a}") for a in "xyz"))
    return tried.filter(worst <= limit).groupBy("segment_id").agg(F.max("c").alias("kept_lods"))


def grid_origin(low: Column, high: Column, grid: Column) -> Column:
    """Of a grid around the middle of the mesh, held so that it covers the mesh; the upper hold wins."""
    return g.clip(F.floor((low + high) / 2 - grid / 2), F.ceil(high - grid), F.floor(low)).cast("long")


def union_chunks(low: Column, high: Column, origin: Column, box: Column) -> tuple[Column, Column]:
    first = F.greatest(F.floor((low - origin) / box), F.lit(0))
    return first.cast("long"), F.greatest(F.ceil((high - origin) / box), first + 1).cast("long")


def in_curve_order(fragments: DataFrame, by: list[str]) -> DataFrame:
    """Fragments (fx, fy, fz) with their place on the Z-order curve within each group."""
    code = g.morton(F.col("fx"), F.col("fy"), F.col("fz"))
    return fragments.withColumn("code", code).withColumn("place", (F.row_number().over(Window.partitionBy(*by).orderBy("code")) - 1).cast("long"))


def with_placeholders(fragments: DataFrame, boxes: DataFrame) -> DataFrame:
    """All cells of each level's union box (lo_x, hi_x, ... in level-0 cells, n_lods), with the size 0 where there is
    no fragment (segment_id, lod, fx, fy, fz, n_bytes)."""
    cells = boxes.withColumn("lod", F.explode(F.expr("sequence(0, n_lods - 1)")))
    for a in "xyz":
        first = F.floor(F.col(f"lo_{a}") / F.pow(F.lit(2), F.col("lod"))).cast("long")
        last = (F.ceil(F.col(f"hi_{a}") / F.pow(F.lit(2), F.col("lod"))) - 1).cast("long")
        cells = cells.filter(first <= last).withColumn(f"f{a}", F.explode(F.sequence(first, last)))
    key = ["segment_id", "lod", "fx", "fy", "fz"]
    empty = cells.select(*key, F.lit(0).cast("long").alias("n_bytes"))
    # A sum with the fragment where there is one, not a join: rows that lie together by segment stay where they are.
    return empty.unionByName(fragments.select(*key, "n_bytes")).groupBy(*key).agg(F.sum("n_bytes").alias("n_bytes"))


def decomposed(soup: DataFrame, box: float) -> DataFrame:
    """The pieces of each triangle (structs a, b, c) in the grid cells that it reaches: (..., fx, fy, fz, a, b, c).

    A triangle goes only to the cells of its own bounds, one axis after the other, and is clipped there.
    """
    out = soup
    for a in "xyz":
        low = F.floor(F.least(*(F.col(f"{n}.{a}") for n in "abc")) / box).cast("long")
        high = F.greatest(low, F.ceil(F.greatest(*(F.col(f"{n}.{a}") for n in "abc")) / box).cast("long") - 1)
        out = out.withColumn(f"f{a}", F.explode_outer(F.sequence(low, high)))
        for above in (True, False):
            shifted = {n: F.col(n).withField(a, F.col(f"{n}.{a}") - (F.col(f"f{a}") + (0 if above else 1)) * box) for n in "abc"}
            out = mesh.clip_half_space(out.withColumns(shifted), a, 0.0, above)
            out = out.withColumns({n: F.col(n).withField(a, F.col(f"{n}.{a}") + (F.col(f"f{a}") + (0 if above else 1)) * box) for n in "abc"})
    return out
