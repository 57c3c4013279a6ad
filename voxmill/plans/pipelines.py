"""Whole flows: volume to meshes, meshes to levels of detail in fragments, meshes to skeletons, and metric tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kernels, lod, mesh, objects, spread, surface, volume
from ..operators.scratch import kept
from ..sources import formats

STRATEGIES = ("decimate", "downsample")


Steps = float | tuple[float, float, float]


def block_counts(voxels: DataFrame, block: int = 64) -> DataFrame:
    """(segment_id, block) of every voxel."""
    at = F.struct(*(F.floor(F.col(a) / block) for a in "zyx"))
    return voxels.select(F.col("label").alias("segment_id"), at.alias("block"))


def rejected_segments(voxels: DataFrame, max_blocks: int, block: int = 64) -> DataFrame:
    """(segment_id, n_blocks, message) of the labels that ``meshes_of_volume`` leaves out."""
    _, large = mesh.cut_off(block_counts(voxels, block), "block", max_blocks)
    text = F.concat_ws("", F.lit("Mesh "), "segment_id", F.lit(" has too many blocks "), "n_blocks", F.lit(f">={max_blocks}. Skipping."))
    return large.select("segment_id", "n_blocks", text.alias("message"))


def meshes_of_volume(
    voxels: DataFrame, factor: int = 1, method: str = "mode_suppress_zero", voxel: Steps = 1.0, offset: Steps = 0.0,
    reduction: float | None = None, smoothing: int = 0, max_blocks: int | None = None, block: int = 64,
    region: tuple[tuple[int, int, int], tuple[int, int, int]] | None = None, rows: int | None = None,
) -> DataFrame:
    """(segment_id, vertices, faces) of every label: down-sampled, meshed on the whole-number lattice, and, if a
    reduction is given, simplified and smoothed in world units.  Labels that reach into ``max_blocks`` blocks or more are left
    out (``rejected_segments`` lists them).  What a ``region`` (begin and end, in voxels) cuts stays open.  Voxel sizes and
    offsets are in order x, y, z.  ``rows``: about how many voxels there are, for the number of tasks; else they are written once
    and counted."""
    if factor > 1:
        voxels = volume.downsample(voxels, factor, method, tasks=rows and spread.tasks(voxels.sparkSession, rows))
    if max_blocks is not None:
        small, _ = mesh.cut_off(block_counts(voxels, block), "block", max_blocks)
        voxels = voxels.join(small.select(F.col("segment_id").alias("label")), "label", "left_semi")
    begin = end = None
    if region is not None:
        begin, end = tuple(b // factor for b in region[0]), tuple(-(-e // factor) for e in region[1])
    if rows is None:
        voxels = kept(voxels)
        rows = voxels.count()
    sizes, offsets = (v if isinstance(v, tuple) else (v,) * 3 for v in (voxel, offset))
    soup = surface.triangles(voxels, begin, end, rows)
    nested = kernels.meshes_of_soup(soup, tuple(map(float, sizes)), tuple(map(float, offsets)), factor, spread.tasks(voxels.sparkSession, rows))
    if reduction is None:
        return nested
    return kernels.per_mesh(nested, partial(kernels.simplified_and_smoothed, reduction=reduction, iterations=smoothing))


def _reduced(v: np.ndarray, f: np.ndarray, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    target = max(int(len(f) // share), least)
    return kernels.simplified(v, f, target) if target < len(f) else (v, f)


def levels_by_decimation(meshes: DataFrame, lods: int, factor: int = 4, least: int = lod.LEAST_FACES) -> DataFrame:
    """(segment_id, lod, vertices, faces): each level reduced from the mesh itself."""
    out = [meshes.withColumn("lod", F.lit(0))]
    for level in range(1, lods):
        out.append(kernels.per_mesh(meshes, partial(_reduced, share=float(factor**level), least=least)).withColumn("lod", F.lit(level)))
    return reduce(DataFrame.unionByName, out)


def levels_by_downsampling(voxels: DataFrame, lods: int, base: int = 1, **how) -> DataFrame:
    """The same from the volume: level k is meshed at 2**k times the base factor."""
    out = [meshes_of_volume(voxels, base * 2**level, **how).withColumn("lod", F.lit(level)) for level in range(lods)]
    return reduce(DataFrame.unionByName, out)


def multires_levels(strategy: str, lods: int, *, meshes: DataFrame | None = None, voxels: DataFrame | None = None, **how) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown multires_strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return levels_by_decimation(meshes, lods, **how) if strategy == "decimate" else levels_by_downsampling(voxels, lods, **how)


def _soup(levels: DataFrame) -> DataFrame:
    """Triangles with corner positions; each mesh is one row, so its corners are looked up in place."""
    corner = lambda i: F.get("vertices", F.get("face", F.lit(i)).cast("int"))
    tri = levels.select("segment_id", "lod", "vertices", F.explode("faces").alias("face"))
    point = lambda p: F.struct(*(F.get(p, F.lit(i)).alias(a) for i, a in enumerate("xyz")))
    return tri.select("segment_id", "lod", *(point(corner(i)).alias(n) for i, n in enumerate("abc")))


def level_plan(levels: DataFrame, target_faces: int = lod.TARGET_FACES, box: int | None = None) -> DataFrame:
    """(segment_id, n_lods, box_*, origin_*): levels that are kept and their grid."""
    sizes = levels.select("segment_id", "lod", F.size("faces").cast("long").alias("n_faces"), "vertices")
    kept = lod.truncated(sizes.select("segment_id", "lod", "n_faces"))
    points = levels.select("segment_id", "lod", F.explode("vertices").alias("p")).join(kept.select("segment_id", "lod"), ["segment_id", "lod"], "left_semi")
    at = {a: F.get("p", F.lit(i)) for i, a in enumerate("xyz")}
    bounds = points.groupBy("segment_id").agg(*(f(c).alias(f"{n}_{a}") for a, c in at.items() for n, f in (("min", F.min), ("max", F.max))))
    counts = kept.groupBy("segment_id").agg(F.max(F.when(F.col("lod") == 0, F.col("n_faces"))).alias("n_faces"), F.count(F.lit(1)).cast("int").alias("n_lods"))
    plan = bounds.join(counts, "segment_id")
    if box is None:
        plan = lod.auto_box(plan, target_faces)
        chunks = plan.select("segment_id", "n_lods", *(F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.col(f"box_{a}")).alias(f"chunks_{a}") for a in "xyz"))
        chunks = chunks.withColumns({f"chunks_{a}": F.greatest(F.lit(1), F.col(f"chunks_{a}")) for a in "xyz"})
        plan = plan.join(lod.kept_levels(chunks), "segment_id").withColumn("n_lods", F.least("n_lods", "kept_lods"))
    else:
        plan = plan.withColumns({f"box_{a}": F.lit(box).cast("long") for a in "xyz"})
    coarsest = F.pow(F.lit(2), F.col("n_lods") - 1)
    for a in "xyz":
        edge = F.col(f"box_{a}") * coarsest
        grid = F.greatest(F.lit(1), F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / edge)) * edge
        plan = plan.withColumn(f"origin_{a}", lod.grid_origin(F.col(f"min_{a}"), F.col(f"max_{a}"), grid))
        first, last = lod.union_chunks(F.col(f"min_{a}"), F.col(f"max_{a}"), F.col(f"origin_{a}"), F.col(f"box_{a}"))
        plan = plan.withColumn(f"lo_{a}", first).withColumn(f"hi_{a}", last)
    return plan


def fragments(levels: DataFrame, plan: DataFrame, bits: int = 16) -> DataFrame:
    """(segment_id, lod, fx, fy, fz, n_faces, n_bytes, payload): quantized pieces of every kept level.

    From level 1 on a cell is cut at its middle too, and what lies next to the cut is moved onto it, so that
    neighbouring levels meet.
    """
    soup = _soup(levels).join(plan, "segment_id").filter("lod < n_lods")
    half = F.when(F.col("lod") > 0, 2).otherwise(1)
    unit = {}
    for n in "abc":
        unit[n] = F.struct(
            *(((F.col(f"{n}.{a}") - F.col(f"origin_{a}")) / (F.col(f"box_{a}") * F.pow(F.lit(2), F.col("lod"))) * half).alias(a) for a in "xyz")
        )
    pieces = lod.decomposed(soup.select("segment_id", "lod", *(c.alias(n) for n, c in unit.items())), 1.0)
    cell = {a: F.floor(F.col(f"f{a}") / half).cast("long") for a in "xyz"}
    key = ["segment_id", "lod", "fx", "fy", "fz"]
    corner = [F.col(f"{n}.{a}").alias(f"{n}{a}") for n in "abc" for a in "xyz"]
    side = [(F.col(f"f{a}") - cell[a] * half).cast("double").alias(f"s{a}") for a in "xyz"]
    rows = pieces.select("segment_id", "lod", *(c.alias(f"f{a}") for a, c in cell.items()), *corner, *side)
    names = rows.columns[5:]
    together = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *key).sortWithinPartitions(*key, *names)
    kind = [("segment_id", pa.int64()), ("lod", pa.int32()), *((n, pa.int64()) for n in ("fx", "fy", "fz", "n_faces", "n_bytes")), ("payload", pa.binary())]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, found in objects.runs(batches, 5):
            at = [found[n][0].as_py() for n in key]
            held = objects.numbers(found, *names).reshape(-1, 4, 3)
            split = 2 if at[1] else 1
            steps = _steps(held[:, :3] / split - np.array(at[2:]), bits)
            if at[1]:
                steps = _snapped(steps, held[:, 3:].astype(int), bits)
            same = [(steps[:, i] == steps[:, i - 1]).all(1) for i in range(3)]
            steps = steps[~(same[0] | same[1] | same[2])]
            if len(steps):
                points, inverse = np.unique(steps.reshape(-1, 3), axis=0, return_inverse=True)
                raw = formats.packed_fragment(points, inverse.reshape(-1, 3))
                yield *at, len(steps), len(raw), raw

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(packed(batches), pa.schema(kind))

    return together.mapInArrow(pack, "segment_id long, lod int, fx long, fy long, fz long, n_faces long, n_bytes long, payload binary")


def _steps(inside: np.ndarray, bits: int) -> np.ndarray:
    """geometry.quantized for parts of a cell, as an array."""
    most = 2**bits - 1
    inside = np.clip(inside, 0.0, 1.0)
    inside = np.where(inside <= 0.5 / most, 0.0, np.where(1 - inside <= 0.5 / most, 1.0, inside))
    return np.rint(inside * most).astype(np.int64)


def _snapped(q: np.ndarray, side: np.ndarray, bits: int) -> np.ndarray:
    """geometry.snapped_to_half, as an array."""
    plane = 2 ** (bits - 1)
    low = np.minimum(np.where(q >= plane - 1, plane, q), plane)
    high = np.maximum(np.where(q <= plane + 1, plane, q), plane)
    return np.where(side == 0, low, high)


def multires_files(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """(segment_id, data, fragment_index): the two files of each segment."""
    filled = lod.with_placeholders(pieces.select("segment_id", "lod", "fx", "fy", "fz", "n_bytes"), plan.select("segment_id", "n_lods", *(f"{e}_{a}" for a in "xyz" for e in ("lo", "hi"))))
    placed = lod.in_curve_order(filled, ["segment_id", "lod"]).join(
        pieces.select("segment_id", "lod", "fx", "fy", "fz", "payload"), ["segment_id", "lod", "fx", "fy", "fz"], "left"
    )
    grid = plan.select("segment_id", F.array(*(f"box_{a}" for a in "xyz")).alias("box"), F.array(*(f"origin_{a}" for a in "xyz")).alias("origin"))
    rows = placed.select("segment_id", "lod", "place", "fx", "fy", "fz", "n_bytes", "payload").join(grid, "segment_id")
    schema = pa.schema([("segment_id", pa.int64()), ("data", pa.binary()), ("fragment_index", pa.binary())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for segment, held in objects.runs(batches):
            data = b"".join(x.as_py() or b"" for x in held["payload"])
            level, at, sizes = objects.numbers(held, "lod")[:, 0], objects.numbers(held, "fx", "fy", "fz"), objects.numbers(held, "n_bytes")[:, 0]
            levels = [(at[level == i], sizes[level == i]) for i in range(int(level[-1]) + 1)]
            yield segment, data, formats.packed_index(held["box"][0].as_py(), held["origin"][0].as_py(), levels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(packed(batches), schema)

    return kernels.together(rows, "segment_id", ["lod", "place"]).mapInArrow(pack, "segment_id long, data binary, fragment_index binary")


def multires_of_levels(levels: DataFrame, target_faces: int = lod.TARGET_FACES, box: int | None = None, bits: int = 16) -> DataFrame:
    """The files of all segments; levels, plan and fragments are each worked out once."""
    levels = kept(levels)
    plan = kept(level_plan(levels, target_faces, box))
    return multires_files(kept(fragments(levels, plan, bits)), plan)


def skeleton_metrics(skeletons: DataFrame, least_branch: float = 100.0) -> DataFrame:
    """(skel_id, lsp, radius_mean, radius_std, n_branches) of the pruned skeletons, the longest first."""

    def measure(nodes: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple]:
        nodes, edges = kernels.pruned(nodes, edges, least_branch)
        return [(kernels.longest_shortest_path(nodes, edges), float(nodes[:, 3].mean()), float(nodes[:, 3].std()), len(kernels.polylines(len(nodes), edges)))]

    got = kernels.per_skeleton(skeletons, measure, "lsp double, radius_mean double, radius_std double, n_branches long")
    return got.orderBy(F.desc("lsp"), "skel_id")


def skeletons_of_meshes(meshes: DataFrame, subdivisions: int = 0) -> DataFrame:
    """(skel_id, nodes, edges) by contraction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return kernels.skeleton_batches((i, n, np.array(e, np.int64).reshape(-1, 2)) for i, v, f in kernels.opened_meshes(batches) for n, e in [kernels.skeleton_of_mesh(v, f, subdivisions=subdivisions)])

    return meshes.select("segment_id", "vertices", "faces").mapInArrow(run, kernels.SKELETON)


def shape_metrics(meshes: DataFrame) -> DataFrame:
    """(segment_id, ob_0..2, ob_normalized_0..2, thickness_mean/median/std) of each mesh."""
    names = [*(f"ob_{i}" for i in range(3)), *(f"ob_normalized_{i}" for i in range(3)), "thickness_mean", "thickness_median", "thickness_std"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for segment, points, faces in kernels.opened_meshes(batches):
            box = kernels.oriented_extents(points)
            size = np.linalg.norm(box) or 1.0
            thick = kernels.thickness(points, faces)
            thick = thick[~np.isnan(thick)]
            yield segment, *box, *(box / size), *((thick.mean(), np.median(thick), thick.std()) if len(thick) else (None,) * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(measured(batches), pa.schema([("segment_id", pa.int64()), *((n, pa.float64()) for n in names)]))

    return meshes.select("segment_id", "vertices", "faces").mapInArrow(run, "segment_id long, " + ", ".join(f"{n} double" for n in names))


def mesh_metrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The whole table of a mesh: volume, area, principal inertia, oriented box, curvatures and thickness, by id."""
    soup = mesh.corners(vertices, faces)
    out = mesh.area_volume(soup).join(mesh.principal_values(mesh.inertia(soup)).drop("volume"), "segment_id", "left")
    out = out.join(mesh.curvature_summary(mesh.curvatures(vertices, faces)), "segment_id", "left")
    return out.join(shape_metrics(kernels.nested_meshes(vertices, faces)), "segment_id", "left").orderBy("segment_id")
