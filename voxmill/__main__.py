"""python -m voxmill COMMAND ...: the whole flows from files to files.

    meshes VOLUME OUT [--factor N] [--method M] [--reduction R] [--smoothing N] [--region "z y x z y x"]
           [--max-blocks N] [--single-level]
    levels MESHES OUT [--lods N] [--decimation F] [--box B] [--properties CSV --id-column NAME]
    skeletons MESHES OUT [--least-branch L] [--tolerance T]
    skeletonize-single MESH OUT
    analyze MESHES OUT

Folders must be ones that all machines share.  Spark settings come from the environment, as for spark-submit.
"""

from __future__ import annotations

import argparse
import json
import os

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _write(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def meshes(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import volume
    from .operators.scratch import kept
    from .plans import pipelines
    from .sources import formats, listing, volumes

    size, offset = volumes.voxel_size_and_offset(spark, a.source)
    begin = end = None
    if a.region:
        low, high = listing.parsed_region(a.region)
        begin, end = (tuple(int(round((v - o) / s)) for v, o, s in zip(at, offset, size, strict=True)) for at in (low, high))
    voxels = volumes.read_voxels(spark, a.source, begin, end)
    # The lattice is in voxels; sizes and offsets are z, y, x and meshes x, y, z.
    got = kept(
        pipelines.meshes_of_volume(
            voxels, a.factor, a.method, tuple(size[::-1]), tuple(offset[::-1]), reduction=a.reduction, smoothing=a.smoothing,
            max_blocks=a.max_blocks, region=(begin, end) if a.region else None,
        )
    )
    if a.max_blocks is not None:
        left = pipelines.rejected_segments(volume.downsample(voxels, a.factor, a.method) if a.factor > 1 else voxels, a.max_blocks)
        files = left.select(F.concat("segment_id", F.lit(".txt")).alias("name"), F.col("message").cast("binary").alias("payload"))
        formats.write_payloads(files, f"{a.out}/too_big_skipped", "name")
    if a.single_level:
        files = kept(formats.single_level_files(got))
        formats.write_payloads(files.select("segment_id", F.col("data").alias("payload")), a.out, "segment_id")
        formats.write_payloads(files.select(F.concat("segment_id", F.lit(".index")).alias("name"), F.col("fragment_index").alias("payload")), a.out, "name")
        ids = [str(r["segment_id"]) for r in files.select("segment_id").orderBy("segment_id").toLocalIterator()]
        label = {"id": "label", "type": "label", "values": [""] * len(ids)}
        _write(f"{a.out}/segment_properties/info", json.dumps({"@type": "neuroglancer_segment_properties", "inline": {"ids": ids, "properties": [label]}}))
        _write(f"{a.out}/info", formats.multilod_info(properties=True))
        return
    formats.write_payloads(formats.mesh_payloads(got), a.out, "segment_id")
    manifest = got.select(F.concat("segment_id", F.lit(":0")).alias("name"), F.to_json(F.struct(F.array(F.col("segment_id").cast("string")).alias("fragments"))).cast("binary").alias("payload"))
    formats.write_payloads(manifest, a.out, "name")
    _write(f"{a.out}/info", formats.legacy_info())


def levels(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import properties
    from .plans import pipelines
    from .sources import formats

    source = formats.read_meshes(spark, a.source)
    files = pipelines.multires_of_levels(pipelines.levels_by_decimation(source, a.lods, a.decimation), box=a.box)
    formats.write_payloads(files.select("segment_id", F.col("data").alias("payload")), a.out, "segment_id")
    formats.write_payloads(files.select(F.concat("segment_id", F.lit(".index")).alias("name"), F.col("fragment_index").alias("payload")), a.out, "name")
    if a.properties:
        table = spark.read.csv(a.properties, header=True, inferSchema=False).withColumn("_line", F.monotonically_increasing_id())
        ids = files.select("segment_id")
        _write(f"{a.out}/segment_properties/info", json.dumps(properties.columnar(ids, properties.joined(ids, table, a.id_column, order="_line"))))
    _write(f"{a.out}/info", formats.multilod_info(properties=bool(a.properties)))


def skeletons(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import kernels
    from .operators.scratch import kept
    from .plans import pipelines
    from .sources import formats

    found = kept(pipelines.skeletons_of_meshes(formats.read_meshes(spark, a.source)))
    pipelines.skeleton_metrics(found, a.least_branch).write.mode("overwrite").csv(f"{a.out}/metrics", header=True)

    def packed(nodes: np.ndarray, edges: list) -> list[tuple]:
        nodes, edges = kernels.pruned(nodes, edges, a.least_branch)
        return [(formats.packed_skeleton(*kernels.simplified_skeleton(nodes, edges, a.tolerance)),)]

    formats.write_payloads(kernels.per_skeleton(found, packed, "payload binary"), f"{a.out}/skeletons", "skel_id")
    _write(f"{a.out}/skeletons/info", formats.skeleton_info())


def skeletonize_single(spark: SparkSession, a: argparse.Namespace) -> None:
    """One mesh file, or all of a folder, to text: v x y z radius, then e i j."""
    from .plans import pipelines
    from .sources import formats

    def text(nodes: np.ndarray, edges: list) -> list[tuple]:
        lines = ["v %.9g %.9g %.9g %.9g" % tuple(n) for n in nodes] + [f"e {i} {j}" for i, j in edges]
        return [("\n".join(lines).encode() + b"\n",)]

    from .operators import kernels

    found = pipelines.skeletons_of_meshes(formats.read_meshes(spark, a.source))
    files = kernels.per_skeleton(found, text, "payload binary")
    formats.write_payloads(files.withColumn("name", F.concat("skel_id", F.lit(".txt"))), a.out, "name")


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    from .operators import kernels
    from .operators.scratch import kept
    from .plans import pipelines
    from .sources import formats

    vertices, faces = kernels.flat(kept(formats.read_meshes(spark, a.source)))
    pipelines.mesh_metrics(vertices, faces).write.mode("overwrite").csv(f"{a.out}/metrics", header=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="voxmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for f in (meshes, levels, skeletons, skeletonize_single, analyze):
        p = commands.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        p.add_argument("source")
        p.add_argument("out")
        if f is meshes:
            p.add_argument("--factor", type=int, default=1)
            p.add_argument("--method", default="mode_suppress_zero")
            p.add_argument("--reduction", type=float)
            p.add_argument("--smoothing", type=int, default=0)
            p.add_argument("--region")
            p.add_argument("--max-blocks", type=int)
            p.add_argument("--single-level", action="store_true")
        elif f is levels:
            p.add_argument("--lods", type=int, default=3)
            p.add_argument("--decimation", type=int, default=4)
            p.add_argument("--box", type=int)
            p.add_argument("--properties")
            p.add_argument("--id-column", default="Object ID")
        elif f is skeletons:
            p.add_argument("--least-branch", type=float, default=100.0)
            p.add_argument("--tolerance", type=float, default=50.0)
    a = parser.parse_args(args)
    a.run(spark or SparkSession.builder.appName("voxmill").getOrCreate(), a)


if __name__ == "__main__":
    main()
