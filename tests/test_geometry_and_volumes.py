import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.functions import geometry as g
from voxmill.operators import graph, lod, mesh, surface, volume
from voxmill.sources import volumes


def solid(spark, size, inside):
    rows = [(z, y, x, int(inside(z, y, x))) for z in range(size) for y in range(size) for x in range(size)]
    return spark.createDataFrame([r for r in rows if r[3]], "z long, y long, x long, label long")


def test_modes(spark):
    cells = [[1, 1, 2, 1, 2, 2, 1, 1], [0, 0, 5, 5, 0, 5, 0, 0], [7, 7, 3, 3, 7, 7, 3, 3], [0] * 8]
    rows = [(i >> 2, i >> 1 & 1, 2 * k + (i & 1), v) for k, cell in enumerate(cells) for i, v in enumerate(cell) if v]
    voxels = spark.createDataFrame(rows, "z long, y long, x long, label long")
    got = lambda m: {r.x: r.label for r in volume.downsample(voxels, 2, m).collect()}
    assert got("mode_suppress_zero") == {0: 1, 1: 5, 2: 3}
    assert got("mode") == {0: 1, 2: 3}
    assert got("binary") == {0: 1, 2: 1}
    assert got("binary_suppress_zero") == {0: 1, 1: 1, 2: 1}
    with pytest.raises(ValueError, match="Unknown downsample_method"):
        volume.downsample(voxels, 2, "other")


def test_clipped_cells_count_less(spark):
    voxels = spark.createDataFrame([(0, 0, 2, 9)], "z long, y long, x long, label long")
    assert volume.downsample(voxels, (1, 1, 2), "mode", ((0, 1), (0, 1), (0, 3))).collect()[0].label == 9
    assert volume.downsample(voxels, (1, 1, 2), "mode").count() == 0


def test_blocks(spark):
    rows = volume.blocks(spark, (0, 0, 0), (5, 4, 4), (4, 4, 4), 1).orderBy("block").collect()
    assert [(r.begin_z, r.end_z) for r in rows] == [(-1, 5), (3, 9)] and rows[0].begin_y == -1
    assert volume.blocks(spark, (0, 0, 0), (0, 4, 4), (4, 4, 4)).count() == 0


def test_case_table_is_closed():
    table = surface.case_triangles()
    assert len({c for c, *_ in table}) == 254 and max(t for _, t, _ in table) <= 4


@pytest.mark.parametrize("name", ["cube", "ball"])
def test_surfaces_enclose_their_volume(spark, name):
    n = 20
    if name == "cube":
        voxels, want, tolerance = solid(spark, n, lambda z, y, x: min(z, y, x) >= 2 and max(z, y, x) < 17), 15**3, 0.05
    else:
        voxels, want, tolerance = solid(spark, n, lambda z, y, x: (z - 9) ** 2 + (y - 9) ** 2 + (x - 9) ** 2 <= 64), 4 / 3 * math.pi * 8.0**3, 0.15
    soup = surface.triangles(voxels)
    points = surface.vertices(soup)
    world, faces = surface.to_world(points), surface.indexed_faces(soup, points)
    got = mesh.validity(world, faces).first()
    assert got.valid and got.euler == 2 and abs(got.volume - want) < tolerance * want
    box = mesh.bounds_centroid(world).first()
    low, high = (1.5, 16.5) if name == "cube" else (0.5, 17.5)
    assert (box.min_x, box.max_z) == (low, high)


def test_noise_is_balanced(spark):
    rng = np.random.default_rng(3)
    noise = rng.random((7, 7, 7)) < 0.5
    soup = surface.triangles(solid(spark, 7, lambda z, y, x: noise[z, y, x]))
    points = surface.vertices(soup)
    assert mesh.topology(points.withColumnRenamed("label", "segment_id"), surface.indexed_faces(soup, points)).first().balanced


def tetrahedron(spark):
    v = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])], "segment_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 2, 1), (1, 0, 1, 3), (1, 1, 2, 3), (1, 0, 3, 2)], "segment_id long, v0 long, v1 long, v2 long")
    return v, f


def test_mesh_metrics(spark):
    v, f = tetrahedron(spark)
    got = mesh.validity(v, f).first()
    assert got.valid and got.euler == 2 and abs(got.volume - 1 / 6) < 1e-12
    assert abs(mesh.area_volume(mesh.corners(v, f)).first().area - (1.5 + math.sqrt(3) / 2)) < 1e-12
    pic = mesh.principal_values(mesh.inertia(mesh.corners(v, f))).first()
    assert abs(pic.pic_0 + pic.pic_1 + pic.pic_2 - 2 * 3 / 6 * (1 / 10 - 1 / 16)) < 1e-9
    total = mesh.curvatures(v, f).join(v, ["segment_id", "vid"]).count()
    assert total == 4
    half = mesh.clip_half_space(mesh.corners(v, f), "z", 0.5, True)
    assert abs(mesh.area_volume(half).first().area - (1.5 + math.sqrt(3) / 2 - 0.5) / 4) < 1e-9
    assert mesh.validity(v, f.filter("v0 <> 1")).first().valid is False


def test_clip_sides_add_up(spark):
    v, f = tetrahedron(spark)
    soup = mesh.corners(v, f)
    parts = [mesh.area_volume(mesh.clip_half_space(soup, "x", 0.3, up)).first().area for up in (True, False)]
    assert abs(sum(parts) - mesh.area_volume(soup).first().area) < 1e-9


def test_quantize_and_snap(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (-3.0,), (9.0,)], "v double")
    got = [r[0] for r in rows.select(g.quantized(F.col("v"), F.lit(0.0), F.lit(1.0), 16)).collect()]
    assert got == [0, 65535, 32768, 0, 65535]
    near = spark.createDataFrame([(31, 0), (30, 0), (33, 1), (34, 1), (40, 0), (1, 1)], "q int, s int")
    assert [r[0] for r in near.select(g.snapped_to_half(F.col("q"), F.col("s"), 6)).collect()] == [32, 30, 32, 34, 32, 32]
    with pytest.raises(ValueError):
        g.quantized(F.col("v"), F.lit(0), F.lit(1), 17)


def test_morton_order(spark):
    rng = np.random.default_rng(0)
    points = [tuple(map(int, p)) for p in rng.integers(0, 50, (40, 3))]

    def less(p, q):
        best = None
        for a in (2, 1, 0):
            x = p[a] ^ q[a]
            if best is None or best[0] < x and best[0] < best[0] ^ x:
                best = x, a
        return p[best[1]] < q[best[1]]

    df = spark.createDataFrame([(1, *p) for p in points], "s long, fx long, fy long, fz long")
    got = [(r.fx, r.fy, r.fz) for r in lod.in_curve_order(df, ["s"]).orderBy("place").collect()]
    assert all(not less(q, p) for p, q in zip(got, got[1:], strict=False))


def test_levels(spark):
    rows = [(1, 0, 100), (1, 1, 50), (1, 2, 50), (1, 3, 10), (2, 0, 9), (2, 2, 3)]
    got = lod.truncated(spark.createDataFrame(rows, "segment_id long, lod int, n_faces long")).collect()
    assert sorted((r.segment_id, r.lod) for r in got) == [(1, 0), (1, 1), (2, 0)]
    with pytest.raises(ValueError):
        g.staged_reductions(F.lit(0.5), 0.5, 0.6)


def test_components(spark):
    v = spark.createDataFrame([(1, i) for i in range(30)], "segment_id long, vid long")
    links = spark.createDataFrame([(1, i, i + 1) for i in range(29) if i != 14], "segment_id long, a long, b long")
    got = {r.vid: r.component for r in graph.components(v, links).collect()}
    assert got == {i: 0 if i <= 14 else 15 for i in range(30)}


def test_weld_needs_no_pairs_of_all(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.0999, 0.0, 0.0), (1, 2, -0.05, -0.05, -0.05), (1, 3, 5.0, 5.0, 5.0)], "segment_id long, vid long, x double, y double, z double")
    assert sorted((r.a, r.b) for r in mesh.weld_pairs(v, 0.1).collect()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("codec", [None, "zlib"])
def test_zarr_round_trip(spark, tmp_path, version, codec):
    data = np.zeros((10, 9, 8), np.uint16)
    data[2:7, 3:9, 1:4] = 5
    data[9, 8, 7] = 65535
    volumes.write_zarr(f"{tmp_path}/v.zarr/s0", data, (4, 4, 4), {"voxel_size": [4, 4, 4], "offset": [1, 2, 3]}, version, codec)
    got = {(r.z, r.y, r.x): r.label for r in volumes.read_voxels(spark, f"file://{tmp_path}/v.zarr/s0").collect()}
    assert got == {tuple(map(int, p)): int(data[tuple(p)]) for p in np.argwhere(data)}
    box = volumes.read_voxels(spark, f"file://{tmp_path}/v.zarr/s0", (0, 0, 0), (3, 9, 8)).collect()
    assert len(box) == 1 * 6 * 3
    assert volumes.voxel_size_and_offset(spark, f"file://{tmp_path}/v.zarr/s0") == ([4.0, 4.0, 4.0], [1.0, 2.0, 3.0])


def test_metadata():
    assert volumes.split_container("a/b.zarr/c.n5/s0/x") == ("a/b.zarr/c.n5", "s0/x")
    assert volumes.split_container("a/b") == ("a/b", "")
    steps = [{"type": "translation", "translation": [1, 2, 3]}, {"type": "scale", "scale": [2, 2, 2]}]
    attrs = {"ome": {"multiscales": [{"axes": [{"name": "x", "unit": "nanometer"}, {"name": "y"}, {"name": "z"}], "datasets": [{"path": "s0", "coordinateTransformations": steps}], "coordinateTransformations": [{"type": "scale", "scale": [1, 1, 10]}]}]}}
    assert volumes.multiscale_transform(attrs, "s0")[:2] == ([20.0, 2.0, 2.0], [60.0, 4.0, 2.0])
