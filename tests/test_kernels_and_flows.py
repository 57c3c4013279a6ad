import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators import kernels as k
from voxmill.operators import properties, skeleton, surface
from voxmill.plans import pipelines
from voxmill.sources import formats
from voxmill.streaming import chunks


def ball_rows(size=24, r=9):
    c = size // 2
    return [(z, y, x, 1) for z in range(size) for y in range(size) for x in range(size) if (z - c) ** 2 + (y - c) ** 2 + (x - c) ** 2 <= r * r]


@pytest.fixture(scope="module")
def ball(spark):
    voxels = spark.createDataFrame(ball_rows(), "z long, y long, x long, label long")
    row = pipelines.meshes_of_volume(voxels).first()
    return np.array(row.vertices), np.array(row.faces)


def test_simplify_keeps_shape(ball):
    v, f = k.simplified(*ball, 300)
    assert len(f) <= 450 and k.is_valid(v, f)
    assert abs(k.signed_volume(v, f) / k.signed_volume(*ball) - 1) < 0.1


def test_simplify_and_smooth(ball):
    v, f = k.simplified_and_smoothed(*ball, reduction=0.8, iterations=5)
    assert k.is_valid(v, f) and abs(k.signed_volume(v, f) / k.signed_volume(*ball) - 1) < 0.3
    assert np.allclose(v.mean(0), ball[0].mean(0), atol=1.0)


def test_repair_closes_and_turns(ball):
    v, f = ball
    broken = np.vstack([f[3:], f[10:12], [[0, 0, 1]]])
    broken[5] = broken[5][::-1]
    assert k.is_valid(*k.repaired(v, broken)) and not k.is_valid(v, broken)


def test_largest_part(ball):
    v, f = ball
    both = np.vstack([v, [[90, 90, 90], [91, 90, 90], [90, 91, 90]]])
    assert len(k.largest_part(both, np.vstack([f, [[len(v), len(v) + 1, len(v) + 2]]]))[1]) == len(f)
    assert len(k.largest_part(v, f[:0])[1]) == 0


def test_boxes_and_thickness(ball):
    corner = np.array([(x, y, z) for x in (0, 10.0) for y in (0, 2.0) for z in (0, 1.0)])
    turn = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]])
    assert np.allclose(k.oriented_extents(corner @ turn.T), [1, 2, 10], atol=0.1)
    thick = k.thickness(*k.simplified(*ball, 200))
    assert 10 < np.nanmean(thick) < 19


def line(*points):
    return np.array([(*p, 1.0) for p in points], float)


def test_skeleton_steps():
    n, e = line((0, 0, 0), (10, 0, 0), (20, 0, 0)), [(0, 1), (1, 2)]
    assert k.longest_shortest_path(n, e) == 20
    t = line((0, 0, 0), (10, 0, 0), (20, 0, 0), (10, 1, 0)), [(0, 1), (1, 2), (1, 3)]
    assert len(k.pruned(*t, 5)[0]) == 3 and len(k.pruned(*t, 0.5)[0]) == 4
    path = line(*((float(i), 0, 0) for i in range(101)))
    kept, links = k.simplified_skeleton(path, [(i, i + 1) for i in range(100)], 1.0)
    assert sorted(kept[:, 0]) == [0, 100] and links == [(0, 1)]
    y = line((0, 0, 0), (100, 0, 0), (100 + 70.7106781, 70.7106781, 0), (100 + 70.7106781, -70.7106781, 0))
    assert abs(k.longest_shortest_path(y, [(0, 1), (1, 2), (1, 3)]) - 200) < 1e-6
    assert sorted(map(len, k.polylines(4, [(0, 1), (1, 2), (1, 3)]))) == [2, 2, 2]
    assert k.polylines(3, [(0, 1), (1, 2), (2, 0)]) == [[0, 1, 2, 0]]


def test_skeleton_rows(spark):
    nodes = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 0.0, r) for i, r in enumerate((2.0, 4.0, 6.0))] + [(1, 3, 0.0, 9.0, 0.0, None)], "skel_id long, node long, x double, y double, z double, radius double")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "skel_id long, src long, dst long")
    got = skeleton.metrics(nodes, edges).first()
    assert (got.length, got.radius_mean, got.n_ends) == (20.0, 4.0, 3) and abs(got.radius_std - math.sqrt(8 / 3)) < 1e-12
    lines = spark.createDataFrame([(1, 0, "v 0 0 0 1"), (1, 1, "v 1 0 0 2"), (1, 2, "e 0 1"), (1, 3, "p 0 1")], "skel_id long, line_no long, value string")
    n, e, p = skeleton.parsed_text(lines)
    assert n.count() == 2 and tuple(e.first())[1:] == (0, 1) and p.count() == 2


def test_skeleton_of_rod(spark):
    rows = [(z, y, x, 1) for z in range(30) for y in range(4) for x in range(4)]
    meshes = pipelines.meshes_of_volume(spark.createDataFrame(rows, "z long, y long, x long, label long"))
    got = pipelines.skeleton_metrics(pipelines.skeletons_of_meshes(meshes), 1.0).first()
    assert 20 < got.lsp < 36 and got.radius_mean > 0.5


def test_formats(ball):
    v, f = ball
    v2, f2 = formats.unpacked_mesh(formats.packed_mesh(v, f))
    assert np.allclose(v, v2) and (f == f2).all()
    with pytest.raises(ValueError):
        formats.unpacked_mesh(formats.packed_mesh(v, f)[:-5])
    for parsed in (formats.parsed_ply(formats.ply_text(v, f).encode()),):
        assert np.allclose(parsed[0], v) and (parsed[1] == f).all()
    assert len(formats.parsed_obj(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nv 1 1 0\nf 1/1 2 4 -2\n")[1]) == 2
    levels = [(np.array([[0, 1, 2], [3, 4, 5]]), np.array([7, 8])), (np.array([[0, 0, 1]]), np.array([9]))]
    box, origin, back = formats.unpacked_index(formats.packed_index([64, 64, 64], [1, 2, 3], levels))
    assert (box, origin) == ([64, 64, 64], [1, 2, 3]) and all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(levels, back, strict=True))
    n, e = formats.unpacked_skeleton(formats.packed_skeleton(line((0, 0, 0), (1, 2, 3)), [(0, 1)]))
    assert n.tolist() == [[0, 0, 0], [1, 2, 3]] and e == [(0, 1)]
    ids, at, props = formats.unpacked_annotations(formats.packed_annotations([5, 9], np.arange(6), np.array([[1.5], [2.5]])), 3, 1)
    assert ids == [5, 9] and at.tolist() == [[0, 1, 2], [3, 4, 5]] and props.ravel().tolist() == [1.5, 2.5]


def test_mesh_files(spark, tmp_path, ball):
    v, f = ball
    (tmp_path / "7").write_bytes(formats.packed_mesh(v, f))
    (tmp_path / "8.ply").write_text(formats.ply_text(v, f))
    (tmp_path / "7.index").write_bytes(b"")
    got = {r.segment_id: len(r.faces) for r in formats.read_meshes(spark, str(tmp_path)).collect()}
    assert got == {7: len(f), 8: len(f)}
    formats.write_payloads(formats.mesh_payloads(formats.read_meshes(spark, str(tmp_path))), f"{tmp_path}/out", "segment_id")
    assert (tmp_path / "out/8").read_bytes() == (tmp_path / "out/7").read_bytes()


def test_fragments_hold_the_surface(spark, ball):
    v, f = ball
    mesh = spark.createDataFrame([(1, v.tolist(), f.tolist())], k.MESH)
    levels = pipelines.levels_by_decimation(mesh, 2, 2, least=12)
    plan = pipelines.level_plan(levels, target_faces=400)
    p = plan.first()
    area = {}
    for r in pipelines.fragments(levels, plan).collect():
        q, tri = formats.unpacked_fragment(r.payload)
        assert r.n_bytes == len(r.payload) and q.max() <= 65535
        box = np.array([p.box_x, p.box_y, p.box_z]) * 2**r.lod
        world = np.array([p.origin_x, p.origin_y, p.origin_z]) + (np.array([r.fx, r.fy, r.fz]) + q / 65535.0) * box
        a, b, c = (world[tri[:, i]] for i in range(3))
        area[r.lod] = area.get(r.lod, 0) + np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2
    a, b, c = (v[f[:, i]] for i in range(3))
    assert abs(area[0] / (np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2) - 1) < 1e-3
    assert abs(area[1] / area[0] - 1) < 0.1
    files = pipelines.multires_of_levels(levels, target_faces=400).first()
    _, _, listed = formats.unpacked_index(files.fragment_index)
    assert sum(int(s.sum()) for _, s in listed) == len(files.data)


def test_strategies(spark):
    voxels = spark.createDataFrame(ball_rows(16, 6), "z long, y long, x long, label long")
    got = pipelines.multires_levels("downsample", 2, voxels=voxels)
    assert [r.n for r in got.select("lod", F.size("faces").alias("n")).orderBy("lod").collect()] == sorted([r.n for r in got.select(F.size("faces").alias("n")).collect()], reverse=True)
    with pytest.raises(ValueError, match="Unknown multires_strategy"):
        pipelines.multires_levels("other", 2)


def test_properties(spark):
    ids = spark.createDataFrame([(10,), (9,), (2,)], "segment_id long")
    table = spark.createDataFrame([("10", "a", "1", "x", "1.5"), ("9", "b", "300", "x", "2"), ("10", "c", "2", "y", "")], '`Object ID` string, `my name!` string, n string, t string, d string').withColumn("line", F.monotonically_increasing_id())
    values = properties.joined(ids, table, "Object ID", order="line")
    doc = properties.columnar(ids, values)["inline"]
    assert doc["ids"] == ["2", "9", "10"]
    by = {p["id"]: p for p in doc["properties"]}
    assert by["my_name"]["type"] == "label" and by["my_name"]["values"] == ["", "b", "c"]
    assert by["n"]["data_type"] == "uint16" and by["n"]["values"] == [0, 300, 2]
    assert by["d"]["data_type"] == "uint8" and by["t"]["type"] == "string"
    with pytest.raises(ValueError):
        properties.joined(ids, table, "nope")
    with pytest.raises(ValueError):
        properties.joined(ids, table, "Object ID", ["nope"])


def test_stream_keeps_downsampled(spark, tmp_path):
    schema = "z long, y long, x long, label long"
    for part in ([(0, 0, 0, 4), (0, 0, 1, 4)], [(0, 1, 0, 5), (1, 1, 0, 5), (1, 0, 0, 5)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = chunks.keep_downsampled(chunks.voxel_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/ck")
        q.awaitTermination()
    assert [r.label for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [5]


def test_case_triangles_deterministic():
    assert surface.case_triangles() == surface.case_triangles()
