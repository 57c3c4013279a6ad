"""Operators that SQL can't say, against plain versions and by what they must keep."""

import collections
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.__main__ import main
from voxmill.operators import graph, mesh, skeleton
from voxmill.operators import kernels as k
from voxmill.plans import catalogue, pipelines
from voxmill.sources import adapters, formats, volumes


@pytest.fixture(scope="module")
def sf():
    """Large enough that each height field has faces."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ball(spark):
    rows = [(z, y, x, 1) for z in range(22) for y in range(22) for x in range(22) if (z - 11) ** 2 + (y - 11) ** 2 + (x - 11) ** 2 <= 64]
    row = pipelines.meshes_of_volume(spark.createDataFrame(rows, "z long, y long, x long, label long")).first()
    return np.array(row.vertices), np.array(row.faces)


@pytest.fixture(scope="module")
def terrain(spark, sf):
    """Height fields by segment: vertices and faces."""
    rows = k.nested_meshes(*adapters.terrain(spark, sf)).collect()
    return {r.segment_id: (np.array(r.vertices, float).reshape(-1, 3), np.array(r.faces, int).reshape(-1, 3)) for r in rows}


def area(v, f):
    a, b, c = (v[f[:, i]] for i in range(3))
    return float(np.linalg.norm(np.cross(b - a, c - a), axis=1).sum() / 2)


def clipped(polygon, axis, at, sign):
    out = []
    for p, q in zip(polygon, [*polygon[1:], *polygon[:1]], strict=True):
        dp, dq = (p[axis] - at) * sign, (q[axis] - at) * sign
        if dp >= 0:
            out.append(p)
        if dp * dq < 0:
            out.append(p + (q - p) * dp / (dp - dq))
    return out


def polygon_area(polygon):
    return sum(np.linalg.norm(np.cross(b - polygon[0], c - polygon[0])) / 2 for b, c in itertools.pairwise(polygon[1:])) if len(polygon) > 2 else 0.0


def test_decompose_fragments_cell_by_cell(spark, sf, terrain):
    want = collections.Counter()
    for segment, (v, f) in terrain.items():
        for face in f:
            corners = list(v[face])
            low, high = np.floor(np.min(corners, axis=0) / 2.5).astype(int), np.floor(np.max(corners, axis=0) / 2.5).astype(int)
            for cell in itertools.product(*(range(a, b + 1) for a, b in zip(low, high, strict=True))):
                polygon = corners
                for axis, at in enumerate(cell):
                    polygon = clipped(clipped(polygon, axis, at * 2.5, 1), axis, (at + 1) * 2.5, -1)
                want[(segment, *map(int, cell))] += polygon_area(polygon)
    got = {(r.segment_id, r.fx, r.fy, r.fz): r.area for r in catalogue.QUERIES["decompose_fragments"](spark, sf).collect()}
    assert all(abs(want[x] - a) < 1e-3 for x, a in got.items()) and all(a < 1e-3 for x, a in want.items() if x not in got)
    assert len(got) > 50


def test_qem_decimate(spark, sf, terrain):
    got = {(r.segment_id, r.lod): r.n_faces for r in catalogue.QUERIES["qem_decimate"](spark, sf).collect()}
    for segment, (v, f) in terrain.items():
        assert got[segment, 0] == len(f) and got[segment, 1] <= got[segment, 0] and got[segment, 2] <= got[segment, 1]
    v, f = terrain[max(terrain, key=lambda s: len(terrain[s][1]))]
    out = k.simplified(v, f, 12)
    border = {tuple(v[x]) for loop in k.boundary_loops(f) for x in loop}
    assert border <= set(map(tuple, out[0]))  # no border vertex moves


@pytest.mark.parametrize("backend", ["queue", "sweep"])
def test_both_collapses_keep_a_closed_surface(ball, backend):
    v, f = k.BACKENDS[backend](*ball, 200)
    assert len(f) <= 320 and k.is_valid(v, f)
    assert abs(k.signed_volume(v, f) / k.signed_volume(*ball) - 1) < 0.12


@pytest.mark.parametrize("backend", ["queue", "sweep"])
def test_blocks_reduced_by_themselves_still_fit(ball, backend):
    v, f = ball
    high = v[f].mean(1)[:, 0] > 11
    halves = [k.compacted(v, f[high]), k.compacted(v, f[~high])]
    border = [{tuple(p[x]) for loop in k.boundary_loops(t) for x in loop} for p, t in halves]
    small = [k.simplified_block(*h, 0.95, backend=backend) for h in halves]
    assert all(len(t) < len(h[1]) for (_, t), h in zip(small, halves, strict=True))
    assert [{tuple(p[x]) for loop in k.boundary_loops(t) for x in loop} for p, t in small] == border
    whole = k.merged(np.vstack([small[0][0], small[1][0]]), np.vstack([small[0][1], small[1][1] + len(small[0][0])]))
    assert k.is_valid(*whole)
    assert k.reduction_target(1000, 0.99, 40) == 80 and k.reduction_target(1000, 0.75, 4) == 250 and k.reduction_target(20, 0.99) == 12


def test_repair_parts_vertices_where_fans_touch():
    tetra = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    faces = np.array([[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]])
    both = np.vstack([tetra, -tetra[1:]])
    other = np.array([[0, 4, 5], [0, 6, 4], [4, 6, 5], [0, 5, 6]])
    v, f = k.parted_fans(both, np.vstack([faces, other]))
    assert len(v) == 8 and v[7].tolist() == [0, 0, 0] and len(f) == 8
    assert k.is_valid(*(k.parted_fans(tetra, faces))) and len(k.parted_fans(tetra, faces)[0]) == 4


def test_repair_query(spark, sf, terrain):
    got = {r.segment_id: r for r in catalogue.QUERIES["repair"](spark, sf).collect()}
    for segment, (v, f) in terrain.items():
        holes = [len(x) for x in k.boundary_loops(f) if len(x) <= 30]
        assert got[segment].n_faces == len(f) + sum(n - 2 for n in holes)
    smooth = {r.segment_id: r for r in catalogue.QUERIES["simplify_smooth"](spark, sf).collect()}
    assert set(smooth) == set(terrain) and all(smooth[s].n_faces <= max(12, got[s].n_faces) for s in smooth)


def plain_rdp(points, tolerance):
    if len(points) < 3:
        return list(points)
    a, b = points[0], points[-1]

    def gap(p):
        d = b - a
        t = np.clip((p - a) @ d / (d @ d), 0, 1) if d @ d else 0.0
        return np.linalg.norm(p - a - t * d)

    gaps = [gap(p) for p in points[1:-1]]
    i = int(np.argmax(gaps)) + 1
    if gaps[i - 1] <= tolerance:
        return [a, b]
    return plain_rdp(points[: i + 1], tolerance)[:-1] + plain_rdp(points[i:], tolerance)


def test_skel_rdp(spark, sf):
    paths = collections.defaultdict(list)
    for r in adapters.tracks(spark, sf).orderBy("skel_id", "ts", "event_id").collect():
        paths[r.skel_id].append(np.array([r.x, r.y, r.z]))
    got = {r.skel_id: r.n_nodes for r in catalogue.QUERIES["skel_rdp"](spark, sf).collect()}
    assert got == {s: len(plain_rdp(np.array(p), 150.0)) if len(p) > 1 else 0 for s, p in paths.items()}


def plain_longest(nodes, edges):
    n = len(nodes)
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b in edges:
        d[a, b] = d[b, a] = min(d[a, b], np.linalg.norm(nodes[a, :3] - nodes[b, :3]))
    for m in range(n):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1])
    return d[np.isfinite(d)].max()


def test_longest_shortest_path_with_and_without_cycles():
    rng = random.Random(2)
    for trial in range(40):
        n = rng.randrange(2, 30)
        nodes = np.array([[rng.random() * 9 for _ in range(3)] + [1.0] for _ in range(n)])
        edges = [(rng.randrange(i), i) for i in range(1, n) if trial % 4 or i % 7]  # trees, and some in parts
        if trial % 2:
            edges += [(rng.randrange(n), rng.randrange(n)) for _ in range(3)]
        assert k.longest_shortest_path(nodes, edges) == pytest.approx(plain_longest(nodes, [e for e in edges if e[0] != e[1]]))


def test_prune_needs_a_branch_point_at_one_end_only():
    nodes = np.array([[0, 0, 0, 1], [10, 0, 0, 1], [20, 0, 0, 1], [10, 3, 0, 1], [12, 3, 0, 1.0]])
    # A loop at a branch point has it at both ends, so it stays; the arms go, the shortest first, while that is a branch point.
    edges = [(0, 1), (1, 2), (1, 3), (3, 4), (4, 1)]
    left, links = k.pruned(nodes, edges, 50.0)
    assert len(links) == 3 and sorted(left[:, 0].tolist()) == [10, 10, 12]


def test_first_hits_are_those_of_every_triangle(ball):
    v, f = ball
    rng = np.random.default_rng(1)
    o = rng.uniform(4, 18, (60, 3))
    d = rng.normal(size=(60, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    d[:3] = np.eye(3)  # along the axes, too
    a, b, c = (v[f[:, i]] for i in range(3))
    got = k.first_hits(o, d, a, b - a, c - a)
    for i in range(len(o)):
        h = np.cross(d[i], c - a)
        det = np.einsum("ij,ij->i", b - a, h)
        with np.errstate(divide="ignore", invalid="ignore"):
            u = np.einsum("ij,ij->i", o[i] - a, h) / det
            q = np.cross(o[i] - a, b - a)
            w, t = q @ d[i] / det, np.einsum("ij,ij->i", c - a, q) / det
        hit = (np.abs(det) > 1e-12) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > 1e-3)
        assert got[i] == pytest.approx(t[hit].min() if hit.any() else np.inf)


def test_thickness_of_a_slab(spark):
    rows = [(z, y, x, 1) for z in range(5) for y in range(30) for x in range(30)]
    row = pipelines.meshes_of_volume(spark.createDataFrame(rows, "z long, y long, x long, label long")).first()
    v, f = np.array(row.vertices), np.array(row.faces)
    middle = (np.abs(v[:, 0] - 14.5) < 6) & (np.abs(v[:, 1] - 14.5) < 6)
    thick = k.thickness(v, f)[middle]
    assert len(v) > 2000 and 5 <= thick.min() and thick.max() < 7.5  # straight through is 5, the cone's rays go further


def test_mesh_metric_table(spark, sf, terrain):
    rows = catalogue.QUERIES["mesh_metric_table"](spark, sf).collect()
    assert {r.segment_id for r in rows} == {s for s, (_, f) in terrain.items() if len(f)}
    for r in rows:
        v, f = terrain[r.segment_id]
        assert r.area == pytest.approx(area(v, f)) and r.volume == pytest.approx(k.signed_volume(v, f), rel=1e-6, abs=1e-9)
        box = sorted(np.ptp(v, axis=0))
        assert r.ob_0 <= r.ob_1 <= r.ob_2 and r.ob_0 * r.ob_1 * r.ob_2 <= np.prod(box) * (1 + 1e-6)
        for n in ("mean", "gaussian", "rms", "abs"):
            assert all(r[f"{n}_{s}"] is not None for s in ("mean", "median", "std"))


def test_curvature_of_a_ball(spark):
    rows = []
    n, m, radius = 40, 80, 5.0
    at = lambda i, j: i * m + j % m
    points = [(1, at(i, j), *(radius * np.array([math.sin(math.pi * (i + 1) / (n + 1)) * math.cos(2 * math.pi * j / m), math.sin(math.pi * (i + 1) / (n + 1)) * math.sin(2 * math.pi * j / m), math.cos(math.pi * (i + 1) / (n + 1))])).tolist()) for i in range(n) for j in range(m)]
    for i in range(n - 1):
        for j in range(m):
            rows += [(1, at(i, j), at(i + 1, j), at(i + 1, j + 1)), (1, at(i, j), at(i + 1, j + 1), at(i, j + 1))]
    v = spark.createDataFrame(points, "segment_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame(rows, "segment_id long, v0 long, v1 long, v2 long")
    got = mesh.curvatures(v, f).filter(F.col("vid").between(at(8, 0), at(n - 9, m - 1))).agg(*(F.avg(x).alias(x) for x in ("mean", "gaussian", "rms", "abs"))).first()
    assert got["mean"] == pytest.approx(1 / radius, rel=0.02) and got["gaussian"] == pytest.approx(1 / radius**2, rel=0.02)
    assert got["rms"] == pytest.approx(math.sqrt(2) / radius, rel=0.02) and got["abs"] == pytest.approx(2 / radius, rel=0.02)


def test_draco_stream_byte_by_byte():
    raw = formats.packed_fragment(np.array([[0, 1, 2], [3, 4, 5], [6, 7, 65535]]), np.array([[0, 1, 2]]))
    want = "445241434f 02 02 01 00 0000  01 03 01 000102  01 01 00 04 03 00 00 00  000001000200 030004000500 06000700ffff"
    assert raw == bytes.fromhex(want.replace(" ", ""))
    for n in (3, 300, 70_000):
        steps = np.arange(3 * n).reshape(-1, 3) % 65536
        faces = np.array([[0, 1, n - 1], [n - 1, 2, 1]])
        back = formats.unpacked_fragment(formats.packed_fragment(steps, faces))
        assert (back[0] == steps).all() and (back[1] == faces).all()
    for bad in (b"DRACO\x02\x02\x01\x01\0\0", b"other bytes"):
        with pytest.raises(ValueError):
            formats.unpacked_fragment(bad)


def test_levels_read_back(spark, ball):
    v, f = ball
    made = spark.createDataFrame([(1, v.tolist(), f.tolist())], k.MESH)
    files = pipelines.multires_of_levels(pipelines.levels_by_decimation(made, 2, 2, least=12), target_faces=400).first()
    levels = formats.unpacked_levels(files.fragment_index, files.data)
    assert len(levels) == 2
    assert area(*levels[0]) == pytest.approx(area(v, f), rel=1e-3) and area(*levels[1]) == pytest.approx(area(v, f), rel=0.1)
    single = formats.single_level_files(made).first()
    ((points, faces),) = formats.unpacked_levels(single.fragment_index, single.data)
    assert np.abs(points - v).max() <= np.ptp(v) / 65535 and (faces == f).all()
    empty = formats.single_level_files(spark.createDataFrame([(2, [], [])], k.MESH)).first()
    assert empty.data == b""


def test_multires_and_skeleton_queries(spark, sf, terrain):
    files = {r.segment_id: r for r in catalogue.QUERIES["multires_pipeline"](spark, sf).collect()}
    assert {s for s, (_, f) in terrain.items() if len(f)} <= set(files) <= set(terrain)
    assert all((r.n_data > 0 or not len(terrain[s][1])) and r.n_index >= 28 + 16 + 4 + 16 for s, r in files.items())
    lengths = {r.skel_id: r for r in catalogue.QUERIES["skeleton_pipeline"](spark, sf).collect()}
    for s, (v, f) in terrain.items():
        if s in lengths and len(f):
            assert 0 <= lengths[s].lsp <= sum(np.ptp(v, axis=0)) * 4


def test_segments_with_too_many_blocks_are_told(spark):
    rows = [(z, 0, 0, 1) for z in range(200)] + [(0, 5, 5, 2)]
    voxels = spark.createDataFrame(rows, "z long, y long, x long, label long")
    (told,) = pipelines.rejected_segments(voxels, 3).collect()
    assert (told.segment_id, told.n_blocks) == (1, 4) and "too many blocks" in told.message
    assert [r.segment_id for r in pipelines.meshes_of_volume(voxels, max_blocks=3).collect()] == [2]


def test_weld_and_components(spark):
    points = [(1, i, 0.1 * i if i < 5 else 10.0 * i, 0.0, 0.0) for i in range(8)]
    v = spark.createDataFrame(points, "segment_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 5, 6), (1, 1, 5, 6), (1, 2, 3, 7), (1, 6, 7, 4)], "segment_id long, v0 long, v1 long, v2 long")
    left, faces = mesh.welded(v, f, 0.15)
    assert sorted(r.vid for r in left.collect()) == [0, 5, 6, 7]
    assert sorted((r.v0, r.v1, r.v2) for r in faces.collect()) == [(0, 5, 6), (6, 7, 0)]
    assert graph.components(v, mesh.weld_pairs(v, 1e-3)).filter("vid <> component").count() == 0


def test_node_look_up_takes_the_first(spark):
    nodes = spark.createDataFrame([(1, 3, 0.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0), (1, 9, 1.0, 0.0, 0.0)], "skel_id long, node long, x double, y double, z double")
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0)], "skel_id long, x double, y double, z double")
    assert [(r.x, r.node) for r in skeleton.node_at(nodes, asked).collect()] == [(0.0, 2)]


def test_command_line_flags(spark, tmp_path):
    data = np.zeros((20, 20, 90), np.uint8)
    data[4:16, 4:16, 2:88] = 7
    data[0:3, 0:3, 0:3] = 9
    volumes.write_zarr(f"{tmp_path}/v.zarr/s0", data, (16, 16, 16), {"voxel_size": [8, 4, 2]})
    source = f"{tmp_path}/v.zarr/s0"
    main(["meshes", source, f"{tmp_path}/one", "--single-level", "--max-blocks", "2"], spark)
    assert "too many blocks" in (tmp_path / "one/too_big_skipped/7.txt").read_text()
    ((v, f),) = formats.unpacked_levels((tmp_path / "one/9.index").read_bytes(), (tmp_path / "one/9").read_bytes())
    assert np.allclose(np.ptp(v, axis=0), [6, 12, 24], atol=0.01) and len(f) > 12
    assert json.loads((tmp_path / "one/info").read_text())["@type"].endswith("draco")
    assert json.loads((tmp_path / "one/segment_properties/info").read_text())["inline"]["ids"] == ["9"]
    main(["meshes", source, f"{tmp_path}/cut", "--region", "0 0 0 160 80 60", "--reduction", "0.5"], spark)
    v, f = formats.unpacked_mesh((tmp_path / "cut/7").read_bytes())
    assert k.boundary_loops(f) and v[:, 0].max() <= 60  # the region's side at x = 60 is open
    main(["skeletonize-single", f"{tmp_path}/cut/7", f"{tmp_path}/text"], spark)
    assert (tmp_path / "text/7.txt").read_text().startswith("v ")


def test_subdivision_keeps_the_surface(ball):
    v, f = k.subdivided(*ball)
    assert len(f) == 4 * len(ball[1]) and k.is_valid(v, f)
    assert k.signed_volume(v, f) == pytest.approx(k.signed_volume(*ball), rel=0.05)
    flat = np.array([[0, 0, 0], [2, 0, 0], [2, 2, 0], [0, 2, 0.0]]), np.array([[0, 1, 2], [0, 2, 3]])
    v, f = k.subdivided(*flat)
    assert len(v) == 9 and len(f) == 8 and [1, 0, 0] in v.tolist() and len(k.boundary_loops(f)[0]) == 8
    nodes, edges = k.skeleton_of_mesh(*ball, subdivisions=1)
    assert len(nodes) and all(0 <= x < len(nodes) for e in edges for x in e)
