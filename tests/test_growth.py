"""What one task, one worker or the disk holds does not grow with the tables; the ways that keep it so agree with the plain ones."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmill.operators import kernels as k
from voxmill.operators import mesh, objects, spread, surface, volume
from voxmill.plans import pipelines
from voxmill.sources import adapters, formats

VOXELS = "z long, y long, x long, label long"


def noise(spark, size=20, labels=3):
    """Random voxels over several blocks, on both sides of zero."""
    held = np.random.default_rng(5).integers(0, labels + 1, (size,) * 3)
    at = range(-3, size - 3)
    rows = [(z, y, x, int(held[z, y, x])) for z in at for y in at for x in at]
    return spark.createDataFrame(rows, VOXELS).filter("label <> 0")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_solids_and_cells_get_tasks_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(adapters, "BALL", 100_000)
    parts = adapters.table(spark, sf, "part").count()
    assert adapters.solids(spark, sf).rdd.getNumPartitions() == parts * 100_000 // spread.ROWS
    voxels = noise(spark)
    assert surface.cell_cases(voxels, 5 * spread.ROWS).rdd.getNumPartitions() == 5
    assert surface.triangles(voxels, rows=5 * spread.ROWS).rdd.getNumPartitions() == 5


def test_cells_are_summed_where_their_voxels_went(spark):
    """One exchange, before voxels are multiplied by eight."""
    assert plan(surface.cell_cases(noise(spark), 10)).count("Exchange") == 1


def test_cells_over_blocks_are_whole(spark):
    voxels = noise(spark)
    corners = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(1 << i).alias("bit")) for i, (z, y, x) in enumerate(surface.CORNERS)))
    sent = voxels.select("z", "y", "x", "label", F.explode(corners).alias("c"))
    plain = sent.groupBy(*((F.col(a) - F.col(f"c.{a}")).alias(a) for a in "zyx"), "label").agg(F.sum("c.bit").cast("int").alias("code")).filter("code < 255")
    assert rows_of(surface.cell_cases(voxels)) == rows_of(plain)


def test_vertices_of_cells_are_those_of_triangles(spark):
    voxels = noise(spark)
    assert rows_of(surface.cell_vertices(voxels)) == rows_of(surface.vertices(surface.triangles(voxels)))


def test_validity_of_voxels_is_that_of_their_meshes(spark):
    ball = spark.createDataFrame([(z, y, x, 9) for z in range(40, 49) for y in range(9) for x in range(9) if (z - 44) ** 2 + (y - 4) ** 2 + (x - 4) ** 2 < 17], VOXELS)
    voxels = noise(spark).union(ball)
    soup = surface.triangles(voxels)
    points = surface.vertices(soup)
    names = ["segment_id", "n_faces", "n_edges", "n_boundary", "balanced", "valid", "volume"]
    want = rows_of(mesh.validity(surface.to_world(points), surface.indexed_faces(soup, points)).select(*names))
    got = rows_of(surface.validity(voxels).select(*names))
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and len(got) == 4
    assert np.allclose([r[-1] for r in got], [r[-1] for r in want])
    assert plan(surface.validity(voxels, 10)).count("Exchange hash") == 2  # of voxels, and of the sums of labels


def test_objects_are_taken_off_a_stream():
    """Whole, whatever the batches; null is an object; batches that go back are small."""
    rows = [(key, i) for key, n in ((1, 3), (2, 1), (None, 4), (7, 6)) for i in range(n)]
    kind = pa.schema([("k", pa.int64()), ("i", pa.int64())])
    for size in (1, 2, 5, 50):
        batches = [pa.RecordBatch.from_pydict({"k": [r[0] for r in rows[i : i + size]], "i": [r[1] for r in rows[i : i + size]]}, schema=kind) for i in range(0, len(rows), size)]
        got = [(key, held["i"].to_pylist()) for key, held in objects.runs([batches[0].slice(0, 0), *batches])]
        assert got == [(1, [0, 1, 2]), (2, [0]), (None, [0, 1, 2, 3]), (7, [0, 1, 2, 3, 4, 5])]
        parts = [(key, [i for part in held for i in part["i"].to_pylist()]) for key, held in objects.run_parts(batches)]
        assert parts == got
    out = list(objects.batched(((i, b"x" * objects.BYTES) for i in range(3)), pa.schema([("k", pa.int64()), ("v", pa.binary())])))
    assert [b.num_rows for b in out] == [1, 1, 1]


def test_index_files_from_flat_rows(spark):
    """Rows of a segment that lie apart come together, in order; no worker gets all segments at once."""
    rows = [(s, lod, p, p + s, 2 * p, lod, 10 * p) for s in range(30) for lod in (0, 1) for p in range(4 - lod)]
    df = spark.createDataFrame(rows, "segment_id long, lod int, place long, fx long, fy long, fz long, n_bytes long").repartition(3)
    assert rows_of(formats.index_rows(formats.index_files(df))) == rows_of(df)
    assert "collect_list" not in plan(formats.index_files(df))


def test_paths_in_arrays_are_those_in_sets(monkeypatch):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (12, 9), (40, 45), (60, 50)):
        edges = rng.integers(0, n, (m, 2))
        edges = np.vstack([edges, edges[:3, ::-1], [[n, n + 1], [n + 1, n + 2], [n + 2, n]]])
        want = k.polylines(n + 3, [tuple(e) for e in edges.tolist()])
        monkeypatch.setattr(k, "LARGE", 0)
        assert k.polylines(n + 3, edges) == want
        monkeypatch.undo()
        assert k.polylines(n + 3, edges) == want


def tree(spark):
    nodes = [(s, 10 * i + s, float(i), float(s), None if i == 2 else 0.5, 1.0) for s in (1, 2, 3) for i in range(5 + s)]
    edges = [(s, 10 * (i // 2) + s, 10 * i + s) for s in (1, 2, 3) for i in range(1, 5 + s)]
    return spark.createDataFrame(nodes, "skel_id long, node long, x double, y double, z double, radius double").repartition(3), spark.createDataFrame(edges, "skel_id long, src long, dst long").repartition(2)


def test_skeleton_files_from_flat_rows(spark):
    nodes, edges = tree(spark)
    files = formats.skeleton_files(nodes, edges)
    nested = {r.skel_id: formats.packed_skeleton(np.array(r.nodes, float), r.edges) for r in k.nested_skeletons(nodes, edges).collect()}
    assert {r.skel_id: bytes(r.payload) for r in files.collect()} == nested
    assert rows_of(formats.skeleton_edges(files, nodes)) == rows_of(edges)
    sizes = k.each_skeleton(nodes, edges, lambda n, e: [(len(n), len(e))], "n long, e long")
    assert rows_of(sizes) == [(1, 6, 5), (2, 7, 6), (3, 8, 7)]
    for df in (files, sizes, k.nested_skeletons(nodes, edges)):
        assert "collect_list" not in plan(df)


def test_meshes_from_flat_rows(spark):
    """Also a mesh without faces; one without vertices is none; a face whose vertex is missing is an error."""
    v = spark.createDataFrame([(s, 7 * i, float(i), float(s), None) for s in (1, 2) for i in range(4)], "segment_id long, vid long, x double, y double, z double").repartition(3)
    f = spark.createDataFrame([(1, 21, 0, 7), (1, 0, 7, 14), (3, 0, 7, 14)], "segment_id long, v0 long, v1 long, v2 long")
    got = {r.segment_id: r for r in k.nested_meshes(v, f.filter("segment_id < 3")).collect()}
    assert sorted(got) == [1, 2] and got[1].faces == [[0, 1, 2], [3, 0, 1]] and got[2].faces == [] and got[2].vertices[3][:2] == [3.0, 2.0]
    assert k.nested_meshes(v, f).count() == 2 and "collect_list" not in plan(k.nested_meshes(v, f))
    with pytest.raises(Exception, match="not there"):
        k.nested_meshes(v, spark.createDataFrame([(1, 0, 7, 15)], f.schema)).collect()


def test_meshes_of_soup_are_those_of_numbered_vertices(spark):
    soup = surface.triangles(noise(spark, 8))
    points = surface.vertices(soup)
    how = (1.5, 2.0, 3.0), (0.25, -1.0, 7.0), 2
    want = k.nested_meshes(surface.to_world(points, *how), surface.indexed_faces(soup, points))
    assert rows_of(k.meshes_of_soup(soup, *how)) == rows_of(want)


def test_many_meshes_come_in_small_batches(spark):
    out = list(k.mesh_batches((i, np.zeros((objects.BYTES // 40, 3)), np.zeros((0, 3), int)) for i in range(6)))
    assert [b.num_rows for b in out] == [2, 2, 2]
    assert [(i, len(v), len(f)) for i, v, f in k.opened_meshes(out)] == [(i, objects.BYTES // 40, 0) for i in range(6)]


def test_dealt_downsampling_is_the_same(spark):
    voxels = noise(spark)
    for method in volume.METHODS:
        assert rows_of(volume.downsample(voxels, 3, method, tasks=5)) == rows_of(volume.downsample(voxels, 3, method))


def field(n):
    """A height field eight wide, as in ``adapters.terrain``."""
    i = np.arange(n)
    c = i[(i % 8 < 7) & (i + 9 < n)]
    v = np.column_stack([i % 8, i // 8, np.random.default_rng(1).uniform(-1, 10, n)]).astype(float)
    return v, np.stack([np.column_stack([c, c + 1, c + 8]), np.column_stack([c + 1, c + 9, c + 8])], 1).reshape(-1, 3)


def test_collapses_take_little_memory():
    """Sets, dictionaries and tuples of floats took 2500 bytes a vertex."""
    v, f = field(1000)
    tracemalloc.start()
    k.simplified(v, f, len(f) // 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1250 * len(v)


def test_edges_in_arrays(spark):
    faces = np.random.default_rng(2).integers(0, 9, (40, 3))
    held = {}
    for a, b, c in faces.tolist():
        for p, q in ((a, c), (b, a), (c, b)):
            held[min(p, q), max(p, q)] = held.get((min(p, q), max(p, q)), 0) + 1
    ends, times = k.edge_counts(faces)
    assert dict(zip(map(tuple, ends.tolist()), times.tolist(), strict=True)) == held and len(held) == len(ends)
    assert k.border_vertices(faces) == {v for e, n in held.items() if n == 1 for v in e}
    assert len(k.oriented(np.zeros((0, 3)), faces[:0])[1]) == 0 and k.boundary_loops(faces[:0]) == []


def test_levels_are_packed_off_a_stream(spark):
    meshes = spark.createDataFrame([(i, v.tolist(), f.tolist()) for i in range(3) for v, f in [field(80 + i)]], k.MESH)
    levels = pipelines.levels_by_decimation(meshes, 2, 2, least=12)
    levels_plan = pipelines.level_plan(levels, 20)
    pieces = pipelines.fragments(levels, levels_plan)
    files = pipelines.multires_files(pieces, levels_plan)
    assert "collect_list" not in plan(pieces) and "collect_list" not in plan(files)
    total = {r.segment_id: r.n for r in pieces.groupBy("segment_id").agg(F.sum("n_bytes").alias("n")).collect()}
    assert {r.segment_id: len(r.data) for r in files.collect()} == total and len(total) == 3


def test_joins_of_meshes_send_nothing_to_the_driver(spark, sf):
    """Small sides were broadcast by way of the driver, and tasks were merged by their compressed bytes."""
    vertices, faces = adapters.terrain(spark, "/root/testdata/sf0.01")
    for df in (mesh.corners(vertices, faces, 7), mesh.curvatures(vertices, faces), mesh.denoise_seams(vertices, faces, 100, 1, 1)):
        assert len(df.collect()) and "Broadcast" not in plan(df)
    assert mesh.corners(vertices, faces, 7).rdd.getNumPartitions() == 7
    assert mesh.neighbours(faces, 7).rdd.getNumPartitions() == 7


def test_rings_in_tasks_are_the_same(spark):
    vertices, faces = adapters.terrain(spark, "/root/testdata/sf0.01")
    seeds = vertices.filter("vid in (0, 17)")
    assert rows_of(mesh.k_ring(seeds, mesh.neighbours(faces, 5), 2, 5)) == rows_of(mesh.k_ring(seeds, mesh.neighbours(faces), 2))
