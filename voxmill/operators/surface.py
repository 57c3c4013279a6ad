"""Surfaces of labels: marching cubes as a join with a table of cases.

A vertex is the middle of an edge between two voxel centres, so twice its coordinates are whole numbers.  On
that lattice equal positions are equal keys: pieces from different blocks fit without tolerance or halo.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spread

CORNERS = [(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)]


@cache
def case_triangles() -> list[tuple[int, int, tuple[int, ...]]]:
    """(case, number, nine doubled offsets z, y, x of three vertices) for every case with a surface.

    Around each face of the cell the corners are walked counter-clockwise seen from outside.  Every run of inside
    corners gives a directed segment from the edge where the run is entered to the one where it is left; opposite
    inside corners are thus kept apart, by a rule of the face alone, so neighbouring cells agree.  The segments
    chain into loops, and each loop is fanned into triangles.
    """
    faces = []
    for axis in range(3):
        for side in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            ring = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
                corner = [0, 0, 0]
                corner[axis], corner[u], corner[v] = side, a, b
                ring.append(tuple(corner))
            # (axis, u, v) is a rotation of (z, y, x), which is left-handed as (x, y, z) is right-handed.
            faces.append(ring if side == 0 else ring[::-1])
    out = []
    for case in range(1, 255):
        inside = {c for i, c in enumerate(CORNERS) if case >> i & 1}
        follow = {}
        for ring in faces:
            for i in range(4):
                if ring[i] in inside and ring[i - 1] not in inside:
                    k = i
                    while ring[(k + 1) % 4] in inside:
                        k += 1
                    middle = lambda p, q: tuple(a + b for a, b in zip(p, q, strict=True))
                    follow[middle(ring[i - 1], ring[i])] = middle(ring[k % 4], ring[(k + 1) % 4])
        number = 0
        while follow:
            start, loop = min(follow), []
            at = start
            while at in follow:
                loop.append(at)
                at = follow.pop(at)
            for i in range(1, len(loop) - 1):
                out.append((case, number, (*loop[0], *loop[i], *loop[i + 1])))
                number += 1
    return out


def case_table(spark: SparkSession) -> DataFrame:
    """The cases as rows; about 800 of them, whatever the data."""
    names = [f"{a}{i}" for i in range(3) for a in "zyx"]
    schema = "code int, tri int, " + ", ".join(f"{n} int" for n in names)
    return spark.createDataFrame([(c, t, *v) for c, t, v in case_triangles()], schema)


def _cells(voxels: DataFrame, rows: int | None, reach: int = 0) -> DataFrame:
    """The cells of each block (bz, by, bx), and with a reach of 1 those that touch its low faces from outside.

    A voxel goes to the blocks that have a cell with it as a corner, so a block's cells are whole where they are summed, and
    only voxels cross the network.
    """
    spark = voxels.sparkSession
    n = spread.tasks(spark, voxels.count() if rows is None else rows)
    held = voxels.filter("label <> 0").select("z", "y", "x", "label")
    held = spread.dealt(held, n, {a: F.col(a) - 1 for a in "zyx"}, {a: F.col(a) + reach for a in "zyx"})
    corners = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(1 << i).alias("bit")) for i, (z, y, x) in enumerate(CORNERS)))
    sent = held.select(*spread.BLOCKS, "z", "y", "x", "label", F.explode(corners).alias("c"))
    sent = sent.select(*spread.BLOCKS, *((F.col(a) - F.col(f"c.{a}")).alias(a) for a in "zyx"), "label", "c.bit")
    place = {a: F.col(a) - F.col(f"b{a}") * spread.BLOCK for a in "zyx"}
    for p in place.values():
        sent = sent.filter((p >= -reach) & (p < spread.BLOCK))
    if reach:
        sent = sent.filter(sum(((p < 0).cast("int") for p in place.values()), F.lit(0)) <= 1)
    return sent.groupBy(*spread.BLOCKS, "z", "y", "x", "label").agg(F.sum("bit").cast("int").alias("code")).filter("code < 255")


def cell_cases(voxels: DataFrame, rows: int | None = None) -> DataFrame:
    """(z, y, x, label, code) of the cells that a label's surface passes; a cell's least corner is its name.

    Each voxel goes to the eight cells that it is a corner of, which also closes surfaces at the edge of the volume.  ``rows``
    says about how many voxels there are, for the number of tasks; without it they are counted.
    """
    return _cells(voxels, rows).select("z", "y", "x", "label", "code")


def triangles(
    voxels: DataFrame, begin: tuple[int, int, int] | None = None, end: tuple[int, int, int] | None = None, rows: int | None = None
) -> DataFrame:
    """(label, z0, y0, x0, ... x2): triangles in doubled coordinates, counter-clockwise seen from outside.

    Given the region that the voxels were cut to, cells that reach out of it are left out, so what the region cuts stays
    open; without one all surfaces are closed.
    """
    table = F.broadcast(case_table(voxels.sparkSession))
    cells = cell_cases(voxels, rows)
    if begin is not None and end is not None:
        for a, b, e in zip("zyx", begin, end, strict=True):
            cells = cells.filter((F.col(a) >= b) & (F.col(a) + 1 < e))
    cells = cells.join(table, "code")
    return cells.select("label", *((2 * F.col(a) + F.col(f"{a}{i}")).alias(f"{a}{i}") for i in range(3) for a in "zyx"))


def vertices(soup: DataFrame) -> DataFrame:
    """(label, vid, z, y, x): distinct positions of each label, numbered in their order from 0."""
    corner = F.array(*(F.struct(*(F.col(f"{a}{i}").alias(a) for a in "zyx")) for i in range(3)))
    return numbered(soup.select("label", F.explode(corner).alias("p")).select("label", "p.*").distinct())


def cell_vertices(voxels: DataFrame, rows: int | None = None) -> DataFrame:
    """The vertices of the closed surfaces of voxels, without triangles.

    A vertex lies between two voxels of which one has the label; the cell that has the lower of them as its least corner gives
    it, so each comes once.
    """
    n = spread.tasks(voxels.sparkSession, rows := voxels.count() if rows is None else rows)
    bit = lambda i: F.shiftright("code", i).bitwiseAND(F.lit(1))
    points = []
    for i, corner in enumerate(CORNERS):
        if sum(corner) == 1:
            at = F.struct(*((2 * F.col(a) + c).alias(a) for a, c in zip("zyx", corner, strict=True)))
            points.append(F.when(bit(0) != bit(i), at))
    given = cell_cases(voxels, rows).select("label", F.explode(F.array_compact(F.array(*points))).alias("p")).select("label", "p.*")
    return numbered(given.repartition(n, "label", "z"))


def numbered(points: DataFrame) -> DataFrame:
    """(label, vid, z, y, x): positions of each label, numbered in their order from 0.

    They are numbered within each plane of one z, behind the number of those on planes before it, so a label of very
    many vertices is not ranked in one task.
    """
    planes = points.groupBy("label", "z").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    planes = planes.select("label", "z", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("label", "z").orderBy("y", "x")) - 1
    ranked = points.withColumn("within", within).join(planes, ["label", "z"])
    return ranked.select("label", (F.col("first") + F.col("within")).cast("long").alias("vid"), "z", "y", "x")


@cache
def case_edges() -> list[tuple[int, ...]]:
    """What each case gives to the edges of a surface.

    One row sums up the edges within the cell, which no other cell has: (case, no side 0 0 0, no edge, 0, 0, edges, those of one
    face, unbalanced and unsound ones, triangles, and the sum of their corners' triple products as d + 2 cell . (x, y, z)).  One row
    each is for the edges on the cell's faces, shared with the cell beyond: (case, which upper face z y x, doubled offsets of the
    lesser end, way to the other end, faces that use it, those from the lesser end, zeros).
    """
    by_case: dict[int, list[list[tuple[int, ...]]]] = {}
    for case, _, v in case_triangles():
        by_case.setdefault(case, []).append([v[:3], v[3:6], v[6:]])
    out = []
    for case, tris in by_case.items():
        used: dict[tuple, list[int]] = {}
        d, normal = 0, [0, 0, 0]
        for t in tris:
            for i in range(3):
                p, q = t[i], t[(i + 1) % 3]
                held = used.setdefault((min(p, q), max(p, q)), [0, 0])
                held[0] += 1
                held[1] += p < q
            o = [c[::-1] for c in t]  # x, y, z
            cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
            d += sum(a * b for a, b in zip(o[0], cross(o[1], o[2]), strict=True))
            for i in range(3):
                normal = [a + b for a, b in zip(normal, cross(o[i], o[(i + 1) % 3]), strict=True)]
        own = [0, 0, 0, 0]
        for (p, q), (n, forward) in used.items():
            side = next((a for a in range(3) if p[a] == q[a] != 1), None)
            if side is None:
                own = [a + b for a, b in zip(own, (1, n == 1, 2 * forward != n, not (n == 2 and forward == 1)), strict=True)]
                continue
            way = (q[0] - p[0] + 2) * 25 + (q[1] - p[1] + 2) * 5 + q[2] - p[2] + 2
            out.append((case, *(int(a == side and p[a] == 2) for a in range(3)), *p, way, n, forward, *(0,) * 9))
        out.append((case, 0, 0, 0, None, None, None, -1, 0, 0, *own, len(tris), d, *normal))
    return out


def validity(voxels: DataFrame, rows: int | None = None) -> DataFrame:
    """(segment_id, n_faces, n_edges, n_boundary, balanced, volume, valid) of the closed surfaces of voxels, as ``mesh.validity``
    has them for meshes: valid if closed, wound alike and of a positive volume.

    An edge on the face between two cells is counted in the block of the upper one, which has both; so edges meet where the
    voxels went, and neither triangles nor edges cross the network, only sums of each label and block.
    """
    names = [*(f"s{a}" for a in "zyx"), *(f"k{a}" for a in "zyx"), "way", "n", "forward", "n_edges", "n_boundary", "tilted", "unsound", "n_faces", "d", "mx", "my", "mz"]
    table = F.broadcast(voxels.sparkSession.createDataFrame(case_edges(), ", ".join(f"{n} int" for n in ("code", *names))))
    each = _cells(voxels, rows, 1).join(table, "code")
    for a in "zyx":
        each = each.filter(spread.block(F.col(a) + F.col(f"s{a}")) == F.col(f"b{a}"))
    key = [*spread.BLOCKS, "label", *(f"k{a}" for a in "zyx"), "way"]
    product = F.col("d") + 2 * sum((F.col(a) * F.col(f"m{a}") for a in "xyz"), F.lit(0))
    sums = ["n", "forward", "n_edges", "n_boundary", "tilted", "unsound", "n_faces"]
    met = each.select(*spread.BLOCKS, "label", *((2 * F.col(a) + F.col(f"k{a}")).alias(f"k{a}") for a in "zyx"), "way", *sums, product.alias("v"))
    met = met.groupBy(*key).agg(*(F.sum(n).alias(n) for n in (*sums, "v")))
    n, forward, shared = F.col("n"), F.col("forward"), F.col("way") >= 0
    sound = (n == 2) & (forward == 1)
    count = lambda name, test: F.sum(F.when(shared, test.cast("long")).otherwise(F.col(name))).alias(name)
    got = met.groupBy(F.col("label").alias("segment_id")).agg(
        F.sum("n_faces").alias("n_faces"), count("n_edges", F.lit(True)), count("n_boundary", n == 1), count("tilted", 2 * forward != n),
        count("unsound", ~sound), (F.sum("v") / 48.0).alias("volume"),
    )
    balanced, valid = F.col("tilted") == 0, (F.col("unsound") == 0) & (F.col("volume") > 0)
    return got.select("segment_id", "n_faces", "n_edges", "n_boundary", balanced.alias("balanced"), "volume", valid.alias("valid"))


def indexed_faces(soup: DataFrame, points: DataFrame) -> DataFrame:
    """(segment_id, v0, v1, v2) by vertex numbers; corners are looked up in one join and gathered in one aggregation."""
    slots = F.array(*(F.struct(F.lit(i).alias("i"), *(F.col(f"{a}{i}").alias(a) for a in "zyx")) for i in range(3)))
    numbered = soup.withColumn("fid", F.monotonically_increasing_id())
    each = numbered.select("label", "fid", F.explode(slots).alias("s")).select("label", "fid", "s.*")
    met = each.join(points, ["label", "z", "y", "x"])
    at = [F.max(F.when(F.col("i") == i, F.col("vid"))).alias(f"v{i}") for i in range(3)]
    return met.groupBy(F.col("label").alias("segment_id"), "fid").agg(*at).select("segment_id", "v0", "v1", "v2")


def to_world(
    points: DataFrame, voxel: float | tuple[float, float, float] = 1.0, offset: float | tuple[float, float, float] = 0.0, factor: int = 1
) -> DataFrame:
    """Vertices (segment_id, vid, x, y, z) in world units, sizes and offsets in order x, y, z; after down-sampling they move
    by half the larger kernel."""
    sizes, offsets = (v if isinstance(v, tuple) else (v,) * 3 for v in (voxel, offset))
    place = {
        a: F.lit(float(o)) + F.col(a) / 2.0 * float(s) * factor + (factor - 1) / 2 * float(s)
        for a, s, o in zip("xyz", sizes, offsets, strict=True)
    }
    return points.select(F.col("label").alias("segment_id"), "vid", *(c.alias(a) for a, c in place.items()))
