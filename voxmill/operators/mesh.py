"""Meshes as rows: vertices (segment_id, vid, x, y, z) and faces (segment_id, v0, v1, v2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from . import spread
from .graph import components

KEY = "segment_id"


def face_tasks(faces: DataFrame) -> int:
    """Tasks for the corners of faces, which are counted."""
    return spread.tasks(faces.sparkSession, 3 * faces.count())


def corners(vertices: DataFrame, faces: DataFrame, n: int | None = None) -> DataFrame:
    """Faces with the positions of their corners, as structs a, b, c, and a face number fid if they have none.

    The corners are gathered in one aggregation, so the faces cross the network once, not three times.  It has n tasks, or as
    many as the number of faces asks for.
    """
    n = n or face_tasks(faces)
    if "fid" not in faces.columns:
        faces = faces.withColumn("fid", F.monotonically_increasing_id())
    slots = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("vid")) for i in range(3)))
    each = faces.select(KEY, "fid", "v0", "v1", "v2", F.explode(slots).alias("s")).select(KEY, "fid", "v0", "v1", "v2", "s.*")
    met = spread.matched(each, vertices.select(KEY, "vid", F.struct("x", "y", "z").alias("p")), [KEY, "vid"], n).repartition(n, KEY, "fid")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("p")))
    return met.groupBy(KEY, "fid", "v0", "v1", "v2").agg(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))


def _normal(prefixes=("a", "b", "c")) -> g.Vector:
    a, b, c = map(g.vector, prefixes)
    return g.cross(g.minus(b, a), g.minus(c, a))


def area_volume(soup: DataFrame) -> DataFrame:
    a, b, c = map(g.vector, "abc")
    return soup.groupBy(KEY).agg(
        (F.sum(g.norm(_normal())) / 2).alias("area"), (F.sum(g.dot(a, g.cross(b, c))) / 6).alias("volume")
    )


def bounds_centroid(vertices: DataFrame) -> DataFrame:
    each = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return vertices.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_vertices"), *each)


def inertia(soup: DataFrame) -> DataFrame:
    """Second moments of the solid about its centre of mass (density 1): volume, centre and the tensor's six entries."""
    a, b, c = map(g.vector, "abc")
    det = g.dot(a, g.cross(b, c))
    sums = [F.sum(det).alias("v6")]
    for i, n in enumerate("xyz"):
        sums.append(F.sum(det * (a[i] + b[i] + c[i])).alias(f"m_{n}"))
    for i in range(3):
        for k in range(i, 3):
            s = [p[i] + q[i] + r[i] for p, q, r in ((a, b, c),)][0] * (a[k] + b[k] + c[k])
            own = a[i] * a[k] + b[i] * b[k] + c[i] * c[k]
            sums.append(F.sum(det * (s + own)).alias(f"q_{'xyz'[i]}{'xyz'[k]}"))
    got = soup.groupBy(KEY).agg(*sums).filter("v6 <> 0")
    volume = F.col("v6") / 6
    centre = {n: F.col(f"m_{n}") / 4 / F.col("v6") for n in "xyz"}
    second = lambda n, m: F.col(f"q_{n}{m}") / 120 - volume * centre[n] * centre[m]
    diagonal = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}
    tensor = [(second(p, p) + second(q, q)).alias(f"i_{n}{n}") for n, (p, q) in diagonal.items()]
    tensor += [(-second(n, m)).alias(f"i_{n}{m}") for n, m in ("xy", "xz", "yz")]
    return got.select(KEY, volume.alias("volume"), *(c.alias(f"c_{n}") for n, c in centre.items()), *tensor)


def principal_values(tensors: DataFrame) -> DataFrame:
    """The eigenvalues of the symmetric 3 x 3 tensor (pic_0 <= pic_1 <= pic_2), in closed form, and scaled to norm 1."""
    xx, yy, zz, xy, xz, yz = (F.col(f"i_{n}") for n in ("xx", "yy", "zz", "xy", "xz", "yz"))
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    bx, by, bz = xx - q, yy - q, zz - q
    det = bx * (by * bz - yz * yz) - xy * (xy * bz - yz * xz) + xz * (xy * yz - by * xz)
    r = g.clip(F.try_divide(det, 2 * p * p * p), F.lit(-1.0), F.lit(1.0))
    phi = F.acos(F.coalesce(r, F.lit(0.0))) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    values = tensors.withColumns({"pic_0": low, "pic_1": 3 * q - high - low, "pic_2": high})
    size = F.sqrt(sum((F.col(f"pic_{i}") * F.col(f"pic_{i}") for i in range(3)), F.lit(0.0)))
    return values.select(KEY, "volume", *(f"pic_{i}" for i in range(3)), *((F.col(f"pic_{i}") / size).alias(f"pic_normalized_{i}") for i in range(3)))


def directed_edges(faces: DataFrame) -> DataFrame:
    ends = F.array(*(F.struct(F.col(p).alias("src"), F.col(q).alias("dst")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select(KEY, F.explode(ends).alias("e")).select(KEY, "e.*")


def edges(faces: DataFrame) -> DataFrame:
    """(segment_id, lo, hi, n, forward): undirected edges with how many faces use them, and how many from lo to hi."""
    return directed_edges(faces).groupBy(KEY, F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") < F.col("dst")).alias("forward")
    )


def topology(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts of each mesh, its Euler number, and whether it is closed, consistently wound and edge-manifold."""
    e = edges(faces).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if(F.col("n") == 1).alias("n_boundary"),
        F.count_if(F.col("n") > 2).alias("n_nonmanifold"),
        F.bool_and((F.col("n") == 2)).alias("watertight"),
        F.bool_and((F.col("n") > 2) | (F.col("forward") <= 1) & (F.col("n") - F.col("forward") <= 1)).alias("wound"),
        F.bool_and(2 * F.col("forward") == F.col("n")).alias("balanced"),
    )
    v = vertices.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_vertices"))
    f = faces.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_faces"))
    return v.join(f, KEY).join(e, KEY).withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def validity(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A mesh is valid if it is watertight, consistently wound and encloses a positive volume."""
    size = area_volume(corners(vertices, faces)).select(KEY, "volume")
    return topology(vertices, faces).join(size, KEY).withColumn("valid", F.col("watertight") & F.col("wound") & (F.col("volume") > 0))


def boundary_vertices(faces: DataFrame) -> DataFrame:
    open_edges = edges(faces).filter("n = 1")
    return open_edges.select(KEY, F.explode(F.array("lo", "hi")).alias("vid")).distinct()


def cleaned_faces(faces: DataFrame) -> DataFrame:
    """Without degenerate faces, and one face of those with the same three corners: the first in order of its numbers."""
    whole = faces.filter("v0 <> v1 and v1 <> v2 and v0 <> v2")
    return whole.groupBy(KEY, F.array_sort(F.array("v0", "v1", "v2")).alias("corners")).agg(F.min(F.struct("v0", "v1", "v2")).alias("f")).select(KEY, "f.*")


def used_vertices(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    used = faces.select(KEY, F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, [KEY, "vid"], "left_semi")


def reindexed(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices numbered from 0 without gaps, in order, and the faces that go with them."""
    number = (F.row_number().over(Window.partitionBy(KEY).orderBy("vid")) - 1).cast("long")
    numbered = vertices.withColumn("new", number)
    out = faces
    for i in range(3):
        out = out.join(numbered.select(KEY, F.col("vid").alias(f"v{i}"), F.col("new").alias(f"n{i}")), [KEY, f"v{i}"])
    return numbered.drop("vid").withColumnRenamed("new", "vid"), out.select(KEY, *(F.col(f"n{i}").alias(f"v{i}") for i in range(3)))


def concatenated(parts: DataFrame, order: str) -> DataFrame:
    """The first vertex number of each part when parts follow each other."""
    before = F.coalesce(F.sum("n_vertices").over(Window.partitionBy(KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("first_vid", before)


def dihedral_angles(vertices: DataFrame, faces: DataFrame, tasks: int | None = None) -> DataFrame:
    """(segment_id, lo, hi, angle): the angle between the two faces at each edge that has just two."""
    tasks = tasks or face_tasks(faces)
    soup = corners(vertices, faces, tasks)
    n = _normal()
    size = g.norm(n)
    face = soup.filter(size > 0).select(KEY, "v0", "v1", "v2", F.struct(*((x / size).alias(a) for x, a in zip(n, "xyz", strict=True))).alias("n"))
    ends = F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    each = face.select(KEY, "n", F.explode(ends).alias("e")).select(KEY, "e.*", "n").repartition(tasks, KEY, "lo", "hi")
    pair = each.groupBy(KEY, "lo", "hi").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("p"), F.max("n").alias("q")).filter("k = 2")
    angle = F.acos(g.clip(g.dot(g.vector("p"), g.vector("q")), F.lit(-1.0), F.lit(1.0)))
    return pair.select(KEY, "lo", "hi", angle.alias("angle"))


def seam_vertices(vertices: DataFrame, faces: DataFrame, degrees: float, tasks: int | None = None) -> DataFrame:
    sharp = dihedral_angles(vertices, faces, tasks).filter(F.col("angle") >= math.radians(degrees))
    return sharp.select(KEY, F.explode(F.array("lo", "hi")).alias("vid")).distinct()


def neighbours(faces: DataFrame, tasks: int | None = None) -> DataFrame:
    """(segment_id, vid, other): both ways of every edge, once; in so many tasks, if the number is given."""
    e = directed_edges(faces).filter("src <> dst")
    both = e.select(KEY, F.col("src").alias("vid"), F.col("dst").alias("other")).union(
        e.select(KEY, F.col("dst").alias("vid"), F.col("src").alias("other"))
    )
    return (both.repartition(tasks, KEY, "vid") if tasks else both).distinct()


def k_ring(seeds: DataFrame, around: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """Vertices within k edges of the seeds."""
    if tasks:
        reached = seeds.select(KEY, "vid").repartition(tasks, KEY, "vid").distinct()
        for _ in range(k):
            step = around.join(reached.hint("merge"), [KEY, "vid"], "left_semi").select(KEY, F.col("other").alias("vid"))
            reached = reached.union(step).repartition(tasks, KEY, "vid").distinct()
        return reached
    reached = seeds.select(KEY, "vid").distinct()
    for _ in range(k):
        step = around.join(reached, [KEY, "vid"], "left_semi").select(KEY, F.col("other").alias("vid"))
        reached = reached.union(step).distinct()
    return reached


def taubin(
    vertices: DataFrame, faces: DataFrame, iterations: int = 10, lamb: float = 0.5, mu: float = -0.53, movable: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Smoothed vertices: in each iteration a step by lamb and one by mu towards the mean neighbour, all at once.

    ``movable`` (segment_id, vid) restricts which vertices move.
    """
    n = tasks or face_tasks(faces)
    around = neighbours(faces, n).repartition(n, KEY, "other")
    now = vertices.select(KEY, "vid", "x", "y", "z").repartition(n, KEY, "vid")
    if movable is not None:
        now = now.join(movable.select(KEY, "vid", F.lit(True).alias("moves")).hint("merge"), [KEY, "vid"], "left")
        now = now.withColumn("moves", F.coalesce("moves", F.lit(False)))
    else:
        now = now.withColumn("moves", F.lit(True))
    for step in (lamb, mu) * iterations:
        there = now.select(KEY, F.col("vid").alias("other"), *(F.col(a).alias(f"o{a}") for a in "xyz"))
        mean = around.join(there.hint("merge"), [KEY, "other"]).repartition(n, KEY, "vid").groupBy(KEY, "vid").agg(*(F.avg(f"o{a}").alias(f"m{a}") for a in "xyz"))
        moved = {a: F.when(F.col("moves") & F.col(f"m{a}").isNotNull(), F.col(a) + step * (F.col(f"m{a}") - F.col(a))).otherwise(F.col(a)) for a in "xyz"}
        now = now.join(mean.hint("merge"), [KEY, "vid"], "left").select(KEY, "vid", *(c.alias(a) for a, c in moved.items()), "moves")
    return now.drop("moves")


def denoise_seams(vertices: DataFrame, faces: DataFrame, degrees: float, k: int, iterations: int, lamb: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Smooths within k edges of sharp seams alone."""
    n = face_tasks(faces)
    ring = k_ring(seam_vertices(vertices, faces, degrees, n), neighbours(faces, n), k, n)
    return taubin(vertices, faces, iterations, lamb, mu, ring, n)


def curvatures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(segment_id, vid, gaussian, mean, rms, abs): angle defect and cotangent mean curvature over a third of the faces'
    area; the root of the principal curvatures' squares, and the sum of their sizes, follow from these two."""
    n = face_tasks(faces)
    soup = corners(vertices, faces, n)
    three = []
    for i, names in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))):
        p, q, r = map(g.vector, names)
        u, w = g.minus(q, p), g.minus(r, p)
        size = g.norm(g.cross(u, w))
        cot = lambda m, n: F.try_divide(g.dot(m, n), g.norm(g.cross(m, n)))
        at_q, at_r = cot(g.minus(p, q), g.minus(r, q)), cot(g.minus(p, r), g.minus(q, r))
        angle = F.acos(g.clip(F.try_divide(g.dot(u, w), g.norm(u) * g.norm(w)), F.lit(-1.0), F.lit(1.0)))
        lap = ((at_r * (-u[k]) + at_q * (-w[k])).alias(f"l{a}") for k, a in enumerate("xyz"))
        three.append(F.struct(F.col(f"v{i}").alias("vid"), angle.alias("angle"), (size / 6).alias("area"), *lap))
    each = soup.select(KEY, F.explode(F.array(*three)).alias("t")).select(KEY, "t.*").repartition(n, KEY, "vid")
    total = each.groupBy(KEY, "vid").agg(F.sum("angle").alias("angle"), F.sum("area").alias("area"), *(F.sum(f"l{a}").alias(f"l{a}") for a in "xyz"))
    lap = tuple(F.col(f"l{a}") for a in "xyz")
    values = total.filter("area > 0").select(
        KEY, "vid", ((2 * math.pi - F.col("angle")) / F.col("area")).alias("gaussian"), (g.norm(lap) / (4 * F.col("area"))).alias("mean")
    )
    k, h = F.col("gaussian"), F.col("mean")
    # With principal curvatures p and q: h = (p + q) / 2 and k = p * q.
    return values.withColumns(
        {"rms": F.sqrt(F.abs(4 * h * h - 2 * k)), "abs": F.when(k >= 0, 2 * F.abs(h)).otherwise(2 * F.sqrt(h * h - k))}
    )


def curvature_summary(values: DataFrame, names: tuple[str, ...] = ("mean", "gaussian", "rms", "abs")) -> DataFrame:
    """Mean, median and population deviation of each; not-a-number counts as absent."""
    known = {n: F.when(~F.isnan(n), F.col(n)) for n in names}
    # A median holds its segment's values, so segments are spread over tasks; how many values there are is not asked.
    values = values.repartition(spread.keyed(values.sparkSession, 1), KEY)
    return values.groupBy(KEY).agg(
        *(f(c).alias(f"{n}_{s}") for n, c in known.items() for s, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop)))
    )


def weld_pairs(vertices: DataFrame, epsilon: float) -> DataFrame:
    """(segment_id, a, b): vertices nearer than epsilon, a < b.

    A cell join: a vertex lies in one cell and looks into that and its 26 neighbours, so near vertices meet on an
    equal key; only the half of the offsets that come later is looked into, and a cell's own vertices in order.
    """
    cell = {f"c{a}": F.floor(F.col(a) / epsilon).cast("long") for a in "xyz"}
    placed = vertices.select(KEY, "vid", "x", "y", "z").withColumns(cell)
    half = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in half))
    looking = placed.withColumn("s", F.explode(steps)).select(
        KEY, F.col("vid").alias("a"), *(F.col(n).alias(f"a{n}") for n in "xyz"),
        *((F.col(f"c{n}") + F.col(f"s.{k}")).alias(f"c{n}") for n, k in zip("xyz", "ijk", strict=True)),
        F.expr("s.i = 0 and s.j = 0 and s.k = 0").alias("own"),
    )
    met = looking.join(placed.withColumnRenamed("vid", "b"), [KEY, "cx", "cy", "cz"])
    gap = tuple(F.col(n) - F.col(f"a{n}") for n in "xyz")
    near = met.filter((~F.col("own") | (F.col("a") < F.col("b"))) & (g.dot(gap, gap) <= epsilon * epsilon))
    return near.select(KEY, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def welded(vertices: DataFrame, faces: DataFrame, epsilon: float) -> tuple[DataFrame, DataFrame]:
    """Vertices that are linked by steps of at most epsilon become the least of them; faces follow, without those that
    degenerate or repeat."""
    names = components(vertices, weld_pairs(vertices, epsilon))
    left = vertices.join(names.filter("vid = component").select(KEY, "vid"), [KEY, "vid"], "left_semi")
    out = faces.select(KEY, "v0", "v1", "v2")
    for i in range(3):
        out = out.join(names.select(KEY, F.col("vid").alias(f"v{i}"), F.col("component").alias(f"n{i}")), [KEY, f"v{i}"])
    return left, cleaned_faces(out.select(KEY, *(F.col(f"n{i}").alias(f"v{i}") for i in range(3))))


def face_counts_by_component(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """(segment_id, component, n_faces) with ``labels`` (segment_id, vid, component)."""
    return faces.join(labels.withColumnRenamed("vid", "v0"), [KEY, "v0"]).groupBy(KEY, "component").agg(F.count(F.lit(1)).alias("n_faces"))


def largest_component(counts: DataFrame) -> DataFrame:
    """Of each segment the component with the most faces, the first of equals."""
    best = counts.groupBy(KEY).agg(F.min(F.struct((-F.col("n_faces")).alias("m"), "component")).alias("b"))
    return best.select(KEY, F.col("b.component").alias("component"), (-F.col("b.m")).alias("n_faces"))


def clip_half_space(soup: DataFrame, axis: str, at: float, keep_above: bool) -> DataFrame:
    """The part of each triangle (structs a, b, c) on one side of a plane: none, one or two triangles.

    The corners are turned so that the odd one out comes first; cuts lie at a + (b - a) * t.
    """
    sign = 1.0 if keep_above else -1.0
    side = {n: (F.col(f"{n}.{axis}") - at) * sign for n in "abc"}
    inside = {n: s >= 0 for n, s in side.items()}
    count = sum((x.cast("int") for x in inside.values()), F.lit(0))
    turned = soup.withColumn("_in", count)
    odd = lambda n: F.when(F.col("_in") == 1, inside[n]).otherwise(~inside[n])
    first = F.when(odd("a"), 0).when(odd("b"), 1).otherwise(2)
    ring = F.array("a", "b", "c")
    turned = turned.withColumn("_f", F.when(F.col("_in") % 3 == 0, 0).otherwise(first)).withColumn("_r", ring)
    for i, n in enumerate("pqr"):
        turned = turned.withColumn(f"_{n}", F.get("_r", ((F.col("_f") + i) % 3).cast("int")))

    def cut(m: str, n: str) -> Column:
        t = F.try_divide(at - F.col(f"{m}.{axis}"), F.col(f"{n}.{axis}") - F.col(f"{m}.{axis}"))
        # On the plane itself, not next to it by rounding, so that what is cut at one plane fits.
        between = {a: F.col(f"{m}.{a}") + (F.col(f"{n}.{a}") - F.col(f"{m}.{a}")) * t for a in "xyz" if a != axis}
        return F.struct(*(between.get(a, F.lit(float(at))).alias(a) for a in "xyz"))

    three = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    p, q, r = (F.col(f"_{n}") for n in "pqr")
    pq, pr = cut("_p", "_q"), cut("_p", "_r")
    pieces = (
        F.when(F.col("_in") == 3, F.array(three(p, q, r)))
        .when(F.col("_in") == 1, F.array(three(p, pq, pr)))
        .when(F.col("_in") == 2, F.array(three(pq, q, r), three(pq, r, pr)))
    )
    keep = [c for c in soup.columns if c not in "abc"]
    # An outer explode, as the optimizer copies what an inner one explodes into filters below it.
    out = turned.select(*keep, F.explode_outer(pieces).alias("_t")).filter("_t is not null")
    return out.select(*keep, "_t.a", "_t.b", "_t.c")


def clip_to_box(soup: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """The part of each triangle (structs a, b, c) in a box (x, y, z): six clips, then without what rounding left outside.
    Neighbouring boxes cut an edge at the same point, so their pieces fit."""
    for axis, lo, hi in zip("xyz", low, high, strict=True):
        soup = clip_half_space(clip_half_space(soup, axis, lo, True), axis, hi, False)
        for n in "abc":
            soup = soup.filter((F.col(f"{n}.{axis}") >= lo) & (F.col(f"{n}.{axis}") <= hi))
    return soup


def rescaled(vertices: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    return vertices.withColumns({a: F.col(a) * s for a, s in zip("xyz", scale, strict=True)})


def cut_off(pieces: DataFrame, block: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Segments with fewer blocks than ``most``, and those with as many or more, which are left out of the work."""
    counted = pieces.groupBy(KEY).agg(F.count_distinct(block).alias("n_blocks"))
    return counted.filter(F.col("n_blocks") < most), counted.filter(F.col("n_blocks") >= most)
