"""Labelled volumes as sparse voxel rows (z, y, x, label); label 0 is background and absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spread

AXES = ("z", "y", "x")
NEIGHBOURS = ((0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))


def surface_metrics(voxels: DataFrame) -> DataFrame:
    """Voxels, exposed faces and bounds of each label.  A face is exposed where the neighbour has another label.

    Every voxel sends its label to itself and its six neighbours; one aggregation on the place tells how many of
    those arrive with the same label.  So there is no self-join.
    """
    cells = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for d, a in zip(step, AXES, strict=True))) for step in ((0, 0, 0), *NEIGHBOURS)))
    sent = voxels.select(*AXES, "label", F.explode(cells).alias("d")).select(
        *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in AXES), "label", F.expr("d.dz = 0 and d.dy = 0 and d.dx = 0").alias("own")
    )
    met = sent.groupBy(*AXES, "label").agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    faces = met.filter("own").withColumn("exposed", 7 - F.col("n"))
    bounds = [f(a).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]
    return faces.groupBy("label").agg(F.count(F.lit(1)).alias("n_voxels"), F.sum("exposed").alias("n_faces"), *bounds)


# ---------------------------------------------------------------- blocks and regions


def blocks(spark: SparkSession, begin: tuple[int, int, int], end: tuple[int, int, int], size: tuple[int, int, int], padding: int = 0) -> DataFrame:
    """Full blocks from the begin of a region on, the first axis fastest; the last ones may reach beyond its end."""
    counts = [max(0, -(-(e - b) // s)) for b, e, s in zip(begin, end, size, strict=True)]
    rows = spark.range(counts[0] * counts[1] * counts[2]).withColumnRenamed("id", "block")
    at = (F.col("block") % counts[0], F.floor(F.col("block") / counts[0]) % counts[1], F.floor(F.col("block") / (counts[0] * counts[1]))) if all(counts) else [F.lit(0)] * 3
    out = rows
    for axis, b, s, k in zip(AXES, begin, size, at, strict=True):
        out = out.withColumn(f"begin_{axis}", (F.lit(b) + k * s - padding).cast("long"))
        out = out.withColumn(f"end_{axis}", (F.lit(b) + k * s + s + padding).cast("long"))
    return out


def default_block_chunks(chunk: Column, n_bytes: Column, extent: Column, target_mb: float = 128.0) -> Column:
    """Chunks along each axis of a block: the cube root of what the budget holds, at most what fits, at least 1."""
    fit = F.floor(F.pow(F.lit(target_mb * 1e6) / n_bytes, F.lit(1 / 3)))
    return F.greatest(F.lit(1), F.least(fit, F.floor(extent / chunk))).cast("long")


def overlapping(points: DataFrame, key: str, begin: tuple[float, float, float], end: tuple[float, float, float]) -> DataFrame:
    """Rows of segments whose bounding box meets the region, its faces included."""
    boxes = points.groupBy(key).agg(*(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    meets = F.lit(True)
    for a, b, e in zip("xyz", begin, end, strict=True):
        meets = meets & (F.col(f"lo_{a}") <= e) & (F.col(f"hi_{a}") >= b)
    return points.join(boxes.filter(meets).select(key), key, "left_semi")


def fragment_range(low: Column, high: Column, box: float) -> tuple[Column, Column]:
    return F.greatest(F.floor(low / box), F.lit(0)).cast("long"), (F.floor(high / box) + 1).cast("long")


def partitions_for(elements: Column, workers: int, scaling: int = 10) -> Column:
    """Partitions for so many elements; none for no element."""
    most = F.least(elements, F.lit(workers * scaling))
    return F.when(elements == 0, F.lit(0)).otherwise(F.floor(elements / F.floor(elements / most))).cast("long")


# ---------------------------------------------------------------- down-sampling


def _cell(axis: str, factor: int) -> Column:
    return F.floor(F.col(axis) / factor).cast("long").alias(axis)


def _capacity(factors: tuple[int, int, int], box: tuple[tuple[int, int], ...] | None) -> Column:
    """Voxels of a cell, clipped to the data box."""
    size = F.lit(1).cast("long")
    for axis, f, span in zip(AXES, factors, box or (None,) * 3, strict=True):
        if span is None:
            size = size * f
        else:
            size = size * (F.least((F.col(axis) + 1) * f, F.lit(span[1])) - F.greatest(F.col(axis) * f, F.lit(span[0])))
    return size


def _counted(voxels: DataFrame, factors: tuple[int, int, int], tasks: int | None) -> DataFrame:
    """Voxels of each cell and label, with the block (bz, by, bx) of the cell; dealt by it if the number of tasks is given."""
    cells = [_cell(a, f) for a, f in zip(AXES, factors, strict=True)]
    held = voxels.filter("label <> 0").select(*cells, "label")
    held = held.select("*", *(spread.block(F.col(a)).alias(f"b{a}") for a in AXES))
    if tasks:
        held = held.repartition(tasks, *spread.BLOCKS)
    return held.groupBy(*spread.BLOCKS, *AXES, "label").agg(F.count(F.lit(1)).alias("n"))


def _mode(voxels: DataFrame, factors: tuple, box, tasks: int | None, with_zero: bool) -> DataFrame:
    # Most voxels first, then the smaller label: the least of (-n, label).
    best = _counted(voxels, factors, tasks).groupBy(*spread.BLOCKS, *AXES).agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"), F.sum("n").alias("total"))
    out = best
    if with_zero:
        # Background takes part with what no voxel covers, and wins ties, being smallest.
        out = best.filter(_capacity(factors, box) - F.col("total") < -F.col("b.m"))
    return out.select(*AXES, F.col("b.label").alias("label"))


def _binary(voxels: DataFrame, factors: tuple, box, tasks: int | None, least: Callable[[Column], Column]) -> DataFrame:
    total = _counted(voxels, factors, tasks).groupBy(*spread.BLOCKS, *AXES).agg(F.sum("n").alias("total"))
    return total.filter(F.col("total") > least(_capacity(factors, box))).select(*AXES, F.lit(1).cast("long").alias("label"))


def _nearest(voxels: DataFrame, factors: tuple, box, tasks: int | None = None, start: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    on = F.lit(True)
    for a, f, s in zip(AXES, factors, start, strict=True):
        on = on & (F.pmod(F.col(a) - s, F.lit(f)) == 0)
    return voxels.filter("label <> 0").filter(on).select(*(_cell(a, f) for a, f in zip(AXES, factors, strict=True)), "label")


METHODS = {
    "mode": lambda v, f, b, t: _mode(v, f, b, t, True),
    "mode_suppress_zero": lambda v, f, b, t: _mode(v, f, b, t, False),
    "binary": lambda v, f, b, t: _binary(v, f, b, t, lambda size: F.floor(size / 2)),
    "binary_suppress_zero": lambda v, f, b, t: _binary(v, f, b, t, lambda size: F.lit(0)),
    "nearest": _nearest,
}


def downsample(
    voxels: DataFrame, factors: int | tuple[int, int, int], method: str = "mode_suppress_zero", box: tuple[tuple[int, int], ...] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One voxel for each cell of the global grid; ``box`` clips the cells at the edge of the data.  Blocks of cells are dealt to so
    many tasks, if the number is given."""
    if method not in METHODS:
        raise ValueError(f"Unknown downsample_method {method!r}; known: {', '.join(METHODS)}")
    factors = (factors,) * 3 if isinstance(factors, int) else tuple(factors)
    if factors == (1, 1, 1) and not method.startswith("binary"):
        return voxels.filter("label <> 0").select(*AXES, "label")
    return METHODS[method](voxels, factors, box, tasks)


def downsampled_box(low: Column, high: Column, factor: int) -> tuple[Column, Column]:
    return F.floor(low / factor).cast("long"), F.ceil(high / factor).cast("long")


# ---------------------------------------------------------------- metadata of volumes


def compose_transforms(steps: Column) -> Column:
    """Scale and translation of a list of (type, values), in the order listed: a scale after a translation scales it."""
    ones, zeros = F.array(*[F.lit(1.0)] * 3), F.array(*[F.lit(0.0)] * 3)
    start = F.struct(ones.alias("scale"), zeros.alias("translation"))

    def fold(acc: Column, step: Column) -> Column:
        times = F.struct(
            F.zip_with(acc["scale"], step["values"], lambda a, b: a * b).alias("scale"),
            F.zip_with(acc["translation"], step["values"], lambda a, b: a * b).alias("translation"),
        )
        moved = F.struct(
            acc["scale"].alias("scale"), F.zip_with(acc["translation"], step["values"], lambda a, b: a + b).alias("translation")
        )
        return F.when(step["type"] == "scale", times).when(step["type"] == "translation", moved).otherwise(acc)

    return F.aggregate(steps, start, fold)


def on_root(scale: Column, translation: Column, root_scale: Column, root_translation: Column) -> tuple[Column, Column]:
    """A dataset's transform below the one of its group."""
    moved = F.zip_with(root_translation, F.zip_with(root_scale, translation, lambda a, b: a * b), lambda a, b: a + b)
    return F.zip_with(root_scale, scale, lambda a, b: a * b), moved


def spatial(axes: Column, values: Column) -> Column:
    """The values of the axes z, y, x in this order, whatever other axes there are."""
    names = F.transform(axes, F.lower)
    return F.transform(F.array(*map(F.lit, AXES)), lambda a: F.try_element_at(values, F.nullif(F.array_position(names, a).cast("int"), F.lit(0))))


# Unit names of volume metadata and their short forms.
UNITS = {"angstrom": "Å", "nanometer": "nm", "micrometer": "um", "millimeter": "mm", "centimeter": "cm", "meter": "m"}


def unit(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, name), name)
