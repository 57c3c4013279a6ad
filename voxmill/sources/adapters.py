"""Volumes, meshes and skeletons made from whole relational tables, to run the operators on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import spread

WIDTH = 8  # of a terrain's grid
BALL = 33  # voxels of the largest solid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A noisy 32^3 volume: each order line colours a voxel, the least line number wins."""
    cell = lambda c, a: (F.col(c) % 32).cast("long").alias(a)
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(cell("l_orderkey", "z"), cell("l_partkey", "y"), cell("l_suppkey", "x")).agg(F.min("l_linenumber").cast("long").alias("label"))


def most_solid(spark: SparkSession, sf_dir: str) -> int:
    """The solids have no more voxels than this; the table is not read for it."""
    return BALL * table(spark, sf_dir, "part").count()


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ball for each part in a cube that grows with their number; five neighbours in a row are one label.  Where balls
    overlap the least label wins.

    Parts go to the blocks that their balls meet, and a block's voxels are made in one task: parts cross the network, not voxels.
    """
    table_of_parts = table(spark, sf_dir, "part")
    n_parts = table_of_parts.count()
    edge = math.ceil(n_parts ** (1 / 3))
    q = F.col("p_partkey")
    place = {"z": F.floor(q / (edge * edge)), "y": F.floor(q / edge) % edge, "x": q % edge}
    parts = table_of_parts.select(
        *((c * 4 + 3 + (F.col("p_partkey") % 2 if a == "y" else 0)).cast("long").alias(f"c{a}") for a, c in place.items()),
        (F.floor(q / 5) + 1).cast("long").alias("label"), (F.col("p_size") % 2 + 1).cast("long").alias("r"),
    )
    low, high = ({a: F.col(f"c{a}") + F.col("r") * s for a in "zyx"} for s in (-1, 1))
    out = spread.dealt(parts, spread.tasks(spark, n_parts * BALL), low, high)
    for a in "zyx":
        first = F.col(f"b{a}") * spread.BLOCK
        out = out.withColumn(a, F.explode(F.sequence(F.greatest(low[a], first), F.least(high[a], first + (spread.BLOCK - 1)))))
    d = {a: F.col(a) - F.col(f"c{a}") for a in "zyx"}
    inside = out.filter(d["z"] * d["z"] + d["y"] * d["y"] + d["x"] * d["x"] <= F.col("r") * F.col("r"))
    return inside.groupBy(*spread.BLOCKS, "z", "y", "x").agg(F.min("label").alias("label")).select("z", "y", "x", "label")


def terrain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One height field for each nation: its customers in a grid, their balance as height."""
    held = table(spark, sf_dir, "customer")
    n = spread.keyed(spark, spread.tasks(spark, held.count()))
    held = held.select(F.col("c_nationkey").cast("long").alias("segment_id"), "c_custkey", "c_acctbal").repartition(n, "segment_id")
    number = F.row_number().over(Window.partitionBy("segment_id").orderBy("c_custkey")) - 1
    customers = held.withColumn("r", number)
    vertices = customers.select(
        "segment_id", F.col("r").cast("long").alias("vid"),
        (F.col("r") % WIDTH).cast("double").alias("x"), F.floor(F.col("r") / WIDTH).cast("double").alias("y"), (F.col("c_acctbal") / 1000).alias("z"),
    )
    whole = Window.partitionBy("segment_id")
    cells = vertices.withColumn("n", F.count(F.lit(1)).over(whole)).filter(f"vid % {WIDTH} < {WIDTH - 1} and vid + {WIDTH + 1} < n")
    v = F.col("vid")
    two = F.array(
        F.struct((2 * v).alias("fid"), v.alias("v0"), (v + 1).alias("v1"), (v + WIDTH).alias("v2")),
        F.struct((2 * v + 1).alias("fid"), (v + 1).alias("v0"), (v + WIDTH + 1).alias("v1"), (v + WIDTH).alias("v2")),
    )
    return vertices, cells.select("segment_id", F.explode(two).alias("f")).select("segment_id", "f.*")


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' first three values as points, a segment for each label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("segment_id"), F.col("vec_id").cast("long").alias("vid"),
        *(F.element_at("embedding", i).cast("double").alias(a) for i, a in enumerate("xyz", 1)),
    )


def trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A tree for each region: nations, customers, orders.  Nodes (with depth and parent) and edges."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("skel_id"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("skel_id"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").cast("long").alias("n")).join(nation, "n")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")).join(customer, "c")
    none = F.lit(None).cast("long")
    nodes = (
        region.select("skel_id", F.col("skel_id").alias("node"), none.alias("parent"), F.lit(0).alias("depth"))
        .union(nation.select("skel_id", F.col("n") + 100, F.col("skel_id"), F.lit(1)))
        .union(customer.select("skel_id", F.col("c") + 1_000_000, F.col("n") + 100, F.lit(2)))
        .union(order.select("skel_id", F.col("o") + 1_000_000_000, F.col("c") + 1_000_000, F.lit(3)))
    )
    place = [(F.col("node") * k % 1000).cast("double").alias(a) for a, k in (("x", 7), ("y", 13), ("z", 29))]
    nodes = nodes.select("skel_id", "node", "parent", "depth", *place, (F.col("node") % 10 + 1).cast("double").alias("radius"))
    return nodes, nodes.filter("parent is not null").select("skel_id", F.col("parent").alias("src"), F.col("node").alias("dst"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each user through its events in order of time."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("long").alias("skel_id"), "ts", F.col("event_id").cast("long").alias("event_id"),
        (F.col("event_id") % 1000).cast("double").alias("x"), F.col("value").cast("double").alias("y"), (F.col("event_id") * 7 % 100).cast("double").alias("z"),
    )
