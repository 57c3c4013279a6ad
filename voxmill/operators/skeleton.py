"""Skeletons as rows: nodes (skel_id, node, x, y, z, radius) and edges (skel_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g

KEY = "skel_id"


def weighted_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with their length."""
    place = nodes.select(KEY, "node", F.struct("x", "y", "z").alias("p"))
    out = edges.join(place.select(KEY, F.col("node").alias("src"), F.col("p").alias("a")), [KEY, "src"])
    out = out.join(place.select(KEY, F.col("node").alias("dst"), F.col("p").alias("b")), [KEY, "dst"])
    return out.select(KEY, "src", "dst", g.norm(g.minus(g.vector("a"), g.vector("b"))).alias("w"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(skel_id, node, degree, kind): end (at most 1), branch (more than 2) or path."""
    ends = edges.select(KEY, F.explode(F.array("src", "dst")).alias("node")).groupBy(KEY, "node").agg(F.count(F.lit(1)).alias("degree"))
    degree = F.coalesce("degree", F.lit(0))
    kind = F.when(degree <= 1, "end").when(degree > 2, "branch").otherwise("path")
    return nodes.select(KEY, "node").join(ends, [KEY, "node"], "left").select(KEY, "node", degree.alias("degree"), kind.alias("kind"))


def node_at(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Of each point (skel_id, x, y, z) the first node that lies just there; points without one are left out."""
    first = nodes.groupBy(KEY, "x", "y", "z").agg(F.min("node").alias("node"))
    return points.select(KEY, "x", "y", "z").join(first, [KEY, "x", "y", "z"])


def polyline_positions(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """(skel_id, branch, seq, x, y, z): the positions along each polyline (skel_id, branch, seq, node)."""
    return lines.join(nodes.select(KEY, "node", "x", "y", "z"), [KEY, "node"]).select(KEY, "branch", "seq", "x", "y", "z")


def path_lengths(points: DataFrame, order: list[str]) -> DataFrame:
    """Length and number of points of each polyline whose points follow each other in ``order``."""
    after = Window.partitionBy(KEY).orderBy(*order)
    step = tuple(F.lead(a).over(after) - F.col(a) for a in "xyz")
    return points.select(KEY, g.norm(step).alias("step")).groupBy(KEY).agg(
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n_points")
    )


def tree_longest_path(parents: DataFrame, levels: int) -> DataFrame:
    """The longest path of each tree, from (skel_id, node, parent, depth, w): w is the length of the edge to the parent.

    From the deepest level up, every node hands its parent how far down it reaches; the longest path bends at the node
    whose two furthest children are furthest together.  One aggregation for each level, none over pairs.
    """
    reach = parents.withColumn("down", F.lit(0.0)).withColumn("best", F.lit(0.0))
    for depth in range(levels - 1, 0, -1):
        below = reach.filter(F.col("depth") == depth).select(KEY, F.col("parent").alias("node"), (F.col("down") + F.col("w")).alias("d"), "best")
        two = below.groupBy(KEY, "node").agg(F.slice(F.sort_array(F.array_agg("d"), False), 1, 2).alias("two"), F.max("best").alias("under"))
        up = reach.filter(F.col("depth") < depth).join(two, [KEY, "node"], "left")
        far = F.coalesce(F.get("two", F.lit(0)), F.lit(0.0))
        bend = far + F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
        reach = up.select(
            KEY, "node", "parent", "depth", "w", F.greatest("down", far).alias("down"),
            F.greatest("best", bend, F.coalesce("under", F.lit(0.0))).alias("best"),
        )
    return reach.groupBy(KEY).agg(F.max("best").alias("lsp"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Total length, mean and population deviation of the radius, and numbers of ends and branch points."""
    length = weighted_edges(nodes, edges).groupBy(KEY).agg(F.sum("w").alias("length"))
    radius = nodes.groupBy(KEY).agg(F.avg("radius").alias("radius_mean"), F.stddev_pop("radius").alias("radius_std"), F.count(F.lit(1)).alias("n_nodes"))
    kinds = degrees(nodes, edges).groupBy(KEY).agg(F.count_if(F.col("kind") == "end").alias("n_ends"), F.count_if(F.col("kind") == "branch").alias("n_branches"))
    return radius.join(kinds, KEY).join(length, KEY, "left").withColumn("length", F.coalesce("length", F.lit(0.0)))


def reindexed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered from 0 in order, and their edges."""
    number = (F.row_number().over(Window.partitionBy(KEY).orderBy("node")) - 1).cast("long")
    numbered = nodes.withColumn("new", number)
    out = edges
    for end in ("src", "dst"):
        out = out.join(numbered.select(KEY, F.col("node").alias(end), F.col("new").alias(f"n_{end}")), [KEY, end])
    return numbered.drop("node").withColumnRenamed("new", "node"), out.select(KEY, F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))


def parsed_text(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and polylines from text rows (skel_id, line_no, value): v x y z radius, e i j, p i j k ..."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("p", part).withColumn("kind", F.get("p", F.lit(0)))
    order = Window.partitionBy(KEY).orderBy("line_no")
    number = lambda i: F.get("p", F.lit(i)).cast("double")
    nodes = rows.filter("kind = 'v'").select(
        KEY, (F.row_number().over(order) - 1).cast("long").alias("node"), number(1).alias("x"), number(2).alias("y"), number(3).alias("z"),
        F.get("p", F.lit(4)).try_cast("double").alias("radius"),
    )
    edges = rows.filter("kind = 'e'").select(KEY, F.get("p", F.lit(1)).cast("long").alias("src"), F.get("p", F.lit(2)).cast("long").alias("dst"))
    lines_of = rows.filter("kind = 'p'").select(KEY, (F.row_number().over(order) - 1).cast("long").alias("branch"), F.posexplode(F.slice("p", 2, F.size("p"))).alias("seq", "node"))
    return nodes, edges, lines_of.withColumn("node", F.col("node").cast("long"))
