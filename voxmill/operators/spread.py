"""How rows are dealt to tasks, so that what one task holds does not grow with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task holds in a hash table or sorts, about.
ROWS = 200_000
#: Edge of a block of voxels or cells.
BLOCK = 16
BLOCKS = ["bz", "by", "bx"]


def tasks(spark: SparkSession, rows: int, each: int = ROWS) -> int:
    """So many tasks that each gets about ``each`` rows, and all cores work."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def block(at: Column) -> Column:
    return F.floor(at / BLOCK).cast("long")


def dealt(rows: DataFrame, n: int, first: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    """Rows sent to each block (bz, by, bx) from that of ``first`` to that of ``last``, all rows of a block to one of n tasks.

    A number that is given is not changed by adaptive execution, and what is grouped by the block and more needs no further
    exchange.
    """
    for a in "zyx":
        rows = rows.withColumn(f"b{a}", F.explode(F.sequence(block(first[a]), block(last[a]))))
    return rows.repartition(n, *BLOCKS)


def matched(left: DataFrame, right: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """A join in n tasks.  Adaptive execution would merge small tasks by their compressed bytes, which says little of the rows they
    hold, and send a side of up to ten compressed megabytes to the driver and to all workers."""
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), keys, how)


def keyed(spark: SparkSession, n: int) -> int:
    """Tasks for rows that few keys share: several for each core, so that keys seldom meet."""
    return max(n, 4 * spark.sparkContext.defaultParallelism)
