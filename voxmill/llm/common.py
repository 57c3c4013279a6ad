"""Helpers that the text operators share: scratch tables, word patterns and span digests."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of anything but ASCII white space.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only where it is unset and the master is local, as in tests, a temporary
    folder is created and recorded in the session; machines of a cluster would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="voxmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables that cut lineage: written once to the shared folder, read back from there.

    A lost executor costs a re-read, never a recomputation.  ``drop`` deletes a table that no later
    step reads; what is left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/voxmill-{label}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: A key that holds more than one in HOT_PARTS of all rows is joined by broadcast; there are fewer than HOT_PARTS of them.
HOT_PARTS = 2000
#: Keys with no more rows than this are never hot, nor are any in a table with no more than FEW_ROWS.
HOT_LEAST, FEW_ROWS = 20, 2000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counted: str | None = None) -> DataFrame:
    """``left`` joined on ``keys`` with ``right``, which has one row a key; a hot key does not land in one task.

    Keys of many rows are counted first, unless ``right`` has their rows in the column ``counted``; the hashes of these
    keys, fewer than ``HOT_PARTS``, come to the driver.  Their rows of ``right`` are broadcast; all other keys are joined by
    shuffle.  Both sides should be tables, as they are read more than once.
    """
    n = left.count()
    if n <= FEW_ROWS:
        return left.join(right, keys, how)
    least, mark = max(HOT_LEAST, n // HOT_PARTS), F.xxhash64(*keys)
    if counted:
        hot = right.filter(F.col(counted) > least)
    else:
        hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > least)
    marks = [r[0] for r in hot.na.drop(subset=keys).select(mark).collect()]
    if not marks:
        return left.join(right, keys, how)
    # A key whose hash is that of a hot one goes with it, on both sides.
    few = F.broadcast(right.filter(mark.isin(marks)))
    return left.filter(mark.isin(marks)).join(few, keys, how).unionByName(left.filter(~mark.isin(marks)).join(right.filter(~mark.isin(marks)), keys, how))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of batches, some at a time: Python objects of few texts are held at once, however large Spark's batches are."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()  # the worker lives on for other tasks


def whole_text(col: str | Column) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def content_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes of a row's id and whole text.

    They name a row without relying on row order or on ids being unique; rows that agree in id and text
    share the key and are treated alike.
    """
    parts = [F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))]
    return [
        F.xxhash64(F.lit(11), *parts).alias("_k1"),
        F.xxhash64(F.lit(29), *parts).alias("_k2"),
    ]


def tokens_of(text: Column) -> Column:
    """Number of words of a text, counted in the JVM over the whole text."""
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Operators that return their input's columns use names with a leading underscore on the way; input columns with
    such names wait under others meanwhile."""

    @wraps(operator)
    def call(docs: DataFrame, *args, **options) -> DataFrame:
        other = {c: f"held{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not other:
            return operator(docs, *args, **options)
        args = [other.get(a, a) if isinstance(a, str) else a for a in args]
        options = {k: other.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        return operator(docs.withColumnsRenamed(other), *args, **options).withColumnsRenamed({v: k for k, v in other.items()})

    return call
