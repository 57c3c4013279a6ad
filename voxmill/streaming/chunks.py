"""Volumes that arrive in pieces: an extension of the batch operators for files of voxels that keep coming.

Cells that new voxels touch are down-sampled again from all their voxels; the store is partitioned by coarse cell,
so a batch reads and writes the touched partitions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import volume


def voxel_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Voxel rows from Parquet files as they arrive."""
    return spark.readStream.schema("z long, y long, x long, label long").parquet(folder)


def surface_counts(stream: DataFrame) -> DataFrame:
    """Running voxel counts and bounds of each label."""
    bounds = [f(a).alias(f"{n}_{a}") for a in volume.AXES for n, f in (("min", F.min), ("max", F.max))]
    return stream.groupBy("label").agg(F.count(F.lit(1)).alias("n_voxels"), *bounds)


def keep_downsampled(stream: DataFrame, store: str, out: str, checkpoint: str, factor: int = 2, method: str = "mode_suppress_zero", cell: int = 64) -> StreamingQuery:
    """Keeps a down-sampled copy of all voxels that have come.  ``cell`` must be a multiple of ``factor``; later labels of
    a voxel replace earlier ones only by being greater, so the order of files does not matter."""
    if cell % factor:
        raise ValueError("cell must be a multiple of factor")
    part = F.concat_ws("_", *(F.floor(F.col(a) / cell) for a in volume.AXES))

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("part", part).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(store)
        touched = batch.select(part.alias("part")).distinct()
        voxels = spark.read.parquet(store).join(touched, "part", "left_semi")
        whole = voxels.groupBy("part", *volume.AXES).agg(F.max("label").alias("label"))
        small = volume.downsample(whole, factor, method).withColumn("part", F.concat_ws("_", *(F.floor(F.col(a) * factor / cell) for a in volume.AXES)))
        small.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(out)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
