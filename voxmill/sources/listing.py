"""Folders of per-segment files, and regions given as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def segment_files(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """(segment_id, ending, n_bytes) of the files of a folder, without reading any.

    ``strict`` raises on a file whose stem is not a number; else such files are left out.
    """
    name = F.regexp_extract("path", "/([^/]*)$", 1)
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    number = stem.cast("long") if strict else stem.try_cast("long")
    rows = spark.read.format("binaryFile").load(folder).select(
        number.alias("segment_id"), F.regexp_extract(name, r"^[^.]*(\..*)?$", 1).alias("ending"), F.col("length").alias("n_bytes")
    )
    return rows.filter("segment_id is not null")


def parsed_region(text: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Six numbers: begin and end."""
    parts = [float(x) for x in text.replace(",", " ").split()]
    if len(parts) != 6:
        raise ValueError("a region is six numbers: z, y, x of its begin, then of its end")
    return tuple(parts[:3]), tuple(parts[3:])


def normalised_region(region: dict) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """From {begin, end} or {offset, shape}."""
    if "begin" in region and "end" in region:
        return tuple(region["begin"]), tuple(region["end"])
    if "offset" in region and "shape" in region:
        return tuple(region["offset"]), tuple(o + s for o, s in zip(region["offset"], region["shape"], strict=True))
    raise ValueError("a region needs begin and end, or offset and shape")
