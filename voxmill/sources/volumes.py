"""Chunked volumes (Zarr 2 and 3, N5) as voxel rows.

Metadata is a few small files, read through Spark's own file system layer, so any store that Spark reaches will do, or by
HTTP.  Chunks are read one row each and decoded in Arrow batches.  Of a region only the chunks that it meets are opened:
their names are listed, as a pattern for a file system and one by one for HTTP.  An absent chunk holds the fill value.
"""

from __future__ import annotations

import json
import math
import random
import re
import time
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs


def split_container(path: str) -> tuple[str, str]:
    """The path up to the last part that ends in .zarr or .n5, and the rest; without one, all and nothing."""
    found = list(re.finditer(r"\.(zarr|n5)(?=/|$)", path))
    if not found:
        return path, ""
    return path[: found[-1].end()], path[found[-1].end() :].strip("/")


#: How often a read over HTTP is tried, and its first and longest pause in seconds.
ATTEMPTS, PAUSE, LONGEST = 10, 1.0, 30.0


def over_http(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def fetched(url: str, attempts: int = ATTEMPTS, pause: float = PAUSE) -> bytes | None:
    """What a URL gives, or None if there is nothing (404, or 403 as object stores say); other failures are tried again,
    each time after a longer pause."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    for attempt in range(1, attempts + 1):
        try:
            with urlopen(url, timeout=5 * attempt) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code in (403, 404, 410):
                return None
            if attempt == attempts:
                raise
        except OSError:
            if attempt == attempts:
                raise
        time.sleep(min(LONGEST, pause * 1.3 ** (attempt - 1)) * (0.5 + random.random()))
    return None


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's content, or None if there is none."""
    if over_http(path):
        return fetched(path)
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(target) or fs.getFileStatus(target).isDirectory():
        return None
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> Any:
    raw = read_bytes(spark, path)
    try:
        return None if raw is None else json.loads(raw)
    except ValueError:
        return None


def attributes(spark: SparkSession, path: str) -> dict:
    if (doc := read_json(spark, f"{path}/zarr.json")) is not None:
        return doc.get("attributes", {})
    for name in (".zattrs", "attributes.json"):
        if (doc := read_json(spark, f"{path}/{name}")) is not None:
            return doc
    return {}


class Layout(NamedTuple):
    """Shape and chunks in the order of the stored axes (N5 turned, so that its last axis is contiguous too); ``codecs`` as
    Zarr 3 names them; ``axes`` a name for each axis."""

    kind: str
    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: list[dict]
    fill: int
    prefix: str
    separator: str
    axes: tuple[str, ...]


_N5_CODECS = {"lz4": "lz4_blocks"}


def _whole_fill(value: Any) -> int:
    """A fill value as a label: nothing, false and not-a-number are background."""
    if value is None or isinstance(value, str) and not value.lstrip("-").isdigit():
        return 0
    return int(value)


def _axes(spark: SparkSession, path: str, n: int, named: list | None, turned: bool) -> tuple[str, ...]:
    """Axis names from the array, its attributes or its multiscale group; else z, y, x behind whatever comes before."""
    own = attributes(spark, path)
    above = attributes(spark, path.rstrip("/").rpartition("/")[0])
    group = (above.get("multiscales") or (above.get("ome") or {}).get("multiscales") or [{}])[0].get("axes")
    for names in (named, own.get("_ARRAY_DIMENSIONS"), own.get("axis_names"), own.get("axes"), group):
        if isinstance(names, list) and len(names) == n:
            names = [str(x["name"] if isinstance(x, dict) else x).lower() for x in names]
            names = names[::-1] if turned and names is not group and names[:1] == ["x"] else names
            if set("zyx") <= set(names):
                return tuple(names)
    return (*(f"axis{i}" for i in range(n - 3)), *"zyx"[-min(3, n) :])


def layout(spark: SparkSession, path: str) -> Layout:
    """The array at a path; of a multiscale group the first dataset."""
    path = path.rstrip("/")
    if (doc := read_json(spark, f"{path}/.zarray")) is not None:
        if doc.get("filters"):
            raise ValueError(f"unsupported filters {[f.get('id') for f in doc['filters']]}")
        shape = tuple(doc["shape"])
        steps: list[dict] = [{"name": "bytes"}]
        if doc.get("order", "C") == "F":
            steps.insert(0, {"name": "transpose", "configuration": {"order": list(range(len(shape)))[::-1]}})
        steps.append({"name": (doc.get("compressor") or {"id": "raw"})["id"]})
        codecs.check(steps)
        return Layout(
            "zarr", path, shape, tuple(doc["chunks"]), doc["dtype"], steps, _whole_fill(doc.get("fill_value")), "",
            doc.get("dimension_separator", "."), _axes(spark, path, len(shape), None, False),
        )
    if (doc := read_json(spark, f"{path}/zarr.json")) is not None and doc.get("node_type", "array") == "array":
        steps = doc.get("codecs", [{"name": "bytes"}])
        codecs.check(steps)
        shape, keys = tuple(doc["shape"]), doc.get("chunk_key_encoding", {})
        plain = keys.get("name") == "v2"
        separator = (keys.get("configuration") or {}).get("separator", "." if plain else "/")
        dtype = codecs.dtype_of(doc["data_type"], steps).str
        return Layout(
            "zarr3", path, shape, tuple(doc["chunk_grid"]["configuration"]["chunk_shape"]), dtype, steps, _whole_fill(doc.get("fill_value")),
            "" if plain else "c" + separator, separator, _axes(spark, path, len(shape), doc.get("dimension_names"), False),
        )
    if (doc := read_json(spark, f"{path}/attributes.json")) is not None and "dimensions" in doc:
        name = doc.get("compression", {"type": doc.get("compressionType", "raw")})["type"]
        steps = [{"name": "bytes"}, {"name": _N5_CODECS.get(name, name)}]
        codecs.check(steps)
        shape, dtype = tuple(doc["dimensions"][::-1]), np.dtype(doc["dataType"]).newbyteorder(">").str
        return Layout(
            "n5", path, shape, tuple(doc["blockSize"][::-1]), dtype, steps, 0, "", "/", _axes(spark, path, len(shape), None, True)
        )
    attrs = attributes(spark, path)
    scales = attrs.get("multiscales") or (attrs.get("ome") or {}).get("multiscales")
    if scales and scales[0].get("datasets"):
        return layout(spark, f"{path}/{scales[0]['datasets'][0]['path']}")
    raise FileNotFoundError(f"no array at {path}")


def decoded(raw: bytes | None, spec: Layout) -> np.ndarray:
    """A chunk, in the order of the axes; one that is absent holds the fill value."""
    shape = spec.chunks
    if raw is None:
        return np.full(shape, spec.fill, np.dtype(spec.dtype))
    if spec.kind == "n5":
        n = int.from_bytes(raw[2:4], "big")
        shape = tuple(int.from_bytes(raw[4 + 4 * i : 8 + 4 * i], "big") for i in range(n))[::-1]
        raw = raw[4 + 4 * n + (4 if int.from_bytes(raw[:2], "big") == 1 else 0) :]
    return codecs.decode(raw, shape, np.dtype(spec.dtype), spec.codecs, spec.fill)


def _chunk_rows(spark: SparkSession, spec: Layout, ranges: list[tuple[int, int]], whole: bool) -> DataFrame:
    """(c0, c1, ..., content) of the chunks in half-open ranges of places; content is null where a chunk is absent, and
    such rows are only there if they are worth reading."""
    names = [f"c{i}" for i in range(len(spec.shape))]
    on_disk = names[::-1] if spec.kind == "n5" else names
    grid = spark.range(math.prod(max(0, b - a) for a, b in ranges))
    step = 1
    for name, (a, b) in list(zip(names, ranges, strict=True))[::-1]:
        grid = grid.withColumn(name, F.floor(F.col("id") / step) % max(1, b - a) + a)
        step *= max(1, b - a)
    grid = grid.select(*(F.col(n).cast("long").alias(n) for n in names))
    if over_http(spec.path):
        url = F.concat(F.lit(f"{spec.path}/{spec.prefix}"), F.concat_ws(spec.separator, *(F.col(n).cast("string") for n in on_disk)))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, one in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    raw = fetched(one)
                    if raw is not None or spec.fill:
                        row = batch.slice(i, 1)
                        yield pa.RecordBatch.from_arrays([*row.columns[:-1], pa.array([raw], pa.binary())], [*names, "content"])

        spread = grid.repartition(spark.sparkContext.defaultParallelism, *names)
        return spread.select(*names, url.alias("url")).mapInArrow(fetch, ", ".join(f"{n} long" for n in names) + ", content binary")
    place = "/" + re.escape(spec.prefix) + re.escape(spec.separator).join(["([0-9]+)"] * len(names)) + "$"
    files = spark.read.format("binaryFile")
    if whole:
        found = files.option("recursiveFileLookup", "true").load(spec.path)
    else:
        # A pattern that only the wanted names match, so no other chunk is opened.
        some = lambda a, b: str(a) if b == a + 1 else "{" + ",".join(map(str, range(a, b))) + "}"
        disk_ranges = ranges[::-1] if spec.kind == "n5" else ranges
        try:
            found = files.load(f"{spec.path}/{spec.prefix}" + spec.separator.join(some(a, b) for a, b in disk_ranges))
        except AnalysisException:  # not one of them is there
            found = spark.createDataFrame([], "path string, content binary")
    found = found.filter(F.col("path").rlike(place)).select(
        *(F.regexp_extract("path", place, on_disk.index(n) + 1).cast("long").alias(n) for n in names), "content"
    )
    if not spec.fill:
        return found
    there = found.select(*names)
    return found.unionByName(grid.join(there, names, "left_anti").withColumn("content", F.lit(None).cast("binary")))


def read_voxels(
    spark: SparkSession,
    path: str,
    begin: tuple[int, int, int] | None = None,
    end: tuple[int, int, int] | None = None,
    others: dict[str, int] | None = None,
) -> DataFrame:
    """(z, y, x, label) of the voxels that are not 0, of the whole volume or a half-open box; what lies outside the volume is
    0.  Of further axes, as channels or times, one place is read: that in ``others``, or the first."""
    spec = layout(spark, path)
    if len(spec.shape) < 3:
        raise ValueError("a volume has three axes")
    whole = begin is None and end is None and len(spec.shape) == 3
    axes = [spec.axes.index(a) for a in "zyx"]
    low, high = [0] * len(spec.shape), list(spec.shape)
    for i, name in enumerate(spec.axes):
        if i not in axes:
            low[i] = (others or {}).get(name, 0)
            high[i] = low[i] + 1
    for i, b, e in zip(axes, begin or (0, 0, 0), end or [spec.shape[i] for i in axes], strict=True):
        low[i], high[i] = max(0, b), min(e, spec.shape[i])
    ranges = [(b // c, max(b // c, -(-e // c))) for b, e, c in zip(low, high, spec.chunks, strict=True)]
    if any(a >= b for a, b in ranges):
        return spark.createDataFrame([], "z long, y long, x long, label long")
    chunks = _chunk_rows(spark, spec, ranges, whole)

    def voxels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                *at, raw = (c[k].as_py() for c in batch.columns)
                data = decoded(raw, spec)
                spots = np.nonzero(data)
                label = data[spots].astype(np.int64)
                spots = [s + c * n for s, c, n in zip(spots, at, spec.chunks, strict=True)]
                inside = np.ones(len(label), bool)
                for s, b, e in zip(spots, low, high, strict=True):
                    inside &= (s >= b) & (s < e)
                yield pa.RecordBatch.from_arrays([*(pa.array(spots[i][inside]) for i in axes), pa.array(label[inside])], ["z", "y", "x", "label"])

    return chunks.mapInArrow(voxels, "z long, y long, x long, label long")


def write_voxels(
    voxels: DataFrame, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], dtype: str = "<u4", order: str = "C", fill: int = 0
) -> None:
    """Voxels (z, y, x, label) as a Zarr 2 array; each chunk that holds any is written by one task.  ``path`` must lie in a
    folder that all machines share."""
    from . import formats

    place = {f"c{a}": F.floor(F.col(a) / n).cast("long") for a, n in zip("zyx", chunks, strict=True)}
    inside = F.struct(*((F.col(a) % n).cast("int").alias(a) for a, n in zip("zyx", chunks, strict=True)), "label")
    held = voxels.withColumns(place).groupBy(*place).agg(F.collect_list(inside).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = [], []
            for *at, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.full(chunks, fill, np.dtype(dtype))
                data[tuple([s[a] for s in spots] for a in "zyx")] = [s["label"] for s in spots]
                names.append(".".join(map(str, at)))
                out.append(zlib.compress(data.tobytes(order=order), 1))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(out, pa.binary())], ["name", "payload"])

    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "order": order, "fill_value": fill, "filters": None, "compressor": {"id": "zlib", "level": 1}}
    files = held.mapInArrow(pack, "name string, payload binary")
    about = voxels.sparkSession.createDataFrame([(".zarray", bytearray(json.dumps(meta).encode()))], "name string, payload binary")
    formats.write_payloads(files.union(about), path, "name")


def write_zarr(path: str, data: np.ndarray, chunks: tuple[int, ...], attrs: dict | None = None, version: int = 2, codec: str | None = "zlib") -> None:
    """A small local volume, for examples and tests."""
    import os

    os.makedirs(path, exist_ok=True)
    data = np.ascontiguousarray(data.astype(data.dtype.newbyteorder("<")))
    if version == 2:
        meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "order": "C", "fill_value": 0, "filters": None, "compressor": {"id": codec, "level": 1} if codec else None}
        files = {".zarray": meta, ".zattrs": attrs or {}}
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + ([{"name": "gzip", "configuration": {"level": 1}}] if codec else [])
        grid = {"name": "regular", "configuration": {"chunk_shape": chunks}}
        files = {"zarr.json": {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": data.dtype.name, "chunk_grid": grid, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 0, "codecs": codecs, "attributes": attrs or {}}}
    for name, doc in files.items():
        with open(f"{path}/{name}", "w") as f:
            json.dump(doc, f)
    for index in np.ndindex(*(-(-s // c) for s, c in zip(data.shape, chunks, strict=True))):
        part = np.zeros(chunks, data.dtype)
        held = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(index, chunks, strict=True))]
        part[tuple(map(slice, held.shape))] = held
        raw = part.tobytes()
        if codec:
            z = zlib.compressobj(1, zlib.DEFLATED, 31 if version == 3 else 15)
            raw = z.compress(raw) + z.flush()
        name = f"{path}/" + (".".join(map(str, index)) if version == 2 else "c/" + "/".join(map(str, index)))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "wb") as f:
            f.write(raw)


# ---------------------------------------------------------------- voxel size and offset


def _fold(steps: list[dict], n: int) -> tuple[list[float], list[float]]:
    scale, shift = [1.0] * n, [0.0] * n
    for step in steps or []:
        values = step.get(step["type"], [])
        if step["type"] == "scale":
            scale, shift = [a * b for a, b in zip(scale, values, strict=True)], [a * b for a, b in zip(shift, values, strict=True)]
        elif step["type"] == "translation":
            shift = [a + b for a, b in zip(shift, values, strict=True)]
    return scale, shift


def multiscale_transform(attrs: dict, dataset: str | None = None) -> tuple[list[float], list[float], str | None] | None:
    """Scale, translation (z, y, x) and unit of a dataset in a multiscale group, the group's own transform applied last."""
    scales = attrs.get("multiscales") or (attrs.get("ome") or {}).get("multiscales")
    if not scales or not scales[0].get("datasets"):
        return None
    group, sets = scales[0], scales[0]["datasets"]
    chosen = next((d for d in sets if dataset is not None and d.get("path") == dataset), sets[0])
    axes = [a if isinstance(a, dict) else {"name": a} for a in group.get("axes") or [{"name": n} for n in "zyx"]]
    scale, shift = _fold(chosen.get("coordinateTransformations"), len(axes))
    above, moved = _fold(group.get("coordinateTransformations"), len(axes))
    shift = [m + a * t for m, a, t in zip(moved, above, shift, strict=True)]
    scale = [a * s for a, s in zip(above, scale, strict=True)]
    names = [a["name"].lower() for a in axes]
    spot = [names.index(a) for a in "zyx" if a in names]
    unit = axes[spot[0]].get("unit") if spot else None
    return [scale[i] for i in spot], [shift[i] for i in spot], unit


def voxel_size_and_offset(spark: SparkSession, path: str) -> tuple[list[float], list[float]]:
    """From the array's attributes, else its parent's, else the multiscale group; 1 and 0 if nothing says."""
    parent, _, name = path.rstrip("/").rpartition("/")
    own, above = attributes(spark, path), attributes(spark, parent)
    size = offset = None
    for attrs in (own, above):
        pixel = attrs.get("pixelResolution") or {}
        pixel = (pixel.get("dimensions") or [])[::-1] if isinstance(pixel, dict) else pixel
        transform = attrs.get("transform") or {}
        size = size or attrs.get("resolution") or attrs.get("voxel_size") or transform.get("scale") or pixel or None
        offset = offset or attrs.get("offset") or transform.get("translate")
    if size is None or offset is None:
        found = multiscale_transform(above, name) or multiscale_transform(own)
        if found:
            size, offset = size or found[0], offset or found[1]
    return list(map(float, size or [1, 1, 1])), list(map(float, offset or [0, 0, 0]))
