"""Binary and text forms of meshes, fragment indexes, skeletons and annotations."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import objects
from ..operators.kernels import MESH, opened_meshes, placed, together


def packed_mesh(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """Number of vertices, positions as 32-bit floats, then corners as 32-bit numbers to the end."""
    return struct.pack("<I", len(vertices)) + np.asarray(vertices, "<f4").tobytes() + np.asarray(faces, "<u4").tobytes()


def unpacked_mesh(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(raw) < 4:
        raise ValueError("no vertex count")
    (n,) = struct.unpack_from("<I", raw)
    if len(raw) < 4 + 12 * n or (len(raw) - 4 - 12 * n) % 12:
        raise ValueError("the mesh is cut short")
    faces = np.frombuffer(raw, "<u4", offset=4 + 12 * n).reshape(-1, 3).astype(np.int64)
    if len(faces) and faces.max() >= n:
        raise ValueError("a face names a vertex that is not there")
    return np.frombuffer(raw, "<f4", 3 * n, 4).reshape(-1, 3).astype(float), faces


def ply_text(vertices: np.ndarray, faces: np.ndarray) -> str:
    head = f"ply\nformat ascii 1.0\nelement vertex {len(vertices)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    return head + "".join("%.9g %.9g %.9g\n" % tuple(v) for v in vertices) + "".join("3 %d %d %d\n" % tuple(f) for f in faces)


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parsed_ply(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces of a PLY file, ASCII or binary; polygons become fans."""
    head, _, body = raw.partition(b"end_header\n")
    lines = [x.split() for x in head.decode().splitlines()]
    kind = next(x[1] for x in lines if x[0] == "format")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for x in lines:
        if x[0] == "element":
            elements.append((x[1], int(x[2]), []))
        elif x[0] == "property":
            elements[-1][2].append(x[1:])
    order = ">" if "big" in kind else "<"
    rows: dict[str, list] = {}
    text = iter(body.decode().split()) if kind == "ascii" else None
    at = 0

    def value(name: str):
        nonlocal at
        if text is not None:
            return float(next(text))
        out = np.frombuffer(body, order + _PLY[name], 1, at)[0]
        at += out.itemsize
        return out

    for name, n, fields in elements:
        rows[name] = []
        for _ in range(n):
            row = {}
            for f in fields:
                row[f[-1]] = [int(value(f[2])) for _ in range(int(value(f[1])))] if f[0] == "list" else value(f[0])
            rows[name].append(row)
    vertices = np.array([[v["x"], v["y"], v["z"]] for v in rows.get("vertex", [])], float).reshape(-1, 3)
    polygons = [f.get("vertex_indices") or f.get("vertex_index") or [] for f in rows.get("face", [])]
    faces = [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]
    return vertices, np.array(faces, np.int64).reshape(-1, 3)


def parsed_obj(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    vertices, faces = [], []
    for line in raw.decode().splitlines():
        part = line.split()
        if part[:1] == ["v"]:
            vertices.append([float(x) for x in part[1:4]])
        elif part[:1] == ["f"]:
            p = [int(x.split("/")[0]) for x in part[1:]]
            p = [i - 1 if i > 0 else len(vertices) + i for i in p]
            faces += [(p[0], p[i], p[i + 1]) for i in range(1, len(p) - 1)]
    return np.array(vertices, float).reshape(-1, 3), np.array(faces, np.int64).reshape(-1, 3)


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """A row for each mesh file whose stem is a number: .ply, .obj, or packed without or with any other ending."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"/([0-9]+)(\.[^/.]*)?$", 1).try_cast("long")
    rows = files.select(stem.alias("segment_id"), F.lower(F.regexp_extract("path", r"\.([^/.]*)$", 1)).alias("kind"), "content").filter("segment_id is not null and kind <> 'index'")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [{"ply": parsed_ply, "obj": parsed_obj}.get(k, unpacked_mesh)(raw) for k, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tolist() for v, _ in held], pa.list_(pa.list_(pa.float64()))), pa.array([f.tolist() for _, f in held], pa.list_(pa.list_(pa.int64())))],
                ["segment_id", "vertices", "faces"],
            )

    return rows.mapInArrow(parse, MESH)


def mesh_payloads(meshes: DataFrame) -> DataFrame:
    """(segment_id, payload): packed meshes."""
    schema = pa.schema([("segment_id", pa.int64()), ("payload", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(((segment, packed_mesh(v, f)) for segment, v, f in opened_meshes(batches)), schema)

    return meshes.select("segment_id", "vertices", "faces").mapInArrow(pack, "segment_id long, payload binary")


def packed_index(chunk: list[float], origin: list[float], levels: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Of fragments: chunk shape, grid origin, number of levels, scales 2**level, vertex offsets, fragment counts; then for
    each level the positions axis by axis and the sizes."""
    out = np.array([*chunk, *origin], "<f4").tobytes() + struct.pack("<I", len(levels))
    out += np.array([2.0**i for i in range(len(levels))], "<f4").tobytes() + np.zeros(3 * len(levels), "<f4").tobytes()
    out += np.array([len(p) for p, _ in levels], "<u4").tobytes()
    for positions, sizes in levels:
        out += np.asarray(positions, "<u4").reshape(-1, 3).T.tobytes() + np.asarray(sizes, "<u4").tobytes()
    return out


def unpacked_index(raw: bytes) -> tuple[list[float], list[float], list[tuple[np.ndarray, np.ndarray]]]:
    head = np.frombuffer(raw, "<f4", 6)
    (n,) = struct.unpack_from("<I", raw, 24)
    at = 28 + 16 * n
    counts = np.frombuffer(raw, "<u4", n, at)
    at += 4 * n
    levels = []
    for c in counts.tolist():
        positions = np.frombuffer(raw, "<u4", 3 * c, at).reshape(3, c).T
        sizes = np.frombuffer(raw, "<u4", c, at + 12 * c)
        levels.append((positions, sizes))
        at += 16 * c
    return head[:3].tolist(), head[3:].tolist(), levels


def index_files(rows: DataFrame) -> DataFrame:
    """(segment_id, payload) of segments' index files; ``rows`` are (segment_id, lod, place, fx, fy, fz, n_bytes)."""
    schema = pa.schema([("segment_id", pa.int64()), ("payload", pa.binary())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for segment, held in objects.runs(batches):
            lod, at, sizes = objects.numbers(held, "lod")[:, 0], objects.numbers(held, "fx", "fy", "fz"), objects.numbers(held, "n_bytes")[:, 0]
            levels = [(at[lod == level], sizes[lod == level]) for level in range(int(lod[-1]) + 1)]
            yield segment, packed_index([1.0] * 3, [0.0] * 3, levels)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(files(batches), schema)

    # The window brings a segment's rows together, unless they are, and sorts them.
    together = rows.withColumn("at", F.row_number().over(Window.partitionBy("segment_id").orderBy("lod", "place")))
    together = together.sortWithinPartitions("segment_id", "lod", "place")
    return together.select("segment_id", "lod", "fx", "fy", "fz", "n_bytes", "at").mapInArrow(pack, "segment_id long, payload binary")


def index_rows(files: DataFrame) -> DataFrame:
    """(segment_id, lod, place, fx, fy, fz, n_bytes) of index files (segment_id, payload)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for level, (positions, sizes) in enumerate(unpacked_index(raw)[2]):
                    n = len(sizes)
                    columns = [pa.array([segment] * n, pa.int64()), pa.array([level] * n, pa.int32()), pa.array(range(n), pa.int64())]
                    columns += [pa.array(c.astype(np.int64)) for c in (*positions.T, sizes)]
                    yield pa.RecordBatch.from_arrays(columns, ["segment_id", "lod", "place", "fx", "fy", "fz", "n_bytes"])

    return files.select("segment_id", "payload").mapInArrow(read, "segment_id long, lod int, place long, fx long, fy long, fz long, n_bytes long")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes((*out, n))


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return n, at


# Fixed values of the public Draco bit stream, version 2.2: a triangle mesh, coded in sequence, corners as plain numbers;
# one attribute, the position, as three unsigned 16-bit numbers, stored as they are.
_DRACO_HEAD = b"DRACO" + bytes([2, 2, 1, 0, 0, 0])
_DRACO_POSITION = bytes([1, 1, 0, 4, 3, 0, 0, 0])


def packed_fragment(steps: np.ndarray, faces: np.ndarray) -> bytes:
    """A fragment's quantized vertices and its faces as a Draco bit stream, with the methods that do not compress."""
    n, corners = len(steps), np.asarray(faces, np.int64).ravel()
    if n < 1 << 8:
        held = corners.astype("<u1").tobytes()
    elif n < 1 << 16:
        held = corners.astype("<u2").tobytes()
    elif n < 1 << 21:
        held = b"".join(map(_varint, corners.tolist()))
    else:
        held = corners.astype("<u4").tobytes()
    return _DRACO_HEAD + _varint(len(corners) // 3) + _varint(n) + b"\1" + held + _DRACO_POSITION + np.asarray(steps, "<u2").tobytes()


def unpacked_fragment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of such a stream; one that is compressed is an error."""
    if raw[:11] != _DRACO_HEAD:
        raise ValueError("not a Draco mesh coded in sequence" if raw[:5] == b"DRACO" else "not a Draco bit stream")
    m, at = _read_varint(raw, 11)
    n, at = _read_varint(raw, at)
    if raw[at] != 1:
        raise ValueError("compressed corners are not read")
    at += 1
    if 1 << 16 <= n < 1 << 21:
        corners = np.empty(3 * m, np.int64)
        for i in range(3 * m):
            corners[i], at = _read_varint(raw, at)
    else:
        kind = np.dtype("<u1" if n < 1 << 8 else "<u2" if n < 1 << 16 else "<u4")
        corners = np.frombuffer(raw, kind, 3 * m, at)
        at += 3 * m * kind.itemsize
    if raw[at : at + len(_DRACO_POSITION)] != _DRACO_POSITION:
        raise ValueError("only plain 16-bit positions are read")
    return np.frombuffer(raw, "<u2", 3 * n, at + len(_DRACO_POSITION)).reshape(-1, 3), corners.reshape(-1, 3).astype(np.int64)


def unpacked_levels(index: bytes, data: bytes, bits: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vertices, faces) of each level in model space, from the two files of a segment; fragments follow each other."""
    chunk, origin, levels = unpacked_index(index)
    out, at = [], 0
    for level, (positions, sizes) in enumerate(levels):
        vertices, faces, n = [np.zeros((0, 3))], [np.zeros((0, 3), np.int64)], 0
        for place, size in zip(positions, sizes.tolist(), strict=True):
            if size:
                steps, held = unpacked_fragment(data[at : at + size])
                vertices.append((steps / (2**bits - 1) + place) * np.array(chunk) * 2**level + origin)
                faces.append(held + n)
                n += len(steps)
            at += size
        out.append((np.vstack(vertices), np.vstack(faces)))
    return out


def single_level_files(meshes: DataFrame, bits: int = 16) -> DataFrame:
    """(segment_id, data, fragment_index) of meshes with one level: one fragment, as large as the mesh's own box.  A mesh
    without faces gives no bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, index = [], []
            for v, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                points = np.array(v, float).reshape(-1, 3)
                low = points.min(0) if len(points) else np.zeros(3)
                chunk = points.max(0) - low if len(points) else np.zeros(3)
                most = 2**bits - 1
                steps = np.clip(np.rint((points - low) / np.where(chunk > 0, chunk, 1) * most), 0, most)
                data.append(packed_fragment(steps, np.array(f, np.int64)) if f else b"")
                index.append(packed_index(chunk.tolist(), low.tolist(), [(np.zeros((1, 3), int), np.array([len(data[-1])]))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(index, pa.binary())], ["segment_id", "data", "fragment_index"])

    return meshes.select("segment_id", "vertices", "faces").mapInArrow(pack, "segment_id long, data binary, fragment_index binary")


def packed_skeleton(nodes: np.ndarray, edges: list[tuple[int, int]]) -> bytes:
    return struct.pack("<II", len(nodes), len(edges)) + np.asarray(nodes, "<f4").reshape(-1, np.shape(nodes)[-1] if len(nodes) else 3)[:, :3].tobytes() + np.asarray(edges, "<u4").reshape(-1, 2).tobytes()


def unpacked_skeleton(raw: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    n, m = struct.unpack_from("<II", raw)
    return np.frombuffer(raw, "<f4", 3 * n, 8).reshape(-1, 3).astype(float), [tuple(e) for e in np.frombuffer(raw, "<u4", 2 * m, 8 + 12 * n).reshape(-1, 2).tolist()]


def skeleton_files(nodes: DataFrame, edges: DataFrame, n: int | None = None) -> DataFrame:
    """(skel_id, payload) of ``packed_skeleton`` from flat nodes and edges; a skeleton is held as the numbers of its file."""
    v = nodes.select("skel_id", F.lit(0).alias("kind"), F.col("node").alias("p"), F.lit(0).cast("long").alias("q"), *(F.col(a).cast("float").alias(a) for a in "xyz"))
    e = edges.select("skel_id", F.lit(1).alias("kind"), F.col("src").alias("p"), F.col("dst").alias("q"), *(F.lit(0.0).cast("float").alias(a) for a in "xyz"))
    schema = pa.schema([("skel_id", pa.int64()), ("payload", pa.binary())])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for skeleton, parts in objects.run_parts(batches):
            held = [bytearray() for _ in range(3)]
            names = None
            for part in parts:
                m = int((np.asarray(part["kind"]) == 0).sum())
                held[0] += np.asarray(part["p"][:m], "<i8").tobytes()
                held[1] += np.column_stack([part[a][:m].to_numpy(zero_copy_only=False) for a in "xyz"]).astype("<f4").tobytes()
                if m < part.num_rows:
                    names = np.frombuffer(bytes(held[0]), "<i8") if names is None else names
                    held[2] += placed(names, np.column_stack([np.asarray(part[a][m:]) for a in "pq"])).astype("<u4").tobytes()
            if held[0]:
                raw = struct.pack("<II", len(held[0]) // 8, len(held[2]) // 8) + held[1] + held[2]
                del held, names
                yield skeleton, bytes(raw)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return objects.batched(files(batches), schema)

    return together(v.unionByName(e), "skel_id", ["kind", "p", "q", *"xyz"], n).mapInArrow(pack, "skel_id long, payload binary")


def skeleton_edges(files: DataFrame, nodes: DataFrame, n: int | None = None) -> DataFrame:
    """(skel_id, src, dst): the edges of files (skel_id, payload), with the names of the nodes (skel_id, node) at their places."""
    v = nodes.select("skel_id", F.lit(0).alias("kind"), F.col("node").alias("p"), F.lit(None).cast("binary").alias("payload"))
    rows = v.unionByName(files.select("skel_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("p"), "payload"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for skeleton, parts in objects.run_parts(batches):
            held = bytearray()
            for part in parts:
                m = int((np.asarray(part["kind"]) == 0).sum())
                held += np.asarray(part["p"][:m], "<i8").tobytes()
                names = np.frombuffer(bytes(held), "<i8") if m < part.num_rows else None
                for k in range(m, part.num_rows):
                    raw = part["payload"][k].as_buffer()
                    size, many = struct.unpack_from("<II", raw)
                    ends = np.frombuffer(raw, "<u4", 2 * many, 8 + 12 * size).reshape(-1, 2)
                    for i in range(0, many, 100_000):
                        some = names[ends[i : i + 100_000]]
                        yield pa.RecordBatch.from_arrays([pa.array([skeleton] * len(some), pa.int64()), pa.array(some[:, 0]), pa.array(some[:, 1])], ["skel_id", "src", "dst"])

    return together(rows, "skel_id", ["kind", "p"], n).mapInArrow(read, "skel_id long, src long, dst long")


def packed_annotations(ids: list[int], coordinates: np.ndarray, properties: np.ndarray | None = None) -> bytes:
    """Count, then coordinates and properties of each, then the ids."""
    rows = np.asarray(coordinates, "<f4").reshape(len(ids), -1)
    if properties is not None:
        rows = np.hstack([rows, np.asarray(properties, "<f4").reshape(len(ids), -1)])
    return struct.pack("<Q", len(ids)) + np.ascontiguousarray(rows, "<f4").tobytes() + np.asarray(ids, "<u8").tobytes()


def unpacked_annotations(raw: bytes, n_coordinates: int, n_properties: int = 0) -> tuple[list[int], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<Q", raw)
    wide = n_coordinates + n_properties
    rows = np.frombuffer(raw, "<f4", n * wide, 8).reshape(n, wide)
    return np.frombuffer(raw, "<u8", n, 8 + 4 * n * wide).tolist(), rows[:, :n_coordinates], rows[:, n_coordinates:]


def annotation_files(rows: DataFrame, coordinates: list[str], properties: list[str], relationship: str | None = None) -> DataFrame:
    """(name, payload) of an annotation layer's files, from rows with a column ``id``: all rows in ``spatial0/0_0_0``, and for
    each value of ``relationship`` its rows in ``relationships``.  One file is one row, as the layout has one cell."""
    row = F.struct("id", F.array(*(F.col(c).cast("double") for c in coordinates)).alias("at"), F.array(*(F.col(c).cast("double") for c in properties)).alias("held"))
    named = [rows.select(F.lit("spatial0/0_0_0").alias("name"), row.alias("r"))]
    if relationship:
        known = rows.filter(F.col(relationship).isNotNull())
        named.append(known.select(F.concat(F.lit("relationships/"), F.col(relationship).cast("string")), row))
    each = named[0] if len(named) == 1 else named[0].union(named[1])
    held = each.groupBy("name").agg(F.array_sort(F.collect_list("r")).alias("rows"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [packed_annotations([r["id"] for r in x], np.array([r["at"] for r in x]), np.array([r["held"] for r in x]) if properties else None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["name", "payload"])

    return held.mapInArrow(pack, "name string, payload binary")


# ---------------------------------------------------------------- metadata documents

_IDENTITY = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]


def multilod_info(bits: int = 16, properties: bool = False) -> str:
    doc = {"@type": "neuroglancer_multilod_draco", "vertex_quantization_bits": bits, "transform": _IDENTITY, "lod_scale_multiplier": 1}
    return json.dumps(doc | ({"segment_properties": "segment_properties"} if properties else {}))


def legacy_info(properties: bool = False) -> str:
    return json.dumps({"@type": "neuroglancer_legacy_mesh"} | ({"segment_properties": "segment_properties"} if properties else {}))


def legacy_manifest(segment_id: int) -> str:
    return json.dumps({"fragments": [str(segment_id)]})


def skeleton_info(properties: bool = False) -> str:
    doc = {"@type": "neuroglancer_skeletons", "transform": _IDENTITY, "vertex_attributes": []}
    return json.dumps(doc | ({"segment_properties": "segment_properties"} if properties else {}))


def annotation_info(kind: str, properties: list[str], low: list[float], high: list[float], unit: str = "nm", relationships: list[str] | None = None) -> str:
    return json.dumps(
        {
            "@type": "neuroglancer_annotations_v1", "dimensions": {a: [1, unit] for a in "xyz"}, "lower_bound": [int(x) for x in low],
            "upper_bound": [int(x + 1) for x in high], "annotation_type": kind, "properties": [{"id": p, "type": "float32"} for p in properties],
            "relationships": [{"id": r, "key": "relationships"} for r in relationships or []], "by_id": {"key": "by_id"}, "spatial": [{"key": "spatial0", "grid_shape": [1, 1, 1], "chunk_size": [max(1, int(h + 1) - int(l)) for l, h in zip(low, high, strict=True)], "limit": 1}],
        }
    )


def write_payloads(rows: DataFrame, folder: str, name: str, payload: str = "payload") -> None:
    """One file for each row, by its name, written by the tasks.

    ``folder`` must be one that all machines share: a path, or the address of a store that Arrow's file systems know.  A
    task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{n}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                part = f"{target.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(raw)
                system.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select(F.col(name).cast("string"), F.col(payload)).mapInArrow(write, "n long").agg(F.sum("n")).collect()
