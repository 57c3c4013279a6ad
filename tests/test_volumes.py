"""Volumes in all the ways that they are stored, read whole and in part."""

import functools
import http.server
import itertools
import json
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxmill.operators import surface
from voxmill.sources import codecs, volumes


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    out = rng.integers(0, 5, (7, 10, 9)).astype("<u4")
    out[:3] = 2
    return out


def lz4(raw):
    return bytes(pa.Codec("lz4_raw").compress(raw))


def blosc(raw, size, block=None, bits=False, code=1, split=True):
    """A frame as the public format has it."""
    pack = {1: lz4, 2: lambda x: bytes(pa.Codec("snappy").compress(x)), 3: zlib.compress, 4: lambda x: bytes(pa.Codec("zstd").compress(x))}[code]
    block = block or len(raw)
    parts = []
    for at in range(0, len(raw), block):
        held = raw[at : at + block]
        n = len(held) // size // (8 if bits else 1) * (8 if bits else 1)
        grid = np.frombuffer(held, np.uint8, n * size).reshape(n, size)
        if bits:
            planes = np.unpackbits(grid, axis=1, bitorder="little").T
            mixed = np.packbits(planes, axis=1, bitorder="little").tobytes()
        else:
            mixed = grid.T.tobytes()
        mixed += held[n * size :]
        split_here = split and len(held) == block and size <= 16 and block // size >= 128
        k = len(mixed) // size if split_here else len(mixed)
        streams = []
        for i in range(0, len(mixed), k):
            packed = pack(mixed[i : i + k])
            packed = packed if len(packed) < k else mixed[i : i + k]
            streams.append(struct.pack("<i", len(packed)) + packed)
        parts.append(b"".join(streams))
    places = list(itertools.accumulate([16 + 4 * len(parts), *map(len, parts)]))
    flags = (4 if bits else 1) | (0 if split else 16) | code << 5
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(raw), block, places[-1]) + struct.pack(f"<{len(parts)}i", *places[:-1]) + b"".join(parts)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("code", [1, 2, 3, 4])
def test_blosc_frames(bits, code):
    rng = np.random.default_rng(code)
    for size, n, block in ((4, 1000, None), (4, 1003, 2048), (1, 500, None), (8, 700, 1024), (2, 77, 64)):
        raw = rng.integers(0, 4, n).astype(f"<u{size}").tobytes()
        for split in (True, False):
            assert codecs.decode(blosc(raw, size, block, bits, code, split), (n,), np.dtype(f"<u{size}"), [{"name": "bytes"}, {"name": "blosc"}]).tobytes() == raw
    plain = struct.pack("<BBBBIII", 2, 1, 2, 4, 8, 8, 24) + b"12345678"
    assert codecs.decode(plain, (2,), np.dtype("<u4"), [{"name": "blosc"}]).tobytes() == b"12345678"


def shard(part, inner, order, missing):
    """Inner chunks stored transposed and packed, with an index and its checksum's place behind them."""
    grid = tuple(s // c for s, c in zip(part.shape, inner, strict=True))
    body, index = b"", np.full((*grid, 2), (1 << 64) - 1, "<u8")
    for at in np.ndindex(*grid):
        held = part[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, inner, strict=True))]
        if (held == missing).all():
            continue
        raw = zlib.compress(np.ascontiguousarray(held.transpose(order)).tobytes(), wbits=31)
        index[at] = len(body), len(raw)
        body += raw
    return body + index.tobytes() + b"sum!"


def stored(root, data, chunks, way):
    """Writes the data as ``way`` says and returns the path; chunks that are all fill are left out."""
    fill = 2 if way in ("fill", "shards") else 0
    doc = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "order": "C", "fill_value": fill, "filters": None, "compressor": None}
    pack, name = bytes, ".".join
    third = {"zarr_format": 3, "node_type": "array", "shape": data.shape, "data_type": data.dtype.name, "fill_value": fill}
    third |= {"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default"}}
    array = lambda x: np.ascontiguousarray(x).tobytes()
    file = ".zarray"
    if way == "F":
        doc["order"] = "F"
        array = lambda x: np.asfortranarray(x).tobytes(order="F")
    elif way == "blosc":
        doc["compressor"] = {"id": "blosc", "cname": "lz4", "clevel": 5, "shuffle": 1}
        pack = lambda raw: blosc(raw, data.dtype.itemsize)
    elif way == "lz4":
        doc["compressor"] = {"id": "lz4"}
        pack = lambda raw: struct.pack("<i", len(raw)) + lz4(raw)
    elif way in ("transpose", "shards"):
        file, name, doc = "zarr.json", lambda x: "c/" + "/".join(x), third
        turn = {"name": "transpose", "configuration": {"order": [2, 0, 1]}}
        inner = [turn, {"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}]
        if way == "transpose":
            doc["codecs"] = [*inner, {"name": "crc32c"}]
            array = lambda x: np.ascontiguousarray(x.transpose(2, 0, 1)).tobytes()
            pack = lambda raw: zlib.compress(raw, wbits=31) + b"sum!"
        else:
            part = tuple(c // 2 for c in chunks)
            index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
            doc["codecs"] = [{"name": "sharding_indexed", "configuration": {"chunk_shape": part, "codecs": inner, "index_codecs": index, "index_location": "end"}}]
            array = lambda x: shard(x, part, (2, 0, 1), fill)
    root.mkdir(parents=True, exist_ok=True)
    (root / file).write_text(json.dumps(doc))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(data.shape, chunks, strict=True))):
        held = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        whole = np.full(chunks, fill, data.dtype)
        whole[tuple(map(slice, held.shape))] = held
        if (whole != fill).any():
            target = root / name(map(str, at))
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(pack(array(whole)))
    return str(root)


def read(spark, path, *args, **options):
    return {(r.z, r.y, r.x): r.label for r in volumes.read_voxels(spark, path, *args, **options).collect()}


def held(data, low=(0, 0, 0), high=None):
    high = high or data.shape
    return {tuple(map(int, p)): int(data[tuple(p)]) for p in np.argwhere(data) if all(a <= x < b for a, x, b in zip(low, p, high, strict=True))}


@pytest.mark.parametrize("way", ["C", "F", "fill", "blosc", "lz4", "transpose", "shards"])
def test_ways_to_store(spark, tmp_path, data, way):
    path = stored(tmp_path / "v", data, (4, 4, 6), way)
    assert read(spark, f"file://{path}") == held(data)
    box = (1, 3, 0), (3, 9, 7)
    assert read(spark, f"file://{path}", *box) == held(data, *box)


def test_what_is_not_known_is_an_error(spark, tmp_path, data):
    path = tmp_path / "v"
    stored(path, data, (4, 4, 6), "C")
    doc = json.loads((path / ".zarray").read_text())
    for change in ({"filters": [{"id": "delta"}]}, {"compressor": {"id": "other"}}):
        (path / ".zarray").write_text(json.dumps(doc | change))
        with pytest.raises(ValueError):
            volumes.layout(spark, f"file://{path}")


def test_only_chunks_of_the_region_are_opened(spark, tmp_path, data):
    path = stored(tmp_path / "v", data, (4, 4, 6), "C")
    for name in ("1.0.0", "0.2.1"):  # too short to decode: opening one would fail
        (tmp_path / "v" / name).write_bytes(b"x")
    box = (0, 0, 0), (4, 8, 6)
    assert read(spark, f"file://{path}", *box) == held(data, *box)
    assert read(spark, f"file://{path}", (90, 0, 0), (99, 8, 6)) == {}
    with pytest.raises(Exception, match="buffer"):
        read(spark, f"file://{path}")


def test_channels_axes_and_groups(spark, tmp_path, data):
    many = np.stack([data, data[::-1], data * 0]).transpose(0, 3, 2, 1)  # c, x, y, z
    path = tmp_path / "g"
    stored(path / "s0", many, (2, 4, 4, 6), "C")
    group = {"multiscales": [{"axes": [{"name": n} for n in "cxyz"], "datasets": [{"path": "s0"}]}]}
    (path / ".zattrs").write_text(json.dumps(group))
    assert read(spark, f"file://{path}") == held(data)
    assert read(spark, f"file://{path}/s0", others={"c": 1}) == held(data[::-1])
    box = (2, 0, 1), (5, 4, 8)
    assert read(spark, f"file://{path}/s0", *box, others={"c": 1}) == held(data[::-1], *box)


def test_over_http_with_retries(spark, tmp_path, data, monkeypatch):
    stored(tmp_path / "v", data, (4, 4, 6), "fill")
    failed = set()

    class Flaky(http.server.SimpleHTTPRequestHandler):
        def do_GET(self):
            if self.path not in failed and not self.path.endswith("json"):
                failed.add(self.path)
                self.send_error(503)
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Flaky, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(volumes, "PAUSE", 0.05)
    monkeypatch.setattr(volumes.fetched, "__defaults__", (5, 0.05))
    try:
        url = f"http://127.0.0.1:{server.server_port}/v"
        assert read(spark, url) == held(data)
        assert read(spark, url, (0, 0, 0), (3, 5, 5)) == held(data, (0, 0, 0), (3, 5, 5))
        assert volumes.read_json(spark, f"{url}/absent.json") is None
    finally:
        server.shutdown()


def test_a_cut_by_a_region_stays_open(spark):
    solid = [(z, y, x, 1) for z in range(2, 10) for y in range(2, 10) for x in range(2, 10)]
    voxels = spark.createDataFrame(solid, "z long, y long, x long, label long")
    begin, end = (0, 0, 0), (6, 20, 20)
    inside = voxels.filter("z < 6")
    closed, opened = surface.triangles(inside), surface.triangles(inside, begin, end)

    def border(soup):
        seen = {}
        for r in soup.collect():
            p = [(r[f"z{i}"], r[f"y{i}"], r[f"x{i}"]) for i in range(3)]
            for k in range(3):
                e = tuple(sorted((p[k], p[k - 2])))
                seen[e] = seen.get(e, 0) + 1
        return {q for e, n in seen.items() if n == 1 for q in e}

    assert not border(closed) and {z for z, _, _ in border(opened)} == {10}  # twice 5, the last plane of the region
    assert not border(surface.triangles(voxels, (0, 0, 0), (20, 20, 20)))
