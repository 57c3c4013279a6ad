"""Decoding of array chunks: compressors, shards, transposed and column-major chunks."""

from __future__ import annotations

import bz2
import lzma
import math
import struct
import zlib

import numpy as np
import pyarrow as pa

#: Steps that turn stored bytes into bytes.
BYTES_STEPS = frozenset("gzip zlib zstd blosc lz4 lz4_blocks bz2 bzip2 lzma xz crc32c raw".split())
_MISSING = (1 << 64) - 1


def _zstd(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(raw)


def _lz4(raw: bytes) -> bytes:
    """A 32-bit size, then one block."""
    (size,) = struct.unpack_from("<i", raw)
    return bytes(pa.Codec("lz4_raw").decompress(raw[4:], size)) if size else b""


def _lz4_blocks(raw: bytes) -> bytes:
    """Framed blocks: a mark, how the block is stored, its two sizes and a checksum, until an empty block."""
    out, at = [], 0
    while at + 21 <= len(raw):
        if raw[at : at + 8] != b"LZ4Block":
            raise ValueError("not a stream of lz4 blocks")
        method = raw[at + 8] & 0xF0
        packed, size = struct.unpack_from("<ii", raw, at + 9)
        at += 21
        if not size:
            break
        part = raw[at : at + packed]
        out.append(bytes(pa.Codec("lz4_raw").decompress(part, size)) if method == 0x20 else part)
        at += packed
    return b"".join(out)


def _unshuffled(raw: bytes, size: int, bits: bool) -> bytes:
    """Bytes (or bits) of equal weight stand together; what does not fill an element (eight of them) follows as it is."""
    n = len(raw) // size // (8 if bits else 1) * (8 if bits else 1)
    head = np.frombuffer(raw, np.uint8, n * size)
    if bits:
        planes = np.unpackbits(head.reshape(size * 8, n // 8), axis=1, bitorder="little")
        body = np.packbits(planes.T.reshape(n, size, 8), axis=2, bitorder="little").tobytes()
    else:
        body = head.reshape(size, n).T.tobytes()
    return body + raw[n * size :]


def _blosc(raw: bytes) -> bytes:
    """A header, where each block starts, and in each block one stream, or one for each byte of an element."""
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", raw)
    if flags & 2:
        return raw[16 : 16 + total]
    if not total:
        return b""
    inner = {
        1: lambda part, n: bytes(pa.Codec("lz4_raw").decompress(part, n)),
        2: lambda part, n: bytes(pa.Codec("snappy").decompress(part, n)),
        3: lambda part, n: zlib.decompress(part),
        4: lambda part, n: _zstd(part),
    }.get(flags >> 5)
    if inner is None:
        raise ValueError("unsupported compressor inside blosc: blosclz")
    out = []
    for i, start in enumerate(struct.unpack_from(f"<{-(-total // block)}i", raw, 16)):
        length = min(block, total - i * block)
        split = not flags & 16 and length == block and size <= 16 and block // size >= 128
        streams, at = [], start
        for _ in range(size if split else 1):
            (packed,) = struct.unpack_from("<i", raw, at)
            plain = length // size if split else length
            part = raw[at + 4 : at + 4 + packed]
            streams.append(part if packed == plain else inner(part, plain))
            at += 4 + packed
        whole = b"".join(streams)
        if size > 1 and flags & 1 or flags & 4:
            whole = _unshuffled(whole, size, bool(flags & 4))
        out.append(whole)
    return b"".join(out)


_DECODERS = {
    "gzip": lambda raw: zlib.decompress(raw, 47),
    "zlib": lambda raw: zlib.decompress(raw, 47),
    "zstd": _zstd,
    "blosc": _blosc,
    "lz4": _lz4,
    "lz4_blocks": _lz4_blocks,
    "bz2": bz2.decompress,
    "bzip2": bz2.decompress,
    "lzma": lzma.decompress,
    "xz": lzma.decompress,
    "crc32c": lambda raw: raw[:-4],
    "raw": bytes,
}


def dtype_of(name: str, steps: list[dict]) -> np.dtype:
    """The type as its bytes are stored."""
    big = any((s.get("configuration") or {}).get("endian") == "big" for s in steps)
    return np.dtype(name).newbyteorder(">" if big else "<")


def check(steps: list[dict]) -> None:
    """Raises on a step that is not known, so that no chunk is read wrongly."""
    known = BYTES_STEPS | {"bytes", "transpose", "sharding_indexed"}
    if odd := sorted({s["name"] for s in steps} - known):
        raise ValueError(f"unsupported codecs {odd}; known: {sorted(known)}")
    for s in steps:
        if s["name"] == "sharding_indexed":
            check(s["configuration"]["codecs"])
            check(s["configuration"].get("index_codecs", []))


def decode(raw: bytes, shape: tuple[int, ...], dtype: np.dtype, steps: list[dict], fill: int = 0) -> np.ndarray:
    """A chunk of this shape from its stored bytes; ``steps`` are those that encoded it, first to last."""
    turns = [s["configuration"]["order"] for s in steps if s["name"] == "transpose"]
    for step in reversed(steps):
        if step["name"] in BYTES_STEPS:
            raw = _DECODERS[step["name"]](raw)
    stored = tuple(shape)
    for order in turns:
        stored = tuple(stored[i] for i in order)
    shard = next((s["configuration"] for s in steps if s["name"] == "sharding_indexed"), None)
    if shard:
        out = _unsharded(raw, stored, np.dtype(dtype), shard, fill)
    else:
        out = np.frombuffer(raw, dtype).reshape(stored)
    for order in reversed(turns):
        out = out.transpose(np.argsort(order))
    return out


def _unsharded(raw: bytes, shape: tuple[int, ...], dtype: np.dtype, shard: dict, fill: int) -> np.ndarray:
    """Inner chunks, found by an index of places and sizes at the shard's end or start."""
    inner = tuple(shard["chunk_shape"])
    grid = tuple(s // c for s, c in zip(shape, inner, strict=True))
    steps = shard.get("index_codecs") or [{"name": "bytes"}]
    size = math.prod(grid) * 16 + 4 * sum(s["name"] == "crc32c" for s in steps)
    index = raw[:size] if shard.get("index_location", "end") == "start" else raw[len(raw) - size :]
    places = decode(index, (*grid, 2), dtype_of("uint64", steps), steps)
    out = np.full(shape, fill, dtype)
    for at in np.ndindex(*grid):
        start, length = (int(x) for x in places[at])
        if (start, length) == (_MISSING, _MISSING):
            continue
        part = decode(raw[start : start + length], inner, dtype_of(dtype.newbyteorder("=").name, shard["codecs"]), shard["codecs"], fill)
        out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, inner, strict=True))] = part
    return out
