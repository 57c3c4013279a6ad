"""Column expressions: vectors, curve order, quantization, distances.  All run in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    """The columns prefix.x, prefix.y and prefix.z."""
    return tuple(F.col(f"{prefix}.{axis}") for axis in "xyz")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def clip(value: Column, low: Column, high: Column) -> Column:
    """The upper bound wins where the bounds cross."""
    return F.least(F.greatest(value, low), high)


def morton(x: Column, y: Column, z: Column, bits: int = 20) -> Column:
    """Place on the Z-order curve; of equally high bits z counts most, then y, then x."""
    code = F.lit(0).cast("long")
    for i in range(bits):
        for k, axis in enumerate((x, y, z)):
            bit = F.shiftright(axis.cast("long"), i).bitwiseAND(F.lit(1).cast("long"))
            code = code + F.shiftleft(bit, 3 * i + k)
    return code


def quantized(value: Column, origin: Column, box: Column, bits: int) -> Column:
    """Steps from 0 to 2**bits - 1 across the box, half to even; within half a step of a face it lies on it."""
    if not 1 <= bits <= 16:
        raise ValueError("vertex quantization bits must be from 1 to 16")
    most = 2**bits - 1
    half = box / F.lit(2.0 * most)
    local = clip(value - origin, F.lit(0.0), box)
    snapped = F.when(local <= half, F.lit(0.0)).when(box - local <= half, box).otherwise(local)
    return F.rint(snapped * most / box).cast("int")


def snapped_to_half(q: Column, side: Column, bits: int) -> Column:
    """Moves a step to the plane between the halves of a cell if it lies next to it; side 0 or 1 says which half."""
    plane = 2 ** (bits - 1)
    low = F.least(F.when(q >= plane - 1, plane).otherwise(q), F.lit(plane))
    high = F.greatest(F.when(q <= plane + 1, plane).otherwise(q), F.lit(plane))
    return F.when(side == 0, low).when(side == 1, high).otherwise(F.raise_error(F.lit("side must be 0 or 1"))).cast("int")


def segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """Distance of a point from a segment, or from its one point."""
    along = minus(b, a)
    square = dot(along, along)
    t = F.when(square == 0, 0.0).otherwise(clip(F.try_divide(dot(minus(p, a), along), square), F.lit(0.0), F.lit(1.0)))
    return norm(tuple(pi - (ai + t * di) for pi, ai, di in zip(p, a, along, strict=True)))


def staged_reductions(total: Column, first: float, second: float) -> tuple[Column, Column]:
    """Two reductions that together leave as much as ``total`` does."""
    if abs(first + second - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    return 1 - F.pow(1 - total, F.lit(first)), 1 - F.pow(1 - total, F.lit(second))
