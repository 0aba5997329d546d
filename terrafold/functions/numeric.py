"""Numeric, geometric and colour expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
MASKED = -30.0


def q6(c: Column) -> Column:
    """Six decimals, never a negative zero.

    The cut lies just off the middle, as means of short decimals fall on the middle itself, where engines differ.
    """
    return F.floor(c * 1e6 + 0.5003) / 1e6


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    """24-bit colour."""
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack_rgb(packed: Column) -> list[Column]:
    return [F.shiftright(packed, n).bitwiseAND(F.lit(255)).alias(c) for c, n in (("r", 16), ("g", 8), ("b", 0))]


def eigenvalues3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> list[Column]:
    """Ascending eigenvalues of a symmetric 3x3 matrix in closed form, clamped at zero."""
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    a, b, c = xx - mean, yy - mean, zz - mean
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    angle = F.acos(clamp(F.when(p > 0, det / (2 * p * p * p)).otherwise(0.0), -1.0, 1.0)) / 3
    top = mean + 2 * p * F.cos(angle)
    low = mean + 2 * p * F.cos(angle + 2 * pi / 3)
    return [F.greatest(v, F.lit(0.0)) for v in (low, 3 * mean - top - low, top)]


def project_pinhole(x: Column, y: Column, z: Column, k: list[list[float]], t: list[list[float]], width: int, height: int, eps: float = EPS) -> list[Column]:
    """u, v, depth and validity of points through extrinsic ``t`` (4x4) and intrinsic ``k`` (3x3)."""
    cam = [F.lit(0.0) + x * float(r[0]) + y * float(r[1]) + z * float(r[2]) + float(r[3]) for r in t[:3]]
    pix = [cam[0] * float(r[0]) + cam[1] * float(r[1]) + cam[2] * float(r[2]) for r in k]
    scale = F.greatest(pix[2], F.lit(eps))
    return _in_view(pix[0] / scale, pix[1] / scale, cam[2], width, height, eps)


def project_x_forward(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int, y_sign: float = 1.0, z_sign: float = -1.0, eps: float = EPS) -> list[Column]:
    """As ``project_pinhole`` for sensors whose x axis points forward."""
    depth = F.greatest(x, F.lit(eps))
    return _in_view(fx * (y * y_sign / depth) + cx, fy * (z * z_sign / depth) + cy, x, width, height, eps)


def _in_view(u: Column, v: Column, depth: Column, width: int, height: int, eps: float) -> list[Column]:
    valid = (depth > eps) & (u >= 0) & (u <= width - 1) & (v >= 0) & (v <= height - 1)
    return [u.alias("u"), v.alias("v"), depth.alias("depth"), valid.alias("valid")]


def spfe(center: Column, mean: Column, top: Column) -> Column:
    """Fixed blend of centre, mean and maximum."""
    return 0.35 * center + 0.45 * mean + 0.20 * top


def qfe(center: Column, mean: Column, q75: Column, top: Column) -> Column:
    """Quantile blend of centre, mean, upper quartile and maximum."""
    return 0.20 * center + 0.45 * mean + 0.25 * q75 + 0.10 * top


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))
