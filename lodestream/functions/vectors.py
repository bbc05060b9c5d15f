"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a: str | Column, b: str | Column) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; null if one of them has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def affine(matrix: list[list[float]], point: list[Column]) -> list[Column]:
    """The first three coordinates of a 4x4 matrix times a point."""
    return [
        F.lit(row[0]) * point[0] + F.lit(row[1]) * point[1] + F.lit(row[2]) * point[2] + F.lit(row[3])
        for row in matrix[:3]
    ]


def gaze_point(yaw: Column, pitch: Column, depth: Column) -> list[Column]:
    """A point ``depth`` away along the gaze: tangents of yaw and pitch across, depth ahead."""
    return [F.tan(yaw) * depth, F.tan(pitch) * depth, depth]


def pinhole(point: list[Column], fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Pixel of a point in front of the camera; null behind it."""
    ahead = point[2] > 0
    return F.when(ahead, fx * point[0] / point[2] + cx), F.when(ahead, fy * point[1] / point[2] + cy)


def gaussian_box_score(x: Column, y: Column, box: tuple[float, float, float, float], sigma: float) -> Column:
    """A bell of deviation ``sigma`` around the centre of a box (x1, y1, x2, y2)."""
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    dx, dy = x - (box[0] + box[2]) / 2, y - (box[1] + box[3]) / 2
    return F.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
