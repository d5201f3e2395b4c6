"""Vector and landmark column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contour points of the two eyes in the 68-point face layout.
RIGHT_EYE = (36, 37, 38, 39, 40, 41)
LEFT_EYE = (42, 43, 44, 45, 46, 47)
MIN_NORM = 1e-9
MIN_EYE_WIDTH = 1e-6


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, accumulated in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; a (near-)zero vector is left as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm < MIN_NORM, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity without materialising the normalised vectors."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    one = F.lit(1.0)
    return dot(a, b) / (
        F.when(na < MIN_NORM, one).otherwise(na) * F.when(nb < MIN_NORM, one).otherwise(nb)
    )


def _gap(points: Column, i: int, j: int) -> Column:
    dx = points[i][0].cast("double") - points[j][0].cast("double")
    dy = points[i][1].cast("double") - points[j][1].cast("double")
    return F.sqrt(dx * dx + dy * dy)


def eye_aspect_ratio(points: Column, eye: tuple[int, ...]) -> Column:
    """Lid opening over twice the eye width; 0 when the width vanishes."""
    c1, u1, u2, c2, d2, d1 = eye
    width = _gap(points, c1, c2)
    return F.when(width < MIN_EYE_WIDTH, F.lit(0.0)).otherwise(
        (_gap(points, u1, d1) + _gap(points, u2, d2)) / (width * 2.0)
    )


def min_ear(points: Column) -> Column:
    """Smaller of the two eye ratios; NULL landmarks stay NULL."""
    return F.when(
        points.isNotNull(),
        F.least(eye_aspect_ratio(points, RIGHT_EYE), eye_aspect_ratio(points, LEFT_EYE)),
    )
