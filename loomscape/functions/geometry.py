"""Column expressions of cameras, quaternions and Gaussian primitives.

Matrices are lists of nine columns in row order, vectors lists of three.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]


def lit(*values: float) -> Vector:
    return [F.lit(float(v)) for v in values]


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def mat_vec(m: Vector, v: Vector) -> Vector:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def transpose(m: Vector) -> Vector:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def mat_mul(a: Vector, b: Vector) -> Vector:
    rows, cols = [a[3 * i : 3 * i + 3] for i in range(3)], transpose(b)
    return [dot(r, cols[3 * j : 3 * j + 3]) for r in rows for j in range(3)]


def det(m: Vector) -> Column:
    return dot(m[0:3], cross(m[3:6], m[6:9]))


def inverse(m: Vector) -> list[Column]:
    """By cofactors; null where the determinant is nothing."""
    d = det(m)
    cols = [cross(m[3:6], m[6:9]), cross(m[6:9], m[0:3]), cross(m[0:3], m[3:6])]
    return [F.when(F.abs(d) > 1e-18, cols[j][i] / d) for i in range(3) for j in range(3)]


def to_camera(rotation: Vector, shift: Vector, point: Vector) -> Vector:
    return [a + b for a, b in zip(mat_vec(rotation, point), shift, strict=True)]


def camera_centre(rotation: Vector, shift: Vector) -> Vector:
    return [-c for c in mat_vec(transpose(rotation), shift)]


def focal_guess(width: Column, height: Column) -> Column:
    return F.lit(0.72) * F.greatest(width, height)


def pinhole(point: Vector, focal: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pixel of a camera-space point; null at or behind the camera."""
    ahead = point[2] > 1e-9
    return F.when(ahead, focal * point[0] / point[2] + cx), F.when(ahead, focal * point[1] / point[2] + cy)


def normalised(u: Column, v: Column, focal: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    return (u - cx) / focal, (v - cy) / focal


def sampson(e: Vector, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Squared first-order distance of a pair from the epipolar geometry e; infinite where undefined."""
    one = F.lit(1.0)
    forth, back = mat_vec(e, [*a, one]), mat_vec(transpose(e), [*b, one])
    off = dot([*b, one], forth)
    norm = forth[0] ** 2 + forth[1] ** 2 + back[0] ** 2 + back[1] ** 2
    return F.when(norm > 1e-18, off * off / norm).otherwise(F.lit(float("inf")))


def ray_angle(point: Vector, centre_a: Vector, centre_b: Vector) -> Column:
    """Degrees between the rays to a point; 0 where a ray has no length."""
    a = [p - c for p, c in zip(point, centre_a, strict=True)]
    b = [p - c for p, c in zip(point, centre_b, strict=True)]
    la, lb = length(a), length(b)
    cos = F.least(F.greatest(dot(a, b) / (la * lb), F.lit(-1.0)), F.lit(1.0))
    return F.when((la < 1e-12) | (lb < 1e-12), 0.0).otherwise(F.degrees(F.acos(cos)))


def unit_quaternion(q: Vector) -> Vector:
    """x, y, z, w of length one; the identity for one of no length."""
    n = F.sqrt(dot(q, q))
    return [F.when(n > 1e-12, c / n).otherwise(F.lit(float(i == 3))) for i, c in enumerate(q)]


def quaternion_matrix(q: Vector) -> Vector:
    x, y, z, w = q
    two = F.lit(2.0)
    return [
        1 - two * (y * y + z * z), two * (x * y - w * z), two * (x * z + w * y),
        two * (x * y + w * z), 1 - two * (x * x + z * z), two * (y * z - w * x),
        two * (x * z - w * y), two * (y * z + w * x), 1 - two * (x * x + y * y),
    ]


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def covariance(rotation: Vector, scale: Vector) -> list[Column]:
    """xx, xy, xz, yy, yz, zz of rotation * diag(scale)^2 * its transpose."""
    s = [c * c for c in scale]
    rows = [rotation[3 * i : 3 * i + 3] for i in range(3)]
    return [dot([a * k for a, k in zip(rows[i], s, strict=True)], rows[j]) for i in range(3) for j in range(i, 3)]


def screen_covariance(cov: list[Column], view: Vector, point: Vector, focal: Column) -> list[Column]:
    """xx, xy, yy on screen by the projection's local linear map, with the blur of a pixel."""
    full = [cov[0], cov[1], cov[2], cov[1], cov[3], cov[4], cov[2], cov[4], cov[5]]
    z = F.greatest(point[2], F.lit(1e-6))
    zero = F.lit(0.0)
    rows = [[focal / z, zero, -focal * point[0] / (z * z)], [zero, focal / z, -focal * point[1] / (z * z)]]
    across = [[dot(r, [view[k], view[3 + k], view[6 + k]]) for k in range(3)] for r in rows]
    half = [mat_vec(full, r) for r in across]
    return [dot(across[0], half[0]) + 0.3, dot(across[0], half[1]), dot(across[1], half[1]) + 0.3]


def screen_radius(cov2: list[Column]) -> Column:
    """Three times the longer axis."""
    mid = (cov2[0] + cov2[2]) / 2
    return 3 * F.sqrt(mid + F.sqrt(F.greatest(mid * mid - (cov2[0] * cov2[2] - cov2[1] * cov2[1]), F.lit(0.0))))
