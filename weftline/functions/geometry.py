"""Geometry of heads and faces as column expressions: poses, quaternions, rotation vectors, landmarks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: residual of orthonormality at which a pose's confidence is 0.
ORTHONORMAL = 0.05


def decompose(m: list[Column]) -> tuple[list[Column], list[Column], Column]:
    """Rotation (9, by rows), translation (3) and scale of a 4x4 similarity (16, by rows).

    The scale is the mean length of the columns; all are NaN where it is under 1e-9 or not finite.
    """
    nan = F.lit(float("nan"))
    lengths = [F.sqrt(m[j] * m[j] + m[4 + j] * m[4 + j] + m[8 + j] * m[8 + j]) for j in range(3)]
    scale = (lengths[0] + lengths[1] + lengths[2]) / 3
    good = F.coalesce((scale >= 1e-9) & ~F.isnan(scale) & (scale < float("inf")), F.lit(False))
    turn = [F.when(good, m[4 * i + j] / scale).otherwise(nan) for i in range(3) for j in range(3)]
    return turn, [F.when(good, m[4 * i + 3]).otherwise(nan) for i in range(3)], F.when(good, scale).otherwise(nan)


def determinant(r: list[Column]) -> Column:
    return r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])


def residual(r: list[Column]) -> Column:
    """Frobenius norm of R'R - I."""
    gram = [[sum(r[3 * k + i] * r[3 * k + j] for k in range(3)) - (1.0 if i == j else 0.0) for j in range(3)] for i in range(3)]
    return F.sqrt(sum(g * g for row in gram for g in row))


def pose_confidence(r: list[Column]) -> Column:
    """1 for a rotation, falling to 0 at the residual ORTHONORMAL; 0 for mirrored or unusable ones."""
    e = residual(r)
    bad = F.isnan(e) | (determinant(r) <= 0)
    return F.when(F.coalesce(bad, F.lit(True)), 0.0).otherwise(1 - F.least(F.lit(1.0), e / ORTHONORMAL))


def quaternion(r: list[Column]) -> list[Column]:
    """w, x, y, z of a rotation of 9 elements with w >= 0: the largest component first, the others from it."""
    squares = [1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8]]
    off = {(0, 1): r[7] - r[5], (0, 2): r[2] - r[6], (0, 3): r[3] - r[1], (1, 2): r[1] + r[3], (1, 3): r[2] + r[6], (2, 3): r[5] + r[7]}

    def by(k: int) -> list[Column]:
        size = F.sqrt(squares[k])
        return [size / 2 if j == k else off[min(j, k), max(j, k)] / (2 * size) for j in range(4)]

    top = F.greatest(*squares)
    out = []
    for j in range(4):
        pick = F.when(squares[0] == top, by(0)[j])
        for k in (1, 2, 3):
            pick = pick.when(squares[k] == top, by(k)[j])
        out.append(pick)
    sign = F.when(out[0] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in out]


def matrix(q: list[Column]) -> list[Column]:
    """The rotation (9, by rows) of a unit quaternion."""
    w, x, y, z = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def rotation_vector(q: list[Column]) -> list[Column]:
    """Axis times angle in degrees of a unit quaternion with w >= 0; zeros for no turn."""
    n = F.sqrt(q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    per = F.when(n < 1e-12, 0.0).otherwise(F.degrees(2 * F.atan2(n, q[0])) / n)
    return [c * per for c in q[1:]]


def from_rotation_vector(v: list[Column]) -> list[Column]:
    """The unit quaternion of a rotation vector in degrees."""
    angle = F.radians(F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]))
    per = F.when(angle < 1e-12, F.radians(F.lit(0.5))).otherwise(F.sin(angle / 2) / F.degrees(angle))
    return [F.cos(angle / 2), *[c * per for c in v]]


def canonical(points: Column, left: int, right: int) -> Column:
    """Flat x, y, z points moved to the middle of two of them and scaled by their distance.

    All NaN where a coordinate isn't finite or the two are under 1e-6 apart.
    """
    a, b = ([F.element_at(points, 3 * p + i + 1) for i in range(3)] for p in (left, right))
    apart = F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))
    middle = F.array(*[(p + q) / 2 for p, q in zip(a, b, strict=True)])
    bad = F.exists(points, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | (apart < 1e-6)
    moved = F.transform(points, lambda v, i: (v - F.element_at(middle, (i % 3 + 1).cast("int"))) / apart)
    return F.when(F.coalesce(bad, F.lit(True)), F.transform(points, lambda v: F.lit(float("nan")))).otherwise(moved)


#: Radians at which pitch and yaw of a gaze saturate.
PITCH_LIMIT, YAW_LIMIT = math.radians(35), math.radians(50)


def centred_gaze(pitch: Column, yaw: Column, confidence: Column, over, squash: bool = False, unit: str = "radians") -> tuple[Column, Column]:
    """Pitch and yaw less their means over a window of frames that are finite and of confidence above 0; as they are without one.

    squash bounds them by tanh at the limits of an eye, which takes radians: it raises for another unit.
    """
    if squash and unit != "radians":
        raise ValueError("squashing takes radians")
    known = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = (confidence > 0) & known(pitch) & known(yaw)
    out = []
    for x, limit in ((pitch, PITCH_LIMIT), (yaw, YAW_LIMIT)):
        mean = F.avg(F.when(usable, x)).over(over)
        moved = limit * F.tanh((x - mean) / limit) if squash else x - mean
        out.append(F.when(mean.isNull(), x).otherwise(moved))
    return out[0], out[1]


#: Width of a face in the picture from which it is trusted in full, ratio of height to width at which an eye
#: is closed, gains of the iris offset, and the places of the eyes' landmarks (outer, inner, upper, lower, iris).
MIN_FACE_SPAN, EYE_CLOSED, YAW_GAIN, PITCH_GAIN = 0.15, 0.12, 1.4, 1.1
EYES = ((33, 133, 159, 145, 468), (263, 362, 386, 374, 473))


def _unusable(points: Column) -> Column:
    return points.isNull() | F.exists(points, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def landmark_confidence(points: Column) -> Column:
    """Share of flat x, y, z points inside the picture, less for a face under MIN_FACE_SPAN wide and high; 0 for none or not finite ones."""
    axis = [F.filter(points, lambda v, i: i % 3 == 0), F.filter(points, lambda v, i: i % 3 == 1)]
    inside = F.zip_with(*axis, lambda x, y: ((x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)).cast("double"))
    share = F.aggregate(inside, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(axis[0]), F.lit(0))
    span = F.greatest(*[F.array_max(c) - F.array_min(c) for c in axis])
    return F.when(_unusable(points), 0.0).otherwise(F.coalesce(share * F.least(F.lit(1.0), span / MIN_FACE_SPAN), F.lit(0.0)))


def iris_gaze(points: Column, width: Column, height: Column, eyes=EYES) -> tuple[Column, Column, Column]:
    """Pitch, yaw (a proxy without unit, up and right positive) and confidence of flat x, y, z points by the irises' offsets.

    Coordinates are shares of the picture, so they are stretched to pixels first. An eye under 1e-6 pixels wide doesn't
    count. NaN, NaN and 0 where neither counts, where a point isn't finite, or where the eyes are closed.
    """

    def at(p: int) -> list[Column]:
        return [F.element_at(points, 3 * p + 1) * width, F.element_at(points, 3 * p + 2) * height]

    def apart(a: list[Column], b: list[Column]) -> Column:
        return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b, strict=True)))

    seen = []
    for outer, inner, upper, lower, iris in eyes:
        a, b, wide = at(outer), at(inner), apart(at(outer), at(inner))
        shares = [(i - (p + q) / 2) / F.nullif(wide, F.lit(0.0)) for i, p, q in zip(at(iris), a, b, strict=True)]
        ratio = apart(at(upper), at(lower)) / F.nullif(wide, F.lit(0.0))
        seen.append([F.when(wide >= 1e-6, c) for c in (*shares, ratio)])
    n = sum(e[2].isNotNull().cast("int") for e in seen)
    x, y, opening = (sum(F.coalesce(e[k], F.lit(0.0)) for e in seen) / F.nullif(n, F.lit(0)) for k in range(3))
    lost = _unusable(points) | F.coalesce(opening <= EYE_CLOSED, F.lit(True))
    nan = F.lit(float("nan"))
    return F.when(lost, nan).otherwise(-y * PITCH_GAIN), F.when(lost, nan).otherwise(x * YAW_GAIN), F.when(lost, 0.0).otherwise(F.least(F.lit(1.0), opening / (2 * EYE_CLOSED)))
