"""Vector algebra on array columns: channels, sanitising, rotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channel(x: Column, start: int, width: int) -> Column:
    """A slice of a vector, from 0."""
    return F.slice(x, start + 1, width)


def checked(x: Column, width: int) -> Column:
    """The array if it has the width; raises otherwise."""
    return F.when(F.size(x) == width, x).otherwise(F.raise_error(F.lit(f"a vector isn't {width} wide")))


def assemble(parts: list[tuple[Column, int]]) -> Column:
    """Channels of checked widths, one after another."""
    return F.concat(*[checked(c, w) for c, w in parts])


def sanitize(x: Column, neutral: list[float]) -> Column:
    """The channel, or the neutral one where any of its values is missing or not finite."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(bad, F.array(*map(F.lit, neutral))).otherwise(x)


def symmetric(x: Column, width: int) -> Column:
    """The first ``width`` values from 0..1 to -1..1."""
    return F.transform(x, lambda v, i: F.when(i < width, 2 * v - 1).otherwise(v))


def spread(q: Column, widths: list[int]) -> Column:
    """A value for each channel to one for each dimension."""
    return F.flatten(F.zip_with(q, F.array(*map(F.lit, widths)), lambda v, n: F.array_repeat(v, n)))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))


def rotation_columns(x: list[Column]) -> list[Column]:
    """The 9 elements (by rows) of the rotation of six values, two columns: Gram-Schmidt and a cross product.

    The identity where the first column is under 1e-8 long or a value isn't finite. Where the second is parallel to the
    first, x takes its place, or y if the first is within 0.9 of x.
    """
    n = F.sqrt(sum(c * c for c in x[:3]))
    a = [c / F.nullif(n, F.lit(0.0)) for c in x[:3]]
    dot = sum(p * q for p, q in zip(a, x[3:], strict=True))
    rest = [q - dot * p for p, q in zip(a, x[3:], strict=True)]
    m = F.sqrt(sum(c * c for c in rest))
    aside = F.abs(a[0]) < 0.9
    unit = [F.when(aside, 1.0).otherwise(0.0), F.when(aside, 0.0).otherwise(1.0), F.lit(0.0)]
    along = sum(p * u for p, u in zip(a, unit, strict=True))
    other = [u - along * p for p, u in zip(a, unit, strict=True)]
    k = F.sqrt(sum(c * c for c in other))
    b = [F.when(m < 1e-8, o / F.nullif(k, F.lit(0.0))).otherwise(r / F.nullif(m, F.lit(0.0))) for o, r in zip(other, rest, strict=True)]
    c = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    bad = F.coalesce((n < 1e-8) | F.isnan(n) | F.isnan(m) | (n == float("inf")), F.lit(True))
    identity = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    rows = [v[i] for i in range(3) for v in (a, b, c)]
    return [F.when(bad, e).otherwise(r) for e, r in zip(identity, rows, strict=True)]


def let(value: Column, body) -> Column:
    """body of a named value: a transform over one element, so that a plan holds the value once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rotation(six: Column) -> Column:
    """rotation_columns of an array of six values as one array of 9, by the same rules, in a plan that stays small."""
    at = lambda x, i: F.element_at(x, i)
    scaled = lambda v: let(F.nullif(norm(v), F.lit(0.0)), lambda n: F.transform(v, lambda c: c / n))

    def second(a: Column) -> Column:
        rest = let(sum(at(a, i) * at(six, i + 3) for i in (1, 2, 3)), lambda d: F.array(*[at(six, i + 3) - d * at(a, i) for i in (1, 2, 3)]))
        x_or_y = F.when(F.abs(at(a, 1)) < 0.9, F.array(*map(F.lit, (1.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 0.0))))
        aside = let(F.when(F.abs(at(a, 1)) < 0.9, at(a, 1)).otherwise(at(a, 2)), lambda d: F.zip_with(x_or_y, a, lambda u, c: u - d * c))
        return let(let(rest, lambda r: F.when(norm(r) < 1e-8, aside).otherwise(r)), scaled)

    def third(a: Column, b: Column) -> Column:
        c = [at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((2, 3), (3, 1), (1, 2))]
        return F.array(*[v for i in range(3) for v in (at(a, i + 1), at(b, i + 1), c[i])])

    first = F.slice(six, 1, 3)
    found = let(scaled(first), lambda a: let(second(a), lambda b: third(a, b)))
    usable = ~F.exists(six, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (norm(first) >= 1e-8)
    identity = F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
    return F.when(F.coalesce(usable, F.lit(False)), found).otherwise(identity)


def geodesic(a: list[Column], b: list[Column]) -> Column:
    """Angle in radians between two rotations of 9 elements."""
    trace = sum(p * q for p, q in zip(a, b, strict=True))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))
