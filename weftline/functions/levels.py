"""Quantizers: values to signed levels and back, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the levels, by magnitude.
LEVELS = ("none", "slight", "moderate", "strong")


@dataclass(frozen=True)
class Quantizer:
    """Bin edges of the magnitude, the value that stands for each bin, and whether the sign counts."""

    edges: tuple[float, ...]
    values: tuple[float, ...]
    signed: bool

    def __post_init__(self) -> None:
        if list(self.edges) != sorted(set(self.edges)) or len(self.values) != len(self.edges) + 1:
            raise ValueError("edges must rise, and there must be a value for each bin")

    def level(self, x: Column) -> Column:
        """Level of a value; one on an edge takes the upper bin. Unsigned values under 0 are 0, what isn't finite raises."""
        m = F.abs(x) if self.signed else F.greatest(x, F.lit(0.0))
        n = sum(((m >= e).cast("int") for e in self.edges), F.lit(0))
        n = n * F.signum(x).cast("int") if self.signed else n
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value isn't finite")).cast("int")).otherwise(n)

    def value(self, level: Column) -> Column:
        """The value that stands for a level."""
        return F.signum(level.cast("double")) * F.element_at(F.array(*map(F.lit, self.values)), F.abs(level) + 1)

    def bounds(self, level: Column) -> tuple[Column, Column]:
        """The least and the highest value of a level, both of it; that of no magnitude reaches to both sides if the sign counts."""
        edges = F.array(F.lit(0.0), *map(F.lit, self.edges), F.lit(float("inf")))
        inner, outer = F.element_at(edges, F.abs(level) + 1), F.element_at(edges, F.abs(level) + 2)
        lo = F.when(level > 0, inner).when(level < 0, -outer).otherwise(-outer if self.signed else F.lit(0.0))
        return lo, F.when(level < 0, -inner).otherwise(outer)

    def clip(self, level: Column, hint: Column) -> Column:
        """A hint cut to its level's bin."""
        lo, hi = self.bounds(level)
        return F.greatest(lo, F.least(hi, hint))


# The engine's quantizers.
QUANTIZERS = {
    "blendshape": Quantizer((0.05, 0.2, 0.5), (0.0, 0.125, 0.35, 0.75), False),
    "translation": Quantizer((0.1, 0.3, 0.8), (0.0, 0.2, 0.55, 1.2), True),
    "rotation": Quantizer((2.0, 6.0, 15.0), (0.0, 4.0, 10.5, 22.5), True),
    "gaze_iris": Quantizer((0.01, 0.03, 0.08), (0.0, 0.02, 0.055, 0.12), True),
    "gaze_radians": Quantizer((0.035, 0.105, 0.26), (0.0, 0.07, 0.18, 0.39), True),
}


def label(level: Column) -> Column:
    """A level's text: its name, with + or - before it unless it is 0."""
    name = F.element_at(F.array(*map(F.lit, LEVELS)), F.abs(level) + 1)
    return F.when(level > 0, F.concat(F.lit("+"), name)).when(level < 0, F.concat(F.lit("-"), name)).otherwise(name)


def parse_label(text: Column) -> Column:
    """The level of a label; anything else raises."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.regexp_replace(text, "^[+-]", "")).cast("int") - 1
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    fits = (place >= 0) & ((place == 0) == ~text.rlike("^[+-]"))
    return F.when(fits, sign * place).otherwise(F.raise_error(F.concat(F.lit("no level: "), text)).cast("int"))
