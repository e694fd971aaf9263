"""Column expressions. All are built-in functions, so they stay in generated code or the optimizer's reach."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clipped(x: Column, eps: float = EPS) -> Column:
    return F.greatest(x, F.lit(eps))


def slug(x: Column) -> Column:
    """Lower case, runs of other signs as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def trailing_number(x: Column) -> Column:
    """The number at the end of a key, null if there is none."""
    return F.regexp_extract(x, r"(\d+)$", 1).try_cast("bigint")


def shifted_key(x: Column, shift: int) -> Column:
    """A key with the number at its end moved by `shift`; keys without one stay."""
    number = trailing_number(x)
    return F.when(number.isNotNull(), F.concat(F.regexp_replace(x, r"\d+$", ""), (number + shift).cast("string"))).otherwise(x)


def wrapped(angle: Column) -> Column:
    """An angle in [0, 2 pi)."""
    return F.pmod(angle, F.lit(2.0) * F.pi())


def circular(angles: Column) -> Column:
    """Cosines, then sines, of an array of angles (T4: raw angles are the default elsewhere)."""
    return F.concat(F.transform(angles, F.cos), F.transform(angles, F.sin))


def dihedral(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The dihedral angle of four points, each an array of three numbers, in radians (D1); null for a degenerate one."""

    def minus(u: Column, v: Column) -> list[Column]:
        return [u[i] - v[i] for i in range(3)]

    def cross(u: list[Column], v: list[Column]) -> list[Column]:
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def dot(u: list[Column], v: list[Column]) -> Column:
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    one, two, three = minus(b, a), minus(c, b), minus(d, c)
    left, right = cross(one, two), cross(two, three)
    x, y = dot(left, right), F.sqrt(dot(two, two)) * dot(one, right)
    return F.when((x != 0) | (y != 0), F.atan2(y, x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def linspace(start: Column | float, stop: Column | float, n: int) -> Column:
    first = F.lit(start)
    step = (F.lit(stop) - first) / (n - 1) if n > 1 else F.lit(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i * step)


def ladder(low: Column | float, high: Column | float, n: int, geometric: bool = True) -> Column:
    """n inverse temperatures from low to high, numbers or columns of positive ones."""
    if not geometric or n == 1:
        return linspace(low, high, n)
    return F.transform(linspace(0.0, 1.0, n), lambda x: F.lit(low) * F.pow(F.lit(high) / F.lit(low), x))


def one_hot(label: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: (i == label).cast("int"))


def argmax(values: Column) -> Column:
    """The first place of the greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    raw = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))


def mismatches(a: Column, b: Column) -> Column:
    """In how many places two arrays of labels differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def in_rectangles(a: Column, b: Column, rules: list[tuple[float, float, float, float]]) -> Column:
    """Whether (a, b) lies in one of the rectangles (least a, most a, least b, most b; swapped bounds are put right);
    no rule lets all pass, NaN and null fail every rule (F10)."""
    out = F.lit(not rules)
    for a0, a1, b0, b1 in rules:
        out = out | (a.between(min(a0, a1), max(a0, a1)) & b.between(min(b0, b1), max(b0, b1)))
    return F.coalesce(out & (F.lit(not rules) | ~(F.isnan(a) | F.isnan(b))), F.lit(False))


def interpolated(x0: Column, y0: Column, x1: Column, y1: Column, y: Column | float) -> Column:
    """Where the line from (x0, y0) to (x1, y1) reaches y."""
    y = F.lit(y) if isinstance(y, float) else y
    return F.when(y1 == y0, x1).otherwise(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
