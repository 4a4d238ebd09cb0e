"""Column functions on arrays of doubles. Null arrays give null; nothing here raises on bad data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str | Sequence[float]


def col(v: Vec) -> Column:
    """A column, or a Python sequence as an array literal, of doubles."""
    if isinstance(v, (str, Column)):
        return (F.col(v) if isinstance(v, str) else v).cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")


def total(v: Vec) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)


def zipped(a: Vec, b: Vec, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(col(a), col(b), f)


def dot(a: Vec, b: Vec) -> Column:
    return total(zipped(a, b, lambda x, y: x * y))


def l2sq(a: Vec, b: Vec) -> Column:
    """Squared Euclidean distance; null when lengths differ."""
    return total(zipped(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a: Vec, b: Vec) -> Column:
    return F.sqrt(l2sq(a, b))


def l1(a: Vec, b: Vec) -> Column:
    return total(zipped(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Vec, b: Vec) -> Column:
    """Greatest difference; null when lengths differ or a value is null."""
    d = zipped(a, b, lambda x, y: F.abs(x - y))
    return F.when(~F.exists(d, lambda x: x.isNull()), F.array_max(d))


def lp(a: Vec, b: Vec, p: float) -> Column:
    return F.pow(total(zipped(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def distance(a: Vec, b: Vec, norm: str | float = "l2sq") -> Column:
    known = {"l2sq": l2sq, "l2": l2, "l1": l1, "linf": linf}
    return known[norm](a, b) if isinstance(norm, str) else lp(a, b, norm)


def norm(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def mean(v: Vec) -> Column:
    return F.try_divide(total(v), F.size(col(v)).cast("double"))


def pearson(a: Vec, b: Vec) -> Column:
    """Pearson correlation; null when lengths differ or either side does not vary."""
    ca, cb = col(a), col(b)
    n = F.size(ca).cast("double")
    sa, sb = total(ca), total(cb)
    up = n * dot(ca, cb) - sa * sb
    down = F.sqrt((n * dot(ca, ca) - sa * sa) * (n * dot(cb, cb) - sb * sb))
    return F.when(F.size(ca) == F.size(cb), F.try_divide(up, down))


def piece(v: Vec, start: int, length: int) -> Column:
    """``length`` values from the 0-based position ``start``."""
    return F.slice(col(v), start + 1, length)


def argmax(v: Vec) -> Column:
    """0-based position of the first maximum."""
    c = col(v)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def bin_index(x: Column, low: float, high: float, n: int) -> Column:
    """Equal-width bin 0..n-1 of ``x`` over [low, high], clamped at both ends."""
    return clamp(F.floor((x - F.lit(float(low))) / F.lit((high - low) / n)), 0, n - 1).cast("int")


def bin_middle(i: Column, low: float, high: float, n: int) -> Column:
    return F.lit(float(low)) + (i + F.lit(0.5).cast("double")) * F.lit((high - low) / n)
