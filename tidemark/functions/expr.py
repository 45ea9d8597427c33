"""Column builders that several operators share. None computes rows; Catalyst sees plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = "series_id"
YEAR = 252


def series(order: str = "pos") -> WindowSpec:
    return Window.partitionBy(SERIES).orderBy(order)


def trailing(k: int) -> WindowSpec:
    """The last k rows of a series, the current one included."""
    return series().rowsBetween(1 - k, 0)


def ahead(h: int) -> WindowSpec:
    """The next h rows of a series, without the current one."""
    return series().rowsBetween(1, h)


def whole() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, agg: Column, frame: WindowSpec, k: int) -> Column:
    """agg over the frame where it holds k values, else null."""
    return F.when(F.count(value).over(frame) == k, agg.over(frame))


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x held in [low, high]; null stays null, which greatest and least alone would not do."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(x.isNotNull(), F.least(F.greatest(x, wrap(low)), wrap(high)))


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def logit(p: Column) -> Column:
    return F.ln(p) - F.log1p(-p)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


#: Fixed coefficients: rational approximation of the normal tail (Abramowitz and Stegun 26.2.17), error below 7.5e-8.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
TAIL_AT = 0.2316419


def phi(x: Column) -> Column:
    """The normal distribution function, to within 7.5e-8; neither Spark SQL nor DuckDB has one."""
    t = 1 / (1 + F.lit(TAIL_AT) * F.abs(x))
    poly = reduce(lambda acc, c: (acc + F.lit(c)) * t, reversed(TAIL), F.lit(0.0))
    tail = F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def wilson(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Interval of a share p of an effective number n of trials, held in [0, 1]; null without trials."""
    zz = z * z
    middle, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    scale = 1 + zz / n
    guard = F.when(n > 0, 1)
    return guard * F.greatest(F.lit(0.0), (middle - spread) / scale), guard * F.least(F.lit(1.0), (middle + spread) / scale)


def path_key(*columns: str) -> Column:
    """One string for several columns, whatever they hold; ``path_part`` gives them back."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))


def path_part(key: str, i: int) -> Column:
    return F.from_json(F.col(key), "array<string>")[i]


def runs(flag: Column, order: WindowSpec) -> Column:
    """A number for each run of equal values, rising along the order."""
    change = F.when(flag.eqNullSafe(F.lag(flag).over(order)), 0).otherwise(1)
    return change
