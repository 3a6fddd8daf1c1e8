"""Inverting response curves: from a few (score, setting) points to the setting that meets a target score.

Points are an array of structs (score, setting), sorted by score. All methods are column arithmetic on that array, so a million curves are
a million rows of one projection: no Python, no shuffle beyond the one that gathers the points. Scores must rise strictly, else the
result is null; methods that do not extrapolate give null outside their range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(score: str = "score", setting: str = "setting") -> Column:
    """Aggregate: the array that the methods take."""
    return F.sort_array(F.collect_list(F.struct(F.col(score).cast("double").alias("score"), F.col(setting).cast("double").alias("setting"))))


def _xy(p: Column, n: int) -> tuple[list[Column], list[Column]]:
    return [F.get(p, F.lit(i))["score"] for i in range(n)], [F.get(p, F.lit(i))["setting"] for i in range(n)]


def _rising(x: list[Column]) -> Column:
    test = x[0].isNotNull()
    for a, b in zip(x, x[1:], strict=False):
        test = test & (a < b)
    return test


def _guarded(x: list[Column], t: Column, value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    test = _rising(x)
    if low is not None:
        test = test & (t >= low) & (t <= high)
    return F.when(test, value)


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def linear(p: Column, t: Column) -> Column:
    """Through the two lowest scores; extrapolates."""
    x, y = _xy(p, 2)
    return _guarded(x, t, y[0] + (t - x[0]) * _over(y[1] - y[0], x[1] - x[0]))


def _lagrange(x: list[Column], y: list[Column], t: Column) -> Column:
    total = None
    for i, yi in enumerate(y):
        term = yi
        for j, xj in enumerate(x):
            if j != i:
                term = term * _over(t - xj, x[i] - xj)
        total = term if total is None else total + term
    return total


def quadratic(p: Column, t: Column) -> Column:
    """Lagrange through three points."""
    x, y = _xy(p, 3)
    return _guarded(x, t, _lagrange(x, y, t), x[0], x[2])


def cubic(p: Column, t: Column) -> Column:
    """Lagrange through four points."""
    x, y = _xy(p, 4)
    return _guarded(x, t, _lagrange(x, y, t), x[0], x[3])


def _in_interval(x: list[Column], t: Column, pieces: list[Column]) -> Column:
    """The piece of the first interval that holds t; the first one outside."""
    out = F.when((t >= x[0]) & (t <= x[1]), pieces[0])
    for i in range(1, len(pieces)):
        out = out.when((t >= x[i]) & (t <= x[i + 1]), pieces[i])
    return out.otherwise(pieces[0])


def natural(p: Column, t: Column) -> Column:
    """Natural cubic spline through three or four points, its second derivatives in closed form."""

    def spline(n: int) -> Column:
        x, y = _xy(p, n)
        h = [b - a for a, b in zip(x, x[1:], strict=False)]
        s = [_over(y[i + 1] - y[i], h[i]) for i in range(n - 1)]
        d = [3.0 * (s[i] - s[i - 1]) for i in range(1, n - 1)]
        zero = F.lit(0.0)
        if n == 3:
            m = [zero, _over(d[0], 2.0 * (h[0] + h[1])), zero]
        else:
            a, b = 2.0 * (h[0] + h[1]), 2.0 * (h[1] + h[2])
            det = a * b - h[1] * h[1]
            m = [zero, _over(d[0] * b - h[1] * d[1], det), _over(a * d[1] - h[1] * d[0], det), zero]
        pieces = []
        for k in range(n - 1):
            u = t - x[k]
            pieces.append(y[k] + (s[k] - h[k] * (2.0 * m[k] + m[k + 1]) / 3.0) * u + m[k] * u * u + _over(m[k + 1] - m[k], 3.0 * h[k]) * u * u * u)
        return _guarded(x, t, _in_interval(x, t, pieces), x[0], x[n - 1])

    return F.when(F.size(p) >= 4, spline(4)).otherwise(spline(3))


def _hermite(u: Column, h: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    """Cubic between two points with given slopes; u runs from 0 to 1."""
    v = 1.0 - u
    return y0 * (1.0 + 2.0 * u) * v * v + h * d0 * u * v * v + y1 * u * u * (3.0 - 2.0 * u) - h * d1 * u * u * v


def _hermite_pieces(x: list[Column], y: list[Column], d: list[Column], t: Column) -> Column:
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    return _in_interval(x, t, [_hermite(_over(t - x[k], h[k]), h[k], y[k], y[k + 1], d[k], d[k + 1]) for k in range(len(h))])


def pchip(p: Column, t: Column) -> Column:
    """Monotone cubic through four points: weighted harmonic slopes, limited left to right to a circle of radius 3; extrapolates with the first piece."""
    x, y = _xy(p, 4)
    h = [b - a for a, b in zip(x, x[1:], strict=False)]
    s = [_over(y[i + 1] - y[i], h[i]) for i in range(3)]

    def inner(i: int) -> Column:
        w1, w2 = 2.0 * h[i] + h[i - 1], h[i] + 2.0 * h[i - 1]
        return F.when(s[i - 1] * s[i] <= 0, 0.0).otherwise(_over(w1 + w2, _over(w1, s[i - 1]) + _over(w2, s[i])))

    def shrunk(z: Column, i: int) -> Column:
        """The slopes z after interval i: both ends to zero on a level piece, else drawn into the circle."""
        a, b = _over(z[f"d{i}"], z[f"s{i}"]), _over(z[f"d{i + 1}"], z[f"s{i}"])
        radius = F.sqrt(a * a + b * b)

        def end(j: int) -> Column:
            d = z[f"d{j}"]
            return F.when(z[f"s{i}"] == 0, 0.0).when(radius > 3.0, d * _over(F.lit(3.0), radius)).otherwise(d) if j in (i, i + 1) else d

        return F.struct(*(end(j).alias(f"d{j}") for j in range(4)), *(z[f"s{j}"].alias(f"s{j}") for j in range(3)))

    def limited(slopes: Column) -> Column:
        for step in (lambda z: shrunk(z, 0), lambda z: shrunk(z, 1), lambda z: shrunk(z, 2)):
            slopes = F.transform(F.array(slopes), step)[0]
        return slopes

    start = F.struct(s[0].alias("d0"), inner(1).alias("d1"), inner(2).alias("d2"), s[2].alias("d3"), *(s[j].alias(f"s{j}") for j in range(3)))
    value = F.transform(F.array(limited(start)), lambda z: _hermite_pieces(x, y, [z[f"d{j}"] for j in range(4)], t))[0]
    return _guarded(x, t, value)


def catmull_rom(p: Column, t: Column) -> Column:
    """Between the two inner of four points, tension one half."""
    x, y = _xy(p, 4)
    d1, d2 = 0.5 * _over(y[2] - y[0], x[2] - x[0]), 0.5 * _over(y[3] - y[1], x[3] - x[1])
    h = x[2] - x[1]
    return _guarded(x, t, _hermite(_over(t - x[1], h), h, y[1], y[2], d1, d2), x[1], x[2])


def akima(p: Column, t: Column) -> Column:
    """Four points; with so few, both neighbours of an inner point weigh the same."""
    x, y = _xy(p, 4)
    s = [_over(y[i + 1] - y[i], x[i + 1] - x[i]) for i in range(3)]
    d = [s[0], (s[0] + s[1]) / 2.0, (s[1] + s[2]) / 2.0, s[2]]
    return _guarded(x, t, _hermite_pieces(x, y, d, t), x[0], x[3])


METHODS = {"linear": linear, "quadratic": quadratic, "natural": natural, "pchip": pchip, "catmull": catmull_rom, "akima": akima, "cubic": cubic}


def recommended(p: Column, low: Column, high: Column, target: Column, step: Column, method_3: Column | str = "natural", method_4: Column | str = "pchip") -> Column:
    """The next setting to measure, given sorted points and the limits that are left.

    0, 1 and more than 4 points: the middle of the limits; 2: linear; 3 and 4: the chosen method. Where a method has no answer, the middle again. The
    result is snapped to step and held in the limits.
    """
    n = F.size(p)

    def chosen(method: Column | str, default: str, names: tuple[str, ...]) -> Column:
        """The answer of the method named; a name that is known now leaves the others out of the expression."""
        if isinstance(method, str):
            return METHODS[method](p, target)
        out = F.when(F.lit(False), 0.0)
        for name in names:
            out = out.when(F.coalesce(method, F.lit(default)) == name, METHODS[name](p, target))
        return out

    three, four = chosen(method_3, "natural", ("linear", "quadratic", "natural")), chosen(method_4, "pchip", tuple(METHODS))
    found = F.when(n == 2, linear(p, target)).when(n == 3, three).when(n == 4, four)
    middle = (low + high) / 2.0
    return F.least(F.greatest(F.round(F.coalesce(found, middle) / step) * step, low), high)
