"""Scalar expressions over hits, edges and vectors; all of them Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """NaN, infinities and nulls become 0."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == INF), F.lit(0.0)).otherwise(c)


def scaled(c: Column, scale: float) -> Column:
    return c / F.lit(float(scale))


def radius2(r: Column, z: Column) -> Column:
    return r * r + z * z


def pseudorapidity(r: Column, z: Column) -> Column:
    """-log(tan(theta / 2)); infinite on the axis."""
    half = F.tan(F.atan2(r, z) / 2)
    return F.when(r == 0, F.when(z > 0, F.lit(INF)).when(z < 0, F.lit(-INF)).otherwise(F.lit(INF))).otherwise(-F.log(half))


def cylindrical(x: Column, y: Column, z: Column) -> dict[str, Column]:
    r = F.sqrt(x * x + y * y)
    return {"r": r, "phi": F.atan2(y, x), "z": z, "eta": pseudorapidity(r, z)}


def wrapped(angle: Column) -> Column:
    """One turn back into [-pi, pi]; the ends stay."""
    return F.when(angle > F.pi(), angle - 2 * F.pi()).when(angle < -F.pi(), angle + 2 * F.pi()).otherwise(angle)


def slope(dphi: Column, dr: Column) -> Column:
    """dphi / dr between -100 and 100; 0/0 is 0."""
    flat = F.when(dphi > 0, F.lit(100.0)).when(dphi < 0, F.lit(-100.0)).otherwise(F.lit(0.0))
    return F.when(dr == 0, flat).otherwise(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.try_divide(dphi, dr))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once; inside a lambda an expression is worked out for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalised(v: Column) -> Column:
    """Unit length; lengths below 1e-12 count as 1e-12."""
    return bound(F.greatest(norm(v), F.lit(1e-12)), lambda length: F.transform(v, lambda x: x / length))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit (biased) variance within a vector."""
    n = F.nullif(F.size(v), F.lit(0))  # an empty vector stays empty
    variance = lambda mean: F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    scaled = lambda mean: bound(F.sqrt(variance(mean) + eps), lambda width: F.transform(v, lambda x: (x - mean) / width))
    return bound(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n, scaled)


def edge_features(prefix_src: str = "s_", prefix_dst: str = "d_") -> dict[str, Column]:
    """The six edge features of scaled end points: dr, dphi, dz, deta, phislope, rphislope."""
    s, d = (lambda c, p=p: F.col(p + c) for p in (prefix_src, prefix_dst))
    dr, dphi = d("r") - s("r"), wrapped((d("phi") - s("phi")) * F.pi()) / F.pi()
    steep = slope(dphi, dr)
    rphi = (d("r") + s("r")) / 2 * steep
    return {"dr": dr, "dphi": dphi, "dz": d("z") - s("z"), "deta": d("eta") - s("eta"), "phislope": steep, "rphislope": F.when(F.isnan(rphi), F.lit(0.0)).otherwise(rphi)}
