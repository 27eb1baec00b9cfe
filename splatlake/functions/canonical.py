"""Canonical splat columns from raw ones, and what follows from a splat's scale and rotation.

Splat schema: splat_id BIGINT, x y z s0 s1 s2 qx qy qz qw opacity FLOAT, sh ARRAY<FLOAT> (3, 12, 27 or 48).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORE = ("x", "y", "z", "s0", "s1", "s2", "qx", "qy", "qz", "qw", "opacity")
SPLAT = ("splat_id", *CORE, "sh")


def num(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v) if isinstance(v, (int, float)) else F.col(v)).cast("double")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def sigmoid(v) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(num(v), -60.0, 60.0)))


def opacity(v, convention: str = "graphdeco") -> Column:
    return sigmoid(v) if convention == "graphdeco" else clamp(num(v), 0.0, 1.0)


def log_scale(v) -> Column:
    return F.ln(F.greatest(num(v), F.lit(1e-8)))


def quaternion(r: list, convention: str = "graphdeco") -> list[Column]:
    """x, y, z, w of unit length with w >= 0; graphdeco stores w first."""
    w, x, y, z = (num(c) for c in r) if convention == "graphdeco" else (num(r[k]) for k in (3, 0, 1, 2))
    length = F.sqrt(x * x + y * y + z * z + w * w)
    length = F.when(length < 1e-12, 1.0).otherwise(length)
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    return [c / length * sign for c in (x, y, z, w)]


def sh_order(degree: int) -> list[tuple[str, int]]:
    """Source of each of the coefficient-major values: ('dc', channel) or ('rest', index)."""
    extra = (degree + 1) ** 2 - 1
    out = [("dc", c) for c in range(3)]
    for k in range(extra):
        out += [("rest", c * extra + k) for c in range(3)]
    return out


def sh_degree(n_rest: int) -> int:
    # Number of f_rest properties by degree.
    counts = (0, 9, 24, 45)
    if n_rest not in counts:
        raise ValueError(f"{n_rest} f_rest properties; 0, 9, 24 or 45 are possible")
    return counts.index(n_rest)


def canonicalise(raw: DataFrame, convention: str = "graphdeco", linear_scale: bool = False) -> DataFrame:
    """Raw columns x y z op_logit s0..2 r0..3 f_dc_0..2 f_rest_* (and splat_id) to the splat schema."""
    rest = sorted((c for c in raw.columns if c.startswith("f_rest_")), key=lambda c: int(c[7:]))
    degree = sh_degree(len(rest))
    quat = quaternion(["r0", "r1", "r2", "r3"], convention)
    sh = [F.col(f"f_dc_{k}" if kind == "dc" else rest[k]).cast("float") for kind, k in sh_order(degree)]
    scale = [log_scale(s) if linear_scale else F.col(s) for s in ("s0", "s1", "s2")]
    return raw.select("splat_id", *[F.col(c).cast("float").alias(c) for c in "xyz"], *[s.cast("float").alias(f"s{k}") for k, s in enumerate(scale)], *[q.cast("float").alias(n) for q, n in zip(quat, ("qx", "qy", "qz", "qw"))], opacity("op_logit", convention).cast("float").alias("opacity"), F.array(*sh).alias("sh"))


def rotation(qx="qx", qy="qy", qz="qz", qw="qw") -> list[list[Column]]:
    """Rotation matrix of a normalised quaternion; a zero one is the identity."""
    x, y, z, w = (num(c) for c in (qx, qy, qz, qw))
    n = F.sqrt(x * x + y * y + z * z + w * w)
    zero = n < 1e-12
    n = F.when(zero, 1.0).otherwise(n)
    x, y, z, w = x / n, y / n, z / n, F.when(zero, 1.0).otherwise(w / n)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def covariance() -> list[Column]:
    """xx, xy, xz, yy, yz, zz of R S^2 R^T."""
    r = rotation()
    s = [F.exp(2.0 * num(f"s{k}")) for k in range(3)]
    return [r[i][0] * r[j][0] * s[0] + r[i][1] * r[j][1] * s[1] + r[i][2] * r[j][2] * s[2] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def extents() -> list[Column]:
    """Half extents of the 3-sigma box, as floats."""
    c = covariance()
    return [(3.0 * F.sqrt(F.greatest(c[k], F.lit(1e-20)))).cast("float") for k in (0, 3, 5)]


def radius() -> Column:
    """Length of the 3-sigma half extents; the trace of the covariance does not depend on the rotation."""
    return 3.0 * F.sqrt(sum((F.exp(2.0 * num(f"s{k}")) for k in range(1, 3)), F.exp(2.0 * num("s0"))))


def split_weight() -> Column:
    """Opacity times the squared radius; 1 where that is not a positive number."""
    e = [num(v) for v in extents()]
    w = F.greatest(num("opacity"), F.lit(1e-4)) * (e[0] * e[0] + e[1] * e[1] + e[2] * e[2])
    return F.when((w > 0) & (w < float("inf")), w).otherwise(1.0)


def bounds() -> list[Column]:
    """Aggregates: minimum and maximum of the positions; a NaN does not count."""
    return [f(F.when(~F.isnan(c), num(c))).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"]


def bounds_3sigma() -> list[Column]:
    e = dict(zip("xyz", extents()))
    return [F.min(num(c) - num(e[c])).alias(f"min_{c}") for c in "xyz"] + [F.max(num(c) + num(e[c])).alias(f"max_{c}") for c in "xyz"]


def slot(direction, offset) -> Column:
    """1 where the projection reaches the plane's offset, else 0; a NaN goes to 0."""
    p = sum((num(c) * d for c, d in zip("yz", direction[1:])), num("x") * direction[0])
    return F.when(~F.isnan(p) & (p >= offset), 1).otherwise(0)


def histogram_bin(p: Column, low: Column, extent: Column, bins: int = 128) -> Column:
    return clamp(F.floor((p - low) / extent * float(bins)), 0, bins - 1).cast("int")
