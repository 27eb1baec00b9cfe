"""Level-of-detail roll-up: each tile keeps a target number of splats, all tiles of a depth at once.

Rows carry ``node`` (the tile), ``o1``/``o2`` (row order: child's rank and slot, or 0 and splat_id) and the splat columns.
Everything is grouped by (node, voxel) or (node, slot), and places within a tile come from range partitions, so a tile of any
size is spread over tasks.  The search for rows to keep moves the columns of NARROW only; splats join again where they are
merged.  Ties compare exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..streaming.checkpoint import Tables
from .kdtree import BROADCAST_ROWS

MAX_REGRID = 24
LOW_RANK = 0.94
NARROW = ("node", "voxel", "o1", "o2", "x", "y", "z", "radius", "weight")


def sized(table: DataFrame, n: int) -> DataFrame:
    """Broadcast if its n rows are few."""
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def place(rows: DataFrame, order: list, keep) -> DataFrame:
    """Adds ``slot``, a row's place (from 0) in its node by ``order``, and ``total``, the node's rows.

    Rows are sorted over range partitions of (node, order) and numbered there; a table of (node, partition), with at most as
    many rows as there are nodes and partitions, turns numbers into places.
    """
    keys = {f"__k{k}": c for k, c in enumerate(order)}
    by = ["node", *keys]
    at = keep(rows.withColumns(keys).repartitionByRange(*by).sortWithinPartitions(*by).drop(*keys).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    found = sorted(tuple(r) for r in at.groupBy("node", "__part").agg(F.min("__at"), F.count(F.lit(1))).collect())
    total: dict[int, int] = {}
    base = []
    for node, part, first, n in found:
        base.append((node, part, total.get(node, 0) - first))
        total[node] = total.get(node, 0) + n
    offsets = rows.sparkSession.createDataFrame([(*b, total[b[0]]) for b in base], "node int, __part long, __base long, total long")
    return at.join(sized(offsets, len(base)), ["node", "__part"]).withColumn("slot", F.col("__at") + F.col("__base")).drop("__at", "__part", "__base")


def grid_dims(extent, target: int) -> list[int]:
    """Voxels along each axis for about ``target`` voxels."""
    e = [max(v, 1e-6) for v in extent]
    side = target ** (1 / 3)
    dims = [max(1, round(side * v / max(e))) for v in e]
    again = (target / math.prod(dims)) ** (1 / 3)
    return [max(1, round(d * again)) for d in dims]


def with_voxel(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Adds voxel, weight and radius; grid: node, low_x.., ext_x.., d0, d1, d2, diag (of a voxel), target."""
    at = rows.join(grid, "node")
    u = [C.clamp((C.num(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"ext_{c}"), F.lit(1e-6)), 0.0, 0.999999) for c in "xyz"]
    i, j, k = (F.floor(v * F.col(f"d{n}")).cast("long") for n, v in enumerate(u))
    at = at.withColumn("voxel", i + F.col("d0") * (j + F.col("d1") * k))
    at = at.withColumn("radius", C.radius().cast("float"))
    weight = F.greatest(C.num("opacity"), F.lit(1e-4)) * F.sqrt(F.greatest(C.num("radius") / F.col("diag"), F.lit(0.35)))
    return at.withColumn("weight", F.greatest(weight, F.lit(1e-12)))


def occupancy(at: DataFrame) -> DataFrame:
    return at.select("node", "voxel").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("occupied"))


def fit_grid(rows: DataFrame, tiles: list[dict]) -> tuple[DataFrame, list[dict]]:
    """Shrinks each tile's grid by 0.85 until its occupied voxels are at most its target; counts after every change."""
    spark = rows.sparkSession
    for t in tiles:
        t["dims"] = grid_dims(t["ext"], t["target"])
        t["occupied"] = None

    def table(some: list[dict]) -> DataFrame:
        out = []
        for t in some:
            size = [e / d for e, d in zip(t["ext"], t["dims"])]
            out.append((t["node"], *map(float, t["low"]), *map(float, t["ext"]), *t["dims"], max(math.sqrt(sum(float(v) ** 2 for v in size)), 1e-12), t["target"]))
        return sized(spark.createDataFrame(out, "node int, low_x double, low_y double, low_z double, ext_x double, ext_y double, ext_z double, d0 long, d1 long, d2 long, diag double, target long"), len(out))

    open_tiles = tiles
    for _ in range(MAX_REGRID):
        counts = {r.node: r.occupied for r in occupancy(with_voxel(rows, table(open_tiles))).collect()}
        for t in open_tiles:
            t["occupied"] = counts.get(t["node"], 0)
        open_tiles = [t for t in open_tiles if t["occupied"] > t["target"] and t["dims"] != [1, 1, 1]]
        if not open_tiles:
            break
        for t in open_tiles:
            t["dims"] = [max(1, int(0.85 * d)) for d in t["dims"]]
    return table(tiles), tiles


def representatives(at: DataFrame) -> DataFrame:
    """rank 1: the row nearest to its voxel's weighted centre (less a share of its radius); 2: the same without it; 3: the rest."""
    # Sums in row order: the same rows give the same sums, and all windows share one sort.
    cell = Window.partitionBy("node", "voxel").orderBy("o1", "o2").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = at.select(*NARROW, "diag", "target")

    def best(sx, sy, sz, sw, among=None):
        d = [C.num(c) - s / sw for c, s in zip("xyz", (sx, sy, sz))]
        cost = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - 0.15 * C.num("radius") * C.num("radius")) / F.greatest(F.col("diag") * F.col("diag"), F.lit(1e-12))
        row = F.struct(cost.alias("cost"), (-F.col("weight")).alias("w"), (-C.num("radius")).alias("r"), "o1", "o2", *[C.num(c).alias(c) for c in "xyz"])
        return F.min(row if among is None else F.when(among, row)).over(cell)

    def is_row(name):
        return (F.col(f"{name}.o1") == F.col("o1")) & (F.col(f"{name}.o2") == F.col("o2"))

    at = at.withColumns({"__w": F.sum("weight").over(cell), **{f"__{c}": F.sum(F.col("weight") * C.num(c)).over(cell) for c in "xyz"}})
    at = at.withColumn("__1", best(*(F.col(f"__{c}") for c in "xyz"), F.col("__w")))
    rest = F.greatest(F.col("__w") + F.col("__1.w"), F.lit(1e-12))
    at = at.withColumn("__2", best(*(F.col(f"__{c}") + F.col("__1.w") * F.col(f"__1.{c}") for c in "xyz"), rest, ~is_row("__1")))
    rank = F.when(is_row("__1"), 1).when(is_row("__2"), 2).otherwise(3)
    return at.withColumn("rank", rank).drop("__w", "__x", "__y", "__z", "__1", "__2", "diag")


def select(at: DataFrame, keep=None) -> DataFrame:
    """The rows that stay, with their slot: representatives by voxel, then second candidates by weight, then the rest by
    weight, radius and later row, to the tile's target."""
    keep = keep or Tables(at.sparkSession, "lod")
    return chosen(keep(representatives(at)), keep)


def chosen(ranked: DataFrame, keep) -> DataFrame:
    """``select`` of stored representatives: a range partition reads its rows twice, for its bounds and to deal them."""
    key = F.when(F.col("rank") == 1, F.col("voxel").cast("double")).otherwise(-F.col("weight"))
    last = F.col("rank") > 2
    order = [F.col("rank"), key, F.when(last, -C.num("radius")), F.when(last, -F.col("o1")).otherwise(F.col("o1")), F.when(last, -F.col("o2")).otherwise(F.col("o2"))]
    return place(ranked, order, keep).filter("slot < target")


def assign(at: DataFrame, kept: DataFrame) -> DataFrame:
    """Each row's slot, and where its kept row lies: the one of its voxel with least distance plus radius, the first in row
    order if equal.  A voxel's kept rows are one array, so that a row meets them where it is and pairs are not sorted."""
    rep = F.struct("slot", *[C.num(c).alias(f"r{c}") for c in "xyz"], C.num("radius").alias("rr"), F.col("o1").alias("k1"), F.col("o2").alias("k2"))
    reps = kept.groupBy("node", "voxel").agg(F.collect_list(rep).alias("__reps"))

    def scored(r):
        d = [C.num(c) - r[f"r{c}"] for c in "xyz"]
        score = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + r["rr"]
        return F.struct(score.alias("s"), r["k1"].alias("k1"), r["k2"].alias("k2"), *[r[c].alias(c) for c in ("slot", "rx", "ry", "rz")])

    near = at.select(*NARROW).join(reps, ["node", "voxel"]).select(*NARROW, F.array_min(F.transform("__reps", scored)).alias("__r"))
    return near.select(*NARROW, *[F.col(f"__r.{c}").alias(c) for c in ("slot", "rx", "ry", "rz")])


def eigen_to_scale_quat(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log scales and unit quaternions (w >= 0) of symmetric matrices; eigenvalues are at least 1e-20, largest first."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[:, ::-1], 1e-20), vectors[:, :, ::-1].copy()
    vectors[:, :, 2] *= np.sign(np.linalg.det(vectors))[:, None]
    m = vectors
    trace = np.stack([1 + m[:, 0, 0] - m[:, 1, 1] - m[:, 2, 2], 1 - m[:, 0, 0] + m[:, 1, 1] - m[:, 2, 2], 1 - m[:, 0, 0] - m[:, 1, 1] + m[:, 2, 2], 1 + m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]], 1)
    # Four forms of the same quaternion, each scaled by one of its components; the largest one is the most exact.
    a, b, c = m[:, 2, 1], m[:, 0, 2], m[:, 1, 0]
    d, e, f = m[:, 1, 2], m[:, 2, 0], m[:, 0, 1]
    forms = np.stack([np.stack([trace[:, 0], c + f, b + e, a - d], 1), np.stack([c + f, trace[:, 1], a + d, b - e], 1), np.stack([b + e, a + d, trace[:, 2], c - f], 1), np.stack([a - d, b - e, c - f, trace[:, 3]], 1)], 1)
    q = forms[np.arange(len(m)), np.argmax(trace, 1)]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return 0.5 * np.log(values), np.where(q[:, 3:] < 0, -q, q)


def merged(rows: DataFrame, assigned: DataFrame, n_sh: int) -> DataFrame:
    """node, slot, members and the splat that has the members' weighted mean and covariance; a single member stays as it is.

    One aggregation: second moments are taken about the kept row, which lies among the members, and moved to the mean.
    """
    at = rows.select("node", "o1", "o2", *C.CORE, "sh").join(assigned.select("node", "o1", "o2", "slot", "weight", "rx", "ry", "rz"), ["node", "o1", "o2"])
    own = dict(zip(("xx", "xy", "xz", "yy", "yz", "zz"), C.covariance()))
    w, one = F.col("weight"), F.col("members") == 1
    u = {c: C.num(c) - F.col(f"r{c}") for c in "xyz"}
    shape_of = ("s0", "s1", "s2", "qx", "qy", "qz", "qw")
    sums = [F.count(F.lit(1)).alias("members"), F.sum(w).alias("__w")]
    sums += [F.sum(w * C.num(c)).alias(f"__{c}") for c in "xyz"] + [F.sum(w * u[c]).alias(f"__u{c}") for c in "xyz"] + [F.first(f"r{c}").alias(f"r{c}") for c in "xyz"]
    sums += [F.sum(w * (own[p] + u[p[0]] * u[p[1]])).alias(p) for p in own] + [F.sum(w * C.num("opacity")).alias("__o")]
    sums += [F.first(c).alias(f"__{c}1") for c in (*shape_of, "opacity")] + [F.sum(w * F.col("sh")[k]).alias(f"__sh{k}") for k in range(n_sh)]
    table = at.groupBy("node", "slot").agg(*sums)
    mean = {c: (F.col(f"__{c}") / F.col("__w")).cast("float") for c in "xyz"}
    e = {c: C.num(F.col(c)) - F.col(f"r{c}") for c in "xyz"}
    opacity = F.when(one, F.col("__opacity1")).otherwise(C.clamp(F.col("__o") / F.col("__w"), 0.0, 1.0).cast("float"))
    table = table.withColumns({**mean, "opacity": opacity, "sh": F.array(*[(F.col(f"__sh{k}") / F.col("__w")).cast("float") for k in range(n_sh)])})
    moved = {p: F.col(p) / F.col("__w") - (e[p[0]] * F.col(f"__u{p[1]}") + F.col(f"__u{p[0]}") * e[p[1]]) / F.col("__w") + e[p[0]] * e[p[1]] for p in own}

    @F.pandas_udf("s0 float, s1 float, s2 float, qx float, qy float, qz float, qw float")
    def shape(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([np.maximum(xx, 1e-20), xy, xz], 1), np.stack([xy, np.maximum(yy, 1e-20), yz], 1), np.stack([xz, yz, np.maximum(zz, 1e-20)], 1)], 1)
        odd = ~np.isfinite(m).all((1, 2))
        m[odd] = np.eye(3)
        scale, quat = eigen_to_scale_quat(m)
        scale[odd] = np.nan
        return pd.DataFrame(np.concatenate([scale, quat], 1).astype(np.float32), columns=list(shape_of))

    made = table.withColumn("__f", shape(*moved.values()))
    return made.select("node", "slot", "members", *[F.when(one, F.col(f"__{c}1")).otherwise(F.col(f"__f.{c}")).alias(c) if c in shape_of else F.col(c) for c in C.CORE], "sh")


def simplify(rows: DataFrame, tiles: list[dict], mode: str = "merge", n_sh: int = 3, keep=None) -> tuple[DataFrame, DataFrame]:
    """Rows of tiles over their target become ``target`` rows with slots; and own_error per tile.

    tiles: dicts of node, target, low, ext.  rows are read several times; keep() writes a table and reads it back.
    """
    keep = keep or Tables(rows.sparkSession, "lod")
    grid, _ = fit_grid(rows, tiles)
    at = with_voxel(rows.select("node", "o1", "o2", *C.CORE), grid)
    ranked = keep(representatives(at))
    kept = chosen(ranked, keep)
    assigned = keep(assign(ranked, kept))
    stay = kept.select("node", "o1", "o2", "slot")
    if mode == "merge":
        stay = stay.join(assigned.select("node", "slot").distinct(), ["node", "slot"], "left_anti")
    out = rows.join(stay, ["node", "o1", "o2"]).select("node", "slot", *C.CORE, "sh")
    if mode == "merge":
        out = out.unionByName(merged(rows, assigned, n_sh).drop("members"))
    out = keep(out.withColumn("radius", C.radius().cast("float")))
    return out, own_error(assigned, out, keep)


def own_error(assigned: DataFrame, out: DataFrame, keep=None) -> DataFrame:
    """The exact 95th percentile, by tile, of how far a row's 3-sigma ball reaches from its output's."""
    o = out.select("node", "slot", *[C.num(c).alias(f"t{c}") for c in "xyz"], C.num("radius").alias("tr"))
    d = [C.num(c) - F.col(f"t{c}") for c in "xyz"]
    error = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + C.num("radius") + F.col("tr")
    keep = keep or Tables(out.sparkSession, "lod")
    far = keep(assigned.join(o, ["node", "slot"]).select("node", error.alias("e")))
    # Rows under an estimate of a lower percentile are only counted; where it turns out too high, all rows are placed.
    low = far.groupBy("node").agg(F.percentile_approx("e", LOW_RANK, 1000).alias("low"))
    below = F.count_if(F.col("e").isNull() | (F.col("e") < F.col("low")))
    counts = [(r.node, r.low, r.below, r.n) for r in far.join(low, "node").groupBy("node", "low").agg(below.alias("below"), F.count(F.lit(1)).alias("n")).collect()]
    counts = [(node, low, below, n) if low is not None and below <= math.floor(0.95 * (n - 1)) else (node, None, 0, n) for node, low, below, n in counts]
    bounds = sized(out.sparkSession.createDataFrame(counts, "node int, low double, below long, n long"), len(counts))
    far = far.join(bounds, "node").filter(F.col("low").isNull() | (F.col("e") >= F.col("low"))).drop("low")
    far = place(far, [F.col("e")], keep).withColumn("slot", F.col("slot") + F.col("below"))
    at = 0.95 * (F.col("n") - 1)
    near = far.filter((F.col("slot") == F.floor(at)) | (F.col("slot") == F.ceil(at))).groupBy("node", "n").agg(F.min("e").alias("lo"), F.max("e").alias("hi"))
    return near.select("node", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("own_error"))
