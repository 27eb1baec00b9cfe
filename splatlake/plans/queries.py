"""Registered queries of the tiling engine over the stand-in clouds, and their DuckDB SQL.

``cloud0`` (degree 0) comes from ``events``, ``cloud3`` (degree 3) from ``embeddings``.  Floating sums depend on their
order, so both sides round them to 6 places.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import spz
from ..operators import lod
from ..streaming.checkpoint import Tables, shared_dir
from .options import TilingOptions, apportion, auto_max_depth, auto_tile_refinement, depth_target, enu_matrix, geometric_error

GRID, KEPT = 5, 200
#: Fixed planes of a three-level tree: path, axis, offset.
PLANES = (("", "y", 35.0), ("0", "z", 15.0), ("1", "x", 75.0), ("00", "y", 12.0), ("01", "x", 40.0), ("11", "z", 10.0))


def r6(c: Column) -> Column:
    """Rounded to 6 places; adding 0.0 makes a negative zero positive."""
    return F.round(c, 6) + F.lit(0.0)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw0(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    i = F.col("event_id")
    f = lambda c: c.cast("float")
    m = lambda k: F.pmod(i, F.lit(k))
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(86400000000.0)
    return e.select(
        i.alias("splat_id"), f(F.col("user_id")).alias("x"), f(F.col("value")).alias("y"), f(days).alias("z"),
        f((m(7) - 3) / F.lit(2.0)).alias("op_logit"), f(-4.0 + m(5) / F.lit(4.0)).alias("s0"), f(F.lit(-4.5)).alias("s1"), f(F.lit(-3.5)).alias("s2"),
        f(m(3) - 1).alias("r0"), f(m(4)).alias("r1"), f(F.lit(1)).alias("r2"), f(m(2)).alias("r3"),
        *[f(m(5 + k) / F.lit(4.0) - 0.5).alias(f"f_dc_{k}") for k in range(3)],
    )


RAW0 = """raw0 AS (SELECT event_id AS splat_id, user_id::FLOAT AS x, value::FLOAT AS y, ((epoch_us(ts)-1704067200000000)/86400000000::DOUBLE)::FLOAT AS z,
 (((event_id%7)-3)/2.0::DOUBLE)::FLOAT AS op_logit, (-4.0::DOUBLE+(event_id%5)/4.0::DOUBLE)::FLOAT AS s0, (-4.5)::FLOAT AS s1, (-3.5)::FLOAT AS s2,
 (event_id%3-1)::FLOAT AS r0, (event_id%4)::FLOAT AS r1, 1::FLOAT AS r2, (event_id%2)::FLOAT AS r3,
 ((event_id%5)/4.0::DOUBLE-0.5)::FLOAT AS f_dc_0, ((event_id%6)/4.0::DOUBLE-0.5)::FLOAT AS f_dc_1, ((event_id%7)/4.0::DOUBLE-0.5)::FLOAT AS f_dc_2 FROM events)"""
CANON0 = RAW0 + """, len0 AS (SELECT *, sqrt(r1::DOUBLE*r1::DOUBLE+r2::DOUBLE*r2::DOUBLE+r3::DOUBLE*r3::DOUBLE+r0::DOUBLE*r0::DOUBLE) AS ql FROM raw0),
 cloud0 AS (SELECT splat_id, x, y, z, s0, s1, s2, (r1::DOUBLE/l*g)::FLOAT AS qx, (r2::DOUBLE/l*g)::FLOAT AS qy, (r3::DOUBLE/l*g)::FLOAT AS qz, (r0::DOUBLE/l*g)::FLOAT AS qw,
 (1.0::DOUBLE/(1.0::DOUBLE+exp(-least(greatest(op_logit::DOUBLE,-60.0),60.0))))::FLOAT AS opacity, f_dc_0, f_dc_1, f_dc_2
 FROM (SELECT *, CASE WHEN ql < 1e-12 THEN 1.0::DOUBLE ELSE ql END AS l, CASE WHEN r0 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM len0))"""


def cloud0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonicalise(raw0(spark, sf_dir))


def raw3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k]
    f = lambda c: c.cast("float")
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("splat_id"), *[f(10 * e(k)).alias(c) for k, c in enumerate("xyz")], f(4 * e(10)).alias("op_logit"), *[f(-4 + e(3 + k)).alias(f"s{k}") for k in range(3)],
        *[e(6 + k).alias(f"r{k}") for k in range(4)], *[e(11 + k).alias(f"f_dc_{k}") for k in range(3)], *[e(14 + k).alias(f"f_rest_{k}") for k in range(45)],
    )


def cloud3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.canonicalise(raw3(spark, sf_dir))


# Sources and projections.


def canonical_core(spark, sf_dir):
    return cloud0(spark, sf_dir).select("splat_id", *C.CORE[:-1], r6(C.num("opacity")).alias("opacity"))


def canonical_sh3(spark, sf_dir):
    return cloud3(spark, sf_dir).select("splat_id", F.posexplode("sh").alias("k", "v"))


def opacity_khr(spark, sf_dir):
    return raw0(spark, sf_dir).select("splat_id", C.opacity("op_logit", "khr_native").cast("float").alias("opacity"))


def log_scale(spark, sf_dir):
    return raw0(spark, sf_dir).select("splat_id", r6(C.log_scale(F.col("y") - 50)).alias("log_scale"))


def quat_normalise(spark, sf_dir):
    q = C.quaternion(["r0", "r1", "r2", "r3"], "khr_native")
    return raw0(spark, sf_dir).select("splat_id", *[r6(v).alias(n) for v, n in zip(q, ("qx", "qy", "qz", "qw"))])


def extents_3sigma(spark, sf_dir):
    return cloud0(spark, sf_dir).select("splat_id", *[F.round(C.num(e), 5).alias(f"e{c}") for e, c in zip(C.extents(), "xyz")])


def radius_3sigma(spark, sf_dir):
    return cloud0(spark, sf_dir).select("splat_id", r6(C.radius()).alias("radius"))


def covariance6(spark, sf_dir):
    return cloud0(spark, sf_dir).select("splat_id", *[(F.round(v, 9) + 0.0).alias(n) for v, n in zip(C.covariance(), ("xx", "xy", "xz", "yy", "yz", "zz"))])


def split_weight(spark, sf_dir):
    return cloud0(spark, sf_dir).select("splat_id", F.round(C.split_weight(), 5).alias("weight"))


def ply_round_trip(spark, sf_dir):
    """The cloud written as a PLY file in the shared folder and read back through the data source, in many partitions."""
    import uuid

    from ..sources import ply

    path = f"{shared_dir(spark)}/cloud-{uuid.uuid4().hex}.ply"
    system, at = ply.filesystem(path)
    system.create_dir(at.rsplit("/", 1)[0])
    ply.write_splats(cloud0(spark, sf_dir), path)
    back = ply.read_splats(spark, path)
    return back.select("splat_id", "x", "y", "z", "s0", "s1", "s2", *[(F.round(C.num(c), 5) + 0.0).alias(c) for c in ("qx", "qy", "qz", "qw", "opacity")], *[F.col("sh")[k].alias(f"sh{k}") for k in range(3)])


# Global aggregates.


def global_bounds(spark, sf_dir):
    return cloud0(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *C.bounds())


def weighted_moments(spark, sf_dir):
    w = C.num("opacity")
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    s = cloud0(spark, sf_dir).agg(F.sum(w).alias("w"), *[F.sum(w * C.num(c)).alias(c) for c in "xyz"], *[F.sum(w * C.num(p[0]) * C.num(p[1])).alias(p) for p in pairs])
    return s.select(F.round("w", 4).alias("w"), *[F.round(F.col(c) / F.col("w"), 4).alias(f"mean_{c}") for c in "xyz"], *[F.round(F.col(p) / F.col("w") - F.col(p[0]) * F.col(p[1]) / F.col("w") / F.col("w"), 3).alias(f"cov_{p}") for p in pairs])


def cloud_bounds_3sigma(spark, sf_dir):
    b = cloud0(spark, sf_dir).agg(*C.bounds_3sigma())
    return b.select(*[F.round(c, 4).alias(c) for c in b.columns])


# Split search.


def _binned(spark, sf_dir) -> DataFrame:
    cloud = cloud0(spark, sf_dir).select("splat_id", "x", "y", "z")
    b = cloud.agg(F.min(C.num("y")).alias("low"), (F.max(C.num("y")) - F.min(C.num("y"))).alias("extent"))
    # One row of bounds, on the same key as all rows.
    at = cloud.withColumn("k", F.lit(0)).join(F.broadcast(b.withColumn("k", F.lit(0))), "k")
    return at.withColumn("bin", C.histogram_bin(C.num("y"), F.col("low"), F.col("extent")))


def projection_histogram(spark, sf_dir):
    return _binned(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *C.bounds())


def _volume(lo: list[Column], hi: list[Column]) -> Column:
    e = [F.greatest(b - a, F.lit(0.0)) for a, b in zip(lo, hi)]
    least = F.greatest(F.lit(1e-9), F.greatest(*e) * 1e-9)
    return F.greatest(e[0], least) * F.greatest(e[1], least) * F.greatest(e[2], least)


def prefix_suffix_volume(spark, sf_dir):
    """For every boundary between occupied bins: counts and box volumes below and above it."""
    h = projection_histogram(spark, sf_dir)
    order = Window.orderBy("bin")
    below, above = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    side = lambda w: _volume([F.min(f"min_{c}").over(w) for c in "xyz"], [F.max(f"max_{c}").over(w) for c in "xyz"])
    out = h.select("bin", F.sum("n").over(below).alias("n_below"), F.sum("n").over(above).alias("n_above"), side(below).alias("v_below"), side(above).alias("v_above"))
    return out.filter("n_below is not null").select("bin", "n_below", "n_above", *[F.round(c, 3).alias(c) for c in ("v_below", "v_above")])


def best_split(spark, sf_dir):
    """The ten best boundaries of one axis by the split objective, exact comparison."""
    h = projection_histogram(spark, sf_dir).persist()
    whole = h.agg(F.sum("n").alias("n"), *[F.min(f"min_{c}").alias(f"lo_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"hi_{c}") for c in "xyz"]).withColumn("k", F.lit(0))
    bounds = spark.range(1, 128).select(F.col("id").cast("int").alias("boundary"))
    # 127 boundaries by at most 128 bins.
    side = lambda cond, p: bounds.join(h, cond).groupBy("boundary").agg(F.sum("n").alias(f"n{p}"), *[F.min(f"min_{c}").alias(f"{p}lo_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"{p}hi_{c}") for c in "xyz"])
    both = side(F.col("bin") < F.col("boundary"), "b").join(side(F.col("bin") >= F.col("boundary"), "a"), "boundary").withColumn("k", F.lit(0)).join(whole, "k")
    vol = lambda p: _volume([C.num(f"{p}lo_{c}") for c in "xyz"], [C.num(f"{p}hi_{c}") for c in "xyz"])
    extent = C.num("hi_y") - C.num("lo_y")
    split = C.num("lo_y") + extent * F.col("boundary") / 128.0
    mid = F.least(F.lit(1.0), F.abs(split - (C.num("lo_y") + extent / 2)) / (extent / 2))
    score = (vol("b") + vol("a")) / vol("") + 0.5 * mid + 0.1 * F.abs(F.col("nb") - F.col("na")) / F.col("n")
    return both.select("boundary", F.col("nb").alias("n_below"), F.col("na").alias("n_above"), F.round(split, 6).alias("split"), F.round(score, 9).alias("score")).orderBy("score", "boundary").limit(10)


def engine_first_split(spark, sf_dir):
    """The partition's own choice for the root: axis, offset, and how many rows lie on either side."""
    from ..operators import kdtree

    at = cloud0(spark, sf_dir).select("splat_id", "x", "y", "z")
    part = kdtree.Partition(at, FLAGSHIP, checkpoint_every=1 << 30)
    root = part.nodes[0]
    axes = kdtree.split_axes(kdtree.axes_by_extent(part._ranges(root)), False)
    axis, offset = part._planes([(root, "count", axes)])[0]
    side = C.slot([F.lit(float(v)) for v in axis.direction], F.lit(offset))
    return at.agg(F.lit(axis.index).alias("axis"), F.round(F.lit(offset), 9).alias("offset"), F.count_if(side == 0).alias("n_below"), F.count_if(side == 1).alias("n_above"))


def halfspace_route(spark, sf_dir):
    d = (0.6, 0.8, 0.0)
    return cloud0(spark, sf_dir).select("splat_id", C.slot([F.lit(v) for v in d], F.lit(80.0)).alias("slot"))


def _routed(spark, sf_dir) -> DataFrame:
    """Each row's path through the fixed planes: one broadcast of a plane table per level."""
    at = cloud0(spark, sf_dir).select("splat_id", "x", "y", "z").withColumn("path", F.lit(""))
    for level in range(3):
        own = [(p, *[1.0 if a == c else 0.0 for c in "xyz"], o) for p, a, o in PLANES if len(p) == level]
        planes = spark.createDataFrame(own, "path string, dx double, dy double, dz double, offset double")
        at = at.join(F.broadcast(planes), "path", "left")
        step = C.slot([F.col("dx"), F.col("dy"), F.col("dz")], F.col("offset"))
        at = at.withColumn("path", F.when(F.col("offset").isNull(), F.col("path")).otherwise(F.concat("path", step.cast("string")))).select("splat_id", "x", "y", "z", "path")
    return at


def leaf_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("splat_id", "path")


def kd_leaf_stats(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("path").agg(F.count(F.lit(1)).alias("n"), *C.bounds())


def ancestor_rollup(spark, sf_dir):
    """Counts and bounds of all nodes: leaf aggregates go up the path, not rows."""
    leaves = kd_leaf_stats(spark, sf_dir)
    up = leaves.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.substring("path", F.lit(1), k))))
    return up.groupBy("node").agg(F.sum("n").alias("n"), *[F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"])


def tree_stats(spark, sf_dir):
    nodes = ancestor_rollup(spark, sf_dir).select("node")
    parents = nodes.filter("node <> ''").select(F.expr("substring(node, 1, length(node) - 1)").alias("node")).distinct().withColumn("inner", F.lit(1))
    return nodes.join(parents, "node", "left").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.when(F.col("inner").isNull(), 1).otherwise(0)).alias("leaves"), F.max(F.length("node")).alias("max_level"))


def volume_median_flag(spark, sf_dir):
    leaves = kd_leaf_stats(spark, sf_dir).withColumn("depth", F.length("path"))
    v = leaves.withColumn("volume", _volume([C.num(f"min_{c}") for c in "xyz"], [C.num(f"max_{c}") for c in "xyz"]))
    m = v.groupBy("depth").agg(F.expr("percentile(volume, 0.5)").alias("median"), F.count(F.lit(1)).alias("tiles"))
    return v.join(m, "depth").select("path", "depth", F.round("volume", 3).alias("volume"), F.round("median", 3).alias("median"), ((F.col("tiles") > 1) & (F.col("volume") > 3 * F.col("median"))).alias("flagged"))


def root_refine_topk(spark, sf_dir):
    """The larger half, by volume, of the tiles that want refining."""
    leaves = kd_leaf_stats(spark, sf_dir)
    v = leaves.withColumn("volume", _volume([C.num(f"min_{c}") for c in "xyz"], [C.num(f"max_{c}") for c in "xyz"]))
    ranked = v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("volume"), "path"))).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return ranked.filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("total") / 2))).select("path", F.round("volume", 3).alias("volume"), "rank")


# Level of detail over one tile: a fixed grid, KEPT rows.


def _rows(spark, sf_dir) -> DataFrame:
    return cloud0(spark, sf_dir).withColumn("node", F.lit(0)).withColumn("o1", F.lit(0).cast("long")).withColumn("o2", F.col("splat_id"))


def _tile(spark, sf_dir) -> DataFrame:
    rows = _rows(spark, sf_dir)
    b = rows.groupBy("node").agg(*[F.min(C.num(c)).alias(f"low_{c}") for c in "xyz"], *[(F.max(C.num(c)) - F.min(C.num(c))).alias(f"ext_{c}") for c in "xyz"])
    diag = F.sqrt(sum((F.col(f"ext_{c}") * F.col(f"ext_{c}") for c in "yz"), F.col("ext_x") * F.col("ext_x"))) / float(GRID)
    grid = b.select("*", *[F.lit(GRID).cast("long").alias(f"d{k}") for k in range(3)], diag.alias("diag"), F.lit(KEPT).cast("long").alias("target"))
    return lod.with_voxel(rows, F.broadcast(grid))


def voxel_assign(spark, sf_dir):
    return _tile(spark, sf_dir).select("splat_id", "voxel", r6(F.col("weight")).alias("weight"))


def voxel_occupancy(spark, sf_dir):
    return lod.occupancy(_tile(spark, sf_dir)).select("node", "occupied")


def voxel_representative(spark, sf_dir):
    return lod.representatives(_tile(spark, sf_dir)).filter("rank = 1").select("voxel", F.col("o2").alias("splat_id"))


def extra_candidates(spark, sf_dir):
    return lod.representatives(_tile(spark, sf_dir)).filter("rank = 2").select("voxel", F.col("o2").alias("splat_id"))


def fill_leftover(spark, sf_dir):
    return lod.select(_tile(spark, sf_dir)).select("slot", F.col("o2").alias("splat_id"), F.col("rank").alias("stage"))


def _assigned(spark, sf_dir) -> DataFrame:
    at = _tile(spark, sf_dir)
    return lod.assign(at, lod.select(at))


def nearest_rep_assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select(F.col("o2").alias("splat_id"), "slot")


def merge_weighted_mean(spark, sf_dir):
    m = lod.merged(_rows(spark, sf_dir), _assigned(spark, sf_dir), 3)
    return m.select("slot", "members", *[(F.round(C.num(c), 2) + 0.0).alias(c) for c in "xyz"], F.round(C.num("opacity"), 4).alias("opacity"), *[(F.round(C.num(F.col("sh")[k]), 4) + 0.0).alias(f"sh{k}") for k in range(3)])


def merge_covariance(spark, sf_dir):
    """The covariance that every merged splat's scale and rotation stand for: its trace, and all six terms as shares of it."""
    m = lod.merged(_rows(spark, sf_dir), _assigned(spark, sf_dir), 3)
    c = C.covariance()
    trace = c[0] + c[3] + c[5]
    return m.select("slot", F.round(F.log10(trace), 3).alias("log_trace"), *[(F.round(v / trace, 3) + 0.0).alias(n) for v, n in zip(c, ("xx", "xy", "xz", "yy", "yz", "zz"))])


def own_error_p95(spark, sf_dir):
    at = _tile(spark, sf_dir)
    kept = lod.select(at)
    out = kept.select("node", "slot", "x", "y", "z", "radius")
    return lod.own_error(lod.assign(at, kept), out).select("node", F.round("own_error", 4).alias("own_error"))


def handoff_union(spark, sf_dir):
    """Rows of a parent: its children's rows, by child and slot, numbered."""
    at = _routed(spark, sf_dir).filter("length(path) >= 2").withColumn("parent", F.substring("path", 1, 1))
    placed = lod.place(at.select("splat_id", "path", "parent", F.col("parent").cast("int").alias("node")), [F.col("path"), F.col("splat_id")], Tables(spark, "handoff"))
    return placed.select("splat_id", "parent", F.col("slot").cast("int").alias("row"))


def emitted_children(spark, sf_dir):
    """Each leaf's emitted parent when the nodes 0 and 01 are virtual: the nearest ancestor that is not."""
    virtual = ["0", "01"]
    leaves = kd_leaf_stats(spark, sf_dir).select("path")
    ancestors = F.filter(F.transform(F.sequence(F.lit(1), F.length("path")), lambda k: F.expr("path").substr(F.lit(1), F.length("path") - k)), lambda p: ~p.isin(virtual))
    return leaves.select("path", ancestors[0].alias("emitted_parent"))


# Options and error model.


def depth_targets(spark, sf_dir):
    n = cloud0(spark, sf_dir).count()
    return spark.createDataFrame([(d, depth_target(n, d, 6, 0.5)) for d in range(7)], "depth int, target long")


def apportion_targets(spark, sf_dir):
    """Splits of a target over parts with floors: regions' shares of customers over their nations, for several targets."""
    customers = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    parts = _read(spark, sf_dir, "nation").join(customers, F.col("n_nationkey") == F.col("nation"), "left").select("n_regionkey", "n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))
    parts = parts.withColumn("floor", F.least("n", 1 + 5 * F.pmod("n_nationkey", F.lit(3)))).withColumn("tenth", F.explode(F.sequence(F.lit(0), F.lit(10))))
    schema = "n_regionkey int, n_nationkey int, tenth int, part long"

    def split(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["n_nationkey"])
        counts = [r["n"] for r in rows]
        got = apportion(sum(counts) * rows[0]["tenth"] // 10, counts, [r["floor"] for r in rows])
        return pa.table({"n_regionkey": pa.array([r["n_regionkey"] for r in rows], pa.int32()), "n_nationkey": pa.array([r["n_nationkey"] for r in rows], pa.int32()), "tenth": pa.array([r["tenth"] for r in rows], pa.int32()), "part": pa.array(got, pa.int64())})

    return parts.groupBy("n_regionkey", "tenth").applyInArrow(split, schema)


def geometric_error_by_depth(spark, sf_dir):
    return spark.createDataFrame([(d, geometric_error(8.0, d, 0.5)) for d in range(7)], "depth int, error double")


def auto_depth(spark, sf_dir):
    return spark.createDataFrame([(n, auto_max_depth(n, 0.5), auto_tile_refinement(n, 1000, auto_max_depth(n, 0.5), 0.5)) for n in (160_000, 160_001, 320_000, 320_001, 1_000_000)], "n long, depth int, refinement int")


def enu(spark, sf_dir):
    rows = [(lat, lon, k, round(v, 6) + 0.0) for lat, lon in ((0.0, 0.0), (35.0, 139.0), (-33.0, 151.0)) for k, v in enumerate(enu_matrix(lat, lon, 10.0))]
    return spark.createDataFrame(rows, "lat double, lon double, k int, v double")


# Encoding: packets of each batch of rows, unpacked again.


def _unpacked(cloud: DataFrame, schema: str, fields, centre=(0.0, 0.0, 0.0), sh_bits: int = 8) -> DataFrame:
    """splat_id and what ``fields`` takes from the stored packets of each batch's rows, in any order.

    Rows too far from the centre for one packet go to packets of their own part of space.  A null position comes back as null.
    """

    def each(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            cols = lambda *names: np.stack([t.column(c).to_numpy() for c in names], 1)
            null = np.stack([t.column(c).is_null().to_numpy() for c in "xyz"], 1)
            local = (cols("x", "y", "z").astype(np.float64) - centre).astype(np.float32)
            opacity, scale, quat = t.column("opacity").to_numpy(), cols("s0", "s1", "s2"), cols("qx", "qy", "qz", "qw")
            sh = np.asarray(t.column("sh").combine_chunks().flatten()).reshape(t.num_rows, -1)
            local[null] = 0
            for part, at in spz.parts(local):
                got = spz.unpack(spz.compress(spz.packet(local[at], opacity[at], sh[at], scale[at], quat[at], part, sh_bits, sh_bits)))
                got["xyz"] = np.ma.array(got["xyz"] + part, mask=null[at])
                yield pa.RecordBatch.from_pydict({"splat_id": t.column("splat_id").combine_chunks().take(pa.array(at)), **fields(got)})

    return cloud.mapInArrow(each, "splat_id long, " + schema)


def spz_position(spark, sf_dir):
    fields = lambda got: {f"p{c}": pa.array(np.rint(got["xyz"].data[:, k] * 4096).astype(np.int64), mask=got["xyz"].mask[:, k]) for k, c in enumerate("xyz")}
    return _unpacked(cloud0(spark, sf_dir), "px long, py long, pz long", fields, (75.0, 50.0, 15.0))


def spz_opacity_color_scale(spark, sf_dir):
    names = ("o", "c0", "c1", "c2", "s0", "s1", "s2")
    fields = lambda got: dict(zip(names, map(pa.array, np.concatenate([got["opacity"], got["color"], got["scale"]], 1).T.astype(np.int32))))
    return _unpacked(cloud0(spark, sf_dir), ", ".join(f"{n} int" for n in names), fields)


def spz_sh(spark, sf_dir):
    fields = lambda got: {"v": pa.array(list(got["sh"].astype(np.int32)), pa.list_(pa.int32()))}
    return _unpacked(cloud3(spark, sf_dir), "v array<int>", fields, sh_bits=4).select("splat_id", F.posexplode("v").alias("k", "b")).select("splat_id", (F.col("k") + 3).alias("k"), "b")


def spz_quat(spark, sf_dir):
    fields = lambda got: {"packed": pa.array(np.ascontiguousarray(got["rotation"]).view("<u4").ravel().astype(np.int64))}
    return _unpacked(cloud0(spark, sf_dir), "packed long", fields)


# The whole engine.

FLAGSHIP = TilingOptions(max_depth=3, leaf_limit=100, tile_refinement=1)


def _build(spark, sf_dir, options=FLAGSHIP):
    from .convert import Build

    return Build(cloud0(spark, sf_dir), options)


def lod_full(spark, sf_dir):
    return _build(spark, sf_dir).tiles().select("key", "depth", "n", r6(F.col("own_error")).alias("own_error"), r6(F.col("geometric_error")).alias("geometric_error"))


def kd_tree_full(spark, sf_dir):
    from ..operators.kdtree import Partition

    positions = cloud0(spark, sf_dir).select("splat_id", "x", "y", "z").persist()
    return Partition(positions, FLAGSHIP, checkpoint_every=1 << 30).fit().finish().table().select("key", "path", "level", "depth", "count", "leaf", "virtual", "emitted_parent")


def _packed(spark, sf_dir):
    from .convert import Build

    return Build(cloud3(spark, sf_dir), TilingOptions(max_depth=1, leaf_limit=200, tile_refinement=1)).encode()


def spz_packet(spark, sf_dir):
    return _packed(spark, sf_dir).select("uri", "n", "spz_bytes")


def glb_tiles(spark, sf_dir):
    return _packed(spark, sf_dir).select("uri", "n", F.length("glb").alias("glb_bytes"), F.decode(F.substring("glb", 1, 4), "US-ASCII").alias("magic"))


def tileset_json(spark, sf_dir):
    from . import tileset

    b = _build(spark, sf_dir)
    return spark.createDataFrame([(json.dumps(tileset.tileset(b.partition, b.root()[0], b.options, "z_up")),)], "document string")


def synthetic_cloud(spark, sf_dir):
    from ..sources.synthetic import cloud

    return cloud(spark, 10_000).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(C.num(c)), 3).alias(f"mean_{c}") for c in "xyz"], F.round(F.min(C.num("opacity")), 2).alias("least_opacity"))


QUERIES = {f.__name__: f for f in (canonical_core, canonical_sh3, opacity_khr, log_scale, quat_normalise, extents_3sigma, radius_3sigma, covariance6, split_weight, ply_round_trip, global_bounds, weighted_moments, cloud_bounds_3sigma, projection_histogram, prefix_suffix_volume, best_split, engine_first_split, halfspace_route, leaf_route, kd_leaf_stats, ancestor_rollup, tree_stats, volume_median_flag, root_refine_topk, voxel_assign, voxel_occupancy, voxel_representative, extra_candidates, fill_leftover, nearest_rep_assign, merge_weighted_mean, merge_covariance, own_error_p95, handoff_union, emitted_children, depth_targets, apportion_targets, geometric_error_by_depth, auto_depth, spz_position, spz_opacity_color_scale, spz_sh, spz_quat, lod_full, kd_tree_full, spz_packet, glb_tiles, tileset_json, synthetic_cloud)}
QUERIES["enu_matrix"] = enu
