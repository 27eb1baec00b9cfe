import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from splatlake.functions import spz
from splatlake.operators import kdtree, lod
from splatlake.plans.convert import Build, convert
from splatlake.plans.options import TilingOptions
from splatlake.sources.ply import write_ply
from splatlake.sources.synthetic import cloud
from splatlake.streaming.checkpoint import Manifest, Tables


@pytest.fixture(scope="module")
def splats(spark):
    return cloud(spark, 1500).persist()


def walk(build):
    p = build.partition
    return p, [n for n in p.tree() if not n.virtual]


@pytest.fixture(scope="module", params=["merge", "sample", "boxes"])
def build(request, splats):
    kind = request.param
    return Build(splats, TilingOptions(max_depth=2, leaf_limit=150, tile_refinement=3 if kind == "merge" else 1, sample_mode="sample" if kind != "merge" else "merge", oriented_bounding_boxes=kind == "boxes"))


def test_structure(build, splats):
    p, tiles = walk(build)
    leaves = p.leaves()
    assert sum(n.count for n in p.tree() if n.leaf) == 1500 and not any(n.virtual for n in tiles)
    assert len({n.uri for n in tiles}) == len(tiles)
    for n in tiles:
        for c in p.emitted_children(n):
            assert c.depth == n.depth + 1 <= 2
            if not p.basis:
                assert all(a <= b for a, b in zip(n.low, c.low)) and all(a >= b for a, b in zip(n.high, c.high))
    at = {r.node: r for r in p.positions.groupBy("node").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    tree_leaves = [n for n in p.tree() if n.leaf]
    assert set(at) == {n.id for n in tree_leaves} and len(leaves) >= len(tree_leaves)
    for n in tree_leaves:
        assert at[n.id].n == n.count and n.low[0] <= at[n.id].lo and at[n.id].hi <= n.high[0]


def test_roll_up(build):
    p, tiles = walk(build)
    rows = {r.node: r.n for r in build.rows().groupBy("node").agg(F.count("*").alias("n")).collect()}
    assert rows == {n.id: build.kept_rows[n.id] for n in tiles}
    for n in tiles:
        thinned = not n.leaf and build.rows_in[n.id] > build.targets[n.id]
        assert rows[n.id] == (build.targets[n.id] if thinned else build.rows_in[n.id])
        assert (build.own.get(n.id, 0.0) > 0) == thinned
    slots = build.rows().groupBy("node").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count("*").alias("n"), F.count_distinct("slot").alias("d")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 and r.d == r.n for r in slots)
    error = {r.depth: r.geometric_error for r in build.tiles().collect()}
    assert all(error[d + 1] == pytest.approx(error[d] / 2) for d in range(max(error)))


def test_packets_decode(build):
    for r in build.encode().collect():
        data = bytes(r.glb)
        size = int.from_bytes(data[12:16], "little")
        doc = json.loads(data[20 : 20 + size])
        back = spz.unpack(data[28 + size :][: doc["bufferViews"][0]["byteLength"]])
        assert len(back["xyz"]) == r.n and r.spz_bytes == 16 + 20 * r.n


def best_split_brute(points, wm=0.5, wc=0.1):
    """All axes and boundaries of one node, straight from the definition, without epsilon ties."""
    low, high = points.min(0), points.max(0)
    ext = high - low
    rank = sorted(range(3), key=lambda k: -ext[k])
    axes = [(rank[0], 1.0)]
    if ext[rank[0]] / ext[rank[1]] < 2:
        axes.append((rank[1], math.sqrt(ext[rank[0]] / ext[rank[1]])))
    parent, found = kdtree.volume(ext), []
    for axis, factor in axes:
        bins = np.clip(np.floor((points[:, axis] - low[axis]) / ext[axis] * 128), 0, 127)
        for b in range(1, 128):
            lo, hi = points[bins < b], points[bins >= b]
            if len(lo) and len(hi):
                split = low[axis] + ext[axis] * b / 128
                v = kdtree.volume(np.ptp(lo, 0)) + kdtree.volume(np.ptp(hi, 0))
                mid = min(1, abs(split - (low[axis] + ext[axis] / 2)) / (ext[axis] / 2))
                found.append((factor * (v / parent + wm * mid + wc * abs(len(lo) - len(hi)) / len(points)), axis, split))
    return min(found)


def test_root_split_is_the_best_one(splats):
    points = np.array([[r.x, r.y, r.z] for r in splats.select("x", "y", "z").collect()], np.float64)
    p = kdtree.Partition(splats.select("splat_id", "x", "y", "z"), TilingOptions(max_depth=1, leaf_limit=800, tile_refinement=1)).fit()
    _, axis, split = best_split_brute(points)
    root = p.nodes[0]
    assert root.direction == kdtree.IDENTITY[axis] and root.offset == pytest.approx(split)
    assert p.nodes[root.children[1]].count == (points[:, axis] >= split).sum()


def test_simplify_against_a_plain_model(spark, splats):
    """Voxels, representatives, fill and assignment of one tile, row by row."""
    rows = splats.select(F.lit(0).alias("node"), F.lit(0).cast("long").alias("o1"), F.col("splat_id").alias("o2"), *[c for c in splats.columns if c != "splat_id"])
    table = {r.o2: r for r in rows.collect()}
    xyz = np.array([[table[k].x, table[k].y, table[k].z] for k in range(1500)], np.float64)
    radius = np.array([3 * math.sqrt(sum(math.exp(2 * table[k][f"s{j}"]) for j in range(3))) for k in range(1500)]).astype(np.float32).astype(np.float64)
    low, ext, target = xyz.min(0), np.ptp(xyz, 0), 200
    tile = {"node": 0, "target": target, "low": tuple(low), "ext": tuple(ext)}
    grid, info = lod.fit_grid(rows, [dict(tile)])
    d = np.array(info[0]["dims"])
    voxel = (np.floor(np.clip((xyz - low) / np.maximum(ext, 1e-6), 0, 0.999999) * d) * [1, d[0], d[0] * d[1]]).sum(1).astype(int)
    assert info[0]["occupied"] == len(set(voxel)) <= target
    diag = np.sqrt(((ext / d) ** 2).sum())
    w = np.array([max(table[k].opacity, 1e-4) for k in range(1500)]) * np.sqrt(np.maximum(radius / diag, 0.35))
    first, second = {}, {}
    for v in sorted(set(voxel)):
        own = np.flatnonzero(voxel == v)
        for into in (first, second):
            if len(own):
                c = (w[own, None] * xyz[own]).sum(0) / w[own].sum()
                cost = (((xyz[own] - c) ** 2).sum(1) - 0.15 * radius[own] ** 2) / diag**2
                into[v] = min(zip(cost, -w[own], -radius[own], own))[3]
                own = own[own != into[v]]
    chosen = [first[v] for v in sorted(first)]
    chosen += sorted(second.values(), key=lambda k: (-w[k], k))[: target - len(chosen)]
    rest = sorted(set(range(1500)) - set(chosen), key=lambda k: (-w[k], -radius[k], -k))
    chosen += rest[: target - len(chosen)]
    at = lod.with_voxel(rows, grid)
    kept = lod.select(at)
    assert [r.o2 for r in kept.orderBy("slot").collect()] == chosen
    slot = {k: min((np.sqrt(((xyz[k] - xyz[c]) ** 2).sum()) + radius[c], c, s) for s, c in enumerate(chosen) if voxel[c] == voxel[k])[2] for k in range(1500)}
    assigned = lod.assign(at, kept)
    assert {r.o2: r.slot for r in assigned.collect()} == slot
    out, error = lod.simplify(rows, [dict(tile)], "sample")
    e = [np.sqrt(((xyz[k] - xyz[chosen[s]]) ** 2).sum()) + radius[k] + radius[chosen[s]] for k, s in slot.items()]
    assert error.first().own_error == pytest.approx(np.percentile(e, 95), rel=1e-6)
    merged = {r.slot: r for r in lod.simplify(rows, [dict(tile)], "merge")[0].collect()}
    assert set(merged) == set(range(target))
    for s in range(0, target, 17):
        own = [k for k, v in slot.items() if v == s]
        if len(own) > 1:
            mean = (w[own, None] * xyz[own]).sum(0) / w[own].sum()
            assert np.allclose([merged[s].x, merged[s].y, merged[s].z], mean, atol=1e-5)


def test_covariance_round_trip():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 3, 3))
    cov = a @ a.transpose(0, 2, 1) + 0.01 * np.eye(3)
    scale, q = lod.eigen_to_scale_quat(cov)
    x, y, z, w = q.T
    r = np.stack([np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], 1), np.stack([2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], 1), np.stack([2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], 1)], 1)
    back = r @ (np.exp(2 * scale)[:, :, None] * r.transpose(0, 2, 1))
    assert np.allclose(back, cov, atol=1e-9) and (w >= 0).all() and np.allclose((q * q).sum(1), 1)


def test_volume_and_ties():
    assert kdtree.volume([2, 3, 0]) == pytest.approx(1.8e-8)
    assert kdtree.better((1.0, 2.0), (1.0 + 1e-12, 3.0)) is True and kdtree.better((1.0,), (1.0,)) is None and kdtree.better((2.0,), (1.0,)) is False


def test_odd_clouds(spark):
    def build(points, **options):
        rows = [(k, *map(float, p), -4.0, -4.0, -4.0, 0.0, 0.0, 0.0, 1.0, 0.5, [0.1, 0.2, 0.3]) for k, p in enumerate(points)]
        return Build(spark.createDataFrame(rows, "splat_id long, x float, y float, z float, s0 float, s1 float, s2 float, qx float, qy float, qz float, qw float, opacity float, sh array<float>"), TilingOptions(**options))

    one = build([(1, 2, 3)], max_depth=3, leaf_limit=1)
    assert one.partition.stats()["nodes"] == 1 and one.kept_rows == {0: 1}
    same = build([(1, 1, 1)] * 20, max_depth=2, leaf_limit=5, tile_refinement=1)
    assert same.partition.stats()["nodes"] == 1  # no direction to split along
    line = build([(k, 0, 0) for k in range(40)] + [(float("nan"), 0, 0)], max_depth=1, leaf_limit=10, tile_refinement=1)
    assert sum(n.count for n in line.partition.tree() if n.leaf) == 41
    with pytest.raises(ValueError, match="no splats"):
        build([])


def test_convert_and_restart(spark, tmp_path, splats):
    path, out = str(tmp_path / "a.ply"), str(tmp_path / "tiles")
    write_ply(path, splats.orderBy("splat_id").toArrow())
    options = {"maxDepth": 1, "leafLimit": 400, "tileRefinement": 1, "coordinate": [35, 139, 10]}
    summary = convert(spark, path, out, **options)
    doc = json.load(open(f"{out}/tileset.json"))
    assert doc["root"]["transform"][15] == 1 and summary["input_splats"] == 1500

    def files(tile):
        yield tile["content"]["uri"]
        for c in tile.get("children", []):
            yield from files(c)

    assert all(os.path.getsize(f"{out}/{f}") > 0 for f in files(doc["root"]))
    again = convert(spark, path, out, clean=False, **options)
    assert json.load(open(f"{out}/tileset.json")) == doc and not again["diagnostics"]["checkpoint"]["reused"]


def test_place(spark):
    """Places of rows in nodes that span partitions and partitions that span nodes, with equal first keys."""
    rng = np.random.default_rng(1)
    rows = [(int(n), int(v), k) for k, (n, v) in enumerate(zip(np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 40, 3000)), rng.integers(0, 4, 3000)))]
    at = lod.place(spark.createDataFrame(rows, "node int, v int, o long").repartition(7), [-F.col("v"), F.col("o")], Tables(spark, "test"))
    got = {(r.node, r.v, r.o): (r.slot, r.total) for r in at.collect()}
    for node in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == node), key=lambda r: (-r[1], r[2]))
        assert [got[r] for r in own] == [(k, len(own)) for k in range(len(own))]
    assert lod.place(spark.createDataFrame([], "node int, o long"), [F.col("o")], Tables(spark, "test")).count() == 0


def test_tables_of_the_roll_up_are_deleted(spark, splats):
    store = Tables(spark, "dropped")
    build = Build(splats, TilingOptions(max_depth=2, leaf_limit=150, tile_refinement=1), store)
    left = [p for p in store.paths if os.path.exists(p.removeprefix("file:"))]
    assert len(left) < len(store.paths) / 2 and build.rows().count() == sum(build.kept_rows.values())


def test_interrupted_conversion_goes_on(spark, tmp_path, splats, monkeypatch):
    path, out, whole = str(tmp_path / "a.ply"), str(tmp_path / "tiles"), str(tmp_path / "whole")
    write_ply(path, splats.orderBy("splat_id").toArrow())
    options = {"maxDepth": 2, "leafLimit": 300, "tileRefinement": 1}
    convert(spark, path, whole, **options)
    put, seen = Manifest.put, []

    def breaks(self, stage, value):
        put(self, stage, value)
        seen.append(stage)
        if len(seen) == 5:
            raise RuntimeError("lost")

    monkeypatch.setattr(Manifest, "put", breaks)
    with pytest.raises(RuntimeError, match="lost"):
        convert(spark, path, out, **options)
    monkeypatch.setattr(Manifest, "put", put)
    began = {s: os.stat(f"{out}/.stages/{s}").st_mtime_ns for s in seen}
    kept, drop = {}, convert.__globals__["write_tiles"]

    def look(tiles, folder):
        kept.update({s: os.stat(f"{out}/.stages/{s}").st_mtime_ns for s in seen})
        drop(tiles, folder)

    monkeypatch.setitem(convert.__globals__, "write_tiles", look)
    summary = convert(spark, path, out, clean=False, **options)
    assert summary["diagnostics"]["checkpoint"]["reused"] and kept == began
    assert json.load(open(f"{out}/tileset.json")) == json.load(open(f"{whole}/tileset.json"))
    names = sorted(os.path.relpath(os.path.join(d, f), whole) for d, _, fs in os.walk(whole) for f in fs if f.endswith(".glb"))
    assert len(names) > 3 and all(open(f"{out}/{n}", "rb").read() == open(f"{whole}/{n}", "rb").read() for n in names)


def test_rows_are_placed_and_assigned_without_sorting_pairs(spark, splats, monkeypatch):
    rows = splats.withColumns({"node": F.lit(0), "o1": F.lit(0).cast("long"), "o2": F.col("splat_id")})
    n, placed, plain = splats.count(), [], lod.place

    def watched(at, order, keep):
        placed.append(at)
        return plain(at, order, keep)

    monkeypatch.setattr(lod, "place", watched)
    low = rows.agg(*[F.min(c) for c in "xyz"], *[F.max(c) for c in "xyz"]).first()
    keep = Tables(spark, "watched")
    tile = {"node": 0, "target": n // 2, "low": low[:3], "ext": [b - a for a, b in zip(low[:3], low[3:])]}
    out, error = lod.simplify(rows, [tile], keep=keep)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(placed[0])  # not computed twice, for the bounds of a range partition and to deal rows
    assert placed[1].count() < 0.1 * n  # of all errors, only the upper ones are sorted
    grid, _ = lod.fit_grid(rows, [dict(tile)])
    at = lod.with_voxel(rows, grid)
    assert "SortAggregate" not in lod.assign(at, lod.select(at, keep))._jdf.queryExecution().executedPlan().toString()
    e = lod.assign(at, lod.select(at, keep)).join(out.select("slot", *[F.col(c).alias(f"t{c}") for c in "xyz"], F.col("radius").alias("tr")), "slot").toPandas()
    d = sum((e[c].astype(float) - e[f"t{c}"].astype(float)) ** 2 for c in "xyz") ** 0.5 + e["radius"].astype(float) + e["tr"].astype(float)
    assert error.first().own_error == pytest.approx(np.quantile(d, 0.95), rel=1e-12)


def test_percentile_of_few_and_equal_errors(spark):
    for values in ([3.0], [1.0, 2.0], [5.0] * 40, [1.0] * 97 + [2.0, 3.0, 4.0], [float(k * k % 101) for k in range(101)]):
        row = "node int, slot long, x float, y float, z float, radius float"
        assigned = spark.createDataFrame([(0, 0, v, 0.0, 0.0, 0.0) for v in values], row)
        out = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0)], row)
        assert lod.own_error(assigned, out).first().own_error == pytest.approx(np.quantile(values, 0.95), rel=1e-12)
