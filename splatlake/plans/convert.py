"""From a splat table to a tile set.

``build`` partitions, rolls up and measures; ``encode`` adds binary tiles; ``convert`` reads a PLY file (or takes a
DataFrame of the splat schema), writes all files, and can be restarted.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import frames
from ..operators import encode as E
from ..operators import kdtree, lod
from ..streaming.checkpoint import Manifest, Tables, fingerprint, shared_dir
from . import tileset as T
from .options import ConversionError, TilingOptions, apportion, depth_target, geometric_error, root_error


class Build:
    """A tile set before encoding: partition, handoff rows by tile (node, slot, splat columns), own errors, targets."""

    def __init__(self, splats: DataFrame, given: TilingOptions, store=None):
        self.splats, self.given, self.timings = splats, given, {}
        self.spark = splats.sparkSession
        self._ready()
        self._store = store or Tables(self.spark, "build")
        began = time.time()
        weight = [C.split_weight().alias("weight")] if given.oriented_bounding_boxes else []
        positions = splats.select("splat_id", "x", "y", "z", *weight).persist()
        n = positions.count()
        if n == 0:
            raise ConversionError("no splats")
        self.options = given.resolved(n)
        basis = kdtree.principal_axes(positions) if given.oriented_bounding_boxes else None
        self.timings["scan_positions"] = self._ms(began)
        began = time.time()
        self.partition = kdtree.Partition(positions, self.options, basis).fit().finish()
        self.count = n
        self.deepest = min(self.options.max_depth, self.partition.stats()["max_depth"])
        self.timings["build_tiling_tree"] = self._ms(began)
        began = time.time()
        routed = self.partition.positions.select("splat_id", "node")
        self.leaves = self._store(splats.join(routed, "splat_id").select("node", "splat_id", *C.CORE, "sh"))
        positions.unpersist()
        self.timings["partition"] = self._ms(began)
        began = time.time()
        self.targets = self._targets()
        self._roll_up()
        self.timings["build_tiles"] = self._ms(began)

    @staticmethod
    def _ms(began: float) -> int:
        return int(1000 * (time.time() - began))

    def _ready(self) -> None:
        """checkpoint() needs a folder that executors share."""
        context = self.spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir(shared_dir(self.spark))

    def _targets(self) -> dict[int, int]:
        """Rows that each node keeps: by depth, and for nodes below a virtual one, their share of its target."""
        p, rate, out = self.partition, self.options.sampling_rate_per_level, {}

        def least(n) -> int:
            below = [p.nodes[c] for c in n.children]
            return max(1, sum(least(c) for c in below)) if n.virtual else 1

        def spread(n, target: int) -> None:
            below = [p.nodes[c] for c in n.children]
            shares = apportion(target, [c.count for c in below], [least(c) for c in below])
            for c, s in zip(below, shares):
                out[c.id] = s
                if c.virtual:
                    spread(c, s)

        for n in p.tree():
            if n.virtual and (n.parent < 0 or not p.nodes[n.parent].virtual):
                spread(n, depth_target(n.count, n.depth, self.deepest, rate, len(n.children)))
        for n in p.tree():
            if not n.virtual and n.id not in out:
                out[n.id] = depth_target(n.count, n.depth, self.deepest, rate, len(n.children))
        return out

    def _roll_up(self) -> None:
        """Depth by depth from the deepest: rows of a tile are its leaf rows or what the tiles below it keep."""
        p = self.partition
        tiles = [n for n in p.tree() if not n.virtual]
        ranks = {c.id: (n.id, k) for n in tiles for k, c in enumerate(p.handoff_order(n))}
        n_sh = self.splats.select(F.size("sh")).first()[0]
        columns = ["node", "o1", "o2", *C.CORE, "sh"]
        self.own: dict[int, float] = {}
        self.rows_in: dict[int, int] = {}
        kept: list[DataFrame] = []
        handoff: DataFrame | None = None
        sizes: dict[int, int] = {}
        for depth in range(max(n.depth for n in tiles), -1, -1):
            level = [n for n in tiles if n.depth == depth]
            leaves = [n for n in level if n.leaf]
            parts = []
            if leaves:
                ids = self.spark.createDataFrame([(n.id,) for n in leaves], "node int")
                parts.append(self.leaves.join(lod.sized(ids, len(leaves)), "node").select("node", F.lit(0).cast("long").alias("o1"), F.col("splat_id").alias("o2"), *C.CORE, "sh"))
            if handoff is not None:
                up = [(c, *ranks[c]) for c in sizes if c in ranks]
                table = self.spark.createDataFrame(up, "node int, up int, o1 long")
                parts.append(handoff.join(lod.sized(table, len(up)), "node").select(F.col("up").alias("node"), "o1", F.col("slot").alias("o2"), *C.CORE, "sh"))
            rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).select(*columns)
            count = {n.id: n.count if n.leaf else sum(sizes[c.id] for c in p.handoff_order(n)) for n in level}
            self.rows_in.update(count)
            thin = [n for n in level if not n.leaf and count[n.id] > self.targets[n.id]]
            whole = len(thin) < len(level)
            if not thin:
                handoff = lod.place(rows, ["o1", "o2"], self._store).select("node", "slot", *C.CORE, "sh")
            else:
                before = len(getattr(self._store, "paths", ()))
                rows = self._store(rows)
                some = lod.sized(self.spark.createDataFrame([(n.id,) for n in thin], "node int"), len(thin))
                wanted = [{"node": n.id, "target": self.targets[n.id], "low": n.low, "ext": n.extent} for n in thin]
                out, errors = lod.simplify(rows.join(some, "node") if whole else rows, wanted, self.options.sample_mode, n_sh, self._store)
                self.own.update({r.node: r.own_error for r in errors.collect()})
                handoff = out
                if whole:
                    plain = lod.place(rows.join(some, "node", "left_anti"), ["o1", "o2"], self._store)
                    handoff = self._store(out.drop("radius").unionByName(plain.select("node", "slot", *C.CORE, "sh")))
                if isinstance(self._store, Tables):
                    self._store.drop(before, handoff)
                handoff = handoff.select("node", "slot", *C.CORE, "sh")
            thinned = {n.id for n in thin}
            sizes = {n.id: self.targets[n.id] if n.id in thinned else count[n.id] for n in level}
            kept.append(handoff)
            self.kept_rows = {**getattr(self, "kept_rows", {}), **sizes}
        self.handoffs = kept

    def rows(self) -> DataFrame:
        """All tiles' rows: node, slot, splat columns."""
        out = self.handoffs[0]
        for h in self.handoffs[1:]:
            out = out.unionByName(h)
        return out

    def root(self) -> tuple[float, str]:
        n = self.partition.nodes[0]
        return root_error(self.own.get(0, 0.0), math.sqrt(sum(e * e for e in n.extent)), n.count, self.deepest, self.options)

    def tiles(self) -> DataFrame:
        """A row per tile: node, key, uri, depth, n, own_error, geometric_error."""
        error = self.root()[0]
        rows = [(n.id, n.key, n.uri, n.depth, self.kept_rows[n.id], float(self.own.get(n.id, 0.0)), geometric_error(error, n.depth, self.options.sampling_rate_per_level)) for n in self.partition.tree() if not n.virtual]
        return self.spark.createDataFrame(rows, "node int, key string, uri string, depth int, n long, own_error double, geometric_error double")

    def encode(self, frame: str = frames.CAMERA) -> DataFrame:
        """A row per tile: uri, n, spz_bytes, glb."""
        centres = {}
        for n in self.partition.tree():
            if n.virtual:
                continue
            centre = [(a + b) / 2 for a, b in zip(n.low, n.high)]
            # Merged splats stay inside the box of centres; beyond 24-bit fixed point the kernel names the tile.
            centres[n.id] = (centre, n.key)
        packed = E.packets(self.rows(), centres, self.options, frame)
        names = self.spark.createDataFrame([(n.id, n.uri) for n in self.partition.tree() if not n.virtual], "node int, uri string")
        return packed.join(lod.sized(names, len(self.partition.nodes)), "node")


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """Files of the tiles under a folder that executors share; a path or a URI that Arrow's file systems know."""

    def each(rows):
        import pyarrow.fs as fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for r in rows:
            path = f"{base}/{r.uri}"
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path + ".part") as f:
                f.write(bytes(r.glb))
            system.move(path + ".part", path)  # a retried task leaves whole files only

    tiles.select("uri", "glb").foreachPartition(each)


def convert(spark: SparkSession, source: str | DataFrame, output: str, **options) -> dict:
    """Writes tiles, tileset.json and build_summary.json to ``output``; returns the summary.

    A failed run leaves its finished stages in ``output/.stages``; the same call with ``clean=False`` goes on from them.
    """
    from ..sources import ply

    given = TilingOptions.of(**options)
    began = time.time()
    frame = (frames.CAMERA, "default")
    if isinstance(source, str):
        header = ply.read_header(source)
        frame = frames.detect(header.comments)
        splats, n, path = ply.read_splats(spark, source, given.input_convention, given.linear_scale_input), header.count, ply.local(source)
    else:
        splats, n, path = source, -1, None
    folder = ply.local(output)
    stages = os.path.join(folder, ".stages")
    manifest = Manifest(stages, fingerprint(path, given, n, "" if path else uuid.uuid4().hex))
    if given.clean:
        manifest.clear()
        manifest = Manifest(stages, manifest.mark)
    reused = manifest.reused
    os.makedirs(folder, exist_ok=True)
    calls = iter(range(1 << 30))

    def store(df: DataFrame) -> DataFrame:
        # Stages come in the same order in every run of the same input and options.
        name = str(next(calls))
        at = os.path.join(stages, name)
        if not manifest.get(name):
            df.write.mode("overwrite").parquet(at)
            manifest.put(name, True)
        return spark.read.schema(df.schema).parquet(at)

    build = Build(splats, given, store)
    if n >= 0 and build.count != n:
        raise ConversionError(f"{build.count} rows were read; the header says {n}")
    write_tiles(build.encode(frame[0]), folder)
    error, why = build.root()
    started = time.time()
    with open(os.path.join(folder, "tileset.json"), "w") as f:
        json.dump(T.tileset(build.partition, error, build.options, frame[0]), f)
    degree = {3: 0, 12: 1, 27: 2, 48: 3}[splats.select(F.size("sh")).first()[0]]
    build.timings["write_tileset"] = int(1000 * (time.time() - started))
    build.timings["total"] = int(1000 * (time.time() - began))
    out = T.summary(build.partition, build.count, degree, error, why, given, build.options, frame, build.timings, reused, "done")
    with open(os.path.join(folder, "build_summary.json"), "w") as f:
        json.dump(out, f, indent=1)
    import shutil

    shutil.rmtree(stages, ignore_errors=True)
    return out
