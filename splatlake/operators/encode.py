"""Tiles as binary glTF: one row per tile, packed by a kernel over the tile's rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import spz


def packets(rows: DataFrame, centres: dict[int, tuple[list[float], str]], options, frame: str, max_rows: int = 4_000_000) -> DataFrame:
    """node, n, spz_bytes (before compression), glb.  rows: node, slot and the splat columns.

    A tile must fit into a task: over ``max_rows`` rows it is refused by name, and a greater depth is the remedy.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def pack(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        centre, name = sent.value[node]
        if table.num_rows > max_rows:
            raise ValueError(f"tile {name} has {table.num_rows} rows; raise max_depth or lower leaf_limit")
        table = table.sort_by("slot")
        cols = lambda *names: np.stack([table.column(c).to_numpy() for c in names], 1)
        sh = table.column("sh").combine_chunks()
        sh = np.asarray(sh.flatten()).reshape(table.num_rows, -1)
        raw = spz.packet(cols("x", "y", "z"), table.column("opacity").to_numpy(), sh, cols("s0", "s1", "s2"), cols("qx", "qy", "qz", "qw"), centre, options.spz_sh1_bits, options.spz_sh_rest_bits, name)
        degree = {3: 0, 12: 1, 27: 2, 48: 3}[sh.shape[1]]
        data = spz.glb(spz.compress(raw, options.spz_compression_level), table.num_rows, degree, centre, frame, options.color_space)
        return pa.table({"node": pa.array([node], pa.int32()), "n": pa.array([table.num_rows], pa.int64()), "spz_bytes": pa.array([len(raw)], pa.int64()), "glb": pa.array([data], pa.binary())})

    return rows.groupBy("node").applyInArrow(pack, "node int, n long, spz_bytes long, glb binary")
