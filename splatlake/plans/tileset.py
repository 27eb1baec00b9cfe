"""The tile set's documents: tileset.json and the build summary."""

from __future__ import annotations

from ..functions import frames
from ..functions.spz import VERSION
from .options import TilingOptions, geometric_error, sampling_divisor

# Fixed values.
SPLAT_EXTENSIONS = ["KHR_gaussian_splatting", "KHR_gaussian_splatting_compression_spz_2"]
CONTENT_EXTENSION = "3DTILES_content_gltf"


def tile_json(partition, node, root_error: float, rate: float, frame: str, top: bool = True) -> dict:
    """A tile and the tiles below it; built from the leaves up, so depth is no limit."""
    made: dict[int, dict] = {}
    for n in reversed(partition.tree()):
        if n.virtual:
            continue
        box = n.box if partition.basis else frames.box_of(n.low, n.high)
        made[n.id] = {"boundingVolume": {"box": frames.tile_box(box, frame)}, "geometricError": geometric_error(root_error, n.depth, rate), "refine": "REPLACE", "content": {"uri": n.uri}}
        below = partition.emitted_children(n)
        if below:
            made[n.id]["children"] = [made[c.id] for c in below]
    return made[node.id]


def tileset(partition, root_error: float, options: TilingOptions, frame: str) -> dict:
    root = tile_json(partition, partition.nodes[0], root_error, options.sampling_rate_per_level, frame)
    if matrix := options.root_matrix():
        root["transform"] = list(matrix)
    return {
        "asset": {"version": "1.1"},
        "extensionsUsed": [CONTENT_EXTENSION],
        "extensions": {CONTENT_EXTENSION: {"extensionsRequired": list(SPLAT_EXTENSIONS), "extensionsUsed": list(SPLAT_EXTENSIONS)}},
        "geometricError": root_error,
        "root": root,
    }


def summary(partition, n: int, degree: int, root_error: float, source: str, given: TilingOptions, options: TilingOptions, frame: tuple[str, str], timings: dict, reused: bool, stage: str) -> dict:
    stats = partition.stats()
    deepest, rate = min(options.max_depth, stats["max_depth"]), options.sampling_rate_per_level
    depths = range(deepest + 1)
    return {
        "input_splats": n,
        "sh_degree": degree,
        "max_depth": options.max_depth,
        "max_depth_source": "auto" if given.max_depth is None else "explicit",
        "tile_refinement": options.tile_refinement,
        "tile_refinement_source": "auto" if given.tile_refinement is None else "explicit",
        "leaf_limit": options.leaf_limit,
        "split_midpoint_penalty": options.split_midpoint_penalty,
        "split_count_balance_penalty": options.split_count_balance_penalty,
        "color_space": options.color_space,
        "memory_budget_gb": options.memory_budget,
        "sampling_rate_per_level": rate,
        "tiling_strategy": "kd_tree",
        "oriented_bounding_boxes": options.oriented_bounding_boxes,
        "content_codec": "spz_stream",
        "spz_version": VERSION,
        "spz_sh1_bits": options.spz_sh1_bits,
        "spz_sh_rest_bits": options.spz_sh_rest_bits,
        "spz_compression_level": options.spz_compression_level,
        "source_coordinate_system": frame[0],
        "source_coordinate_system_source": frame[1],
        "root_transform": list(options.root_matrix()) if options.root_matrix() else None,
        "root_coordinate": list(options.coordinate) if options.coordinate else None,
        "root_transform_source": "coordinate" if options.coordinate else "transform" if options.transform else None,
        "sample_mode": options.sample_mode,
        "configured_min_geometric_error": options.min_geometric_error if (options.min_geometric_error or 0) > 0 else None,
        "diagnostics": {
            "checkpoint": {"reused": reused, "stage": stage},
            "timings_ms": timings,
            "tree": {"node_count": stats["nodes"] - stats["virtual"], "partition_node_count": stats["nodes"], "virtual_node_count": stats["virtual"], "effective_max_depth": deepest, "physical_max_level": stats["max_level"]},
            "geometric_error": {"source": source, "root": root_error, "min": geometric_error(root_error, deepest, rate), "by_depth": {str(d): geometric_error(root_error, d, rate) for d in depths}},
            "sampling": {"rates_by_depth": {str(d): rate ** (deepest - d) for d in depths}, "divisors_by_depth": {str(d): sampling_divisor(d, deepest, rate) for d in depths}},
        },
    }
