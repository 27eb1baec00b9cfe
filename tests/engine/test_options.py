import pytest

from splatlake.functions import frames
from splatlake.plans.options import ConversionError, TilingOptions, apportion, auto_max_depth, auto_tile_refinement, depth_target, enu_matrix, geometric_error, root_error


def test_automatic_depth_and_refinement():
    assert [auto_max_depth(n, 0.5) for n in (160_000, 160_001, 320_000, 320_001, 1_000_000)] == [0, 1, 1, 2, 3]
    assert auto_tile_refinement(1_000_000, 1000, 3, 0.5) == 8
    assert auto_tile_refinement(100, 1000, 0, 0.5) == 1 and auto_max_depth(10**9, 1.0) == 0


def test_targets_and_errors():
    assert depth_target(1000, 0, 3, 0.5) == 125 and depth_target(1000, 3, 3, 0.5) == 1000 and depth_target(10, 0, 5, 0.5, children=2) == 2
    assert geometric_error(8, 3, 0.5) == 1
    assert root_error(2.0, 10.0, 5, 3, TilingOptions(min_geometric_error=1.0)) == (8.0, "configured_min_geometric_error")
    assert root_error(2.0, 10.0, 5, 3, TilingOptions()) == (2.0, "estimated_root_simplify")
    assert root_error(0.0, 10.0, 5, 3, TilingOptions())[0] == 1.25 and root_error(0.0, 10.0, 1, 0, TilingOptions())[0] == pytest.approx(1e-5)


def test_apportion():
    for target, counts, floors in ((10, [7, 7, 7], [1, 1, 1]), (5, [100, 1, 1], [1, 1, 1]), (20, [4, 5, 6], [1, 1, 2]), (7, [3, 3, 3], [2, 2, 2])):
        out = apportion(target, counts, floors)
        assert sum(out) == min(max(target, sum(floors)), sum(counts)) and all(f <= o <= c for f, o, c in zip(floors, out, counts))


def test_apportion_values():
    # Shares follow the counts, not the room above the floors.
    assert apportion(12, [10, 10], [1, 5]) == [4, 8]
    # 10 rows above the floors: 5.56, 2.78, 1.67; the two left go to .78 and .67.
    assert apportion(13, [100, 50, 30], [1, 1, 1]) == [6, 4, 3]
    # A full part passes its rows on: shares 13.3, 13.3, 13.3 with room for 2, 19 and 19; whole rounds, then by position.
    assert apportion(45, [22, 22, 22], [20, 3, 3]) == [22, 12, 11]
    # A share that the room cuts short lacks most, but has no room.
    assert apportion(9, [3, 9], [3, 1]) == [3, 6]
    assert apportion(100, [4, 5], [1, 1]) == [4, 5] and apportion(1, [4, 5], [2, 2]) == [2, 2] and apportion(3, [], []) == []


def test_options_names_and_checks():
    o = TilingOptions.of(maxDepth="auto", **{"leaf-limit": 5}, sampleMode="sample", buildConcurrency=3)
    assert (o.max_depth, o.leaf_limit, o.sample_mode) == (None, 5, "sample")
    for bad in ({"nothing": 1}, {"leafLimit": 0}, {"samplingRatePerLevel": 0}, {"spzSh1Bits": 9}, {"sampleMode": "x"}, {"transform": [1]}, {"coordinate": [91, 0, 0]}, {"minGeometricError": "a"}, {"transform": [1.0] * 16, "coordinate": [0, 0, 0]}):
        with pytest.raises(ConversionError):
            TilingOptions.of(**bad)
    rows = [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [0, 0, 0, 1]]
    assert TilingOptions.of(transform=rows).transform[:4] == (1, 5, 9, 0)
    assert TilingOptions.of(coordinate='{"lat": 1, "lng": 2, "alt": 3}').coordinate == (1, 2, 3)


def test_east_north_up():
    m = enu_matrix(0, 0, 0)
    assert [round(v, 6) + 0.0 for v in m] == [0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 0, 6378137, 0, 0, 1]


def test_frames():
    cases = {"": frames.CAMERA, "epsg 4326": frames.Z_UP, "offsetx 1": frames.Z_UP, "Z-up": frames.Z_UP, "gltf y-up": frames.GLTF_Y_UP, "colmap epsg 4326": frames.CAMERA, "something": frames.CAMERA}
    assert {c: frames.detect([c])[0] for c in cases} == cases
    box = frames.tile_box([1, 2, 3, 1, 0, 0, 0, 2, 0, 0, 0, 3], frames.CAMERA)
    assert box[:3] == [1, 3, -2]
    m = frames.node_matrix([1, 2, 3], frames.Z_UP)
    assert m[12:] == [1, 3, -2, 1]
