"""Options of a conversion, their validation, automatic depth and refinement, and the root transform."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields, replace

# Fixed values.
AUTO_ROOT_SPLATS = 160_000
AUTO_LEAF_MULTIPLE = 5
WGS84_A = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
WGS84_E2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
CHOICES = {"input_convention": ("graphdeco", "khr_native"), "color_space": ("srgb_rec709_display", "lin_rec709_display"), "sample_mode": ("sample", "merge")}
REMOVED = ("source_up_axis", "source_coordinate_system", "resolved_source_coordinate_system", "build_concurrency", "content_workers")


class ConversionError(ValueError):
    """An input or an option that cannot be converted."""


@dataclass(frozen=True)
class TilingOptions:
    input_convention: str = "graphdeco"
    linear_scale_input: bool = False
    color_space: str = "srgb_rec709_display"
    max_depth: int | None = None  # None: automatic
    tile_refinement: int | None = None  # None: automatic
    leaf_limit: int = 1000
    split_midpoint_penalty: float = 0.5
    split_count_balance_penalty: float = 0.1
    min_geometric_error: float | None = None
    spz_sh1_bits: int = 8
    spz_sh_rest_bits: int = 8
    spz_compression_level: int = 9
    transform: tuple[float, ...] | None = None
    coordinate: tuple[float, float, float] | None = None
    sampling_rate_per_level: float = 0.5
    sample_mode: str = "merge"
    memory_budget: float = 2.0
    oriented_bounding_boxes: bool = False
    clean: bool = True
    self_test: bool = False
    self_test_count: int = 1_000_000

    def __post_init__(self):
        def check(ok: bool, message: str) -> None:
            if not ok:
                raise ConversionError(message)

        for name, allowed in CHOICES.items():
            check(getattr(self, name) in allowed, f"{name} must be one of {', '.join(allowed)}")
        check(self.max_depth is None or _whole(self.max_depth) and self.max_depth >= 0, "max_depth must be a whole number, 0 or more")
        check(self.tile_refinement is None or _whole(self.tile_refinement) and self.tile_refinement >= 1, "tile_refinement must be a whole number, 1 or more")
        check(_whole(self.leaf_limit) and self.leaf_limit >= 1, "leaf_limit must be 1 or more")
        for name in ("split_midpoint_penalty", "split_count_balance_penalty"):
            check(_finite(getattr(self, name)) and getattr(self, name) >= 0, f"{name} must be finite and not negative")
        for name in ("spz_sh1_bits", "spz_sh_rest_bits"):
            check(_whole(getattr(self, name)) and 1 <= getattr(self, name) <= 8, f"{name} must be 1 to 8")
        check(_whole(self.spz_compression_level) and 0 <= self.spz_compression_level <= 9, "spz_compression_level must be 0 to 9")
        check(self.min_geometric_error is None or _finite(self.min_geometric_error), "min_geometric_error must be a number")
        check(_finite(self.sampling_rate_per_level) and 0 < self.sampling_rate_per_level <= 1, "sampling_rate_per_level must be over 0 and at most 1")
        check(_finite(self.memory_budget) and self.memory_budget > 0, "memory_budget must be over 0")
        check(self.transform is None or self.coordinate is None, "transform and coordinate exclude each other")
        check(_whole(self.self_test_count) and self.self_test_count >= 1, "self_test_count must be 1 or more")
        object.__setattr__(self, "transform", matrix4(self.transform))
        object.__setattr__(self, "coordinate", coordinate(self.coordinate))

    @classmethod
    def of(cls, **options) -> TilingOptions:
        """From camelCase, kebab-case or snake_case names; removed options are ignored, unknown ones fail."""
        names = {f.name for f in fields(cls)}
        found = {}
        for key, value in options.items():
            name = "".join("_" + c.lower() if c.isupper() else c for c in key.replace("-", "_")).lstrip("_")
            name = {"obb": "oriented_bounding_boxes"}.get(name, name)
            if name in REMOVED:
                continue
            if name not in names:
                raise ConversionError(f"unknown option {key}")
            if name in ("max_depth", "tile_refinement") and value in ("auto", None):
                value = None
            found[name] = value
        return cls(**found)

    def resolved(self, n: int) -> TilingOptions:
        """With automatic values settled for n splats."""
        depth = self.max_depth if self.max_depth is not None else auto_max_depth(n, self.sampling_rate_per_level)
        refinement = self.tile_refinement if self.tile_refinement is not None else auto_tile_refinement(n, self.leaf_limit, depth, self.sampling_rate_per_level)
        return replace(self, max_depth=depth, tile_refinement=refinement)

    def root_matrix(self) -> tuple[float, ...] | None:
        return enu_matrix(*self.coordinate) if self.coordinate else self.transform


def _finite(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)


def _whole(v) -> bool:
    return isinstance(v, int) and not isinstance(v, bool)


def _parsed(value):
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError as e:
            raise ConversionError(f"not JSON: {value}") from e
    return value


def matrix4(value) -> tuple[float, ...] | None:
    """16 numbers in column order: a flat list is kept, four rows are transposed."""
    value = _parsed(value)
    if value is None:
        return None
    rows = list(value)
    if len(rows) == 4 and all(isinstance(r, (list, tuple)) and len(r) == 4 for r in rows):
        rows = [rows[r][c] for c in range(4) for r in range(4)]
    if len(rows) != 16 or not all(_finite(v) for v in rows):
        raise ConversionError("transform must be a 4x4 matrix or 16 numbers")
    return tuple(float(v) for v in rows)


def coordinate(value) -> tuple[float, float, float] | None:
    """Latitude, longitude (degrees) and height (metres)."""
    value = _parsed(value)
    if value is None:
        return None
    if isinstance(value, dict):
        pick = lambda *names: next((value[n] for n in names if value.get(n) is not None), None)
        value = (pick("lat", "latitude"), pick("long", "lng", "lon", "longitude"), pick("height", "alt", "altitude"))
    if len(value) != 3 or not all(_finite(v) for v in value):
        raise ConversionError("coordinate must be latitude, longitude and height")
    lat, lon, height = (float(v) for v in value)
    if abs(lat) > 90 or abs(lon) > 180:
        raise ConversionError("coordinate is out of range")
    return lat, lon, height


def auto_max_depth(n: int, rate: float) -> int:
    if n <= AUTO_ROOT_SPLATS or rate >= 1:
        return 0
    return max(1, math.ceil(math.log(AUTO_ROOT_SPLATS / n) / math.log(rate) - 1e-12))


def auto_tile_refinement(n: int, leaf_limit: int, depth: int, rate: float) -> int:
    """The least r whose estimated root tiles (2, 3, 4, 6, 9, 13 ...) reach the target."""
    unit = leaf_limit * AUTO_LEAF_MULTIPLE * (1 / rate) ** depth
    if depth == 0 or n <= unit:
        return 1
    tiles, r = 2, 1
    while tiles < n / unit:
        tiles += tiles // 2
        r += 1
    return r


def enu_matrix(lat: float, lon: float, height: float) -> tuple[float, ...]:
    """East, north, up and the position on the ellipsoid, in column order."""
    a, b = math.radians(lat), math.radians(lon)
    sa, ca, sb, cb = math.sin(a), math.cos(a), math.sin(b), math.cos(b)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * sa * sa)
    return (-sb, cb, 0.0, 0.0, -sa * cb, -sa * sb, ca, 0.0, ca * cb, ca * sb, sa, 0.0, (n + height) * ca * cb, (n + height) * ca * sb, (n * (1 - WGS84_E2) + height) * sa, 1.0)


def sampling_divisor(depth: int, deepest: int, rate: float) -> float:
    return (1 / rate) ** max(0, deepest - depth)


def depth_target(count: int, depth: int, deepest: int, rate: float, children: int = 0) -> int:
    """Rows that a simplified tile keeps."""
    target = math.ceil(count / sampling_divisor(depth, deepest, rate))
    return min(count, max(1, target, children if children > 1 else 0))


def geometric_error(root_error: float, depth: int, rate: float) -> float:
    return root_error * rate**depth


def root_error(own_error: float, diagonal: float, count: int, deepest: int, options: TilingOptions) -> tuple[float, str]:
    """The root's geometric error and where it comes from."""
    least = options.min_geometric_error
    if least is not None and least > 0:
        return least / options.sampling_rate_per_level**deepest, "configured_min_geometric_error"
    if math.isfinite(own_error) and own_error > 0:
        return max(own_error, diagonal * 1e-6, 1e-6), "estimated_root_simplify"
    return max(diagonal * (1e-6 if count <= 1 else 0.125), 1e-6), "estimated_root_fallback"


def apportion(target: int, counts: list[int], floors: list[int]) -> list[int]:
    """Splits a target over parts in proportion to their counts: at least the floors, at most the counts.

    Each part first gets its floor and, of the rest, the whole rows of its share by count, as far as it has room.  What is
    left goes out a row a part, round after round, by what the share lacked, then larger count, then position.
    """
    whole = sum(counts)
    out = [min(c, f) for c, f in zip(counts, floors)]
    left = min(max(target, sum(out)), whole) - sum(out)
    room = [c - o for c, o in zip(counts, out)]
    if left <= 0:
        return out
    add = [min(r, left * c // whole) for c, r in zip(counts, room)]
    lacks = [left * c - a * whole for c, a in zip(counts, add)]
    left -= sum(add)
    ranked = sorted(range(len(counts)), key=lambda k: (-lacks[k], -counts[k], k))
    while left and (open_parts := [k for k in ranked if add[k] < room[k]]):
        rounds = min(left // len(open_parts), min(room[k] - add[k] for k in open_parts))
        for k in open_parts if rounds else open_parts[:left]:
            add[k] += max(rounds, 1)
            left -= max(rounds, 1)
    return [o + a for o, a in zip(out, add)]
