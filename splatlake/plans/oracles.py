"""DuckDB SQL of the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

from ..operators.kdtree import AXIS_RATIO
from .queries import CANON0, GRID, KEPT, PLANES, RAW0

_AX = "xyz"
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _d(c: str) -> str:
    return f"{c}::DOUBLE"


def _each(form: str, over=_AX, sep: str = ", ") -> str:
    return sep.join(form.format(c=c) for c in over)


def _volume(lo, hi) -> str:
    e = [f"greatest({b}-{a}, 0.0::DOUBLE)" for a, b in zip(lo, hi)]
    least = f"greatest(1e-9::DOUBLE, greatest({', '.join(e)})*1e-9::DOUBLE)"
    return "*".join(f"greatest({v}, {least})" for v in e)


BOUNDS = _each("min({c}::DOUBLE) AS min_{c}") + ", " + _each("max({c}::DOUBLE) AS max_{c}")

# Rotation and covariance.
_UNIT = CANON0 + """, qn AS (SELECT *, sqrt(qx::DOUBLE*qx::DOUBLE+qy::DOUBLE*qy::DOUBLE+qz::DOUBLE*qz::DOUBLE+qw::DOUBLE*qw::DOUBLE) AS n FROM cloud0),
 u AS (SELECT * EXCLUDE (n), qx::DOUBLE/m AS ux, qy::DOUBLE/m AS uy, qz::DOUBLE/m AS uz, CASE WHEN n < 1e-12 THEN 1.0::DOUBLE ELSE qw::DOUBLE/m END AS uw FROM (SELECT *, CASE WHEN n < 1e-12 THEN 1.0::DOUBLE ELSE n END AS m FROM qn))"""
_R = (
    ("(1-2*(uy*uy+uz*uz))", "(2*(ux*uy-uz*uw))", "(2*(ux*uz+uy*uw))"),
    ("(2*(ux*uy+uz*uw))", "(1-2*(ux*ux+uz*uz))", "(2*(uy*uz-ux*uw))"),
    ("(2*(ux*uz-uy*uw))", "(2*(uy*uz+ux*uw))", "(1-2*(ux*ux+uy*uy))"),
)


def _cov(i: int, j: int) -> str:
    return "(" + "+".join(f"{_R[i][k]}*{_R[j][k]}*exp(2.0*s{k}::DOUBLE)" for k in range(3)) + ")"


_COV = [_cov(_AX.index(p[0]), _AX.index(p[1])) for p in _PAIRS]
_EXT = _UNIT + ", ext AS (SELECT *, " + ", ".join(f"(3.0*sqrt(greatest({_COV[k]}, 1e-20)))::FLOAT AS e{c}" for k, c in ((0, "x"), (3, "y"), (5, "z"))) + ", 3.0*sqrt(exp(2.0*s0::DOUBLE)+exp(2.0*s1::DOUBLE)+exp(2.0*s2::DOUBLE)) AS radius FROM u)"
_WEIGHT = "greatest(opacity::DOUBLE, 1e-4)*(ex::DOUBLE*ex::DOUBLE+ey::DOUBLE*ey::DOUBLE+ez::DOUBLE*ez::DOUBLE)"

# Histogram of y.
_HIST = CANON0 + ", yb AS (SELECT min(y::DOUBLE) AS low, max(y::DOUBLE)-min(y::DOUBLE) AS extent FROM cloud0), h AS (SELECT least(greatest(floor((y::DOUBLE-low)/extent*128.0), 0), 127)::INT AS bin, count(*) AS n, " + BOUNDS + " FROM cloud0, yb GROUP BY 1)"
_SIDE = {p: ", ".join(f"min(min_{c}) FILTER (bin {op} b.range) AS {p}lo_{c}, max(max_{c}) FILTER (bin {op} b.range) AS {p}hi_{c}" for c in _AX) + f", sum(n) FILTER (bin {op} b.range) AS n{p}" for p, op in (("b", "<"), ("a", ">="))}

# Routing.
_ROUTED = CANON0
for _level in range(3):
    _from = "cloud0" if not _level else f"l{_level}"
    _prior = "''" if not _level else "path"
    _case = " ".join(f"WHEN {_prior} = '{p}' THEN {_prior} || CASE WHEN {a}::DOUBLE >= {o}::DOUBLE THEN '1' ELSE '0' END" for p, a, o in PLANES if len(p) == _level)
    _ROUTED += f", l{_level + 1} AS (SELECT splat_id, x, y, z, CASE {_case} ELSE {_prior} END AS path FROM {_from})"
_LEAF = _ROUTED + f", leaf AS (SELECT path, count(*) AS n, {BOUNDS} FROM l3 GROUP BY path), vol AS (SELECT *, {_volume([f'min_{c}' for c in _AX], [f'max_{c}' for c in _AX])} AS volume FROM leaf)"
_NODES = _LEAF + f", up AS (SELECT path[1:k.range] AS node, leaf.* FROM leaf, range(0, 4) k WHERE k.range <= length(path)), nodes AS (SELECT node, sum(n)::BIGINT AS n, {_each('min(min_{c}) AS min_{c}')}, {_each('max(max_{c}) AS max_{c}')} FROM up GROUP BY node)"

# One tile on a fixed grid.
_TILE = _EXT + f""", b AS (SELECT {_each('min({c}::DOUBLE) AS low_{c}')}, {_each('max({c}::DOUBLE)-min({c}::DOUBLE) AS ext_{c}')} FROM cloud0),
 g AS (SELECT *, sqrt(ext_x*ext_x+ext_y*ext_y+ext_z*ext_z)/{GRID}.0::DOUBLE AS diag FROM b),
 tile0 AS (SELECT ext.* EXCLUDE (radius), radius::FLOAT AS radius, diag, {', '.join(f'floor(least(greatest(({c}::DOUBLE-low_{c})/greatest(ext_{c}, 1e-6), 0.0), 0.999999)*{GRID})::BIGINT AS v{c}' for c in _AX)} FROM ext, g),
 tile AS (SELECT *, vx+{GRID}*(vy+{GRID}*vz) AS voxel, greatest(greatest(opacity::DOUBLE,1e-4)*sqrt(greatest(radius::DOUBLE/diag,0.35)),1e-12) AS weight FROM tile0)"""


def _cost(s: str) -> str:
    d = "+".join(f"({c}::DOUBLE-({s.format(c=c)}))*({c}::DOUBLE-({s.format(c=c)}))" for c in _AX)
    return f"({d}-0.15*radius::DOUBLE*radius::DOUBLE)/greatest(diag*diag, 1e-12)"


_ORDER = "cost, weight DESC, radius DESC, splat_id"
_RANKED = _TILE + f""", sums AS (SELECT *, sum(weight) OVER v AS sw, {_each('sum(weight*{c}::DOUBLE) OVER v AS sum_{c}')} FROM tile WINDOW v AS (PARTITION BY voxel)),
 c1 AS (SELECT *, {_cost('sum_{c}/sw')} AS cost FROM sums), k1 AS (SELECT *, row_number() OVER (PARTITION BY voxel ORDER BY {_ORDER}) AS rk FROM c1),
 f1 AS (SELECT *, max(weight) FILTER (rk = 1) OVER v AS fw, {_each('max({c}::DOUBLE) FILTER (rk = 1) OVER v AS f_{c}')} FROM k1 WINDOW v AS (PARTITION BY voxel)),
 c2 AS (SELECT * EXCLUDE (cost), CASE WHEN rk = 1 THEN '-infinity'::DOUBLE ELSE {_cost('(sum_{c}-fw*f_{c})/greatest(sw-fw,1e-12)')} END AS cost FROM f1),
 ranked AS (SELECT * EXCLUDE (rk), row_number() OVER (PARTITION BY voxel ORDER BY {_ORDER}) AS rank FROM c2)"""
_KEPT = _RANKED + f""", slots AS (SELECT *, least(rank, 3)::INT AS stage, row_number() OVER (ORDER BY least(rank, 3), CASE WHEN rank = 1 THEN voxel::DOUBLE ELSE -weight END, CASE WHEN rank > 2 THEN -radius::DOUBLE END, CASE WHEN rank > 2 THEN -splat_id ELSE splat_id END)-1 AS slot FROM ranked),
 kept AS (SELECT * FROM slots WHERE slot < {KEPT})"""
_DIST = "sqrt((t.x::DOUBLE-k.x::DOUBLE)*(t.x::DOUBLE-k.x::DOUBLE)+(t.y::DOUBLE-k.y::DOUBLE)*(t.y::DOUBLE-k.y::DOUBLE)+(t.z::DOUBLE-k.z::DOUBLE)*(t.z::DOUBLE-k.z::DOUBLE))"
_ASSIGNED = _KEPT + f""", scored AS (SELECT t.splat_id, k.slot, row_number() OVER (PARTITION BY t.splat_id ORDER BY {_DIST}+k.radius::DOUBLE, k.splat_id) AS pick FROM tile t JOIN kept k USING (voxel)),
 assigned AS (SELECT t.*, s.slot FROM tile t JOIN scored s ON t.splat_id = s.splat_id AND s.pick = 1)"""
_MEANS = _ASSIGNED + f", means AS (SELECT slot, count(*) AS members, sum(weight) AS w, {_each('(sum(weight*{c}::DOUBLE)/sum(weight))::FLOAT AS m{c}')} FROM assigned GROUP BY slot)"

_QUAT = """, qs AS (SELECT splat_id, sqrt(qx::DOUBLE*qx::DOUBLE+qy::DOUBLE*qy::DOUBLE+qz::DOUBLE*qz::DOUBLE+qw::DOUBLE*qw::DOUBLE) AS n, qx::DOUBLE AS a, qy::DOUBLE AS b, qz::DOUBLE AS c, qw::DOUBLE AS d FROM cloud0),
 un AS (SELECT splat_id, [a/n, b/n, c/n, d/n] AS u FROM qs), ix AS (SELECT *, list_position(list_transform(u, lambda v: abs(v)), list_aggregate(list_transform(u, lambda v: abs(v)), 'max')) AS i FROM un)"""
_PART = "(CASE WHEN (u[{k}] < 0) <> (u[i] < 0) THEN 512 ELSE 0 END + least(511, floor(511.0::DOUBLE*(abs(u[{k}])/0.7071067811865476::DOUBLE)+0.5::DOUBLE)))::BIGINT"


def _packed() -> str:
    out = "(i-1)::BIGINT"
    for k in range(1, 5):
        out = f"(CASE WHEN i = {k} THEN {out} ELSE {out}*1024+{_PART.format(k=k)} END)"
    return out


_FDC = ["f_dc_0", "f_dc_1", "f_dc_2"]
# Fixed order of the 48 coefficient-major values: source position in the embedding (1-based).
_SH3 = [12, 13, 14] + [15 + c * 15 + k for k in range(15) for c in range(3)]


def _fixed(lat: str, lon: str) -> list[str]:
    sa, ca, sb, cb = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    f = "(1::DOUBLE/298.257223563::DOUBLE)"
    e2 = f"({f}*(2-{f}))"
    n = f"(6378137.0::DOUBLE/sqrt(1-{e2}*{sa}*{sa}))"
    return [f"-{sb}", cb, "0", "0", f"-{sa}*{cb}", f"-{sa}*{sb}", ca, "0", f"{ca}*{cb}", f"{ca}*{sb}", sa, "0", f"({n}+10)*{ca}*{cb}", f"({n}+10)*{ca}*{sb}", f"({n}*(1-{e2})+10)*{sa}", "1"]


ORACLE_SQL = {
    "canonical_core": f"WITH {CANON0} SELECT splat_id, x, y, z, s0, s1, s2, qx, qy, qz, qw, round(opacity::DOUBLE, 6)+0.0 AS opacity FROM cloud0",
    "canonical_sh3": f"SELECT vec_id AS splat_id, (p.range-1)::INT AS k, embedding[([{', '.join(map(str, _SH3))}])[p.range]] AS v FROM embeddings, range(1, 49) p",
    "opacity_khr": f"WITH {RAW0} SELECT splat_id, least(greatest(op_logit::DOUBLE, 0.0), 1.0)::FLOAT AS opacity FROM raw0",
    "log_scale": f"WITH {RAW0} SELECT splat_id, round(ln(greatest((y-50)::DOUBLE, 1e-8)), 6)+0.0 AS log_scale FROM raw0",
    "quat_normalise": f"WITH {RAW0}, n AS (SELECT *, sqrt(r0::DOUBLE*r0::DOUBLE+r1::DOUBLE*r1::DOUBLE+r2::DOUBLE*r2::DOUBLE+r3::DOUBLE*r3::DOUBLE) AS l, CASE WHEN r3 < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS g FROM raw0) SELECT splat_id, {', '.join(f'round(r{k}::DOUBLE/l*g, 6)+0.0 AS q{c}' for k, c in enumerate('xyzw'))} FROM n",
    "extents_3sigma": f"WITH {_EXT} SELECT splat_id, {_each('round(e{c}::DOUBLE, 5) AS e{c}')} FROM ext",
    "radius_3sigma": f"WITH {_EXT} SELECT splat_id, round(radius, 6) AS radius FROM ext",
    "covariance6": f"WITH {_UNIT} SELECT splat_id, {', '.join(f'round({v}, 9)+0.0 AS {n}' for v, n in zip(_COV, _PAIRS))} FROM u",
    "split_weight": f"WITH {_EXT} SELECT splat_id, round(CASE WHEN {_WEIGHT} > 0 THEN {_WEIGHT} ELSE 1.0 END, 5) AS weight FROM ext",
    "global_bounds": f"WITH {CANON0} SELECT count(*) AS n, {BOUNDS} FROM cloud0",
    "weighted_moments": f"WITH {CANON0}, s AS (SELECT sum(opacity::DOUBLE) AS w, {_each('sum(opacity::DOUBLE*{c}::DOUBLE) AS {c}')}, {', '.join(f'sum(opacity::DOUBLE*{p[0]}::DOUBLE*{p[1]}::DOUBLE) AS {p}' for p in _PAIRS)} FROM cloud0) SELECT round(w, 4) AS w, {_each('round({c}/w, 4) AS mean_{c}')}, {', '.join(f'round({p}/w-{p[0]}*{p[1]}/w/w, 3) AS cov_{p}' for p in _PAIRS)} FROM s",
    "cloud_bounds_3sigma": f"WITH {_EXT} SELECT {_each('round(min({c}::DOUBLE-e{c}::DOUBLE), 4) AS min_{c}')}, {_each('round(max({c}::DOUBLE+e{c}::DOUBLE), 4) AS max_{c}')} FROM ext",
    "projection_histogram": f"WITH {_HIST} SELECT * FROM h",
    "prefix_suffix_volume": f"WITH {_HIST}, w AS (SELECT bin, sum(n) OVER lo AS n_below, sum(n) OVER hi AS n_above, {', '.join(f'min(min_{c}) OVER {p} AS {p}l{c}, max(max_{c}) OVER {p} AS {p}h{c}' for p in ('lo', 'hi') for c in _AX)} FROM h WINDOW lo AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hi AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT bin, n_below::BIGINT AS n_below, n_above::BIGINT AS n_above, round({_volume([f'lol{c}' for c in _AX], [f'loh{c}' for c in _AX])}, 3) AS v_below, round({_volume([f'hil{c}' for c in _AX], [f'hih{c}' for c in _AX])}, 3) AS v_above FROM w WHERE n_below IS NOT NULL",
    "best_split": f"WITH {_HIST}, t AS (SELECT sum(n) AS n, {_each('min(min_{c}) AS lo_{c}, max(max_{c}) AS hi_{c}')} FROM h), s AS (SELECT b.range AS boundary, {_SIDE['b']}, {_SIDE['a']} FROM range(1, 128) b, h GROUP BY b.range), f AS (SELECT s.*, t.*, lo_y+(hi_y-lo_y)*boundary/128.0 AS split FROM s, t WHERE nb > 0 AND na > 0), o AS (SELECT boundary::INT AS boundary, nb::BIGINT AS n_below, na::BIGINT AS n_above, split, ({_volume([f'blo_{c}' for c in _AX], [f'bhi_{c}' for c in _AX])}+{_volume([f'alo_{c}' for c in _AX], [f'ahi_{c}' for c in _AX])})/({_volume([f'lo_{c}' for c in _AX], [f'hi_{c}' for c in _AX])})+0.5::DOUBLE*least(1.0::DOUBLE, abs(split-(lo_y+(hi_y-lo_y)/2))/((hi_y-lo_y)/2))+0.1::DOUBLE*abs(nb-na)::DOUBLE/n::DOUBLE AS score FROM f) SELECT boundary, n_below, n_above, round(split, 6) AS split, round(score, 9) AS score FROM o ORDER BY score, boundary LIMIT 10",
    "ply_round_trip": f"WITH {CANON0} SELECT splat_id, x, y, z, s0, s1, s2, {_each('round({c}::DOUBLE, 5)+0.0 AS {c}', ('qx', 'qy', 'qz', 'qw', 'opacity'))}, f_dc_0 AS sh0, f_dc_1 AS sh1, f_dc_2 AS sh2 FROM cloud0",
    "engine_first_split": f"""WITH {CANON0}, whole AS (SELECT count(*) AS n, {BOUNDS} FROM cloud0),
 ax AS ({' UNION ALL '.join(f'SELECT {k} AS axis, min_{c} AS low, max_{c} AS high, max_{c}-min_{c} AS extent FROM whole' for k, c in enumerate(_AX))}),
 ranked AS (SELECT *, row_number() OVER (ORDER BY extent DESC, axis) AS r, max(extent) OVER () AS widest FROM ax),
 chosen AS (SELECT *, CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE greatest(1.0, sqrt(widest/extent)) END AS factor FROM ranked WHERE r = 1 OR (r = 2 AND widest/extent < {AXIS_RATIO})),
 p AS (SELECT c.axis, c.low, c.extent, x, y, z, CASE c.axis WHEN 0 THEN x::DOUBLE WHEN 1 THEN y::DOUBLE ELSE z::DOUBLE END AS v FROM cloud0, chosen c),
 h AS (SELECT axis, least(greatest(floor((v-low)/extent*128.0), 0), 127)::INT AS bin, count(*) AS n, {BOUNDS} FROM p GROUP BY 1, 2),
 s AS (SELECT h.axis, b.range::INT AS boundary, {_SIDE['b']}, {_SIDE['a']} FROM h, range(1, 128) b GROUP BY 1, 2),
 m AS (SELECT s.axis, c.low+c.extent*boundary/128.0 AS split, {_volume([f'blo_{c}' for c in _AX], [f'bhi_{c}' for c in _AX])} AS vb, {_volume([f'alo_{c}' for c in _AX], [f'ahi_{c}' for c in _AX])} AS va, nb, na, c.low, c.extent, c.factor FROM s JOIN chosen c USING (axis) WHERE nb > 0 AND na > 0),
 best AS (SELECT axis, split FROM m, whole WHERE split > low AND split < low+extent ORDER BY ((va+vb)/({_volume([f'whole.min_{c}' for c in _AX], [f'whole.max_{c}' for c in _AX])})+0.5*least(1.0, abs(split-(low+extent/2))/(extent/2))+0.1*abs(nb-na)/n)*factor LIMIT 1)
SELECT axis::INT AS axis, round(any_value(split), 9) AS "offset", count(*) FILTER (v < split) AS n_below, count(*) FILTER (v >= split) AS n_above FROM best JOIN p USING (axis) GROUP BY axis""",
    "halfspace_route": f"WITH {CANON0} SELECT splat_id, CASE WHEN x::DOUBLE*0.6::DOUBLE+y::DOUBLE*0.8::DOUBLE+z::DOUBLE*0.0::DOUBLE >= 80.0 THEN 1 ELSE 0 END AS slot FROM cloud0",
    "leaf_route": f"WITH {_ROUTED} SELECT splat_id, path FROM l3",
    "kd_leaf_stats": f"WITH {_LEAF} SELECT path, n, {_each('min_{c}')}, {_each('max_{c}')} FROM leaf",
    "ancestor_rollup": f"WITH {_NODES} SELECT * FROM nodes",
    "tree_stats": f"WITH {_NODES} SELECT count(*) AS nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes m WHERE m.node <> '' AND m.node[1:length(m.node)-1] = nodes.node)) AS leaves, max(length(node))::INT AS max_level FROM nodes",
    "volume_median_flag": f"WITH {_LEAF}, m AS (SELECT length(path) AS depth, quantile_cont(volume, 0.5) AS median, count(*) AS tiles FROM vol GROUP BY 1) SELECT path, depth::INT AS depth, round(volume, 3) AS volume, round(median, 3) AS median, tiles > 1 AND volume > 3*median AS flagged FROM vol JOIN m ON length(path) = depth",
    "root_refine_topk": f"WITH {_LEAF}, r AS (SELECT path, volume, row_number() OVER (ORDER BY volume DESC, path) AS rank, count(*) OVER () AS total FROM vol) SELECT path, round(volume, 3) AS volume, rank::INT AS rank FROM r WHERE rank <= greatest(1, total//2)",
    "voxel_assign": f"WITH {_TILE} SELECT splat_id, voxel, round(weight, 6) AS weight FROM tile",
    "voxel_occupancy": f"WITH {_TILE} SELECT 0 AS node, count(DISTINCT voxel) AS occupied FROM tile",
    "voxel_representative": f"WITH {_RANKED} SELECT voxel, splat_id FROM ranked WHERE rank = 1",
    "extra_candidates": f"WITH {_RANKED} SELECT voxel, splat_id FROM ranked WHERE rank = 2",
    "fill_leftover": f"WITH {_KEPT} SELECT slot, splat_id, stage FROM kept",
    "nearest_rep_assign": f"WITH {_ASSIGNED} SELECT splat_id, slot FROM assigned",
    "merge_weighted_mean": f"WITH {_ASSIGNED} SELECT slot, count(*) AS members, {_each('round((sum(weight*{c}::DOUBLE)/sum(weight))::FLOAT::DOUBLE, 2)+0.0 AS {c}')}, round((sum(weight*opacity::DOUBLE)/sum(weight))::FLOAT::DOUBLE, 4) AS opacity, {', '.join(f'round((sum(weight*{f}::DOUBLE)/sum(weight))::FLOAT::DOUBLE, 4)+0.0 AS sh{k}' for k, f in enumerate(_FDC))} FROM assigned GROUP BY slot",
    "merge_covariance": f"WITH {_MEANS}, s AS (SELECT slot, {', '.join(f'sum(weight*({_COV[k]}+({a}::DOUBLE-m{a}::DOUBLE)*({b}::DOUBLE-m{b}::DOUBLE)))/any_value(w) AS r{a}{b}' for k, (a, b) in enumerate(_PAIRS))} FROM assigned JOIN means USING (slot) GROUP BY slot), c AS (SELECT slot, {', '.join(f'greatest(r{p}, 1e-20) AS t{p}' if p[0] == p[1] else f'r{p} AS t{p}' for p in _PAIRS)} FROM s) SELECT slot, round(log10(txx+tyy+tzz), 3) AS log_trace, {', '.join(f'round(t{p}/(txx+tyy+tzz), 3)+0.0 AS {p}' for p in _PAIRS)} FROM c",
    "own_error_p95": f"WITH {_ASSIGNED}, e AS (SELECT {_DIST}+t.radius::DOUBLE+k.radius::DOUBLE AS e FROM assigned t JOIN kept k USING (slot)) SELECT 0 AS node, round(quantile_cont(e, 0.95), 4) AS own_error FROM e",
    "handoff_union": f"WITH {_ROUTED} SELECT splat_id, path[1:1] AS parent, (row_number() OVER (PARTITION BY path[1:1] ORDER BY path, splat_id)-1)::INT AS row FROM l3 WHERE length(path) >= 2",
    "emitted_children": f"WITH {_LEAF} SELECT path, (SELECT path[1:length(path)-k.range] FROM range(1, 4) k WHERE k.range <= length(path) AND path[1:length(path)-k.range] NOT IN ('0', '01') ORDER BY k.range LIMIT 1) AS emitted_parent FROM leaf",
    "depth_targets": "SELECT d.range::INT AS depth, least(n, greatest(1, ceil(n/pow(2, 6-d.range))))::BIGINT AS target FROM range(0, 7) d, (SELECT count(*) AS n FROM events)",
    "apportion_targets": """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
 p AS (SELECT n_regionkey, n_nationkey, coalesce(n, 0) AS n, least(coalesce(n, 0), 1+5*(n_nationkey%3)) AS floor, t.range::INT AS tenth FROM nation LEFT JOIN c ON c_nationkey = n_nationkey, range(0, 11) t),
 w AS (SELECT *, sum(n) OVER g AS whole, greatest(sum(n) OVER g * tenth // 10, sum(floor) OVER g) - sum(floor) OVER g AS remaining FROM p WINDOW g AS (PARTITION BY n_regionkey, tenth)),
 e AS (SELECT *, least(n-floor, remaining*n // greatest(whole, 1)) AS extra FROM w),
 r AS (SELECT *, remaining - sum(extra) OVER (PARTITION BY n_regionkey, tenth) AS rest, row_number() OVER (PARTITION BY n_regionkey, tenth ORDER BY remaining*n-extra*whole DESC, n DESC, n_nationkey) AS priority FROM e),
 units AS (SELECT n_regionkey, tenth, n_nationkey, rest, row_number() OVER (PARTITION BY n_regionkey, tenth ORDER BY turn, priority) AS turn FROM (SELECT *, unnest(range(1, (n-floor-extra+1)::BIGINT)) AS turn FROM r)),
 more AS (SELECT n_regionkey, tenth, n_nationkey, count(*) AS m FROM units WHERE turn <= rest GROUP BY ALL)
SELECT n_regionkey, n_nationkey, tenth, (floor+extra+coalesce(m, 0))::BIGINT AS part FROM r LEFT JOIN more USING (n_regionkey, tenth, n_nationkey)""",
    "geometric_error_by_depth": "SELECT d.range::INT AS depth, 8.0::DOUBLE*pow(0.5::DOUBLE, d.range) AS error FROM range(0, 7) d",
    "auto_depth": "WITH RECURSIVE n AS (SELECT unnest([160000, 160001, 320000, 320001, 1000000])::BIGINT AS n), d AS (SELECT n, CASE WHEN n <= 160000 THEN 0 ELSE ceil(ln(160000.0/n)/ln(0.5)-1e-12)::INT END AS depth FROM n), e AS (SELECT 1 AS r, 2::BIGINT AS t UNION ALL SELECT r+1, t+t//2 FROM e WHERE r < 40) SELECT n, depth, CASE WHEN depth = 0 OR n <= 5000*pow(2, depth) THEN 1 ELSE (SELECT min(r) FROM e WHERE t >= n/(5000*pow(2, depth))) END::INT AS refinement FROM d",
    "enu_matrix": " UNION ALL ".join(f"SELECT {lat}::DOUBLE AS lat, {lon}::DOUBLE AS lon, {k}::INT AS k, round(({v})::DOUBLE, 6)+0.0 AS v" for lat, lon in (("0", "0"), ("35", "139"), ("(-33)", "151")) for k, v in enumerate(_fixed(lat, lon))),
    "spz_position": f"WITH {CANON0} SELECT splat_id, {', '.join(f'round_even(({c}::DOUBLE-{t}::DOUBLE)::FLOAT::DOUBLE*4096.0::DOUBLE, 0)::BIGINT AS p{c}' for c, t in (('x', 75.0), ('y', 50.0), ('z', 15.0)))} FROM cloud0",
    "spz_opacity_color_scale": f"WITH {CANON0} SELECT splat_id, least(greatest(round_even(least(greatest(opacity::DOUBLE, 0.0), 1.0)*255.0::DOUBLE, 0), 0), 255)::INT AS o, {', '.join(f'least(greatest(round_even({f}::DOUBLE*38.25::DOUBLE+127.5::DOUBLE, 0), 0), 255)::INT AS c{k}' for k, f in enumerate(_FDC))}, {', '.join(f'least(greatest(round_even((s{k}::DOUBLE+10.0)*16.0::DOUBLE, 0), 0), 255)::INT AS s{k}' for k in range(3))} FROM cloud0",
    "spz_sh": f"WITH v AS (SELECT vec_id AS splat_id, (p.range-1)::INT AS k, embedding[([{', '.join(map(str, _SH3))}])[p.range]]::DOUBLE AS v FROM embeddings, range(4, 49) p) SELECT splat_id, k, least(greatest(floor((round_even(v*128.0::DOUBLE+128.0::DOUBLE, 0)+8.0::DOUBLE)/16.0::DOUBLE)*16.0::DOUBLE, 0), 255)::INT AS b FROM v",
    "spz_quat": f"WITH {CANON0}{_QUAT} SELECT splat_id, {_packed()} AS packed FROM ix",
}
