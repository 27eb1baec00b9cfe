"""Volume-aware k-d partition of positions, one level of splits per round.

The driver holds the tree (a record per node); positions stay in a DataFrame with the node that each is in.  A round
aggregates 128-bin histograms per candidate node and axis, picks each node's plane in a grouped kernel over at most 256
rows, routes the positions with a join on the node, and aggregates the new nodes' exact counts and bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C

BINS, EPS = 128, 1e-9
LONG_ASPECT, VOLUME_RATIO, AXIS_RATIO = 4.0, 3.0, 2.0
IDENTITY = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
#: Above so many rows a table of planes is joined without a broadcast.
BROADCAST_ROWS = 200_000


@dataclass
class Node:
    id: int
    path: str = ""
    level: int = 0
    depth: int = 0
    x: int = 0
    slot: int = 0
    parent: int = -1
    count: int = 0
    low: tuple = (0.0, 0.0, 0.0)
    high: tuple = (0.0, 0.0, 0.0)
    virtual: bool = False
    children: list[int] = field(default_factory=list)
    direction: tuple | None = None
    offset: float | None = None
    box: list[float] | None = None
    # What the search still may do with the node.
    no_split: bool = False
    no_aspect: bool = False
    refinement: int | None = None
    no_refinement: bool = False
    rebalance: bool = False
    no_rebalance: bool = False

    @property
    def leaf(self) -> bool:
        return not self.children

    @property
    def key(self) -> str:
        return f"{self.level}/{self.x}/0/0"

    @property
    def uri(self) -> str:
        return f"tiles/{self.level}/{self.x}/0_0.glb"

    @property
    def extent(self) -> list[float]:
        return [max(0.0, b - a) for a, b in zip(self.low, self.high)]


@dataclass
class Axis:
    """A direction that a node may be split along, with its range and score multiplier."""

    index: int
    direction: tuple
    low: float
    high: float
    factor: float = 1.0

    @property
    def extent(self) -> float:
        return self.high - self.low


def volume(extent) -> float:
    e = [v if math.isfinite(v) and v > 0 else 0.0 for v in extent]
    least = max(EPS, max(e) * EPS)
    return math.prod(max(v, least) for v in e)


def aspect(extent) -> float:
    longest, second = sorted((max(0.0, v) for v in extent), reverse=True)[:2]
    least = max(EPS, longest * EPS)
    return longest / max(second, least) if longest > least else 1.0


def _near(a: float, b: float) -> float:
    return EPS * max(1.0, *(abs(v) for v in (a, b) if math.isfinite(v)), 0.0)


def better(a: tuple, b: tuple | None) -> bool | None:
    """Whether metrics a come before b, smaller first, values within a relative epsilon being equal; None if all are."""
    if b is None:
        return True
    for x, y in zip(a, b):
        if x < y - _near(x, y):
            return True
        if x > y + _near(x, y):
            return False
    return None


def best_boundary(count: np.ndarray, low: np.ndarray, high: np.ndarray, axis: Axis, parent_volume: float, wm: float, wc: float) -> tuple[tuple, float] | None:
    """Metrics and offset of the best of the 127 bin boundaries: prefix and suffix boxes, then the ordered comparison."""
    n = int(count.sum())
    pre_low, pre_high = np.minimum.accumulate(low), np.maximum.accumulate(high)
    suf_low, suf_high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high[::-1])[::-1]
    below, best, at = np.cumsum(count), None, None
    eps = max(EPS, abs(axis.extent) * EPS)
    half = axis.extent / 2
    for b in range(1, len(count)):
        lower = int(below[b - 1])
        split = axis.low + axis.extent * b / len(count)
        if not 0 < lower < n or not axis.low + eps < split < axis.high - eps:
            continue
        v = volume(pre_high[b - 1] - pre_low[b - 1]), volume(suf_high[b] - suf_low[b])
        mid = min(1.0, abs(split - (axis.low + half)) / half)
        balance = abs(2 * lower - n) / n
        share = sum(v) / parent_volume if parent_volume > EPS else sum(v)
        metrics = (share + wm * mid + wc * balance, sum(v), max(v), balance, mid)
        if better(metrics, best):
            best, at = metrics, split
    return None if best is None else (best, at)


def best_axis(choices: list[tuple[Axis, tuple, float]]) -> tuple[Axis, float] | None:
    """Of the best boundaries of the axes, scores times the axes' multipliers; then the wider, then the lower axis."""
    top = None
    for axis, metrics, offset in choices:
        metrics = (metrics[0] * axis.factor, *metrics[1:])
        if top is None:
            top = (axis, metrics, offset)
            continue
        wins = better(metrics, top[1])
        if wins is None:
            wins = better((-axis.extent,), (-top[0].extent,))
        if wins is None:
            wins = axis.index < top[0].index
        if wins:
            top = (axis, metrics, offset)
    return top and (top[0], top[2])


def axes_by_extent(ranges: list[tuple[float, float]], basis=IDENTITY) -> list[Axis]:
    return sorted((Axis(k, tuple(basis[k]), lo, hi) for k, (lo, hi) in enumerate(ranges)), key=lambda a: -a.extent)


def split_axes(ranked: list[Axis], longest_only: bool) -> list[Axis]:
    """The widest axis, and the second one if it is over half as wide."""
    first = ranked[0]
    if not first.extent > max(EPS, abs(first.extent) * EPS):
        return []
    second = ranked[1]
    if longest_only or not second.extent > EPS or not first.extent / second.extent < AXIS_RATIO:
        return [first]
    return [first, replace(second, factor=max(1.0, math.sqrt(first.extent / second.extent)))]


def principal_axes(positions: DataFrame, weight: str | None = "weight") -> tuple:
    """Right-handed principal axes of the weighted positions, widest first; one pass about a fixed centre, then Jacobi."""
    w = F.col(weight) if weight else F.lit(1.0)
    c = positions.agg(*[F.avg(C.num(v)).alias(v) for v in "xyz"]).first()
    d = {v: C.num(v) - F.lit(c[v]) for v in "xyz"}
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    r = positions.agg(F.sum(w).alias("w"), *[F.sum(w * d[v]).alias(v) for v in "xyz"], *[F.sum(w * d[a] * d[b]).alias(a + b) for a, b in pairs]).first()
    m = {a + b: r[a + b] / r.w - r[a] / r.w * (r[b] / r.w) for a, b in pairs}
    _, vectors = np.linalg.eigh(np.array([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]]))
    basis = [stable_sign(vectors[:, k]) for k in (2, 1)]
    basis.append(np.cross(*basis))
    return tuple(tuple(float(v) for v in b) for b in basis)


def stable_sign(v: np.ndarray) -> np.ndarray:
    """The direction whose largest component is positive."""
    return v if v[np.argmax(np.abs(v))] >= 0 else -v


class Partition:
    """The tree of one table of positions and the search for its splits."""

    def __init__(self, positions: DataFrame, options, basis=None, checkpoint_every: int = 6):
        self.options, self.basis, self.every = options, basis, checkpoint_every
        self.nodes = [Node(0)]
        self.positions = positions.withColumn("node", F.lit(0))
        self._next_x = 1
        self._refresh([self.nodes[0]])
        root = self.nodes[0]
        if root.count == 0:
            raise ValueError("no splats")
        if (options.tile_refinement or 1) > 1:
            root.refinement = 0

    # What is known of nodes.

    def _refresh(self, nodes: list[Node]) -> None:
        """Exact counts, bounds and, with a basis, projected ranges of these leaves."""
        rows = self._of(nodes).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *C.bounds(), *[f(self._dot(b)).alias(f"{n}_{k}") for k, b in enumerate(self.basis or ()) for n, f in (("lo", F.min), ("hi", F.max))])
        for r in rows.collect():
            node = self.nodes[r.node]
            node.count = r.n
            node.low, node.high = (tuple(r[f"{n}_{c}"] if r[f"{n}_{c}"] is not None else 0.0 for c in "xyz") for n in ("min", "max"))
            if self.basis:
                node.box = [(r[f"lo_{k}"], r[f"hi_{k}"]) for k in range(3)]

    @staticmethod
    def _dot(b):
        return C.num("x") * b[0] + C.num("y") * b[1] + C.num("z") * b[2]

    def _of(self, nodes: list[Node]) -> DataFrame:
        if len(nodes) == 1 and len(self.nodes) == 1:
            return self.positions
        ids = self.positions.sparkSession.createDataFrame(pd.DataFrame({"node": np.array([n.id for n in nodes], np.int32)}))
        return self.positions.join(F.broadcast(ids) if len(nodes) <= BROADCAST_ROWS else ids, "node")

    def _ranges(self, node: Node) -> list[tuple[float, float]]:
        return node.box if self.basis else list(zip(node.low, node.high))

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes if n.leaf]

    # Rules.

    def _may_refine(self, n: Node, step: int) -> bool:
        r = self.options.tile_refinement or 1
        return self.options.max_depth > 0 and r > 1 and n.refinement is not None and 0 < n.refinement <= step < r and not n.no_refinement

    def _candidate(self, n: Node, step: int) -> bool:
        o = self.options
        large = n.count > o.leaf_limit
        return n.count > 1 and (n.rebalance and not n.no_rebalance or self._may_refine(n, step) or n.level > 0 and not n.no_aspect and large and aspect(n.extent) > LONG_ASPECT or not n.no_split and n.depth < o.max_depth and large)

    def _action(self, n: Node, step: int) -> tuple[str, list[Axis]] | None:
        """The kind of split, in order of precedence, and its axes; marks what turned out impossible."""
        ranked = axes_by_extent(self._ranges(n), self.basis or IDENTITY)
        axes = split_axes(ranked, False)
        if n.rebalance and not n.no_rebalance:
            if axes:
                return "rebalance", axes
            n.rebalance, n.no_rebalance = False, True
            return None
        if self._may_refine(n, step):
            if axes:
                return "refine", axes
            n.no_refinement = True
            return None
        long = n.level > 0 and not n.no_aspect and n.count > self.options.leaf_limit and aspect([a.extent for a in ranked]) > LONG_ASPECT
        if long and ranked[1].extent > max(EPS, ranked[0].extent * EPS) and axes:
            return "long", split_axes(ranked, True)
        if not n.no_split and n.depth < self.options.max_depth and n.count > self.options.leaf_limit:
            if axes:
                return "count", axes
            n.no_split = True
        n.no_aspect = n.no_aspect or long
        return None

    @staticmethod
    def _give_up(n: Node, kind: str) -> None:
        if kind == "rebalance":
            n.rebalance, n.no_rebalance = False, True
        elif kind == "long":
            n.no_aspect = True
        else:
            n.no_split = True
            n.no_refinement = n.no_refinement or n.refinement is not None

    def _largest_half(self, actions: list[tuple[Node, str, list[Axis]]]) -> list[tuple[Node, str, list[Axis]]]:
        """Of the refining splits only the larger half by volume goes on."""
        refining = [a[0] for a in actions if a[1] == "refine"]
        if len(refining) <= 1:
            return actions
        refining.sort(key=lambda n: (-volume(n.extent), n.key))
        kept = {n.id for n in refining[: max(1, len(refining) // 2)]}
        return [a for a in actions if a[1] != "refine" or a[0].id in kept]

    def _mark_large(self, depths: set[int]) -> None:
        """Flags leaves of these depths that are over three times the median volume of their depth."""
        by: dict[int, list[tuple[Node, float]]] = {}
        for n in self.leaves():
            if n.depth in depths and volume(n.extent) > 0:
                by.setdefault(n.depth, []).append((n, volume(n.extent)))
        for entries in by.values():
            median = float(np.median([v for _, v in entries]))
            for n, v in entries:
                n.rebalance = len(entries) > 1 and v / median > VOLUME_RATIO and n.count > 1 and not n.no_rebalance

    # Rounds.

    def histograms(self, plans: list[tuple[Node, list[Axis]]]) -> DataFrame:
        """node, axis, bin, n and the box of the positions in the bin."""
        rows = [(n.id, a.index, *map(float, a.direction), float(a.low), float(a.extent)) for n, axes in plans for a in axes]
        wanted = self.positions.sparkSession.createDataFrame(rows, "node int, axis int, dx double, dy double, dz double, low double, extent double")
        at = self.positions.join(F.broadcast(wanted) if len(rows) <= BROADCAST_ROWS else wanted, "node")
        p = C.num("x") * F.col("dx") + C.num("y") * F.col("dy") + C.num("z") * F.col("dz")
        at = at.withColumn("bin", C.histogram_bin(F.when(F.isnan(p), F.col("low")).otherwise(p), F.col("low"), F.col("extent"), BINS))
        return at.groupBy("node", "axis", "bin").agg(F.count(F.lit(1)).alias("n"), *C.bounds())

    def _planes(self, plans: list[tuple[Node, str, list[Axis]]]) -> dict[int, tuple[Axis, float]]:
        wm, wc = self.options.split_midpoint_penalty, self.options.split_count_balance_penalty
        by = {n.id: (volume(n.extent), {a.index: a for a in axes}) for n, _, axes in plans}

        def choose(table: pd.DataFrame) -> pd.DataFrame:
            node = int(table["node"].iloc[0])
            parent, axes = by[node]
            found = []
            for index in axes:
                own = table[table["axis"] == index]
                count = np.zeros(BINS, np.int64)
                low, high = np.full((BINS, 3), np.inf), np.full((BINS, 3), -np.inf)
                at = own["bin"].to_numpy()
                count[at] = own["n"]
                low[at] = np.nan_to_num(own[["min_x", "min_y", "min_z"]].to_numpy(float), nan=np.inf)
                high[at] = np.nan_to_num(own[["max_x", "max_y", "max_z"]].to_numpy(float), nan=-np.inf)
                if got := best_boundary(count, low, high, axes[index], parent, wm, wc):
                    found.append((axes[index], *got))
            top = best_axis(found)
            return pd.DataFrame({"node": [node], "axis": [top[0].index], "offset": [top[1]]} if top else {"node": [], "axis": [], "offset": []}).astype({"node": "int32", "axis": "int32", "offset": "float64"})

        rows = self.histograms([(n, axes) for n, _, axes in plans]).groupBy("node").applyInPandas(choose, "node int, axis int, offset double")
        return {r.node: (by[r.node][1][r.axis], r.offset) for r in rows.collect()}

    def _route(self, split: list[tuple[Node, Axis, float, tuple[int, int]]]) -> None:
        rows = [(n.id, *map(float, a.direction), float(off), *ids) for n, a, off, ids in split]
        planes = self.positions.sparkSession.createDataFrame(rows, "node int, dx double, dy double, dz double, offset double, lower int, upper int")
        at = self.positions.join(F.broadcast(planes) if len(rows) <= BROADCAST_ROWS else planes, "node", "left")
        p = C.num("x") * F.col("dx") + C.num("y") * F.col("dy") + C.num("z") * F.col("dz")
        to = F.when(~F.isnan(p) & (p >= F.col("offset")), F.col("upper")).otherwise(F.col("lower"))
        self.positions = at.withColumn("node", F.coalesce(to, "node")).drop("dx", "dy", "dz", "offset", "lower", "upper")

    def fit(self) -> Partition:
        step, rounds = 1, 0
        while self.options.max_depth > 0:
            candidates = [n for n in self._in_tree_order() if n.leaf and self._candidate(n, step)]
            plans = [(n, *a) for n in candidates if (a := self._action(n, step))]
            plans = self._largest_half(plans)
            refines = any(kind == "refine" for _, kind, _ in plans)
            planes = self._planes(plans) if plans else {}
            split, kinds = [], {}
            for n, kind, _ in plans:
                if n.id not in planes:
                    self._give_up(n, kind)
                    continue
                if kind == "rebalance":
                    n.rebalance, n.no_rebalance = False, True
                ids = (len(self.nodes), len(self.nodes) + 1)
                for s, i in enumerate(ids):
                    self.nodes.append(Node(i, n.path + str(s), n.level + 1, n.depth + (kind == "count"), 0, s, n.id, no_aspect=n.no_aspect or kind == "long"))
                split.append((n, *planes[n.id], ids))
                kinds[n.id] = kind
            if not split:
                if not refines:
                    break
                step += 1
                continue
            self._route(split)
            rounds += 1
            if rounds % self.every == 0:
                self.positions = self.positions.checkpoint()
            self._refresh([self.nodes[i] for *_, ids in split for i in ids])
            done, depths = 0, set()
            for n, axis, offset, ids in split:
                kind = kinds[n.id]
                if min(self.nodes[i].count for i in ids) == 0:
                    # One empty side: the node stays a leaf; its rows are in the other child and count for the node.
                    self._undo(n, ids)
                    self._give_up(n, kind)
                    continue
                n.children, n.direction, n.offset, n.virtual = list(ids), tuple(axis.direction), offset, kind != "count"
                for i in ids:
                    c = self.nodes[i]
                    c.x, self._next_x = self._next_x, self._next_x + 1
                    if n.refinement is not None and n.refinement < (self.options.tile_refinement or 1):
                        c.refinement = n.refinement + (kind in ("refine", "count"))
                done += 1
                depths |= {n.depth, n.depth + (kind == "count")}
            if done:
                self._mark_large(depths)
            if refines:
                step += 1
            elif not done:
                break
        return self

    def _undo(self, n: Node, ids: tuple[int, int]) -> None:
        self.positions = self.positions.withColumn("node", F.when(F.col("node").isin(*ids), n.id).otherwise(F.col("node")))
        for i in ids:
            self.nodes[i].parent = -2  # not in the tree

    def _in_tree_order(self) -> list[Node]:
        out, stack = [], [0]
        while stack:
            n = self.nodes[stack.pop()]
            out.append(n)
            stack += reversed(n.children)
        return out

    # The tree as it is emitted.

    def finish(self) -> Partition:
        """Oriented boxes, where asked for, from the leaves' projected ranges rolled up the tree."""
        if self.basis:
            for n in reversed(self._in_tree_order()):
                if n.children:
                    n.box = [(min(self.nodes[c].box[k][0] for c in n.children), max(self.nodes[c].box[k][1] for c in n.children)) for k in range(3)]
            for n in self._in_tree_order():
                centre = [sum((lo + hi) / 2 * self.basis[k][c] for k, (lo, hi) in enumerate(n.box)) for c in range(3)]
                half = [max((hi - lo) / 2, 1e-6) for lo, hi in n.box]
                n.box = centre + [half[k] * v for k in range(3) for v in self.basis[k]]
        return self

    def tree(self) -> list[Node]:
        return self._in_tree_order()

    def emitted_children(self, n: Node) -> list[Node]:
        """Children as tiles: real ones first, then those below virtual ones."""
        own = [self.nodes[c] for c in n.children]
        return [c for c in own if not c.virtual] + [g for c in own if c.virtual for g in self.emitted_children(c)]

    def handoff_order(self, n: Node) -> list[Node]:
        """Tiles below n in the order of slots, through virtual nodes: the order of rows at n."""
        return [g for c in n.children for g in (self.handoff_order(self.nodes[c]) if self.nodes[c].virtual else [self.nodes[c]])]

    def table(self) -> DataFrame:
        """One row per node."""
        parents = {c.id: n for n in self.tree() for c in self.emitted_children(n) if not n.virtual}
        rows = [(n.id, n.key, n.path, n.level, n.depth, n.x, self.nodes[n.parent].key if n.parent >= 0 else None, n.slot, n.count, n.leaf, n.virtual, [float(v) for v in n.low], [float(v) for v in n.high], [float(v) for v in n.direction] if n.direction else None, n.offset, parents[n.id].key if n.id in parents else None) for n in self.tree()]
        return self.positions.sparkSession.createDataFrame(rows, "node int, key string, path string, level int, depth int, x long, parent_key string, child_slot int, count long, leaf boolean, virtual boolean, min array<double>, max array<double>, split_direction array<double>, split_offset double, emitted_parent string")

    def stats(self) -> dict[str, int]:
        tree = self.tree()
        return {"nodes": len(tree), "leaves": sum(n.leaf for n in tree), "virtual": sum(n.virtual for n in tree), "max_level": max(n.level for n in tree), "max_depth": max(n.depth for n in tree)}
