r"""N-gram Jaccard join: all pairs of documents whose shingle sets have a Jaccard similarity of at least a threshold.

The product of the document by n-gram incidence matrix with its transpose counts the shared shingles of every pair.  It
is made in column blocks (ranges of shingle hashes) and only over the entries that can decide a pair:

1. Equal sets are one node (a signature of the set); copies join their node again at the end.
2. In one fixed order of all shingles (frequent ones last), two sets of the needed overlap share one of their first
   ``n - ceil(0.8 n) + 1`` shingles, so only these entries enter the product.  Blocks accumulate the overlap counts of
   pairs of compatible sizes; pairs whose count stays below a bound that follows from the sizes are discarded; the rest
   is verified on the whole sets.
3. Shingles that few nodes share are multiplied out at once.  For the others, each node is first paired with one centre
   of like size; what these links connect needs no further pair.  Then groups that still hold several components are
   multiplied out in pairs of blocks of about ``SUB_BLOCK`` like nodes: a row-by-row sparse product of their prefix
   entries names the members that may be linked, and one of these members' whole sets returns one link for each two
   components it finds linked.  So no pair is ever written for what is linked
   already or not at all, and no link between components is lost.
4. Links join to components by iterated least labels over written tables.

The order needs frequencies only to be fast: shingles that are frequent within a task's batch are counted, and up to
``MAX_HOT`` of the most frequent are sent to all tasks (a bound of 16 bytes each); any order gives the same result.

Null, empty or wordless texts have no shingle and link with nothing (component: their own id).  A text of 1 to 4 words is
one shingle.  Repeated rows are copies; rows that repeat an id with another text are nodes of their own, with one id.
Rows without an id keep a row, with a null component, and lend links to nobody.  Ties go by signature and change no
result.  Texts of any length are read whole; an empty table gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import each_run, map_documents, map_rows, mix, restored, shingles
from .storage import Workspace, hot_keys, join_hot

WORDS, PERCENT = 5, 80
MAX_HOT, BATCH_HOT, SMALL, SUB_BLOCK, SALT_OVER, CENTRES = 200_000, 3, 8, 512, 1_000_000, 2
SIZE_STEP = 0.05  # of the logarithm of the set's size, within a block of like nodes
_SIG = np.uint64(0x94D049BB133111EB)


def needed(na, nb, percent: int = PERCENT):
    """The least overlap of sets of these sizes that reaches the threshold."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix(n, percent: int = PERCENT):
    return n + (-percent * n // 100) + 1


def sets(words, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingles of each document, and a 64-bit signature of each set (0 for an empty one)."""
    h, bounds = shingles(words, n)
    own = [np.unique(h[a:b]) for a, b in zip(bounds, bounds[1:])]
    size = np.array([len(x) for x in own])
    flat = np.concatenate(own) if own else h
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat ^ _SIG), out=total[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    sig = mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64))
    sig[size == 0] = 0
    return own, sig.view(np.int64)


def _nodes(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """kind 0: doc_id, n, sig.  kind 1: a shingle (sig) that is frequent in a batch, with its count (n)."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches):
        for b in batches:
            ids, done = b.column(0), 0
            seen: set[int] = set()
            pool: list[np.ndarray] = []

            def hot():
                if not pool:
                    return None
                u, c = np.unique(np.concatenate(pool), return_counts=True)
                u, c = u[c >= BATCH_HOT], c[c >= BATCH_HOT]
                pool.clear()
                return pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int32)), pa.nulls(len(u), pa.int64()), pa.array(c.astype(np.int64)), pa.array(u.view(np.int64))], names=["kind", "doc_id", "n", "sig"])

            for i, j, w in each_run(b.column(1)):
                own, sig = sets(w, n)
                for x, s in zip(own, sig.tolist()):
                    if s not in seen:
                        seen.add(s)
                        pool.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int32)), ids.slice(i, j - i), pa.array([len(x) for x in own], pa.int64()), pa.array(sig)], names=["kind", "doc_id", "n", "sig"])
                done += sum(map(len, own))
                if done > 2_000_000:
                    if (r := hot()) is not None:
                        yield r
                    done = 0
            if (r := hot()) is not None:
                yield r

    return source.mapInArrow(each, "kind int, doc_id long, n long, sig long")


def _entries(docs: DataFrame, text_col: str, n: int, percent: int, hot, n_blocks: int) -> DataFrame:
    """Per batch and block: the hashes, nodes and sizes of the prefix entries, as byte columns."""
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches):
        shingle, rank, salt = hot.value
        held: list[tuple] = []
        count = 0

        def flush():
            h, node, size = (np.concatenate(x) for x in zip(*held))
            key = h
            if len(shingle):
                at = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
                parts = np.where(shingle[at] == h, salt[at], 1)
                key = np.where(parts > 1, mix(h + node.view(np.uint64) % parts.astype(np.uint64)), h)
            block = (mix(key ^ _SIG) % np.uint64(n_blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            h, node, size, block = h[order], node[order], size[order], block[order]
            edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else np.zeros(1, int)
            rows = list(zip(edge, edge[1:]))
            return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in rows], pa.binary()) for x in (h, node, size))], names=["block", "h", "node", "n"])

        for b in batches:
            seen: set[int] = set()
            for _, _, w in each_run(b.column(0)):
                own, sig = sets(w, n)
                for x, s in zip(own, sig.tolist()):
                    if not len(x) or s in seen:
                        continue
                    seen.add(s)
                    key = mix(x) >> np.uint64(1)
                    if len(shingle):
                        at = np.minimum(np.searchsorted(shingle, x), len(shingle) - 1)
                        key = np.where(shingle[at] == x, rank[at] | np.uint64(1 << 63), key)
                    p = prefix(len(x), percent)
                    first = x[np.argpartition(key, p - 1)[:p]] if p < len(x) else x
                    held.append((first, np.full(p, s, np.int64), np.full(p, len(x), np.int32)))
                    count += p
                if count > 800_000:
                    yield flush()
                    held.clear()
                    count = 0
        if held:
            yield flush()

    return source.mapInArrow(each, "block int, h binary, node binary, n binary")


def _summed(a, b, na, nb, *counts):
    """Adds up the counts of equal pairs."""
    if not len(a):
        return a, b, na, nb, *counts
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[start], b[start], na[start], nb[start], *(np.add.reduceat(c[order], start) for c in counts)


def _ordered(a, b, na, nb):
    flip = a > b
    return np.where(flip, b, a), np.where(flip, a, b), np.where(flip, nb, na), np.where(flip, na, nb)


#: kind 0: pairs of small groups.  1: a node (a) of a large group, with its shingle (h).  2: a node and a centre (b).
_PRODUCT = "kind int, a long, b long, na int, nb int, c int, h long"


def _batch(kind, a, b, na, nb, c, h):
    n = len(a)
    cols = [(np.full(n, kind), np.int32), (a, np.int64), (b, np.int64), (na, np.int32), (nb, np.int32), (c, np.int32), (h, np.int64)]
    return pa.Table.from_arrays([pa.array(np.asarray(x, t)) for x, t in cols], names=[c.split()[0] for c in _PRODUCT.split(", ")])


def _product(percent: int, hot):
    def block(table: pa.Table) -> pa.Table:
        shingle, _, salt = hot.value
        salted = shingle[salt > 1] if len(shingle) else shingle
        h, node, n = (np.frombuffer(b"".join(x.as_py() for x in table.column(c)), t) for c, t in (("h", np.uint64), ("node", np.int64), ("n", np.int32)))
        order = np.lexsort((node, n, h))
        h, node, n = h[order], node[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n = h[new], node[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        size = np.diff(np.append(start, len(h)))
        apart = np.isin(h[start], salted) if len(salted) else np.zeros(len(start), bool)
        pairs: list[tuple] = []
        stars: list[tuple] = []

        def add(x, y, to):
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (x != y)
            x, y = x[ok], y[ok]
            made = (node[x], node[y], n[x], n[y])
            to.append((*(_ordered(*made) if to is pairs else made), np.ones(len(x), np.int32)))

        for s in range(2, SMALL + 1):
            at = start[(size == s) & ~apart]
            for i in range(s if len(at) else 0):
                for j in range(i + 1, s):
                    add(at + i, at + j, pairs)
        big = np.flatnonzero((size > SMALL) | apart)
        for g in big.tolist():
            a, e = int(start[g]), int(start[g] + size[g])
            while a < e:
                z = a + int(np.searchsorted(n[a:e], 100 * int(n[a]) // percent, "right"))
                # The least node is the same one in most groups of a cluster.
                add(np.arange(a, z), np.full(z - a, a + int(np.argmin(node[a:z]))), stars)
                a = z
        made, star = (_summed(*(np.concatenate(x) for x in zip(*p))) if p else [np.zeros(0, np.int64)] * 5 for p in (pairs, stars))
        inside = np.zeros(len(h), bool)
        for g in big.tolist():
            inside[start[g] : start[g] + size[g]] = True
        zero = np.zeros(int(inside.sum()), np.int32)
        return pa.concat_tables([_batch(0, *made, np.zeros(len(made[0]), np.int64)), _batch(2, *star, np.zeros(len(star[0]), np.int64)), _batch(1, node[inside], zero, n[inside], zero, zero, h[inside].view(np.int64))])

    return block


def _sets(wanted: DataFrame, docs: DataFrame, reps: DataFrame, work: Workspace, text_col: str, id_col: str, n: int, broadcast_rows: int) -> DataFrame:
    """sig, set: the whole sets of the wanted nodes, each made from one of its documents."""
    ids = work.keep(reps.join(wanted, "sig").select(F.col("rep").alias("__id")).distinct())
    small = ids.count() <= broadcast_rows  # 8 bytes a row
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__t")).join(F.broadcast(ids) if small else ids, "__id", "left_semi")

    def made(column):
        sig, out = [], []
        for _, _, w in each_run(column):
            own, s = sets(w, n)
            sig.append(s)
            out += [x.tobytes() for x in own]
        return {"sig": pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64)), "set": pa.array(out, pa.binary())}

    return work.keep(map_rows(source, [], "__t", "sig long, set binary", made).dropDuplicates(["sig"]))


def _verified(pairs: DataFrame, found: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    left = found.select(F.col("sig").alias("a"), F.col("set").alias("set_a"))
    right = found.select(F.col("sig").alias("b"), F.col("set").alias("set_b"))

    def overlap(batches):
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return work.keep(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(overlap, "a long, b long"))


def _rows_of_product(own: list[np.ndarray], side: np.ndarray):
    """Row by row, the product of the left block (side 0) with the right one (side 1, or the left one itself): for each
    left member its place, the right members' places and how many entries it shares with each."""
    size = np.array([len(x) for x in own])
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    entry = np.concatenate([own[k] for k in right])
    holder = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(entry, kind="stable")
    entry, holder = entry[order], holder[order]
    for k in left:
        lo, hi = np.searchsorted(entry, own[k], "left"), np.searchsorted(entry, own[k], "right")
        n = hi - lo
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        yield k, right, np.bincount(holder[rows], minlength=len(right))


def _candidates(percent: int):
    """Of a pair of blocks, the members that may be linked: by the entries shared within the prefixes."""

    def block(table: pa.Table) -> pa.Table:
        side, node, label, n, extra = (table.column(c).to_numpy() for c in ("side", "node", "label", "n", "extra"))
        own = [np.asarray(x.values) for x in table.column("hs")]
        use = np.zeros(len(side), bool)
        for k, right, both in _rows_of_product(own, side):
            # Shingles of small groups were counted by pair; a pair has at most ``extra`` of either side of them.
            least = needed(n[k], n[right], percent) + (-percent * np.maximum(n[k], n[right]) // 100) + 1 - np.minimum(extra[k], extra[right])
            ok = (both >= np.maximum(1, least)) & (label[right] != label[k]) & (100 * np.minimum(n[k], n[right]) >= percent * np.maximum(n[k], n[right]))
            use[right[ok]] = True
            use[k] |= ok.any()
        return table.filter(pa.array(use)).select(["block", "other", "side", "node", "label"])

    return block


def _between(percent: int):
    """Exact overlaps of two blocks: one link for each two components that are linked here."""

    def block(table: pa.Table) -> pa.Table:
        side, node, label = (table.column(c).to_numpy() for c in ("side", "node", "label"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array([len(x) for x in own])
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for k, right, both in _rows_of_product(own, side) if (side == 0).any() else ():
            ok = (100 * both >= percent * (size[k] + size[right] - both)) & (label[right] != label[k])
            for j in right[ok]:
                x, y = int(label[k]), int(label[j])
                first.setdefault((min(x, y), max(x, y)), (min(int(node[k]), int(node[j])), max(int(node[k]), int(node[j]))))
        a, b = zip(*first.values()) if first else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return block


def _apart(product: DataFrame, labels: DataFrame, unproven: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """block, other, side, node, label: members of pairs of blocks that may be linked across components.

    Nodes are those of the large groups that still hold several components, in blocks of like nodes; pairs of blocks are
    those that share a shingle across components.  unproven: pairs of small groups that were not verified, with counts.
    """
    at = product.filter("kind = 1").select(F.col("a").alias("node"), F.col("na").alias("n"), "h").join(labels, "node", "left").select("h", "node", "n", F.coalesce("label", "node").alias("label"))
    at = work.keep(at)
    mixed = work.keep(at.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi").select("h", "size"))
    at = work.keep(join_hot(at, mixed.select("h"), ["h"], hot_keys(mixed, ["h"], "size", at.count()), "inner").distinct())
    extra = unproven.select(F.col("a").alias("node"), "c").unionByName(unproven.select(F.col("b").alias("node"), "c")).groupBy("node").agg(F.max("c").alias("extra"))
    # A node's shingles here are of its prefix, so the list is no longer than its own text.
    node = at.groupBy("node").agg(F.min("h").alias("key"), F.first("label").alias("label"), F.first("n").alias("n"), F.collect_list("h").alias("hs")).join(extra, "node", "left")
    # Like nodes mostly have the same least shingle and nearly the same size; so each group meets few blocks, and sizes of
    # blocks bound what their members must share.
    node = work.keep(node.withColumn("size", F.floor(F.ln("n") / SIZE_STEP)))
    parts = node.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / SUB_BLOCK).alias("parts"))
    node = node.join(parts, ["key", "size"]).select("node", "label", F.col("n").cast("long").alias("n"), F.coalesce("extra", F.lit(0)).cast("long").alias("extra"), "hs", F.xxhash64("key", "size", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block"))
    node = work.keep(node)
    sizes = node.groupBy("block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("extra").alias("extra"))
    met = node.select("block", "label", F.explode("hs").alias("h")).groupBy("h", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).join(sizes, "block")
    met = work.keep(met)
    other = met.select("h", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "least", "most", "extra")])
    like = (100 * F.least("most", "most2") >= percent * F.greatest("least", "least2")) & (F.col("block") <= F.col("block2"))
    across = (F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2")) | (F.col("lo") != F.col("lo2"))
    shared = met.join(other, "h").filter(like).groupBy("block", "block2", "least", "most", "extra", "least2", "most2", "extra2").agg(F.count(F.lit(1)).alias("shared"), F.max(across.cast("int")).alias("across"))
    # needed(n, m) - ceil(p max) + 1 is at least this for any members of the two blocks.
    lowest = percent / (100 + percent) * F.least("least", "least2") - (percent / 100 - percent / (100 + percent)) * F.greatest("most", "most2")
    pairs = shared.filter((F.col("across") == 1) & (F.col("shared") + F.least("extra", "extra2") >= lowest - 1e-6))
    pairs = work.keep(pairs.select("block", F.col("block2").alias("other")))
    columns = ["block", "other", "side", "node", "label", "n", "extra", "hs"]
    left = pairs.join(node, "block").withColumn("side", F.lit(0)).select(columns)
    right = pairs.filter("block < other").join(node.withColumnRenamed("block", "other"), "other").withColumn("side", F.lit(1)).select(columns)
    return work.keep(left.unionByName(right).groupBy("block", "other").applyInArrow(_candidates(percent), "block long, other long, side int, node long, label long"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_entries: int = 1 << 19, broadcast_rows: int = 250_000) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, n_links.

    n_links counts the verified links of the document's set.  What a component already implies is not verified again, so
    it is a lower bound of its degree; it is 0 only for a set that is linked with no other one.
    """
    nodes, total, held = _classes(docs, id_col, text_col, words, percent, block_entries, broadcast_rows)
    out = join_hot(nodes, held.select("sig", "component", "n_links"), ["sig"], hot_keys(held, ["sig"], "copies", total))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, block_entries: int, broadcast_rows: int) -> tuple[DataFrame, int, DataFrame]:
    """The rows (doc_id, n_shingles, sig), how many, and for each set with copies or links: sig, rep (its least id), copies,
    label, component (the least id of its component), winner (the set that stands for it), n_links."""
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    first = work.keep(_nodes(docs, id_col, text_col, words))
    nodes = first.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "sig")
    # Added up before it is sent, however many copies a set has.
    reps = work.keep(nodes.filter("doc_id is not null and n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    frequent = first.filter("kind = 1").groupBy("sig").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "sig").limit(MAX_HOT).toArrow()
    shingle, count = frequent.column("sig").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(shingle)
    rank = np.empty(len(shingle), np.uint64)
    rank[:] = np.arange(len(shingle), 0, -1)
    hot = spark.sparkContext.broadcast((shingle[order], rank[order], np.maximum(1, -(-count // SALT_OVER))[order]))
    counted = nodes.agg(F.sum(F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1).alias("entries"), F.count(F.lit(1)).alias("rows")).first()
    total = counted["entries"] or 0
    entries = _entries(docs, text_col, words, percent, hot, max(64, int(total) // block_entries))
    product = work.keep(entries.groupBy("block").applyInArrow(_product(percent, hot), _PRODUCT))

    pairs = work.keep(product.filter("kind = 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").cast("int").alias("c")))
    bound = F.expr(f"ceil({percent}D * (na + nb) / {100 + percent} - 1e-9) - ceil({percent}D * greatest(na, nb) / 100 - 1e-9) + 1")
    # Each node's two centres that it shares most with, if that is much.
    stars = product.filter("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("na").alias("n"))
    # A quarter of the prefix at least; what is left out here only comes later, in the exact product of blocks.
    stars = stars.filter(F.col("c") * 400 >= (100 - percent) * F.col("n"))
    stars = stars.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), False), 1, CENTRES).alias("best")).select("a", F.explode("best.b").alias("b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    wanted = work.keep(pairs.filter(F.col("c") >= bound).select("a", "b").unionByName(stars).distinct())
    ends = lambda p: p.select(F.col("a").alias("sig")).unionByName(p.select(F.col("b").alias("sig"))).distinct()
    made = lambda some: _sets(some, docs, reps, work, text_col, id_col, words, broadcast_rows)
    known = _verified(wanted, made(ends(wanted)), work, percent)
    labels = components(known, work, rounds=3)

    members = _apart(product, labels, pairs.filter(F.col("c") < bound), work, percent)
    held = made(members.select(F.col("node").alias("sig")).distinct()).withColumnRenamed("sig", "node")
    more = work.keep(members.join(held, "node").groupBy("block", "other").applyInArrow(_between(percent), "a long, b long"))

    links = known.unionByName(more).distinct()
    labels = components(links, work)
    degree = links.select(F.col("a").alias("sig")).unionByName(links.select(F.col("b").alias("sig"))).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
    # Only sets with copies or links need more than their own row.
    held = reps.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").join(degree, "sig", "left").filter("copies > 1 or label is not null")
    held = work.keep(held.withColumn("label", F.coalesce("label", "sig")).withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    least = held.groupBy("label").agg(F.min(F.struct("rep", "sig")).alias("least")).select("label", F.col("least.rep").alias("component"), F.col("least.sig").alias("winner"))
    return nodes, counted["rows"], work.keep(held.join(least, "label"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, block_entries: int = 1 << 19, broadcast_rows: int = 250_000) -> DataFrame:
    """One document of each component stays, that of the least id, with all its columns.

    Documents are rows: rows that repeat an id with another text are documents of their own, and of rows that repeat an id
    with the same set (or with no words) one stays.  Rows without an id stay.
    """
    work = Workspace(docs.sparkSession, "deduplicate")
    nodes, total, held = _classes(docs, id_col, text_col, words, percent, block_entries, broadcast_rows)
    # A row for each id and set that has something to lose.
    own = nodes.filter("doc_id is not null").groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("rows"))
    own = join_hot(own, held.select("sig", "component", "winner"), ["sig"], hot_keys(held, ["sig"], "copies", total))
    gone = F.col("winner").isNotNull() & ((F.col("winner") != F.col("sig")) | (F.col("component") != F.col("doc_id")))
    fate = work.keep(own.select("doc_id", "sig", "rows", gone.alias("gone")).filter("gone or rows > 1").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), "rows", "gone"))

    def signed(column):
        sig = [sets(w, words)[1] for _, _, w in each_run(column)]
        return {"__sig": pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64))}

    k = docs.columns.index(id_col)
    rows = map_documents(docs, text_col, "__sig long", signed).withColumn("__id", F.col(f"__c{k}").cast("long"))
    left = join_hot(rows, fate, ["__id", "__sig"], hot_keys(fate, ["__id", "__sig"], "rows", total)).filter("gone is null or not gone")
    if fate.filter("not gone").limit(1).count():
        columns = left.columns
        once = left.filter("rows > 1").groupBy("__id", "__sig").agg(F.first(F.struct(*columns)).alias("__x")).select("__x.*")
        left = left.filter("rows is null or rows = 1").unionByName(once)
    return restored(left, docs.columns)
