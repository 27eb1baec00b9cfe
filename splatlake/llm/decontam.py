r"""Benchmark decontamination with suffix arrays over shards of the training text.

A shard is a run of documents.  Its words become ids of the benchmark's vocabulary (0: a word that no item has, which
matches nothing).  The shard's suffix array sorts, to full depth and by prefix doubling, the suffixes in runs of known
words that can hold a window.  Every distinct start of a benchmark suffix (its window) is binary-searched in it, word by
word, which gives the range of all locations; where a match starts that can't begin earlier, the search goes on to the
longest verbatim match at each location.  Documents stay whole in one task and nothing is shuffled.

The benchmark is a stated query set: it is streamed through the driver and sent as indexed blocks of at most
``block_bytes`` of text; a task holds one block at a time and the same steps run for one block or many.  Words that are hit,
items and longest matches of all blocks unite, so the result doesn't depend on the blocks.

Null or wordless texts and items match nothing.  Items with equal ids are one item; an item without an id still marks
words but is in no list.  Of equally long matches the one that starts first in the document counts, then the least item id
as a string.  Repeated documents give equal rows; texts of any length are read whole; an empty table gives no row; columns
other than the named ones are ignored (kept with ``carry`` unless a result has their name).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, Words, each_run, map_documents, map_rows, restored, strings

WINDOW = 10


class Bench:
    """Vocabulary, words and distinct windows of a block of items."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        self.ids = [None if i is None else str(i) for i in ids]
        data, offsets = strings(pa.array(texts, pa.string()))
        w = Words(data, offsets, ALNUM, LOWER)
        h = w.hashes()
        self.vocab = np.unique(h)
        self.words, self.first = np.searchsorted(self.vocab, h) + 1, w.first
        size = np.minimum(window, w.count)
        n = np.where(w.count > 0, w.count - size + 1, 0)
        item = np.repeat(np.arange(len(ids)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        table = np.zeros((len(item), window), np.int32)
        for k in range(window):
            ok = k < size[item]
            table[ok, k] = self.words[self.first[item[ok]] + place[ok] + k]
        self.windows, back = np.unique(table, axis=0, return_inverse=True) if len(table) else (table, np.zeros(0, np.int64))
        self.size = (self.windows > 0).sum(1)
        self.shortest = int(self.size.min()) if len(self.size) else 0
        # The items and places of each window.
        order = np.argsort(np.ravel(back), kind="stable")
        self.item, self.place = item[order], place[order]
        self.owners = np.concatenate([[0], np.cumsum(np.bincount(np.ravel(back), minlength=len(self.windows)))])


def suffix_array(ids: np.ndarray, least: int) -> np.ndarray:
    """Starts of the suffixes whose first ``least`` ids are known, sorted to their end (a 0) by prefix doubling."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
    start, size = edge[::2], edge[1::2] - edge[::2]
    start, size = start[size >= least], size[size >= least]
    at = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    if not len(at):
        return at
    longest = int(size.max())
    rank = np.zeros(len(ids) + longest + 1, np.int64)
    rank[at] = ids[at]
    width = 1
    while width < longest:
        values, place = np.unique(rank[at] * (len(ids) + int(ids.max()) + 2) + rank[at + width], return_inverse=True)
        rank[at] = place + 1
        width = longest if len(values) == len(at) else 2 * width
    rest = np.repeat(size, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    at = at[rest >= least]
    return at[np.argsort(rank[at], kind="stable")]


def narrow(ids: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range lo..hi of the suffix array the part whose k-th word is the wanted one: binary searches, all at once."""
    ends = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (go := np.flatnonzero(a < b)).size:
            mid = (a[go] + b[go]) >> 1
            got = ids[sa[mid] + k[go]]
            up = (got <= want[go]) if right else (got < want[go])
            a[go[up]] = mid[up] + 1
            b[go[~up]] = mid[~up]
        ends.append(a)
    return ends[0], ends[1]


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and which range each is of."""
    n = ends - starts
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts, n), of


Found = dict[int, tuple[set, tuple[int, int, str | None]]]


def _better(a: tuple, b: tuple) -> tuple:
    """The longer match, else the earlier one, else that of the least item."""
    return min(a, b, key=lambda x: (-x[0], x[1], x[2] is None, x[2] or ""))


def _scan(words: Words, h: np.ndarray, bench: Bench, cover: np.ndarray, found: Found, most: int = 1 << 21) -> None:
    """Marks the words that this block's windows hit, and adds its items and longest matches by document."""
    if not len(h) or not len(bench.windows):
        return
    pos = np.searchsorted(bench.vocab, h)
    pos[pos == len(bench.vocab)] = 0
    # A 0 after each document, so that no suffix runs on into the next one, and enough of them at the end.
    doc = words.doc()
    at = np.arange(len(h)) + doc
    n_docs = len(words.count)
    ids = np.zeros(len(h) + n_docs + bench.windows.shape[1] + 1, np.int64)
    ids[at] = np.where(bench.vocab[pos] == h, pos + 1, 0)
    sa = suffix_array(ids, bench.shortest)
    if not len(sa):
        return
    lo, hi = np.zeros(len(bench.windows), np.int64), np.full(len(bench.windows), len(sa), np.int64)
    for k in range(bench.windows.shape[1]):
        g = np.flatnonzero((bench.size > k) & (hi > lo))
        lo[g], hi[g] = narrow(ids, sa, lo[g], hi[g], bench.windows[g, k], np.full(len(g), k))
        hi[(bench.size > k) & (hi <= lo)] = 0
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return
    doc_of = np.zeros(len(ids), np.int64)
    doc_of[at] = doc
    first = words.first[:-1] + np.arange(n_docs)
    marks = np.zeros(len(ids) + 1, np.int64)
    weight = (hi - lo)[hit] * np.diff(bench.owners)[hit]
    total = np.concatenate([[0], np.cumsum(weight)])
    i = 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        some = hit[i:j]
        i = j
        where, of = _spread(lo[some], hi[some])
        p, g = sa[where], some[of]
        np.add.at(marks, p, 1)
        np.add.at(marks, p + bench.size[g], -1)
        # Every location with every item and place of its window.
        own, of = _spread(bench.owners[g], bench.owners[g + 1])
        where, p, g, item, place = where[of], p[of], g[of], bench.item[own], bench.place[own]
        pairs = np.unique(np.stack([doc_of[p], item]), axis=1)
        for d, x in zip(*pairs.tolist()):
            found.setdefault(d, (set(), (0, -1, None)))[0].add(bench.ids[x])
        # Matches that can't begin a word earlier, searched on to their full length.
        before = bench.words[np.maximum(bench.first[item] + place - 1, 0)]
        starts = (place == 0) | (p == 0) | (ids[np.maximum(p - 1, 0)] != before)
        where, p, g, item, place = where[starts], p[starts], g[starts], item[starts], place[starts]
        suffix, back = np.unique(bench.first[item] + place, return_inverse=True)
        mine = np.zeros(len(suffix), np.int64)
        mine[back] = np.arange(len(back))
        a, b, k, end = lo[g[mine]], hi[g[mine]], bench.size[g[mine]].astype(np.int64), bench.first[item[mine] + 1]
        length = bench.size[g].astype(np.int64)
        live = np.ones(len(length), bool)
        go = np.arange(len(suffix))
        while len(go := go[(suffix[go] + k[go] < end[go]) & (b[go] > a[go])]):
            a[go], b[go] = narrow(ids, sa, a[go], b[go], bench.words[suffix[go] + k[go]], k[go])
            k[go] += 1
            going = np.zeros(len(suffix), bool)
            going[go] = True
            live &= going[back] & (where >= a[back]) & (where < b[back])
            length[live] += 1
        order = np.lexsort((p, -length, doc_of[p]))
        best = order[np.concatenate([[True], doc_of[p[order]][1:] != doc_of[p[order]][:-1]])] if len(order) else order
        # All of the same length and start, for the least item.
        top = dict(zip(doc_of[p[best]].tolist(), zip(length[best].tolist(), p[best].tolist())))
        for x in np.flatnonzero(np.isin(doc_of[p], list(top))).tolist():
            d = int(doc_of[p[x]])
            if (int(length[x]), int(p[x])) == top[d]:
                names, old = found[d]
                found[d] = (names, _better(old, (int(length[x]), int(p[x]) - int(first[d]), bench.ids[int(item[x])])))
    cover |= (np.cumsum(marks[:-1]) > 0)[at]


NAMES = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_start", "match_item")
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, match_start long, match_item string"


def _finder(blocks):
    def fn(column: pa.Array) -> dict[str, pa.Array]:
        runs = []
        for _, _, w in each_run(column, ALNUM, LOWER, 2 << 20):
            runs.append((w, w.hashes()))
            w.data = w.starts = w.ends = None  # hashes and counts are all that is held
        covers, founds = [np.zeros(len(h), bool) for _, h in runs], [{} for _ in runs]
        for block in blocks:
            bench = block.value
            for (words, h), cover, found in zip(runs, covers, founds):
                _scan(words, h, bench, cover, found)
            if len(blocks) > 1:
                block.__dict__.pop("_value", None)  # read again for the next batch
        per: dict[str, list] = {n: [] for n in NAMES}
        for (words, _), cover, found in zip(runs, covers, founds):
            total = np.concatenate([[0], np.cumsum(cover)])
            for d, n in enumerate(words.count.tolist()):
                names, best = found.get(d, (set(), (0, -1, None)))
                items = sorted(x for x in names if x is not None)
                hits = int(total[words.first[d + 1]] - total[words.first[d]])
                for name, v in zip(per, (n, hits, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hits > 0, *best)):
                    per[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        return {n: pa.array(v, k) for (n, v), k in zip(per.items(), kinds)}

    return fn


def _sent(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks; the driver holds one at a time."""
    context, out = benchmark.sparkSession.sparkContext, []
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        size = 64 + len((row.t or "").encode())
        if held and held + size > block_bytes:
            out.append(context.broadcast(Bench(ids, texts, window)))
            ids, texts, held = [], [], 0
        ids.append(row.i)
        texts.append(row.t)
        held += size
    return [*out, context.broadcast(Bench(ids, texts, window))]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: n_words, n_hit, n_items, items_sha256, contaminated, and the longest match (words, start, item).

    ``block_bytes`` bounds a block of the benchmark, of which a task holds one at a time.
    """
    return map_rows(docs, [id_col, *carry], text_col, SCHEMA, _finder(_sent(benchmark, item_col, item_text_col, window, block_bytes)))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """The documents without a verbatim benchmark window; all columns stay."""
    return restored(map_documents(docs, text_col, SCHEMA, _finder(_sent(benchmark, item_col, item_text_col, window, block_bytes))).filter("not contaminated"), docs.columns)
