"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of labelled documents, as many of each label, at most ``sample_rows`` in all, those whose
ids hash lowest.  Terms are lower-cased words; every word of every example is in the index, and document frequencies are
counted over all documents.  A term's weight is (1 + ln tf) x idf x (``FLOOR`` + sqrt(chi-square / n)), the last factor for
its association with the label in the sample; vectors have unit length over all words of a text, those that no example
has included (with the idf of a word of one document and no association).  The index lists, for every term, its postings
by blocks of examples and each block's largest weight; words of few examples, or of over one in ``FULL``, are added up without.  A query adds up upper bounds by block, opens the blocks from the
highest bound down, and stops at those that can't reach the k-th best similarity, so the k nearest are exact.  Votes weigh
by the squared similarity; a logistic curve, fitted on the examples without their own vote and weighted to the labels'
true shares, turns the vote into a score.  Evidence: the nearest example and its similarity.

A null or empty text, or one without a word of the index, has vote 0 and its calibrated score.  Ties in similarity go to
the example that comes first in the index.  Without labelled rows of both labels the score is the positive share (0
without any).  Repeated rows give equal results; an id that has several labels counts as the highest, one that has several
texts brings the one of least hash as an example.  Texts of any length are read whole; an empty table gives no row;
columns other than the named ones are ignored or, with ``carry``, kept unless a result column has their name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, each_run, map_rows

SAMPLE_ROWS, NEIGHBOURS, BLOCK, FULL, QUERIES, FLOOR = 4000, 20, 64, 16, 256, 0.02


def terms(words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document its distinct words (hashes) and their counts."""
    h = words.hashes()
    return [np.unique(h[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:])]


def _weights(at: np.ndarray, tf: np.ndarray, idf: np.ndarray, other: float = 0.0) -> np.ndarray:
    """Unit-length weights; other: the squared weights of words outside the index."""
    w = (1 + np.log(tf)) * idf[at]
    n = np.sqrt((w * w).sum() + other)
    return w / n if n else w


class Index:
    """Postings by (term, block of examples) with the block's largest weight."""

    def __init__(self, vocab: np.ndarray, idf: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: list):
        # Examples of a label and with like terms stand together: bounds of blocks are then tight.
        def key(k: int):
            at, tf = examples[k]
            return (int(labels[k]), int(at[np.argmax(_weights(at, tf, idf))]) if len(at) else -1)

        order = sorted(range(len(examples)), key=key)
        self.vocab, self.idf, self.labels = vocab, idf, np.asarray(labels)[order]
        self.ids = [ids[k] for k in order]
        made = [(examples[k][0], _weights(*examples[k], idf)) for k in order]
        term = np.concatenate([a for a, _ in made]) if made else np.zeros(0, int)
        doc = np.repeat(np.arange(len(made)), [len(a) for a, _ in made])
        weight = np.concatenate([w for _, w in made]) if made else np.zeros(0)
        by = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[by], weight[by], term[by]
        self.n, self.n_blocks = len(made), max(1, -(-len(made) // BLOCK))
        self.first = np.searchsorted(term, np.arange(len(vocab) + 1))
        # Words with fewer postings than there are blocks need no bounds, nor do those whose lists fill every block; the
        # former are added up at once, the latter are rows of a matrix.
        size = np.diff(self.first)
        full = np.flatnonzero(size * FULL >= self.n)
        self.dense_row = np.full(len(vocab), -1)
        self.dense_row[full] = np.arange(len(full))
        self.dense = np.zeros((len(full), self.n))
        for k, t in enumerate(full):
            self.dense[k, self.doc[self.first[t] : self.first[t + 1]]] = self.weight[self.first[t] : self.first[t + 1]]
        frequent = np.flatnonzero((size >= self.n_blocks) & (self.dense_row < 0))
        self.row = np.full(len(vocab), -1)
        self.row[frequent] = np.arange(len(frequent))
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in frequent]) if len(frequent) else np.zeros(0, int)
        cell = self.row[term[at]] * self.n_blocks + self.doc[at] // BLOCK
        self.cell_max = np.zeros((len(frequent), self.n_blocks))
        np.maximum.at(self.cell_max.ravel(), cell, self.weight[at])
        count = np.bincount(cell, minlength=len(frequent) * self.n_blocks).reshape(len(frequent), self.n_blocks)
        self.cell_at = self.first[frequent][:, None] + np.concatenate([np.zeros((len(frequent), 1), np.int64), np.cumsum(count, 1)], 1)
        self.scale, self.shift, self.unknown = 1.0, 0.0, 0.0

    def known(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit-length weights of a text's distinct words."""
        if not len(self.vocab) or not len(words):
            return np.zeros(0, int), np.zeros(0)
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        ok = self.vocab[at] == words
        other = (((1 + np.log(counts[~ok])) * self.unknown) ** 2).sum()
        return at[ok], _weights(at[ok], counts[ok], self.idf, other)

    def common(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each query, every example's share of the similarity from the words of full lists."""
        q = np.zeros((len(queries), len(self.dense)))
        for k, (at, weight) in enumerate(queries):
            row = self.dense_row[at]
            q[k, row[row >= 0]] = weight[row >= 0]
        return q @ self.dense

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, skip=(), base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples but those of skip, exact, and their similarities (only those above 0); base: common()."""
        row = self.row[at]
        rare, row, heavy = (row < 0) & (self.dense_row[at] < 0), row[row >= 0], weight[row >= 0]
        score = self._sum(self.first[at[rare]], self.first[at[rare] + 1], weight[rare])
        score += self.common([(at, weight)])[0] if base is None else base
        bound = heavy @ self.cell_max[row] + np.maximum.reduceat(score, np.arange(0, self.n, BLOCK))
        left = np.argsort(-bound, kind="stable")
        left = left[bound[left] > 0]
        whole = np.zeros(self.n, bool)  # examples of opened blocks
        step, best, seen = 4, 0.0, np.zeros(0, int)
        while len(left) and bound[left[0]] >= best - 1e-9:
            go = left[:step][bound[left[:step]] >= best - 1e-9]
            left, step = left[len(go) :], step * 16
            score += self._sum(self.cell_at[row][:, go].ravel(), self.cell_at[row][:, go + 1].ravel(), np.repeat(heavy, len(go)))
            for g in go.tolist():
                whole[g * BLOCK : (g + 1) * BLOCK] = True
            whole[list(skip)] = False
            seen = np.flatnonzero(whole & (score > 0))
            best = np.partition(score[seen], len(seen) - k)[len(seen) - k] if len(seen) >= k else 0.0
        top = seen[np.lexsort((seen, -score[seen]))][:k]
        return top, score[top]

    def _sum(self, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By example, the postings from start to end times the query's weights."""
        n = end - start
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - start, n)
        return np.bincount(self.doc[rows], self.weight[rows] * np.repeat(weight, n), self.n).astype(np.float64)

    def vote(self, top: np.ndarray, similarity: np.ndarray) -> float:
        w = similarity**2
        return float((w * self.labels[top]).sum() / w.sum()) if len(top) else 0.0

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, share: float) -> None:
        """A logistic curve over votes by Newton's method, the labels weighted to their true shares."""
        weight = np.where(labels == 1, share / max(labels.mean(), 1e-9), (1 - share) / max(1 - labels.mean(), 1e-9))
        x, b = np.stack([votes, np.ones(len(votes))], 1), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            b = b + np.linalg.solve(h, x.T @ (weight * (labels - p)) - 1e-3 * b)
        self.scale, self.shift = float(max(b[0], 1e-3)), float(b[1])

    def score(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * vote + self.shift, -30, 30))))


def _sparse(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    def fn(column: pa.Array) -> dict[str, pa.Array]:
        made = [t for _, _, w in each_run(column, ALNUM, LOWER) for t in terms(w)]
        return {"__w": pa.array([t.view(np.int64) for t, _ in made], pa.list_(pa.int64())), "__n": pa.array([c for _, c in made], pa.list_(pa.int64()))}

    return map_rows(docs, columns, text_col, "__w array<long>, __n array<long>", fn)


def document_frequency(docs: DataFrame, vocab: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each word is, and how many documents there are; tasks send sums by word."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def each(batches):
        vocab, total, rows = sent.value, np.zeros(len(sent.value) + 1, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, w in each_run(b.column(0), ALNUM, LOWER):
                h = w.hashes()
                if len(vocab) and len(h):
                    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
                    ok = vocab[at] == h
                    once = np.unique(w.doc()[ok] * len(vocab) + at[ok])
                    total[:-1] += np.bincount(once % len(vocab), minlength=len(vocab))
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["t", "n"])

    got = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(each, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocab) + 1, np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out[:-1], int(out[-1])


def association(term: np.ndarray, label: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """sqrt(chi-square / n) of each term's presence and the label; term and label: one for each word of each example."""
    a, b = np.bincount(term, label, n_terms), np.bincount(term, 1 - label, n_terms)
    n1, n = float(labels.sum()), len(labels)
    n0 = n - n1
    return np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(np.maximum(1, (a + b) * (n - a - b) * n1 * n0))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[Index | None, float]:
    """The calibrated index and the positive share; learns from labelled rows where ``train`` (on the label rows) holds."""
    marked = labels.filter(train).filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    per = {r[0]: r[1] for r in marked.groupBy("__y").count().collect()}
    share = per.get(1, 0) / max(1, sum(per.values()))
    if len(per) < 2:
        return None, share
    rank = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    rate = F.when(F.col("__y") == 0, min(1.0, sample_rows / 2 / per[0])).otherwise(min(1.0, sample_rows / 2 / per[1]))
    sample = marked.filter(rank < rate * float(1 << 30)).orderBy(rank, "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(sample), "__id")
    rows = rows.groupBy("__id", "__y").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))
    got = _sparse(rows, ["__id", "__y"], "__t").toArrow().sort_by("__id")
    y = np.array(got.column("__y").to_pylist(), int)
    if len(set(y.tolist())) < 2:
        return None, share
    words = [x.values.to_numpy().view(np.uint64) for x in got.column("__w")]
    counts = [x.values.to_numpy() for x in got.column("__n")]
    vocab, back = np.unique(np.concatenate(words), return_inverse=True)
    df, total = document_frequency(docs, vocab, text_col)
    idf = (np.log((total + 1) / (df + 1)) + 1) * (FLOOR + association(back, np.repeat(y, [len(w) for w in words]), y, len(vocab)))
    edge = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    examples = [(back[a:b], c) for a, b, c in zip(edge, edge[1:], counts)]
    index = Index(vocab, idf, examples, y, got.column("__id").to_pylist())
    index.unknown = (np.log((total + 1) / 2) + 1) * FLOOR
    place = {d: k for k, d in enumerate(index.ids)}
    queries = [(at, _weights(at, tf, idf)) for at, tf in examples]
    bases = (base for k in range(0, len(queries), QUERIES) for base in index.common(queries[k : k + QUERIES]))
    votes = np.array([index.vote(*index.nearest(*q, skip=[place[d]], base=base)) for q, base, d in zip(queries, bases, got.column("__id").to_pylist())])
    index.calibrate(votes, y, share)
    return index, share


def score(docs: DataFrame, index: Index | None, share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: score, predicted, vote, nearest_id (long) and nearest_similarity; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        index, out = sent.value, []
        for _, _, w in each_run(column, ALNUM, LOWER):
            if index is None:
                out += [(share, 0.0, None, 0.0)] * len(w.count)
                continue
            queries = [index.known(words, counts) for words, counts in terms(w)]
            for k in range(0, len(queries), QUERIES):
                part = queries[k : k + QUERIES]
                for (at, weight), base in zip(part, index.common(part)):
                    top, sim = index.nearest(at, weight, base=base)
                    vote = index.vote(top, sim)
                    out.append((index.score(vote), vote, index.ids[top[0]] if len(top) else None, float(sim[0]) if len(top) else 0.0))
        value, vote, near, sim = zip(*out) if out else ((), (), (), ())
        return {"score": pa.array(value, pa.float64()), "predicted": pa.array([int(v >= 0.5) for v in value], pa.int32()), "vote": pa.array(vote, pa.float64()), "nearest_id": pa.array(near, pa.int64()), "nearest_similarity": pa.array(sim, pa.float64())}

    return map_rows(docs, [id_col, *carry], text_col, "score double, predicted int, vote double, nearest_id long, nearest_similarity double", fn)
