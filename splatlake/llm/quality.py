"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Fixed rules fail short or repetitive documents.  For the others, Viterbi decoding labels the sequence of lines that have
words, and the share of the content lines' word characters decides retention.  The field has two states, linear features
of a line, and a transition matrix.

Lines have no labels of their own, so the field is fitted with the lines' states hidden, on at most ``sample_docs``
labelled documents that the fixed rules pass, of at most ``sample_lines`` lines.  A document's label only bounds the
expected share of its boilerplate characters: at least ``LOW_SHARE`` where the label is 0, at most ``HIGH_SHARE`` where it is 1
(posterior regularisation: a multiplier per document shifts its lines until the bound holds).  Each round ascends the
likelihood of the shifted expectations, so lines of one document may differ.  Without both labels, fixed weights serve.
Everything else covers every whole text.

Null or wordless text: no words, ``base_failed``, not kept.  Rows are independent: repeated rows give equal results, and
ties in decoding go to content.  Of an id with several labels the lowest counts; of one with several texts the one of
least hash is learned from.  Texts of any length are read whole; an empty table gives no row; columns other than the named ones
are ignored by judge() (kept with ``carry`` unless a result has their name) and all kept by keep_good().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_SPACE, SAME, Words, each_run, grams, map_documents, map_rows, mix, restored, spans_hash, sums_by

SAMPLE_DOCS, SAMPLE_LINES, CONTENT_SHARE = 3000, 400, 0.5
LOW_SHARE, HIGH_SHARE = 0.7, 0.1
_SYMBOL, _UPPER, _DIGIT, _LOUD, _LEAD = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LOUD[list(b"!?")] = True
_LEAD[128:192] = True  # bytes that continue a code point
FEATURES = ("bias", "symbols", "upper", "digits", "loud", "log_words", "word_length", "repeated_line", "repeated_words", "one_word")
#: State 0: content, 1: boilerplate.  Weights of boilerplate over content where nothing can be learned.
PRIOR = np.array([-2.0, 30.0, 6.0, 4.0, 20.0, -0.1, 0.0, 1.5, 4.0, 0.5])
PRIOR_STEPS = np.array([[0.6, -0.6], [-0.6, 0.6]])


class Field:
    """weights: of each feature for boilerplate over content; steps: from state to state."""

    def __init__(self, weights: np.ndarray = PRIOR, steps: np.ndarray = PRIOR_STEPS):
        self.weights, self.steps = weights, steps

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest labels of a sequence; ties go to content."""
        n = len(x)
        score = (x @ self.weights).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        a, b, back0, back1 = 0.0, 0.0, bytearray(n), bytearray(n)
        for k, e in enumerate(score):
            if k:
                from0, from1 = a + s00, b + s10
                to0, to1 = a + s01, b + s11
                back0[k], back1[k] = from1 > from0, to1 > to0
                a, b = max(from0, from1), max(to0, to1)
            b += e
        out, state = np.zeros(n, np.int8), int(b > a)
        for k in range(n - 1, -1, -1):
            out[k] = state
            state = back1[k] if state else back0[k]
        return out

    @classmethod
    def fit(cls, sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 1.0, decay: float = 1e-3) -> Field:
        """Ascends the conditional log-likelihood of labelled lines."""
        return cls._ascend([(x, np.ones(len(y)), y) for x, y in sequences], rounds, rate, decay)

    @classmethod
    def fit_shares(cls, documents: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 120, rate: float = 1.0, decay: float = 1e-3, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> Field:
        """From features and word characters of each document's lines and its label (1: content); lines' states are hidden."""
        return cls._ascend([(x, np.maximum(c, 1), int(y)) for x, c, y in documents], rounds, rate, decay, (low, high))

    @classmethod
    def _ascend(cls, documents, rounds: int, rate: float, decay: float, bounds: tuple[float, float] | None = None) -> Field:
        """All documents go forward and backward together, padded, by length."""
        weights, steps = np.zeros(len(PRIOR)), np.zeros((2, 2))
        total = sum(len(x) for x, _, _ in documents)
        scale = np.maximum(np.sqrt(np.mean(np.concatenate([x for x, _, _ in documents]) ** 2, 0)), 1e-3)
        groups: dict[int, list] = {}
        for d in documents:
            groups.setdefault(max(8, 1 << (len(d[0]) - 1).bit_length()), []).append(d)
        padded = []
        for width, members in groups.items():
            n = len(members)
            xs, part, ys = np.zeros((n, width, len(PRIOR))), np.zeros((n, width)), np.zeros((n, width), int)
            for k, (x, c, y) in enumerate(members):
                xs[k, : len(x)], part[k, : len(x)], ys[k, : len(x)] = x / scale, c / c.sum(), y
            size = np.array([len(x) for x, _, _ in members])
            padded.append([xs, part, ys, size, np.zeros(n)])
        for _ in range(rounds):
            gw, gs = -decay * total * weights, -decay * total * steps
            for group in padded:
                xs, part, ys, size, shift = group
                score = xs @ weights
                free, moves = marginals(score, steps, size)
                if bounds is None:
                    live = np.arange(xs.shape[1]) < size[:, None]
                    held = ys * live
                    pair = live[:, 1:]
                    aim = np.array([[((ys[:, :-1] == i) & (ys[:, 1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)])
                else:
                    held, aim = marginals(score + shift[:, None] * part * size[:, None], steps, size)
                    share = (held * part).sum(1)
                    good = ys[:, 0] == 1
                    # A multiplier grows while its bound is broken and never changes its sign.
                    group[4] = np.where(good, np.minimum(0, shift - 2 * (share - bounds[1])), np.maximum(0, shift + 2 * (bounds[0] - share)))
                gw += np.einsum("nkf,nk->f", xs, held - free)
                gs += aim - moves
            weights, steps = weights + rate * gw / total * 4, steps + rate * gs / total * 4
        return cls(weights / scale, steps)


def marginals(score: np.ndarray, steps: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of boilerplate at each line of padded sequences (0 beyond their size), and expected counts of steps."""
    n, width = score.shape
    live = np.arange(width) < size[:, None]
    e = np.stack([np.zeros((n, width)), score], 2)
    alpha, beta = e.copy(), np.zeros_like(e)
    for k in range(1, width):
        alpha[:, k] += np.logaddexp(alpha[:, k - 1, 0, None] + steps[0], alpha[:, k - 1, 1, None] + steps[1])
    for k in range(width - 2, -1, -1):
        following = e[:, k + 1] + beta[:, k + 1]
        b = np.logaddexp(following[:, 0, None] + steps[:, 0], following[:, 1, None] + steps[:, 1])
        beta[:, k] = np.where(live[:, k + 1, None], b, 0)
    z = np.logaddexp(*alpha[np.arange(n), size - 1].T)
    p = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None], where=live, out=np.zeros((n, width)))
    moves = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            moves[i, j] = np.exp(alpha[:, :-1, i] + steps[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None], where=live[:, 1:], out=np.zeros((n, width - 1))).sum()
    return p, moves


class Lines:
    """Counts of documents and features of their lines for one run of documents."""

    def __init__(self, w: Words):
        data, n = w.data, len(w.count)
        self.n_words = w.count
        points = ~_LEAD[data]
        in_words = NON_SPACE[data]
        self.word_chars = sums_by(points & in_words, w.offsets)
        self.n_symbols = sums_by(_SYMBOL[data], w.offsets)
        h, doc = w.hashes(), w.doc()
        twice = self._repeats(h, doc, 3)
        self.n_repeat_words = sums_by(twice, w.first)
        # Lines: between newlines and document ends; those without a word don't count.
        cuts = np.flatnonzero(data == 10)
        edges = np.unique(np.concatenate([w.offsets, cuts + 1, [len(data)]])) if len(data) else np.zeros(1, np.int64)
        starts, ends = edges[:-1], edges[1:].copy()
        if len(ends):
            ends -= data[ends - 1] == 10
        words_at = np.searchsorted(w.starts, edges)
        some = np.diff(words_at) > 0
        self.starts, self.ends, at = starts[some], ends[some], np.stack([words_at[:-1][some], words_at[1:][some]], 1) if len(starts) else np.zeros((0, 2), int)
        self.first = np.searchsorted(self.starts, w.offsets)
        owner = np.repeat(np.arange(n), np.diff(self.first))
        key = mix(spans_hash(data, self.starts, self.ends) ^ mix(owner.astype(np.uint64) + np.uint64(1)))
        seen, back, times = np.unique(key, return_inverse=True, return_counts=True) if len(key) else (key, key, key)
        first_seen = np.zeros(len(key), bool)
        if len(key):
            first_seen[np.unique(key, return_index=True)[1]] = True
        self.n_dup_lines = sums_by(~first_seen, self.first)
        again = times[back] > 1 if len(key) else first_seen

        def share(mask: np.ndarray) -> np.ndarray:
            total = np.zeros(len(mask) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return total[self.ends] - total[self.starts]

        size = np.maximum(share(in_words), 1)
        words = np.maximum(at[:, 1] - at[:, 0], 1)
        total = np.concatenate([[0], np.cumsum(twice)])
        self.chars = share(points & in_words)
        loud = share(_LOUD[data])
        self.features = np.stack([np.ones(len(size)), share(_SYMBOL[data]) / size, share(_UPPER[data]) / size, share(_DIGIT[data]) / size, np.minimum(loud / words, 1.0), np.log1p(words), np.minimum(size / words, 30) / 10, again, (total[at[:, 1]] - total[at[:, 0]]) / words, words == 1], 1).astype(np.float64) if len(size) else np.zeros((0, len(FEATURES)))

    @staticmethod
    def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Words in n-word windows that their document has twice or more."""
        out = np.zeros(len(h), bool)
        if len(h) < n:
            return out
        g = grams(h, n)
        whole = np.flatnonzero(doc[: len(g)] == doc[n - 1 :])
        key = mix(g[whole] ^ mix(doc[whole].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(n):
            out[whole[again] + k] = True
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES, min_words: int = 50, max_repeat_percent: int = 50) -> Field:
    """Learns from a bounded sample of labelled documents (label 1: content, 0: boilerplate), as many of each label."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__y"))
    per = {r[0]: r[1] for r in marked.groupBy("__y").count().collect()}
    if len(per) < 2:
        return Field()
    rank = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    rate = F.when(F.col("__y") == 0, min(1.0, sample_docs / 2 / per[0])).otherwise(min(1.0, sample_docs / 2 / per[1]))
    # At most sample_docs rows of two integers.
    sample = marked.filter(rank < rate * float(1 << 30)).orderBy(rank, "__id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(sample), "__id")
    rows = rows.groupBy("__id", "__y").agg(F.min_by("__t", F.xxhash64("__t")).alias("__t"))

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        made = []
        for _, _, w in each_run(column, fold=SAME):
            lines = Lines(w)
            passed = ~base_failed(lines, min_words, max_repeat_percent)
            both = np.concatenate([lines.features, lines.chars[:, None]], 1) if len(lines.features) else np.zeros((0, len(FEATURES) + 1))
            made += [both[a:b].ravel() if ok and 0 < b - a <= sample_lines else np.zeros(0) for ok, a, b in zip(passed, lines.first, lines.first[1:])]
        return {"__x": pa.array(made, pa.list_(pa.float64()))}

    got = map_rows(rows, ["__id", "__y"], "__t", "__x array<double>", fn).toArrow().sort_by("__id")
    documents = []
    for x, y in zip(got.column("__x"), got.column("__y").to_pylist()):
        x = x.values.to_numpy().reshape(-1, len(FEATURES) + 1)
        if len(x):
            documents.append((x[:, :-1], x[:, -1], y))
    if len({y for _, _, y in documents}) < 2:
        return Field()
    return Field.fit_shares(documents)


def base_failed(lines: Lines, min_words: int, max_repeat_percent: int) -> np.ndarray:
    return (lines.n_words < min_words) | (100 * lines.n_repeat_words > max_repeat_percent * lines.n_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines")
SCHEMA = ", ".join(f"{n} long" for n in COUNTS) + ", content_share double, base_failed boolean, kept boolean"


def _judge(sent, min_words: int, max_repeat_percent: int, content_share: float):
    names = COUNTS

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        field, out = sent.value, {n: [] for n in (*names, "content_share", "base_failed", "kept")}
        for _, _, w in each_run(column, fold=SAME):
            lines = Lines(w)
            for n in names[:5]:
                out[n].append(getattr(lines, n))
            failed = base_failed(lines, min_words, max_repeat_percent)
            share, good = np.zeros(len(failed)), np.zeros(len(failed), np.int64)
            for d, (a, b) in enumerate(zip(lines.first, lines.first[1:])):
                if b > a:
                    content = field.viterbi(lines.features[a:b]) == 0
                    good[d] = content.sum()
                    share[d] = lines.chars[a:b][content].sum() / max(1, lines.chars[a:b].sum())
            out["n_lines"].append(np.diff(lines.first))
            out["n_content_lines"].append(good)
            out["content_share"].append(share)
            out["base_failed"].append(failed)
            out["kept"].append(~failed & (share >= content_share))
        kinds = {"content_share": np.float64, "base_failed": bool, "kept": bool}
        return {n: pa.array(np.concatenate([np.zeros(0, kinds.get(n, np.int64)), *v]).astype(kinds.get(n, np.int64))) for n, v in out.items()}

    return fn


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, content_share: float = CONTENT_SHARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: the counts, base_failed, content_share, n_lines, n_content_lines, kept; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return map_rows(docs, [id_col, *carry], text_col, SCHEMA, _judge(sent, min_words, max_repeat_percent, content_share))


def keep_good(docs: DataFrame, field: Field, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The documents that judge() keeps, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    return restored(map_documents(docs, text_col, SCHEMA, _judge(sent, min_words, max_repeat_percent, content_share)).filter("kept"), docs.columns)
