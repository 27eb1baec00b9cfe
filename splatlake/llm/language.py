"""Language identification with error-correcting output codes.

Each language has a codeword; for every bit a binary logistic classifier over hashed character n-grams says how likely
the bit is 1.  Decoding is loss-weighted: a codeword's loss sums the logistic losses of its bits, each weighted by how
well that bit's classifier did on that language in training; the least loss wins.  The score is the share of the winner
in a softmax of the negative losses, and a small gap to the runner-up sets ``ambiguous``.

The classifiers learn from a bounded sample: at most ``sample_rows`` labelled texts in all, chosen by a hash of the row's
id within each language, whole texts, as n-gram counts made on the executors.  Prediction uses every whole text.  A null
text, or one without a letter, is ``und`` with score 0.  Ties go to the language that sorts first.  Without training
rows everything is ``und``.  With one language every text with letters is that language.  Rows are independent, so repeated
rows give equal results (and teach as often as they are there).  Texts of any length are read whole; an empty table gives
no row; columns other than the named ones are ignored (kept with ``carry`` unless a result has their name).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, map_rows, runs, strings

BITS = 12
SAMPLE_ROWS = 3000
AMBIGUOUS = 0.2


def counts(column: pa.Array, bits: int = BITS):
    """Yields per text a dense vector of its n-grams' counts: 1 to 3 bytes of the lower-cased UTF-8, hashed."""
    size, shift = 1 << bits, np.uint32(32 - bits)
    data, offsets = strings(column)
    for i, j in runs(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]].astype(np.uint32)
        one = low + np.uint32(1)
        two = one[:-1] * np.uint32(257) + one[1:] if len(one) > 1 else one[:0]
        three = two[:-1] * np.uint32(257) + one[2:] if len(one) > 2 else one[:0]
        hashed = [((g * np.uint32(2654435761)) ^ (g >> np.uint32(7))) * np.uint32(2246822519) >> shift for g in (one, two, three)]
        for k in range(i, j):
            a, b = offsets[k] - offsets[i], offsets[k + 1] - offsets[i]
            own = [h[a : max(a, b - n)] for n, h in enumerate(hashed)]
            yield np.bincount(np.concatenate(own), minlength=size)


def vector(c: np.ndarray) -> np.ndarray:
    v = np.sqrt(c.astype(np.float32))
    n = float(np.sqrt(v @ v))
    return v / n if n else v


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1/1: all distinct splits for up to 5 languages, else the best separated of some random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        width = (1 << (n - 1)) - 1
        return np.array([[-1 if k and (b + 1) >> (k - 1) & 1 else 1 for b in range(width)] for k in range(n)])
    rng, width, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1.0
    for _ in range(200):
        code = np.where(rng.random((n, width)) < 0.5, -1, 1)
        apart = (code[:, None] != code[None]).sum(2) + width * np.eye(n)
        if abs(code.sum(0)).max() < n and apart.min() > most:
            best, most = code, apart.min()
    return best


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, b: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.b, self.trust = langs, code, w, b, trust

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], rounds: int = 150) -> Model:
        langs = sorted(set(y))
        code = codewords(len(langs))
        target = code[[langs.index(v) for v in y]].astype(np.float32)
        # Every language weighs the same, however many rows it has.
        weight = np.array([1 / max(1, y.count(v)) for v in langs], np.float32)[[langs.index(v) for v in y]]
        weight /= weight.sum()
        w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
        vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 20.0
        for _ in range(rounds if len(langs) > 1 else 0):
            g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight[:, None]
            vw = 0.9 * vw - rate * (x.T @ g + 1e-5 * w)
            vb = 0.9 * vb - rate * 0.1 * g.sum(0)
            w, b = w + vw, b + vb
        right = (np.sign(x @ w + b) == target) if len(langs) > 1 else np.ones_like(target, bool)
        own = np.array([right[[v == lang for v in y]].mean(0) for lang in langs])
        return cls(langs, code, w, b, own / np.maximum(own.sum(1, keepdims=True), 1e-9))

    def decode(self, v: np.ndarray) -> tuple[str, float, str, bool]:
        """Language, score, runner-up, ambiguous."""
        margin = v @ self.w + self.b
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-4 * (loss - loss[order[0]]))
        share /= share.sum()
        second = order[1] if len(order) > 1 else order[0]
        return self.langs[order[0]], float(share[order[0]]), self.langs[second], len(order) > 1 and bool(share[order[0]] - share[second] < AMBIGUOUS)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from labelled rows where ``train`` holds."""
    rows = docs.filter(train).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t"), F.col(lang_col).cast("string").alias("__lang"))
    per = {r[0]: r[1] for r in rows.groupBy("__lang").count().collect()}
    if not per:
        return None
    each = sample_rows / len(per)
    rate = F.create_map(*[F.lit(x) for lang, n in per.items() for x in (lang, min(1.0, each / n))])
    rank = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    # Ordered, so that the same rows teach however the table is dealt.
    sample = rows.filter(rank < rate[F.col("__lang")] * float(1 << 30)).orderBy(rank, "__id", F.xxhash64("__t")).limit(sample_rows)

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        made = [vector(c) for c in counts(column)]
        where = [np.flatnonzero(v) for v in made]
        return {"__at": pa.array([w.astype(np.int32) for w in where], pa.list_(pa.int32())), "__v": pa.array([v[w] for v, w in zip(made, where)], pa.list_(pa.float32()))}

    got = map_rows(sample, ["__lang"], "__t", "__at array<int>, __v array<float>", fn).toArrow()
    y = got.column("__lang").to_pylist()
    x = np.zeros((len(y), 1 << BITS), np.float32)
    for k, (at, v) in enumerate(zip(got.column("__at"), got.column("__v"))):
        x[k, at.values.to_numpy()] = v.values.to_numpy()
    return Model.fit(x, y) if y else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: lang_pred, score, runner_up, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        model, out = sent.value, []
        for x, c in zip(column, counts(column)):
            text = x.as_py()
            if model is None or not text or not any(map(str.isalpha, text)):
                out.append(("und", 0.0, "und", False))
            else:
                out.append(model.decode(vector(c)))
        lang, score, second, unsure = zip(*out) if out else ((), (), (), ())
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "runner_up": pa.array(second, pa.string()), "ambiguous": pa.array(unsure, pa.bool_())}

    return map_rows(docs, [id_col, *carry], text_col, "lang_pred string, score double, runner_up string, ambiguous boolean", fn)
