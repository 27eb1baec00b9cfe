"""Stupid-backoff language-model scores of every document against the counts of all documents.

The join of n-gram counts with exploded n-grams is made in blocks of columns instead of rows:

1. A chunk is a run of documents.  It asks for the distinct n-grams (64-bit hashes, all orders) that it holds and brings
   their counts in the chunk, sorted, split by hash range: one row for each (hash range, chunk).
2. A hash range adds up the counts of all chunks, which is the count table of its n-grams, and answers each chunk with
   the totals in the chunk's own order.  The answers are written to the shared folder.
3. The chunk's texts meet its answers; each position takes the longest n-gram with at least ``least`` occurrences,
   with a factor of 0.4 for every order that it backs off; documents sum the logarithms.

So a word crosses the network once per chunk and order, pre-aggregated, whatever its frequency: no key is hot.
Scores: ``log_prob`` (natural logarithm, summed over the words), ``score`` (its mean by word), ``n_backoff`` (words that
did not get the full order).  Null, empty or wordless texts have 0 words, log_prob 0 and a null score.  Words are runs of
anything but ASCII white space, A-Z lower-cased.  Repeated rows count and score like any other.  Texts of any length are
read whole; an empty table gives no row; other columns are ignored, whatever their names.  The rows between the two stages
are at most chunks times ranges, and at most one per distinct n-gram of a chunk.  Chunks are read twice; answers carry a
mark of the n-grams they belong to, so a source that deals its rows differently the second time is an error, never a wrong score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, NON_SPACE, Words, grams, runs, strings
from .storage import Workspace

ORDER, LEAST, FACTOR, CHUNK_BYTES = 3, 2, 0.4, 8 << 20


def _keys(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of the n-grams that end at a word, and the index of that word; none crosses documents."""
    h, doc = words.hashes(), words.doc()
    out = []
    for k in range(1, order + 1):
        g = grams(h, k)
        ok = np.flatnonzero(doc[: len(g)] == doc[k - 1 :]) if len(g) else np.zeros(0, int)
        out.append((g[ok], ok + k - 1))
    return out


def _chunks(batches, chunk_bytes: int):
    """(chunk's number, ids, text column) of a partition's documents: the same for the same scan."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        _, offsets = strings(b.column(1))
        for i, j in runs(offsets, chunk_bytes):
            yield part + n, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)
            n += 1


def _words(column: pa.Array) -> Words:
    return Words(*strings(column), NON_SPACE, LOWER)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, in as few bytes each as the largest one needs."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 1
    return keys[:1].tobytes() + bytes([width]) + step[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width, rest = data[8], np.frombuffer(data, np.uint8, offset=9)
    step = np.zeros((len(rest) // width + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8)
    step[1:, :width] = rest.reshape(-1, width)
    return np.cumsum(step.view("<u8").ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in eight."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def mark(keys: np.ndarray) -> int:
    """Of a set of hashes, to tell whether two reads of a chunk saw the same n-grams."""
    return int(np.bitwise_xor.reduce(keys, initial=np.uint64(len(keys))).view(np.int64))


def requests(source: DataFrame, order: int, bits: int, chunk_bytes: int) -> DataFrame:
    def each(batches):
        for chunk, _, text in _chunks(batches, chunk_bytes):
            w = _words(text)
            keys, counts = np.unique(np.concatenate([k for k, _ in _keys(w, order)]), return_counts=True)
            edge = np.searchsorted((keys >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
            rows = [(r, int(a), int(b)) for r, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([packed(keys[a:b]) for _, a, b in rows], pa.binary()), pa.array([small(counts[a:b]) for _, a, b in rows], pa.binary()), pa.array([int(w.count.sum()) if k == 0 else 0 for k in range(len(rows))], pa.int64()), pa.array([mark(keys)] * len(rows), pa.int64())], names=["range", "chunk", "keys", "counts", "words", "mark"])

    return source.mapInArrow(each, "range int, chunk long, keys binary, counts binary, words long, mark long")


def _answer(table: pa.Table) -> pa.Table:
    keys = [unpacked(x.as_py()) for x in table.column("keys")]
    size = [len(k) for k in keys]
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n_keys = len(keys)
    del keys
    counts = np.concatenate([large(x.as_py(), n) for x, n in zip(table.column("counts"), size)])
    total = np.add.reduceat(counts[order], start)
    back = counts
    back[order] = np.repeat(total, np.diff(np.append(start, n_keys)))
    del order, start, total
    edge = np.concatenate([[0], np.cumsum(size)])
    return pa.Table.from_arrays([table.column("range"), table.column("chunk"), pa.chunked_array([pa.array([small(back[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())]), pa.chunked_array([pa.array(size, pa.int64())]), table.column("words"), table.column("mark")], names=["range", "chunk", "totals", "n", "words", "mark"])


def positions(ends: list[np.ndarray], counts: list[np.ndarray], n_words: int, corpus_words: int, least: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the stupid-backoff score at each word, and whether it backed off; for each order, the words at which
    an n-gram ends and its count."""
    found = [np.zeros(n_words, np.int64) for _ in ends]
    available = np.zeros(n_words, np.int64)
    for k, (at, n) in enumerate(zip(ends, counts)):
        found[k][at] = n
        available[at] = k + 1
    out = np.full(n_words, np.nan)
    for k in range(len(ends) - 1, -1, -1):
        hit = np.isnan(out) & (available > k) & ((found[k] >= least) if k else True)
        # The context is the n-gram of one order less that ends a word earlier.
        below = np.concatenate([[1], found[k - 1][:-1]]) if k else np.full(n_words, corpus_words)
        out[hit] = np.log(found[k][hit] / below[hit]) + (available[hit] - k - 1) * np.log(factor)
        if k == len(ends) - 1:
            full = hit
    return out, ~full


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, least: int = LEAST, factor: float = FACTOR, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = 48 << 20) -> DataFrame:
    """A row per document: n_words, log_prob, score, n_backoff."""
    spark = docs.sparkSession
    work = Workspace(spark, "ngrams")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # The number of hash ranges follows the text: about an entry of 8 bytes for six bytes of text and each order.
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, size * order * 1.5 / range_bytes)))))
    answers = work.keep(requests(source, order, bits, chunk_bytes).groupBy("range").applyInArrow(_answer, "range int, chunk long, totals binary, n long, words long, mark long"))
    corpus_words = answers.agg(F.sum("words")).first()[0] or 0

    def texts(batches):
        for chunk, ids, text in _chunks(batches, chunk_bytes):
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([ids, text], names=["doc_id", "text"])
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "docs"])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for packed in left.column("docs"):
            table = pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()
            w = _words(table.column("text"))
            keys = _keys(w, order)
            ends, joined = [at for _, at in keys], np.concatenate([k for k, _ in keys])
            del keys
            unique, place = np.unique(joined, return_inverse=True)
            del joined
            by = right.sort_by("range")
            totals = np.concatenate([np.zeros(0, np.int64), *(large(x.as_py(), n) for x, n in zip(by.column("totals"), by.column("n").to_pylist()))])
            if len(totals) != len(unique) or any(m != mark(unique) for m in by.column("mark").unique().to_pylist()):
                raise RuntimeError("a chunk's texts differ between two reads of the documents")
            found = np.split(totals[place], np.cumsum([len(at) for at in ends])[:-1])
            logs, backed = positions(ends, found, int(w.count.sum()), corpus_words, least, factor)
            lp = np.array([logs[a:b].sum() for a, b in zip(w.first, w.first[1:])])
            turned = np.concatenate([[0], np.cumsum(backed)])
            n = w.count
            out.append(pa.Table.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n.astype(np.int64)), pa.array(lp), pa.array(lp / np.maximum(n, 1), mask=n == 0), pa.array((turned[w.first[1:]] - turned[w.first[:-1]]).astype(np.int64))], names=["doc_id", "n_words", "log_prob", "score", "n_backoff"]))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("score", pa.float64()), ("n_backoff", pa.int64())]))

    held = source.mapInArrow(texts, "chunk long, docs binary")
    return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, "doc_id long, n_words long, log_prob double, score double, n_backoff long")
