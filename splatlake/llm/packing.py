"""Bounded-space online packing of tokenised documents into sequences of a fixed length.

A document's ids are those of the tokenizer file and then an end id.  Each partition keeps a fixed number of open
windows: whole windows of a long document leave at once; the rest goes to the open window that it fits best; if it fits
none and all windows are open, the fullest is filled with a piece of it and leaves.  What stays open at the end of a
partition goes to a second pass of the same packer over few partitions; there, the last open windows are merged, and the
remainder is cut into power-of-two sequences, which need no padding.

A null text is an empty one (a single end id).  Repeated rows are packed once each.  A document of any length is encoded
whole; memory holds one batch of texts, the cache of encoded words and the open windows.  ``sequence_id`` comes from the
partition number and a counter, so a retried task makes the same rows.  A row without an id is packed under a null id;
windows of equal room are ties that go to the one opened first.  An empty table gives no row; columns other than the named
ones are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

LENGTH = 2048
OPEN = 32
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CLOSE_SPACES = re.compile(r"\s\s")


class _Parts(dict):
    """Ids of parts of a text, encoded at first use; two generations bound the size."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = array("I", self.encode(part)).tobytes()
        if len(part) <= 128:
            self[part] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Ids of a tokenizer file, as little-endian uint32 bytes.

    For byte-level files whose pattern never joins across ``x y`` (a single space between other characters), the text is
    cut before such spaces and every part is encoded once and kept in a cache of bounded size; other texts are encoded
    whole.  Where the file's merges are in the order of their ids, parts go through a rank-based encoder built from the
    same file, which is faster; each process compares it with the file's own on ``CHECKED`` parts and drops it if one
    differs.  The ids are the same.
    """

    CHECKED = 2000

    def __init__(self, path: str, cache: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        state = json.loads(self._t.to_str())
        self._splits = self._safe(state)
        self._fast, self._checks = self._ranked(state) if self._splits else None, 0
        self._parts = _Parts(self._part, cache)

    @staticmethod
    def _safe(state: dict) -> bool:
        pre = state.get("pre_tokenizer") or {}
        return state.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not state.get("truncation") and all(not re.search(r"\s", a["content"]) and not a["lstrip"] and not a["rstrip"] for a in state.get("added_tokens", []))

    @staticmethod
    def _ranked(state: dict):
        """The encoder by ranks, or None if the file isn't of that kind."""
        model = state["model"]
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        vocab = model["vocab"]
        merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if None in merged or any(x >= y for x, y in zip(merged, merged[1:])):
            return None
        # The public byte-to-character table of byte-level vocabularies: printable bytes stand for themselves.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = [a["content"] for a in state.get("added_tokens", [])]
        try:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(chars[c] for c in token): i for token, i in vocab.items() if token not in added}
            core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, KeyError, ValueError):
            return None
        pattern = re.compile("|".join(map(re.escape, added))) if added else None
        return core.encode_ordinary, pattern

    def _part(self, text: str) -> list[int]:
        if self._fast is None or self._fast[1] and self._fast[1].search(text):
            return self._t.encode(text, add_special_tokens=False).ids
        ids = self._fast[0](text)
        if self._checks < self.CHECKED:
            self._checks += 1
            own = self._t.encode(text, add_special_tokens=False).ids
            if own != ids:
                self._fast = None
                return own
        return ids

    def batch(self, texts: list[str]) -> list[bytes]:
        out, get = [], self._parts.__getitem__
        for text in texts:
            if not self._splits or "\0" in text or _CLOSE_SPACES.search(text):
                out.append(array("I", self._t.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, text.replace(" ", "\0 ").split("\0"))))
        self._parts.turn()
        return out


class Packer:
    """Keeps at most ``space`` open windows; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, base: int, length: int = LENGTH, space: int = OPEN):
        self.length, self.space, self.base, self._n = length, space, base, 0
        self.open: list[tuple[int, list]] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.base + self._n, at, ids))
            at += n
        self._n += 1

    def add(self, doc, start: int, total: int, ids: bytes) -> None:
        step = 4 * self.length
        view, at = memoryview(ids), 0
        while len(ids) - at >= step:
            self._emit([(doc, start + at // 4, total, view[at : at + step])])
            at += step
        while at < len(ids):
            n = (len(ids) - at) // 4
            fits = [(self.length - used, k) for k, (used, _) in enumerate(self.open) if self.length - used >= n]
            if fits:
                _, k = min(fits)
            elif len(self.open) < self.space:
                k = len(self.open)
                self.open.append((0, []))
            else:
                k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open[k]
            n = min(n, self.length - used)
            pieces.append((doc, start + at // 4, total, bytes(view[at : at + 4 * n])))
            at += 4 * n
            if used + n == self.length:
                self._emit(pieces)
                del self.open[k]
            else:
                self.open[k] = (used + n, pieces)

    def merge(self) -> None:
        """Fills windows one after the other from what is open; the remainder leaves as power-of-two sequences."""
        rest = [p for _, pieces in sorted(self.open, key=lambda w: -w[0]) for p in pieces]
        self.open = []
        left = sum(len(p[3]) // 4 for p in rest)
        while left:
            room = size = min(self.length, 1 << (left.bit_length() - 1))
            pieces = []
            while room:
                doc, start, total, ids = rest[0]
                n = min(room, len(ids) // 4)
                pieces.append((doc, start, total, ids[: 4 * n]))
                rest[0] = (doc, start + n, total, ids[4 * n :])
                if not rest[0][3]:
                    rest.pop(0)
                room -= n
            left -= size
            self._emit(pieces)


def _rows(rows: list[tuple], ids: bool, window: list[int] | None = None) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 8
    arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
    arrays.append(pa.array([bytes(x) for x in cols[7]] if ids else [None] * len(rows), pa.binary()))
    arrays.append(pa.array(window if window is not None else [None] * len(rows), pa.int64()))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "window"])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, space: int = OPEN, end_id: int = END_ID, with_ids: bool = True, merge_tokens: int = 1 << 22) -> DataFrame:
    """A row per piece; ``ids`` (little-endian uint32) is null without ``with_ids``.

    ``tokenizer_path`` is read on the executors.  ``merge_tokens`` is the size of a partition of the second pass.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "pack")
    tail = np.asarray([end_id], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder, packer = Encoder(tokenizer_path), Packer(part << 32, length, space)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                piece = b.slice(k, 256)
                texts = [x or "" for x in piece.column(1).to_pylist()]
                for doc, ids in zip(piece.column(0).to_pylist(), encoder.batch(texts)):
                    packer.add(doc, 0, len(ids) // 4 + 1, ids + tail)
                if len(packer.done) >= 256:
                    yield _rows(packer.done, with_ids)
                    packer.done.clear()
        yield _rows(packer.done, with_ids)
        rows, window = [], []
        for k, (_, pieces) in enumerate(packer.open):
            for doc, start, total, ids in pieces:
                rows.append((doc, start, len(ids) // 4, 0, total, 0, 0, ids))
                window.append((part << 32) + k)
        if rows:
            yield _rows(rows, True, window)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer((1 << 62) + (TaskContext.get().partitionId() << 32), length, space)
        for b in batches:
            for doc, start, total, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                packer.add(doc, start, total, ids)
            if packer.done:
                yield _rows(packer.done, with_ids)
                packer.done.clear()
        packer.merge()
        yield _rows(packer.done, with_ids)

    schema = PIECES + ", ids binary, window long"
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = work.keep(source.mapInArrow(first, schema))
    left = made.filter("window is not null")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    merged = left.repartition(max(1, -(-tokens // merge_tokens)), "window").sortWithinPartitions("window", "doc_id", "start").mapInArrow(second, schema)
    out = made.filter("window is null").unionByName(merged).drop("window")
    return out if with_ids else out.drop("ids")
