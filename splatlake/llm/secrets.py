r"""Secret scan: fixed patterns plus a sliding Shannon entropy test over candidate strings.

Base kinds, each leftmost and without overlap: ``assign``, ``access``, ``hex`` (patterns below).  The method adds kind
``entropy``: a run of ``[A-Za-z0-9+/_=-]`` of at least 20 characters is cut into windows; for each character class the
entropy of its characters in the window is kept by incremental counts (one character enters, one leaves).  Where the
window's class reaches its threshold, the windows join to a span, unless an allow-list rule suppresses it.  Allow-list
rules never suppress a base span.

Null and empty texts have no span.  Rows are independent, so repeated rows and ties give equal results; a text of any
length is scanned whole, in time in proportion to it.  An empty table gives no row.  Extra columns are ignored unless
carried; a result column takes the place of a carried one.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Key names and patterns of the base kinds.
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")
#: Allow-list: identifiers that look random but are public by nature.
ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(rb"sha(1|224|256|384|512)-[A-Za-z0-9+/=]+"),
    re.compile(rb"[A-Z]{2}[0-9]{2}(-?[A-Z0-9]{4}){3,7}"),
    re.compile(rb"[0-9]{0,19}([+-][0-9]{0,19})*"),
)
#: What ends an address.  A candidate is part of one if ``://`` stands before it with none of these between.
BREAKS = tuple(bytes([c]) for c in b" \t\n\r\f\v\"'<>")
#: Before a candidate: embedded data.
EMBEDDED = re.compile(rb"data:[a-z/+.-]+;base64,", re.IGNORECASE)
#: A run of words and short numbers between slashes; only these are taken for paths where a slash leads.
PATH = re.compile(rb"(?:(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,8}[-_/=])*(?:(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,8})?")

WINDOW = 20
#: Bits per character in a window that holds one class alone, hexadecimal digits, or several classes (``cased``: with
#: fewer than two digits, as names in mixed case have).
THRESHOLDS = {"lower": 3.7, "upper": 3.4, "digit": 2.6, "sign": 1.9, "hex": 3.0, "mixed": 3.6, "cased": 3.9}
_XLOG = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 2))]  # one enters before one leaves
_HEX = frozenset(b"0123456789abcdefABCDEF")


def _class(c: int) -> str:
    return "digit" if 48 <= c <= 57 else "upper" if 65 <= c <= 90 else "lower" if 97 <= c <= 122 else "sign"


def hot_windows(run: bytes, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Spans of a run whose windows reach a threshold; the counts change by one character in and one out."""
    counts: dict[int, int] = {}
    per = {"lower": 0, "upper": 0, "digit": 0, "sign": 0, "hex": 0}
    partial = {"lower": 0.0, "upper": 0.0, "digit": 0.0, "sign": 0.0}  # sum of n*log2(n) by class
    spans: list[tuple[int, int]] = []

    def step(c: int, by: int) -> None:
        kind, n = _class(c), counts.get(c, 0)
        partial[kind] += _XLOG[n + by] - _XLOG[n]
        counts[c] = n + by
        per[kind] += by
        per["hex"] += by * (c in _HEX)

    for k, c in enumerate(run):
        step(c, 1)
        if k >= window:
            step(run[k - window], -1)
        if k < window - 1:
            continue
        every = math.log2(window) - sum(partial.values()) / window
        kinds = sum(per[x] > 0 for x in ("lower", "upper", "digit"))
        hot = False
        if per["hex"] == window:
            hot = per["digit"] >= 3 and per["digit"] < window - 2 and every >= thresholds["hex"]
        elif kinds >= 2:
            hot = every >= thresholds["mixed" if per["digit"] >= 2 else "cased"]
        for x in ("lower", "upper", "digit", "sign"):
            if not hot and per[x] == window:
                hot = math.log2(window) - partial[x] / window >= thresholds[x]
        if hot:
            if spans and spans[-1][1] >= k - window + 1:
                spans[-1] = (spans[-1][0], k + 1)
            else:
                spans.append((k - window + 1, k + 1))
    return spans


class Before:
    """Whether a candidate is part of an address or of embedded data; candidates come in order, each byte is looked at once."""

    def __init__(self, raw: bytes, low: bytes):
        self.raw, self.low, self.at, self.start, self.address = raw, low, 0, 0, False

    def allows(self, at: int) -> bool:
        low, step, start = at, 256, -1
        while low > self.at and start < 0:
            new = max(self.at, low - step)
            start = max(self.raw.rfind(c, new, low) for c in BREAKS)
            low, step = new, 2 * step
        if start >= 0:
            self.start, self.address = start + 1, self.raw.find(b"://", start + 1, at) >= 0
        else:
            self.address = self.address or self.raw.find(b"://", max(self.start, self.at - 2), at) >= 0
        self.at = at
        if self.address:
            return True
        if self.raw[max(0, at - 8) : at].lower() != b";base64,":
            return False
        head = self.low.rfind(b"data:", self.start, at)
        return head >= 0 and EMBEDDED.fullmatch(self.raw, head, at) is not None


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of all spans, in bytes, sorted."""
    found: list[tuple[int, int, int]] = []
    low = raw.lower()
    at = [p for key in KEYS if (p := low.find(key)) >= 0]
    if at:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw, min(at)) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    before = Before(raw, low)
    for m in CANDIDATE.finditer(raw):
        text = m[0]
        path = m.start() + len(text) - len(text.lstrip(b"/"))
        if before.allows(path) or path > m.start() and PATH.fullmatch(text) or any(p.fullmatch(text) for p in ALLOWED):
            continue
        found += [(m.start() + a, 3, m.start() + b) for a, b in hot_windows(text)]
    return sorted(found)


def points(raw: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points."""
    if not found or raw.isascii():
        return found
    marks = sorted({x for a, _, b in found for x in (a, b)})
    to, n, last = {}, 0, 0
    for x in marks:
        n += len(raw[last:x].decode("utf-8", "replace"))
        to[x], last = n, x
    return [(to[a], k, to[b]) for a, k, b in found]


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: counts by kind, ``base_sha256``, ``spans`` and ``n_entropy``; no shuffle."""
    from .kernels import map_rows

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")}
        for x in column:
            raw = x.as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            found = points(raw, scan(raw))
            for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_entropy")):
                out[n].append(sum(f[1] == k for f in found))
            out["base_sha256"].append(hashlib.sha256(_joined(f for f in found if f[1] < 3).encode()).hexdigest())
            out["spans"].append(_joined(found))
        return {n: pa.array(v, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, v in out.items()}

    return map_rows(docs, [id_col, *carry], text_col, "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string", fn)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by a mark; overlapping spans get one.  ``n_chars`` follows, if present."""
    from pyspark.sql import functions as F

    from .kernels import map_documents, restored

    def fn(column: pa.Array) -> dict[str, pa.Array]:
        out = []
        for x in column:
            raw = x.as_buffer()
            if raw is None:
                out.append(None)
                continue
            raw = raw.to_pybytes()
            parts, last = [], 0
            for a, _, b in scan(raw):
                if a >= last:
                    parts += [raw[last:a], mark.encode()]
                last = max(last, b)
            out.append(b"".join([*parts, raw[last:]]).decode())
        return {"__clean": pa.array(out, pa.string())}

    out = map_documents(docs, text_col, "__clean string", fn)
    out = out.withColumn(f"__c{docs.columns.index(text_col)}", F.col("__clean"))
    if "n_chars" in docs.columns:
        out = out.withColumn(f"__c{docs.columns.index('n_chars')}", F.coalesce(F.length("__clean"), F.col(f"__c{docs.columns.index('n_chars')}")).cast(docs.schema["n_chars"].dataType))
    return restored(out, docs.columns)
