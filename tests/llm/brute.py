"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

AZ = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(AZ))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def jaccard(rows):
    """rows of (doc_id, text), ids unique: {doc_id: (n_shingles, component_id)}."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter(p for h in holders.values() for p in combinations(sorted(h), 2))
    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def quality(text):
    raw = SPACED.findall(text or "")
    windows = Counter(tuple(raw[k : k + 3]) for k in range(len(raw) - 2))
    hit = {k + j for k in range(len(raw) - 2) if windows[tuple(raw[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if SPACED.search(x):
            dup += x in seen
            seen.add(x)
    return len(raw), sum(map(len, raw)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def contamination(text, items):
    w = words(text, ALNUM)
    hit, found = set(), set()
    for item, t in items:
        b = words(t, ALNUM)
        n = min(10, len(b))
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def longest_match(text, items):
    """(words, start, item) of the longest verbatim match of at least a window; ties: first start, least item id as a string."""
    w, best = words(text, ALNUM), (0, -1, None)
    starts = defaultdict(list)
    for k, x in enumerate(w):
        starts[x].append(k)
    for item, t in items:
        b = words(t, ALNUM)
        for s in range(len(b)):
            for k in starts[b[s]]:
                n = 0
                while s + n < len(b) and k + n < len(w) and b[s + n] == w[k + n]:
                    n += 1
                if n >= min(10, len(b)):
                    best = min(best, (n, k, None if item is None else str(item)), key=lambda x: (-x[0], x[1], x[2] is None, x[2] or ""))
    return best


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return *(sum(x[1] == k for x in out) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest()


def backoff(rows, order=3, least=2, factor=0.4):
    """rows of (doc_id, text): {doc_id: (n_words, log_prob, n_backoff)}."""
    texts = {i: words(t) for i, t in rows}
    count = Counter(tuple(w[k : k + n]) for w in texts.values() for n in range(1, order + 1) for k in range(len(w) - n + 1))
    total, out = sum(map(len, texts.values())), {}
    for i, w in texts.items():
        log, backed = 0.0, 0
        for k in range(len(w)):
            most = min(order, k + 1)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or count[g] >= least:
                    below = count[g[:-1]] if n > 1 else total
                    log += math.log(count[g] / below) + (most - n) * math.log(factor)
                    backed += n < order
                    break
        out[i] = (len(w), log, backed)
    return out


def repeated(rows, n=50):
    """Word positions of each document that lie in an n-word run which another document has too."""
    holders, texts = defaultdict(set), {i: words(t) for i, t in rows}
    for i, w in texts.items():
        for k in range(len(w) - n + 1):
            holders[tuple(w[k : k + n])].add(i)
    return {i: {p for k in range(len(w) - n + 1) if len(holders[tuple(w[k : k + n])]) > 1 for p in range(k, k + n)} for i, w in texts.items()}


RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def url(u):
    if not u or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = host.translate(AZ)
    best = None
    for _, r in RULES:
        d, _, p = r.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(r) > len(best)):
            best = r
    return host, path, best
