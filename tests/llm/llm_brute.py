"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import math
import re
import zlib

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered_words(text):
    return words((text or "").translate(_LOWER))


def shingles(text, n=5):
    w = lowered_words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def components(texts, percent=85):
    """{id: (set size, component)} of {id: text}, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(docs, length=200, keep_first=False):
    """{row: (bytes, removed, spans, sha256, kept)} of [(row, text)] in their order."""
    raw = [(r, (t or "").encode()) for r, t in docs]
    count, first = collections.Counter(), {}
    for r, b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
            first.setdefault(b[i : i + length], (r, i))
    out = {}
    for r, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if first[w] != (r, i) if keep_first else count[w] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[r] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def base_measures(text):
    w = words(text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    return (
        n,
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def base_scores(docs):
    """{id: (held_out, tokens, known, N, base score)} of [(id, text)]."""
    tokens = {i: [*lowered_words(t), ""] for i, t in docs}
    count = collections.Counter()
    for i, t in tokens.items():
        if fold(i, 7) != 2:
            count.update(t)
    total = sum(count.values())
    size = total + len(count) + 1
    return {
        i: (
            fold(i, 7) == 2,
            len(t),
            sum(count[x] > 0 for x in t),
            total,
            sum(math.log10((count[x] + 1) / size) for x in t),
        )
        for i, t in tokens.items()
    }
