"""Plain single-threaded versions of the operators' contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = "[\x20\x09-\x0d]"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def text_hash(t):
    import xxhash

    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def order(docs):
    """By doc_id, then by the texts' hashes."""
    return sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, text_hash(d[1])))


def op1(docs, tok):
    out, start = [], 0
    for i, t in order(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def op2(docs, least=10):
    key = lambda x: lower(x.strip("\x20\t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op3(docs):
    kinds = (("assign", """(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    out = []
    for i, t in docs:
        spans, counts = [], []
        for n, (name, pattern, ok) in enumerate(kinds):
            own = [(m.start(), n, m.end(), name) for m in re.finditer(pattern, t or "", re.ASCII) if ok(m)]
            spans += own
            counts.append(len(own))
        out.append((i, *counts, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)))))
    return out


def op4(docs, n=50):
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < i:
                gone |= set(range(p, p + n))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def op5(docs, items, n=13):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        if w:
            m = min(n, len(w))
            for p in range(len(w) - m + 1):
                windows[tuple(w[p : p + m])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                if (k := tuple(w[p : p + m])) in windows:
                    hit |= set(range(p, p + m))
                    ids |= windows[k]
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(t, n=4):
    w = words(lower(t or ""))
    return {tuple(w[p : p + n]) for p in range(max(1, len(w) - n + 1))} if w else set()


def op8(docs, percent=85):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            both = len(s & u)
            if both and 100 * both >= percent * (len(s) + len(u) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), find(i)) for i, s in sets]


def op10(docs):
    out = []
    for i, t in docs:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        tri = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        again = {q for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for q in (p, p + 1, p + 2)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), failed))
    return out


def merkle(leaves, fanout=2):
    """(root, for each leaf its [(left, right)] level by level)."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][p : p + fanout])) for p in range(0, len(levels[-1]), fanout)])
    paths = []
    for p in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = p - p % fanout
            path.append(("".join(level[first:p]), "".join(level[p + 1 : first + fanout])))
            p //= fanout
        paths.append(path)
    return levels[-1][0], paths


def op11(docs, fanout=2):
    """docs: (doc_id, source, lang, n_chars, text)."""
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    groups = defaultdict(list)
    for d in docs:
        odd = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
        hashes = sha("".join(map(enc, d))), sha("".join(map(enc, (*d[:3], d[3] + odd if d[3] is not None else None, d[4]))))
        groups[d[2]].append((d[0] is not None, d[0] or 0, *hashes))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: merkle([x[2] for x in sorted(groups[g])], fanout) for g in order}
    root, tops = merkle([trees[g][0] for g in order], fanout) if order else ("", [])
    out = []
    for g, top in zip(order, tops):
        for (has, i, own, odd), path in zip(sorted(groups[g]), trees[g][1]):
            h = odd
            for left, right in (*path, *top):
                h = sha(left + h + right)
            out.append((i if has else None, own, trees[g][0], root, sha("".join(x + y for x, y in (*path, *top))), h, h == root))
    return out


def sketch(t, n=5, scale=16, least=64):
    import xxhash

    w = [x.encode() for x in words((t or "").lower())]
    hashes = set()
    for p in range(len(w) - n + 1 if len(w) >= n else len(w) > 0):
        parts = w[p : p + n] if len(w) >= n else [b" ".join(w)]
        h = 42
        for x in parts:
            h = xxhash.xxh64_intdigest(x, h)
        hashes.add(h - 2**64 if h >= 2**63 else h)
    every = sorted(hashes)
    below = [h for h in every if h < -(2**63) + 2**64 // scale]
    return below if len(below) >= least else every[:least]


def contained(a, b, scale=16, least=64):
    if not a or not b:
        return float(len(a) == len(b))
    upto = min(2**63 - 1 if len(x) < least else max(x[-1], -(2**63) + 2**64 // scale - 1) for x in (a, b))
    own = [h for h in a if h <= upto]
    return len(set(own) & set(b)) / len(own) if own else 0.0


def op12(docs):
    """docs in their order, each a document of its own."""
    shown = lambda s: "".join(f"{h % 2**64:016X}" for h in s)
    out = []
    for p, (i, t) in enumerate(docs):
        t, after = t or "", docs[(p + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b = sketch(t), sketch(edited)
        out.append((i, len(t), sha(edited), shown(a), shown(b), contained(a, b), contained(a, sketch(after))))
    return out


def op13(docs, items, k=10):
    import math

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(x for _, b in bags for x in b)
    out = []
    for item, t in items:
        scored = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // max(total, 1)
            s = sum(int(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * b[x] // (1000 * b[x] + 8 * m)) for x in set(cut(t)) if x in b)
            if s:
                scored.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if has else None, -s) for r, (s, has, i) in enumerate(sorted(scored)[:k])]
    return out
