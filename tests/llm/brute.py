"""Brute-force versions of the contracts, in plain Python over whole texts."""

import hashlib
import math
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring(docs):
    """docs: (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    words = [(i, SPACED.findall(t or "")) for i, t in docs]
    for i, w in words:
        for s in range(len(w) - 12):
            k = tuple(w[s:s + 13])
            if i is not None:
                first[k] = min(i, first.get(k, i))
    out = []
    for i, w in words:
        gone = {p for s in range(len(w) - 12) if i is not None and first[tuple(w[s:s + 13])] < i for p in range(s, s + 13)}
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return sorted(out, key=str)


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near(docs):
    """(doc_id, n_shingles, component_id); ids are distinct."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets)


def contaminated(docs, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[s:s + 10]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if x := windows.get(tuple(w[s:s + n])):
                    found |= x
                    hit.update(range(s, s + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def secrets(text):
    """n_assign, n_access, n_hex, base_sha256 and the spans."""
    t = text or ""
    kinds = (
        [m.span() for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
    spans = sorted((s, k, e) for k, x in enumerate(kinds) for s, e in x)
    text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return (*map(len, kinds), sha(text), text)


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w = SPACED.findall(t)
    count = {}
    for s in range(len(w) - 2):
        count[tuple(w[s:s + 3])] = count.get(tuple(w[s:s + 3]), 0) + 1
    again = {p for s in range(len(w) - 2) if count[tuple(w[s:s + 3])] > 1 for p in range(s, s + 3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def search(docs, items, k=10):
    """(item_id, rank, doc_id, score) over docs (doc_id, text) and items (item_id, text); null ids are never ranked."""
    texts = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in docs]
    texts = [(i, w) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, t in items:
        terms = set(ALNUM.findall((t or "").translate(LOWER)))
        found = []
        for i, w in texts:
            m = 10 + 90 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * w.count(x) // (1000 * w.count(x) + 8 * m)) for x in terms & set(w))
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def bytes_removed(docs, order, window=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); ``order(doc_id, text)`` orders the texts of an id."""
    raw = {(i, t): (t or "").encode() for i, t in docs}
    first = {}
    for i, t in sorted((x for x in raw if x[0] is not None), key=lambda x: (x[0], order(*x))):
        b = raw[i, t]
        for s in range(len(b) - window + 1):
            first.setdefault(b[s:s + window], (i, t, s))
    out = []
    for i, t in docs:
        b = raw[i, t]
        gone = bytearray(len(b))
        if i is not None:
            for s in range(len(b) - window + 1):
                if first[b[s:s + window]] != (i, t, s):
                    gone[s:s + window] = b"\x01" * window
        runs = len([x for x in bytes(gone).split(b"\x00") if x])
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)
