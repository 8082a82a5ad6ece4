"""The operators' results by plain Python over small lists of (id, text)."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contaminated(rows, items, window=10):
    out = []
    for i, text in rows:
        w = alnum_words(text)
        hit, names = [False] * len(w), set()
        for name, item in items:
            p = alnum_words(item)
            for k in range(max(1, len(p) - window + 1) if p else 0):
                part = p[k : k + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit[j : j + len(part)] = [True] * len(part)
                        names |= {str(name)} if name is not None else set()
        out.append((i, len(w), sum(hit), sorted(names)))
    return out


def repeated_words(rows, size):
    first = {}
    for i, text in rows:
        w = space_words(text)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = space_words(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_bytes(rows, size):
    seen, out = {}, []
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - size + 1):
            if seen.setdefault(b[k : k + size], (i, k)) != (i, k):
                gone[k : k + size] = [True] * size
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def components(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = space_words((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]
