"""Plain single-machine versions that the operators are held against."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def near(docs, percent=80, size=2):
    """docs: list of (doc_id, text); all pairs by an inverted index."""
    sets = {}
    for i, t in docs:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids, index = sorted(sets), defaultdict(list)
    for i in ids:
        both = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                both[j] += 1
            index[s].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def repeats(docs, size=20):
    """docs: list of (doc_id, text): removal of words under windows that start earlier elsewhere."""
    seen, out = set(), set()
    for i, t in sorted(docs):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[k : k + size] = [True] * size
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def components(ids, sets, percent):
    """Least id of each id's component under all pairs of similar sets."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i in ids:
        both = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                both[j] += 1
            index[s].append(i)
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def lines(docs, size=8, percent=80):
    """{(doc_id, line_no, keep_doc_id, keep_line_no, kept)} of docs: list of (doc_id, text)."""
    places = [((i, k), x) for i, t in sorted(docs) for k, x in enumerate((t or "").split("\n")) if t is not None and x.strip()]
    first = {}
    for p, x in places:
        first.setdefault(x, p)
    sets = {p: {x[k : k + size] for k in range(max(1, len(x) - size + 1))} for x, p in first.items()}
    keep = components(sorted(sets), sets, percent)
    return {(*p, *keep[first[x]], p == keep[first[x]]) for p, x in places}
