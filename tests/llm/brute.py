"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter

BREAK = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BREAK.split(text or "") if w]


def near(docs, n, percent=80):
    """{id: (set size, least id reachable)} of (id, text) rows."""
    sets = {}
    for i, t in docs:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = set() if not w else {tuple(w)} if len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs, n):
    """[(id, words, removed, kept text)] of (id, text) rows, repeats in other rows and in the same one."""
    parsed = [(i, words(t)) for i, t in docs]
    count = Counter(tuple(w[k : k + n]) for _, w in parsed for k in range(len(w) - n + 1))
    out = []
    for i, w in parsed:
        gone = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    count = Counter(windows)
    covered = set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def leaks(docs, items, percent=80):
    """{doc: items} by exact weighted Jaccard similarity of item-sized windows, without fingerprints."""
    import math

    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    held = {i: sh(tok(t)) for i, t in items if tok(t)}
    df = Counter(x for s in held.values() for x in set(s))
    weight = lambda x: round(math.log(1 + len(held) / df[x]) * 256) if x in df else round(math.log(1 + max(len(held), 1)) * 256)
    found = {}
    for i, t in docs:
        s = sh(tok(t))
        for j, own in held.items():
            for k in range(max(1, len(s) - len(own) + 1)):
                win, it = set(s[k : k + len(own)]), set(own)
                if win and 100 * sum(map(weight, win & it)) >= percent * sum(map(weight, win | it)):
                    found.setdefault(i, set()).add(j)
    return found
