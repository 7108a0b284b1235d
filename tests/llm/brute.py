"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    """{doc_id: (keep_id, size, kept, digest)} of (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id))
    out = {}
    for content, members in groups.items():
        best = min(members)
        for member in members:
            digest = hashlib.sha256(content.encode()).hexdigest()
            out[member[1]] = (best[1], len(members), member == best, digest)
    return out


def measures(text):
    text, w = text or "", words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def shingles(text, n):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in word) for word in words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near(rows, n, percent=80):
    """{doc_id: (size, component)} by comparing all pairs."""
    sets = {doc_id: shingles(text, n) for doc_id, text in rows}
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {doc_id: (len(sets[doc_id]), root(doc_id)) for doc_id in ids}


def repeated(rows, window=20):
    """{doc_id: (words, removed, digest)} by looking at all windows in order."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone |= set(range(i, i + window))
            seen.add(key)
        kept = " ".join(word for i, word in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def greedy(word, initial, following):
    """Pieces of a word by the longest match, or -1."""
    n, at = 0, 0
    while at < len(word):
        pieces = following if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """{doc_id: (size, source size, target, taken)} of (doc_id, text, source); all sizes above 0."""
    sizes, texts = {d: len(words(t)) for d, t, _ in rows}, {d: t for d, t, _ in rows}
    by_source = defaultdict(list)
    for d, _, s in rows:
        by_source[s].append(d)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[d] for d in by_source[s]) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, unit = set(), 0.0
    while len(full) < len(order):
        left = share * sum(total.values()) - sum(most * total[s] for s in full)
        unit = left / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * unit > most * total[s]}
        if not more:
            break
        full |= more
    out = {}
    for s in order:
        target = most * total[s] if s in full else weight[s] * unit
        times = int(target // total[s]) if total[s] else 0
        left = target - times * total[s]
        key = lambda d: int(hashlib.md5(("text " + (texts[d] or "") if d is None else str(d)).encode()).hexdigest()[:15], 16)
        for d in sorted(by_source[s], key=key):
            more = sizes[d] > 0 and left > 0 and 2 * left >= sizes[d]
            left -= sizes[d]
            out[d] = (sizes[d], total[s], target, sizes[d] * (times + more))
    return out
