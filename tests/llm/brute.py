"""Plain forms of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def without_repeats(texts, width=35):
    """(words, removed, digest of what stays) of each text."""
    lists = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[k : k + width]) for w in lists for k in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def links(texts, threshold=0.8):
    """(index of the first of each text's group, other texts linked)."""
    sets = [shingles(t) for t in texts]
    root, count = list(range(len(texts))), [0] * len(texts)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                count[i] += 1
                count[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(top(i), count[i]) for i in range(len(texts))]


def repeat_words(text, width=8):
    w = words(text)
    seen = collections.Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    gone = [False] * len(w)
    for k in range(len(w) - width + 1):
        if seen[tuple(w[k : k + width])] > 1:
            gone[k : k + width] = [True] * width
    return sum(gone)
