"""Plain-Python versions of what the operators give."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def spaced(text):
    return SPACED.findall(low(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(text, items, window=10):
    """(n_words, n_hit, item ids as sorted text)"""
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def shingles(text, n=3):
    w = spaced(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(docs, threshold=85, n=3):
    """Smallest reachable id by id, for unique ids."""
    ids, sets = [i for i, _ in docs], [shingles(t, n) for _, t in docs]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y, key=lambda k: ids[k])] = min(x, y, key=lambda k: ids[k])
    return {i: (len(sets[k]), ids[find(k)]) for k, i in enumerate(ids)}
