"""Plain versions of the operators, for small inputs."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    words = re.findall(r"[^ \t\n\v\f\r]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def near(docs):
    """doc number -> (set size, smallest doc number reachable)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * (i := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def hits(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        size = min(window, len(b))
        wins = {tuple(b[i:i + size]) for i in range(len(b) - size + 1)} if size else set()
        for i in range(len(w) - size + 1 if size else 0):
            if tuple(w[i:i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def line_runs(docs, least=40):
    """Texts without any run of lines of at least ``least`` words that has occurred at an earlier place."""
    seen, out = set(), {}
    for d, text in docs:
        lines = (text or "").split("\n")
        some = [i for i, x in enumerate(lines) if x]
        cut = set()
        for a in range(len(some)):
            for b in range(a + 1, len(some) + 1):
                key = tuple(lines[i] for i in some[a:b])
                if sum(len(x.encode().split()) for x in key) >= least:
                    if key in seen:
                        cut |= set(some[a:b])
                    seen.add(key)
        out[d] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)
    return out


def greedy(word, first, inner):
    at, count = 0, 0
    while at < len(word):
        pieces = inner if at else first
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in pieces), 0)
        if not size:
            return -1
        at, count = at + size, count + 1
    return count
