"""Plain versions of the operators, written from their definitions."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def repeats(docs, length=400):
    """[(n_bytes, n_removed, n_spans, kept digest)] of every text, by counting all windows."""
    texts = [(t or "").encode() for t in docs]
    count = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, end = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                a = max(i, end)
                gone[a:i + length] = b"\1" * (i + length - a)
                end = i + length
        marks = bytes(gone)
        out.append((len(t), sum(gone), marks.count(b"\0\1") + (marks[:1] == b"\1"), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(UP))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([tuple(w)])


def groups(docs, size, percent):
    """[(n_shingles, smallest linked id)] by comparing all pairs; ids may repeat."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=10):
    words = lambda t: SPLIT.findall((t or "").translate(UP))
    wins = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            wins[tuple(w[i:i + size])].add("null" if k is None else str(k))
    sizes = {len(x) for x in wins}
    out = []
    for t in docs:
        w, hit, found = words(t), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := wins.get(tuple(w[i:i + size]))):
                    hit.update(range(i, i + size))
                    found |= x
        out.append((len(w), len(hit), sorted(found)))
    return out


PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def personal(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 14 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15
    return sorted((m.start(), i, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if holds(k, m[0]))
