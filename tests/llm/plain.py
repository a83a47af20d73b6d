"""Slow, plain versions of operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict


def ppm_scores(train, texts, order, alphabet=257):
    """log10 probability of each text under a trie of full counts, symbol by symbol."""
    start, end = 257, 256
    nodes = defaultdict(Counter)

    def steps(text):
        symbols = [start] * order + list(text) + [end]
        return [(symbols, i) for i in range(order, len(symbols))]

    for text in train:
        for symbols, i in steps(text):
            for k in range(order + 1):
                nodes[tuple(symbols[i - k : i])][symbols[i]] += 1
    out = []
    for text in texts:
        total = 0.0
        for symbols, i in steps(text):
            gone = set()
            for k in range(order, -1, -1):
                seen = nodes.get(tuple(symbols[i - k : i]))
                if not seen:
                    continue
                left = {s: n for s, n in seen.items() if s not in gone}
                whole = sum(left.values()) + len(left)
                if symbols[i] in left:
                    total += math.log10(left[symbols[i]] / whole)
                    break
                if left:
                    total += math.log10(len(left) / whole)
                gone |= set(left)
            else:
                total += -math.log10(alphabet - len(gone))
        out.append(total)
    return out


def word_scores(train, texts):
    """(tokens, known, training tokens, smoothed log10 score) of each text."""
    def cut(text):
        return re.findall(rb"[^\x20\x09-\x0D]+", text.lower()) + [None]

    c = Counter(w for t in train for w in cut(t))
    n, v = sum(c.values()), len(c)
    return [
        (len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in map(cut, texts)
    ]


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def base_spans(text):
    """The base patterns as they are written, one after the other."""
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0

    def digits(s):
        return re.sub("[^0-9]", "", s)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, valid in kinds for m in re.finditer(p, text) if valid(m.group())]


def shingles(text, size=5):
    """Distinct shingles of a UTF-8 text."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_groups(rows, percent, size=5):
    """(doc_id, shingles, smallest doc_id of the component, kept); rows: (doc_id, UTF-8 text), ids may be null."""
    sets = [shingles(t, size) for _, t in rows]
    comp = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        smallest = (min(ids) if ids else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), smallest, doc_id is not None and doc_id == smallest))
    return sorted(out, key=repr)


def exact_groups(rows):
    """(doc_id, keep_id, group size, kept); rows: (doc_id, UTF-8 text); of repeated rows one is kept."""
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(rb"[\x20\x09-\x0D]+", b" ", text)].append((doc_id is None, doc_id, i))
    out = []
    for members in groups.values():
        first = min(members, key=lambda m: (m[0], m[1] or 0, m[2]))
        out += [(m[1], first[1], len(members), m is first) for m in members]
    return sorted(out, key=repr)
