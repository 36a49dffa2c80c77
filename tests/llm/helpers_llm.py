"""Plain-Python twins of the operators' definitions, and row builders."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, ids=None, langs=None):
    ids = list(range(len(texts))) if ids is None else ids
    langs = ["en"] * len(texts) if langs is None else langs
    rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = SPACED.findall((text or "").translate(ASCII_LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(rows):
    """{row number: (n_shingles, least id of its component)}."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))]


def repeats(rows, width=50):
    """[(id, words, removed, sha of the kept words)]."""
    words = [SPACED.findall(t or "") for _, t in rows]
    first: dict[tuple, int] = {}
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if i is not None and i < first.get(key, i + 1):
                first[key] = i
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - width + 1):
            if i is not None and first[tuple(w[s:s + width])] < i:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(rows, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[s:s + width])].add(item)
    lengths = sorted({len(k) for k in windows})
    out = []
    for i, text in rows:
        w = ALNUM.findall((text or "").translate(ASCII_LOWER))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s:s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[key]
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(names), sha(",".join(names)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def unigram(rows, train):
    """[(tokens, known, train tokens, base score)]."""
    import math

    tokens = [[*SPACED.findall((t or "").translate(ASCII_LOWER)), None] for _, t in rows]
    c = Counter(w for w_, use in zip(tokens, train) if use for w in w_)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for w in tokens]


def bucket(doc_id, modulus=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def key(row):
    return tuple((x is None, "" if x is None else str(x)) for x in row)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)
