"""The packed language model against plain Python, and its disk."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers_llm import docs_frame
from pyspark.sql import functions as F

from lexicarta.llm import common, pitman_yor


def first_state(texts, train, s):
    """Scores with one table per dish, computed one word after the other."""
    tokens = [["<", "<", *t.split(), ""] for t in texts]
    tri = Counter((w[k - 2], w[k - 1], w[k]) for w, use in zip(tokens, train) if use for k in range(2, len(w)))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)
    d2, d1, d0 = (pitman_yor._discount(*(sum(x == k for x in c.values()) for k in (1, 2))) for c in (tri, bi, uni))
    two, one = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (a, b, _), n in tri.items():
        two[a, b][0] += n
        two[a, b][1] += 1
    for (b, _), n in bi.items():
        one[b][0] += n
        one[b][1] += 1

    def p(a, b, c):
        new = (s.word_strength + d0 * len(uni)) / 257 ** (len(c) + 1)
        p = (max(uni[c] - d0, 0) + new) / (s.word_strength + sum(uni.values()))
        p = (max(bi[b, c] - d1, 0) + (s.context_strength + d1 * one[b][1]) * p) / (s.context_strength + one[b][0])
        return (max(tri[a, b, c] - d2, 0) + (s.context_strength + d2 * two[a, b][1]) * p) / (s.context_strength + two[a, b][0])

    out = []
    for w in tokens:
        total, seen = 0.0, Counter()
        for k in range(2, len(w)):
            fresh = (s.document_strength + s.document_discount * len(seen)) * p(w[k - 2], w[k - 1], w[k])
            total += np.log10((max(seen[w[k]] - s.document_discount, 0) + fresh) / (s.document_strength + k - 2))
            seen[w[k]] += w[k] != ""
        out.append(total)
    return out


@pytest.mark.parametrize("split", [False, True])
def test_scores_match_plain_python(spark, monkeypatch, split):
    """Before any sweep; also with many chunks, buckets and owners, and with
    the common preceding words dealt over several buckets."""
    packed = pytest.importorskip("lexicarta.llm.pitman_yor_packed")
    if split:
        for name, value in (("HOT_ROWS", 10), ("CHUNK_BYTES", 300), ("BUCKET_BYTES", 300), ("OWNER_BYTES", 300)):
            monkeypatch.setattr(packed, name, value)
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 12)}" for _ in range(40)) for _ in range(12)] + ["", "zz w1"]
    s = pitman_yor.Settings(burn_in=0, samples=0)
    found = pitman_yor.score(docs_frame(spark, texts), F.col("doc_id") % 4 != 1, s).collect()
    expected = first_state(texts, [i % 4 != 1 for i in range(len(texts))], s)
    assert np.allclose([r.score for r in sorted(found, key=lambda r: r.doc_id)], expected, atol=1e-3)


def test_staged_state_is_smaller_than_twice_the_text(spark, monkeypatch):
    sizes, write = [], common.Staged.write

    def weigh(self, df):
        out = write(self, df)
        root = self.root.replace("file:", "")
        sizes.append(sum(os.path.getsize(f"{top}/{x}") for top, _, names in os.walk(root) for x in names))
        return out

    monkeypatch.setattr(common.Staged, "write", weigh)
    rng = random.Random(5)
    texts = [" ".join(f"word{int(rng.random() ** 3 * 20_000)}" for _ in range(3000)) for _ in range(60)]
    found = pitman_yor.score(docs_frame(spark, texts), F.col("doc_id") % 5 != 1)
    assert found.count() == 60
    assert max(sizes) < 2 * sum(map(len, texts))
