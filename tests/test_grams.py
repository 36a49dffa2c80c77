"""Packed character n-grams against plain Python windows."""

import random
from collections import Counter

import pytest

from lexicarta.functions import grams as G


def _plain(text, analyzer, n1, n2):
    import re

    text = (text or "").lower()
    if analyzer == "char":
        parts = [re.sub(r"\s\s+", " ", text)]
    else:
        parts = [f" {w} " for w in text.split()]
    out = Counter()
    for p in parts:
        if analyzer == "char_wb" and len(p) < n1:
            out[p] += 1
        for n in range(n1, n2 + 1):
            out.update(p[i: i + n] for i in range(len(p) - n + 1))
    return out


ODD = ["", None, " ", "a", "a b", "  ab \n\t c ", "\u00e9\u6f22\U0001F600 \U0001F600\U0001F601x", "\x00a\x00 \x00", "aaaa aaaa", "x" * 90]


@pytest.mark.parametrize("analyzer", ["char", "char_wb"])
@pytest.mark.parametrize("n1, n2", [(2, 4), (1, 1), (1, 3), (4, 5), (3, 12)])
@pytest.mark.parametrize("run", [1 << 20, 16])
def test_counts_match_plain_windows(spark, monkeypatch, analyzer, n1, n2, run):
    """Small runs cut long texts into pieces; twelve characters fit no code."""
    monkeypatch.setattr(G, "RUN", run)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeAB \n\u00df\u6f22\U0001F600") for _ in range(rng.randrange(80))) for _ in range(40)]
    df = spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").repartition(3)
    got = {}
    for r in G.document_counts(df, analyzer, n1, n2, ["doc_id", "source"]).collect():
        assert r.source == f"s{r.doc_id}" and (r.doc_id, r.term) not in got
        got[r.doc_id, r.term] = r.tf
    expected = {(k, g): n for k, t in enumerate(texts) for g, n in _plain(t, analyzer, n1, n2).items()}
    assert got == expected
    total, docs = Counter(), Counter()
    for (_, g), n in expected.items():
        total[g] += n
        docs[g] += 1
    assert {r.term: (r.tf, r.df) for r in G.corpus_counts(df, analyzer, n1, n2).collect()} == {g: (total[g], docs[g]) for g in total}
