"""Word n-grams counted as packed codes against plain Python windows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexicarta.functions import grams as G
from lexicarta.operators import vocab as V

ODD = ["", None, " ", "a", "Ab ab  AB ab", "x_1 -- x_1, \u00e9t\u00e9 \u6f22\u6f22 x_1", "ab " * 50]


def _plain(text, n1, n2):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(" ".join(words[i: i + n]) for n in range(n1, n2 + 1) for i in range(len(words) - n + 1))


def _frame(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["aa", "bb", "cc", "d"]) for _ in range(rng.randrange(40))) for _ in range(40)]
    df = spark.createDataFrame([(k // 2, f"s{k}", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    return texts, df.repartition(3)


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 2), (2, 3), (1, 5)])
@pytest.mark.parametrize("run", [1 << 18, 8])
def test_counts_match_plain_windows(spark, monkeypatch, n1, n2, run):
    """Repeated ids stay rows of their own."""
    monkeypatch.setattr(G, "RUN_WORDS", run)
    monkeypatch.setattr(G, "CORPUS_WORDS", run)
    texts, df = _frame(spark)
    got = {(r.doc_id, r.source, r.term): r.tf for r in G.word_document_counts(df, n1, n2, ["doc_id", "source"]).collect()}
    expected = {(k // 2, f"s{k}", g): n for k, t in enumerate(texts) for g, n in _plain(t, n1, n2).items()}
    assert got == expected
    total, docs = Counter(), Counter()
    for (_, _, g), n in expected.items():
        total[g] += n
        docs[g] += 1
    assert {r.term: (r.tf, r.df) for r in G.word_corpus_counts(df, n1, n2).collect()} == {g: (total[g], docs[g]) for g in total}


def test_counts_are_made_in_runs(spark):
    """No array of n-grams inside a row, and a fit gets a row per gram and run."""
    _, df = _frame(spark)
    plan = V.term_counts(df, "word", (1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_texts_are_decoded_run_by_run(monkeypatch):
    """Memory follows the run, not the Arrow batch."""
    sizes, plain = [], G._texts

    def decode(column):
        sizes.append(sum(len(t) for t in column.to_pylist()))
        return plain(column)

    monkeypatch.setattr(G, "_texts", decode)
    texts = ["abc " * 25_000] * 40
    assert sum(int(found.tf.sum()) for _, found in G._runs(pa.array(texts), 1, 1, False)) == sum(map(len, texts))
    assert max(sizes) <= 1 << 20
