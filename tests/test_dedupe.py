"""First-wins dedupe on fixed-width keys against a plain Python version, by
the broadcast table and by the bitmap."""

import random

import pytest

from lexicarta.operators import corpus as C
from lexicarta.operators import joins as J

SCHEMA = "doc_id long, pos int, part int, split string, text string"


def corpus_rows(n=600):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        text = rnd.choice([None, "", "hot", "hot", *[f"text {k}" for k in range(200)]])
        rows.append((rnd.choice([i, i, -i, None]), rnd.choice([0, 1, None]), rnd.randrange(-3, 3), rnd.choice(["train", "test", None]), text))
    return rows + rows[:40]  # repeated rows


def plain(rows, order, scope):
    """Least row per text: nulls come first."""
    at = {c: i for i, c in enumerate(("doc_id", "pos", "part", "split", "text"))}
    key = lambda r: [(r[at[c]] is not None, r[at[c]] if r[at[c]] is not None else 0) for c in order]
    best = {}
    for r in rows:
        k = (r[4], *[r[at[c]] for c in scope])
        if k not in best or key(r) < key(best[k]):
            best[k] = r
    return {k: key(r) for k, r in best.items()}


@pytest.mark.parametrize("bound", [J.MAX_BROADCAST_BYTES, 0])
@pytest.mark.parametrize("order,scope", [(["doc_id"], []), (["doc_id", "pos", "part"], ["split"]), (["pos", "part", "doc_id"], []), (["split", "doc_id"], [])])
def test_first_rows_win(spark, monkeypatch, bound, order, scope):
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", bound)
    rows = corpus_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = C.dedupe_first(df, order, scope=scope)
    assert out.columns == df.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows)
    expected = plain(rows, order, scope)
    assert len(got) == len(expected) and plain(got, order, scope) == expected


def test_empty_and_distinct_tables(spark):
    assert C.dedupe_first(spark.createDataFrame([], SCHEMA), ["doc_id"]).collect() == []
    rows = [(i, 0, 0, "train", f"text {i}") for i in range(20)]
    assert sorted(map(tuple, C.dedupe_first(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect())) == rows


def test_texts_are_not_sorted(spark):
    rows = [(i, 0, 0, "train", f"text {i % 7}") for i in range(20)]
    plan = C.dedupe_first(spark.createDataFrame(rows, SCHEMA), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort" not in plan and "hashpartitioning" not in plan


def test_winners_come_from_hash_aggregates(spark, monkeypatch):
    plans = []
    keep = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    C.dedupe_first(spark.createDataFrame(corpus_rows(), SCHEMA), ["doc_id", "pos", "part"], scope=["split"])
    assert "HashAggregate" in plans[0] and "SortAggregate" not in plans[0] and "ObjectHashAggregate" not in plans[0]
