from pyspark.sql import functions as F

from lexicarta.operators import corpus as C
from lexicarta.sources import tables as T
from conftest import SF01


def test_first_wins_dedupe_across_labels(spark):
    df = spark.createDataFrame([(1, "same text", 0), (2, "same text", 1), (0, "other", 1)],
                               "doc_id long, text string, label int")
    out = {r["doc_id"]: r["label"] for r in C.dedupe_first(df.repartition(3), ["doc_id"]).collect()}
    assert out == {0: 1, 1: 0}


def test_dedupe_independent_of_partitioning(spark):
    d = T.read_table(spark, SF01, "documents").select("doc_id", "text")
    a = sorted(r["doc_id"] for r in C.dedupe_first(d, ["doc_id"]).collect())
    b = sorted(r["doc_id"] for r in C.dedupe_first(d.repartition(7, "text"), ["doc_id"]).collect())
    assert a == b and len(a) == 927


def test_null_safe_binarise(spark):
    df = spark.createDataFrame([("human",), ("gpt",), (None,)], "source string")
    assert [r["label"] for r in C.binarise(df).collect()] == [0, 1, 1]


def test_flatten_empty_arrays_and_order(spark):
    nested = spark.createDataFrame(
        [(1, 0, "q", "s", ["h1", "h2"], []), (2, 0, "q2", "s", [], None)],
        "item_id long, part int, question string, source string, human_answers array<string>, chatgpt_answers array<string>")
    rows = C.flatten_qa(nested).orderBy("item_id", "label", "part", "idx").collect()
    assert [(r["text"], r["label"], r["idx"]) for r in rows] == [("h1", 0, 0), ("h2", 0, 1)]


def test_domain_filter_rejects_unknown(spark):
    df = spark.createDataFrame([("a",)], "source string")
    import pytest
    with pytest.raises(ValueError):
        C.domain_filter(df, "zzz", ["a", "b"])


def test_length_funnel_counts(spark):
    df = spark.createDataFrame([("x" * 60,), ("short",)], "text string")
    r = C.length_funnel(df, 50).first()
    assert (r["rows_in"], r["rows_kept"], r["rows_dropped"]) == (2, 1, 1)


def test_nested_qa_parts_preserve_turn_order(spark):
    flat = C.flatten_qa(T.nested_qa(spark, SF01, part_size=3))
    full = C.flatten_qa(T.nested_qa(spark, SF01, part_size=10_000))
    w = ["item_id", "label", "part", "idx"]
    a = [(r["item_id"], r["label"], r["text"]) for r in flat.orderBy(*w).collect()]
    b = [(r["item_id"], r["label"], r["text"]) for r in full.orderBy(*w).collect()]
    assert a == b
