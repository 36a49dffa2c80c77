"""Cases that once gave wrong results: null strata, keys over two files,
pooling over two splits, unseen features, null labels and scores."""

import pytest
from pyspark.sql import functions as F

from lexicarta.operators import linear as L
from lexicarta.operators import metrics as M
from lexicarta.operators import split as S
from lexicarta.operators import vectors as VE
from lexicarta.plans import workflows as W
from lexicarta.sources import files


@pytest.mark.parametrize("method", ["bucket", "window"])
@pytest.mark.parametrize("strata", [("source",), ("label", "source")])
def test_null_strata_keep_the_sizes(spark, method, strata):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"),
                                 F.when(F.col("id") % 4 != 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    out = S.stratified_split(df, strata, test_size=0.2, method=method)
    counts = {(r.source is None, r.split): r.n for r in out.groupBy("source", "split").count().withColumnRenamed("count", "n")
              .groupBy("source", "split").agg(F.sum("n").alias("n")).collect() if r.source is None}
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 80, "test": 20}
    assert counts == {(True, "train"): 20, (True, "test"): 5}


def test_csv_ids_are_unique_and_follow_the_rows(spark, scratch):
    base = f"{scratch}/positions"
    rows = [(f"text {k:02d}" + "\nmore" * (k % 3), k % 2, "s", None, "train" if k < 30 else "test") for k in range(45)]
    df = spark.createDataFrame(rows, "text string, label int, source string, question string, split string").repartitionByRange(7, "text")
    files.write_split_csvs(df, base, "d")
    back = files.read_split_csvs(spark, base, "d").select("doc_id", "text", "split").collect()
    assert sorted(r.doc_id for r in back) == list(range(45))
    assert [r.text for r in sorted(back, key=lambda r: r.doc_id)] == [r[0] for r in rows]


def test_pooling_keeps_the_splits_apart(spark):
    ds = spark.createDataFrame([(0, "a", 0, "s", "train"), (0, "b", 1, "s", "test")],
                               "doc_id long, text string, label int, source string, split string")
    vec = spark.createDataFrame([("a", [1.0]), ("b", [5.0])], "token string, vec array<float>")
    out = {r.split: r.embedding for r in W.extract(ds, "mean_pool", vec, 1).collect()}
    assert out == {"train": [1.0], "test": [5.0]}


def test_pooling_reads_all_tokens_and_masks(spark):
    docs = spark.createDataFrame([(1, "a " * 300 + "b"), (2, "zz zz"), (3, ""), (4, None)], "doc_id long, text string")
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 301.0])], "token string, vec array<float>")
    got = {r.doc_id: r.embedding for r in VE.mean_pool(docs, vec, 2).collect()}
    assert got[1] == [300 / 301, 1.0] and got[2] == got[3] == got[4] == [0.0, 0.0]
    masked = {r.doc_id: r.embedding for r in VE.mean_pool(docs, vec, 2, mask=F.col("token") != "a").collect()}
    assert masked[1] == [0.0, 301.0]


def test_unseen_feature_counts_as_zero(spark):
    model = L.LinearModel("lr", [1.0, 2.0], 0.5, {})
    df = spark.createDataFrame([(1, [0, 7], [1.0, 9.0])], "doc_id long, indices array<int>, values array<double>")
    assert model.transform(df).first().raw == 1.5


def test_null_labels_and_scores_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.1), (1, 1, None), (None, 0, 0.5), (0, None, 0.2), (0, 0, float("nan"))],
                               "label int, prediction int, probability double")
    m = M.classification_metrics(df).first()
    assert (m.n, m.accuracy, m.f1_macro, m.roc_auc) == (4, 1.0, 1.0, 1.0)
    assert M.roc_auc(df.where("prediction is not null")).first().roc_auc == 1.0
    assert tuple(M.excluded_rows(df).first()) == (2, 2)
