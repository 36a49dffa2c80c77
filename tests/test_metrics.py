import pytest
from pyspark.sql import functions as F

from lexicarta.operators import metrics as M
from lexicarta.sources import tables as T
from conftest import SF01


def test_auc_ties(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0, 1, 0], [.5, .5, .9, .1, .5, .9])), "label int, probability double")
    a = M.roc_auc(df).first()["roc_auc"]
    assert abs(a - 0.6111111111) < 1e-9
    neg = M.roc_auc(df.withColumn("probability", -F.col("probability"))).first()["roc_auc"]
    assert abs(neg - (1 - a)) < 1e-12


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(1, .2), (1, .3)], "label int, probability double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_zero_division_and_unseen_classes(spark):
    # class 2 never predicted, class 3 predicted but absent from the truth
    rows = [(0, 0), (0, 0), (1, 0), (2, 1), (1, 3)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = M.classification_metrics(df, score=None).first()
    # per class: 0 p=2/3 r=1 f1=.8; 1 p=0 r=0; 2 p=0 r=0; 3 p=0 r=0 f1=0
    assert abs(m["accuracy"] - 0.4) < 1e-12
    assert abs(m["f1_macro"] - 0.8 / 4) < 1e-12
    assert abs(m["f1_weighted"] - 0.8 * 2 / 5) < 1e-12
    assert abs(m["precision_weighted"] - (2 / 3) * 2 / 5) < 1e-12
    cm = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert len(cm) == 16 and cm[(0, 0)] == 2 and cm[(3, 3)] == 0


def test_against_spark_ml_evaluators(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator

    ps = T.prediction_set(spark, SF01).cache()
    m = M.classification_metrics(ps).first()
    d = ps.select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"),
                  F.col("probability").alias("rawPrediction"))
    for ours, name in (("f1_weighted", "weightedFMeasure"), ("precision_weighted", "weightedPrecision"),
                       ("recall_weighted", "weightedRecall"), ("accuracy", "accuracy")):
        ev = MulticlassClassificationEvaluator(metricName=name)
        assert abs(ev.evaluate(d) - m[ours]) < 1e-9, name
    assert abs(m["recall_weighted"] - m["accuracy"]) < 1e-12
    auc = BinaryClassificationEvaluator(numBins=0).evaluate(d)
    assert abs(auc - m["roc_auc"]) < 1e-9


def test_domain_metrics_one_pass_overall(spark):
    ps = T.prediction_set(spark, SF01)
    rep = M.domain_metrics(ps, "source")
    overall = rep.where("scope = 'overall'").first()
    direct = M.classification_metrics(ps).first()
    for c in (*M.METRIC_COLUMNS, "roc_auc"):
        assert abs(overall[c] - direct[c]) < 1e-12
    assert rep.where("scope = 'domain'").count() == 20


def test_results_table_union(spark):
    df = spark.createDataFrame([(0, 0, .1), (1, 1, .8)], "label int, prediction int, probability double")
    t = M.results_table({"a": M.classification_metrics(df), "b": M.classification_metrics(df, score=None)})
    rows = {r["model"]: r for r in t.collect()}
    assert rows["b"]["roc_auc"] is None and rows["a"]["roc_auc"] == 1.0
