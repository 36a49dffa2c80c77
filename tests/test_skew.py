"""Hot groups: one text repeated thousands of times, one stratum holding
most rows, one run holding most epochs -- results stay exact."""

from pyspark.sql import functions as F

from lexicarta.operators import corpus as C
from lexicarta.operators import diagnostics as D
from lexicarta.operators import metrics as M
from lexicarta.operators import split as S


def test_hot_duplicate_text_first_wins(spark):
    rows = [(i, "hot text" if i % 10 else f"text {i}", i % 2) for i in range(5000, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(16)
    out = {r["text"]: r["doc_id"] for r in C.dedupe_first(df, ["doc_id"]).collect()}
    assert out["hot text"] == 1 and len(out) == 501


def test_dominant_stratum_split_is_exact(spark):
    rows = [(i, 0 if i % 50 else 1, "big" if i % 7 else f"s{i % 3}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, label int, source string").repartition(9)
    b = {r["doc_id"]: r["split"] for r in S.stratified_split(df, ("label", "source"), bucket_hex=2).collect()}
    w = {r["doc_id"]: r["split"] for r in S.stratified_split(df, ("label", "source"), method="window").collect()}
    assert b == w and sum(v == "test" for v in b.values()) == 1200


def test_dominant_domain_auc_equals_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rows = [(i % 2 if i % 3 else 1, (i * 7919 % 1000) / 1000.0, "hot" if i % 9 else "cold") for i in range(9000)]
    df = spark.createDataFrame(rows, "label int, probability double, source string")
    ours = {r["source"]: r["roc_auc"] for r in M.roc_auc(df, ["source"]).collect()}
    ev = BinaryClassificationEvaluator(numBins=0, rawPredictionCol="probability")
    hot = df.where("source = 'hot'").withColumn("label", F.col("label").cast("double"))
    assert abs(ours["hot"] - ev.evaluate(hot)) < 1e-12


def test_long_run_scans_match_plain_windows(spark):
    vals = [((i * 37) % 101) / 100.0 for i in range(3000)]
    df = spark.createDataFrame([("long", i, v) for i, v in enumerate(vals)], "run string, epoch int, val_f1 double")
    m = {r["epoch"]: r for r in D.best_and_stop(df, patience=3).collect()}
    best, no_imp, stop = -1.0, 0, None
    for e, v in enumerate(vals):
        is_best = v > best
        if is_best:
            best, no_imp = v, 0
        else:
            no_imp += 1
        assert m[e]["is_best"] == is_best
        if stop is None and no_imp >= 3:
            stop = e
    assert all(m[e]["ran"] == (e <= stop) for e in m)
