import json
import os

import pytest
from pyspark.sql import functions as F

from lexicarta.operators import corpus as C
from lexicarta.operators import metrics as M
from lexicarta.operators import vocab as V
from lexicarta.sources import files
from lexicarta.streaming import clean as SC


def test_split_csv_roundtrip_with_multiline_text(spark, scratch):
    base = f"{scratch}/processed"
    df = spark.createDataFrame([("line one\nline \"two\", more", 1, "s", None, "train"),
                                ("plain", 0, "t", "q?", "test")],
                               "text string, label int, source string, question string, split string")
    files.write_split_csvs(df, base, "hc3")
    back = files.read_split_csvs(spark, base, "hc3")
    got = sorted((r["text"], r["label"], r["split"]) for r in back.collect())
    assert got == [("line one\nline \"two\", more", 1, "train"), ("plain", 0, "test")]
    with pytest.raises(FileNotFoundError):
        files.read_split_csvs(spark, base, "missing")


def test_partitioned_parquet_prunes_split(spark, scratch):
    path = f"{scratch}/ds"
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "test")], "doc_id long, text string, split string")
    files.write_splits(df, path)
    q = files.read_splits(spark, path).where(F.col("split") == "test")
    assert "PartitionFilters: [isnotnull(split" in q._jdf.queryExecution().executedPlan().toString()
    assert [r["doc_id"] for r in q.collect()] == [2]


def test_metrics_json(spark, scratch):
    df = spark.createDataFrame([(0, 0, .1), (1, 1, .9)], "label int, prediction int, probability double")
    files.save_metrics(M.classification_metrics(df), f"{scratch}/m")
    part = [f for f in os.listdir(f"{scratch}/m") if f.endswith(".json")][0]
    row = json.loads(open(f"{scratch}/m/{part}").readline())
    assert row["accuracy"] == 1.0 and row["roc_auc"] == 1.0


def test_stream_clean_and_featurize(spark, scratch):
    src = f"{scratch}/stream_src"
    spark.createDataFrame([(1, "  hello   world URL_3 " + "x" * 60), (2, "short")],
                          "doc_id long, text string").write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    stream = SC.cleaned_stream(spark, src, schema, min_chars=50)
    train = spark.createDataFrame([(1, "hello world"), (2, "hello there")], "doc_id long, text string")
    model = V.TermVectorizer.counts("word", (1, 1), min_df=1, max_df=1.0).fit(train)
    feats = SC.featurize_stream(stream, model)
    q = SC.start_to_parquet(feats, f"{scratch}/stream_out", "featurize_test",
                            checkpoint=f"{scratch}/stream_ckpt")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{scratch}/stream_out").collect()
    assert sorted((r["doc_id"], r["value"]) for r in out) == [(1, 1.0), (1, 1.0)]
    assert C.MIN_CHARS_MULTICLASS == 50


def test_nested_json_and_multiclass_csv_readers(spark, scratch):
    import json as _json
    p = f"{scratch}/hc3.jsonl"
    with open(p, "w") as f:
        f.write(_json.dumps({"question": "q1", "source": "finance", "human_answers": ["a  URL_1 b"],
                             "chatgpt_answers": ["c"]}) + "\n")
        f.write(_json.dumps({"question": "q2", "source": "open_qa", "human_answers": [], "chatgpt_answers": None}) + "\n")
    nested = files.read_nested_qa(spark, p, "json")
    flat = C.flatten_qa(nested).collect()
    assert sorted((r["text"], r["label"]) for r in flat) == [("a  URL_1 b", 0), ("c", 1)]
    raw = f"{scratch}/tb"
    os.makedirs(raw, exist_ok=True)
    for split in ("train", "test"):
        with open(f"{raw}/{split}.csv", "w") as f:
            f.write('Generation,label\n"some text, with comma",human\n"other\ntext",gpt2\n')
    mc = C.prepare_multiclass(files.read_multiclass_raw(spark, raw), min_chars=5)
    assert sorted((r["split"], r["label"]) for r in mc.collect()) == [("test", 0), ("test", 1), ("train", 0), ("train", 1)]
    with pytest.raises(FileNotFoundError):
        files.read_multiclass_raw(spark, f"{scratch}/nothing")


def test_feature_runner_writes_each_kind(spark, scratch):
    from lexicarta.plans import workflows as W
    rows = [(i, f"doc w{i % 7}x about alpha{i % 3} beta{i % 5} gamma", i % 2, "s", "train" if i % 5 else "test")
            for i in range(40)]
    ds = spark.createDataFrame(rows, "doc_id long, text string, label int, source string, split string")
    vec = spark.createDataFrame([("doc", [1.0, 0.0]), ("about", [0.0, 1.0])], "token string, vec array<float>")
    out = W.run_features(spark, ds, ["tfidf", "word_ngram", "char_ngram", "mean_pool"], f"{scratch}/feats",
                         vectors=vec, dim=2)
    for kind, path in out.items():
        back = files.load_features(spark, path)
        assert back.count() == 40, kind
        assert {r["split"] for r in back.select("split").distinct().collect()} == {"train", "test"}
