import math

import pytest
from pyspark.sql import functions as F

from lexicarta.operators import split as S
from lexicarta.plans import registry as R
from conftest import SF01


def _assign(df, key="doc_id"):
    return {r[key]: r["split"] for r in df.select(key, "split").collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    return R.labelled_prepared(spark, SF01).cache()


def test_bucket_equals_window_and_sizes(spark, corpus):
    n = corpus.count()
    b = _assign(S.stratified_split(corpus, ("label", "source"), method="bucket"))
    w = _assign(S.stratified_split(corpus.repartition(5), ("label", "source"), method="window"))
    assert b == w
    assert len(b) == n
    assert sum(v == "test" for v in b.values()) == math.ceil(0.2 * n)


def test_bucket_with_tiny_buckets_equals_window(spark, corpus):
    # one hex digit -> 16 buckets per stratum, so many boundaries fall mid-bucket
    b = _assign(S.stratified_split(corpus, ("label",), method="bucket", bucket_hex=1, test_size=0.37))
    w = _assign(S.stratified_split(corpus, ("label",), method="window", test_size=0.37))
    assert b == w


def test_per_stratum_allocation_is_largest_remainder(spark, corpus):
    s = S.stratified_split(corpus, ("label", "source"))
    got = {(r["label"], r["source"]): (r["n"], r["n_train"]) for r in
           s.groupBy("label", "source").agg(F.count("*").alias("n"),
                                             F.count_if(F.col("split") == "train").alias("n_train")).collect()}
    n = sum(v[0] for v in got.values())
    n_train = n - math.ceil(0.2 * n)
    base = {k: (c * n_train) // n for k, (c, _) in got.items()}
    rem = {k: (c * n_train) % n for k, (c, _) in got.items()}
    left = n_train - sum(base.values())
    order = sorted(got, key=lambda k: (-rem[k], f"{k[0]}_{k[1]}"))
    expect = {k: base[k] + (1 if i < left else 0) for i, k in enumerate(order)}
    assert {k: v[1] for k, v in got.items()} == expect


def test_singleton_stratum_and_strict(spark):
    df = spark.createDataFrame([(i, i % 3, "a" if i else "solo") for i in range(10)],
                               "doc_id long, label int, source string")
    out = _assign(S.stratified_split(df, ("label", "source")))
    assert len(out) == 10 and sum(v == "test" for v in out.values()) == 2
    with pytest.raises(ValueError):
        S.stratified_split(df, ("label", "source"), strict=True)


def test_subsample_validation_random(spark, corpus):
    assert S.stratified_subsample(corpus, 50).count() == 50
    v = S.validation_split(corpus, 0.1)
    n = corpus.count()
    assert v.where("split = 'val'").count() == math.ceil(0.1 * n)
    r = S.random_split(corpus, 0.2)
    assert r.where("split = 'val'").count() == max(1, int(0.2 * n))
    one = spark.createDataFrame([(1,)], "doc_id long")
    assert S.random_split(one, 0.2).where("split = 'val'").count() == 1


def test_shuffled_rank_is_permutation(spark, corpus):
    r = S.shuffled_rank(corpus)
    ranks = sorted(x["shuffle_rank"] for x in r.select("shuffle_rank").collect())
    assert ranks == list(range(1, corpus.count() + 1))


def test_shuffled_rank_per_group(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "doc_id long, g string")
    r = S.shuffled_rank(df, by=["g"], bucket_hex=1).collect()
    for g in ("a", "b"):
        ranks = sorted(x["shuffle_rank"] for x in r if x["g"] == g)
        assert ranks == list(range(1, len(ranks) + 1))


def test_model_is_saved_and_splits_other_rows_and_streams(spark, corpus, scratch):
    """Fitted rows keep their side wherever the model is applied; a stratum
    that the fit has not seen is split by the overall share."""
    model = S.fit_split(corpus, ("label", "source"))
    want = _assign(S.stratified_split(corpus, ("label", "source"), method="window"))
    assert _assign(model.transform(corpus)) == want
    model.save(f"{scratch}/split_model")
    loaded = S.SplitModel.load(spark, f"{scratch}/split_model")
    assert _assign(loaded.transform(corpus.limit(37))).items() <= want.items()

    new = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit(7).alias("label"), F.lit("unseen").alias("source"))
    share = new.transform(loaded.transform).where("split = 'train'").count() / 10_000
    assert abs(share - 0.8) < 0.02

    source = f"{scratch}/split_stream"
    narrow = corpus.select("doc_id", "label", "source")
    narrow.write.mode("overwrite").parquet(source)
    stream = loaded.transform(spark.readStream.schema(narrow.schema).parquet(source))
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/split_stream_ckpt")
         .option("path", f"{scratch}/split_stream_out").trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert _assign(spark.read.parquet(f"{scratch}/split_stream_out")) == want


def test_fit_reads_no_text(spark):
    """Neither the fit nor a split without text moves the text."""
    narrow = R.labelled_prepared(spark, SF01, keep=R.NARROW)
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert not any("text#" in line for line in plan.splitlines() if "Exchange" in line)
    whole = {r["doc_id"] for r in R.labelled_prepared(spark, SF01).select("doc_id").collect()}
    assert {r["doc_id"] for r in narrow.select("doc_id").collect()} == whole
