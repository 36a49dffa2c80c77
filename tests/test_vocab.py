import math

import pytest
from pyspark.sql import functions as F

from lexicarta.operators import vocab as V
from lexicarta.plans import registry as R
from conftest import SF01


@pytest.fixture(scope="module")
def split(spark):
    return R.labelled_split(spark, SF01).cache()


def test_vocabulary_from_train_only_and_df_bounds(spark, split):
    train = split.where("split = 'train'")
    m = V.TermVectorizer.tfidf().fit(train)
    n = train.count()
    assert m.n_docs == n
    v = m.vocabulary
    bad = v.where((F.col("df") < 2) | (F.col("df") > 0.95 * n)).count()
    assert bad == 0
    ids = [r["term_idx"] for r in v.orderBy("term").collect()]
    assert ids == list(range(len(ids)))
    # test-only terms never enter the vocabulary
    test_terms = V.term_counts(split.where("split = 'test'"), "word", (1, 2)).select("term").distinct()
    train_terms = V.term_counts(train, "word", (1, 2)).select("term").distinct()
    only_test = test_terms.join(train_terms, "term", "left_anti")
    assert only_test.join(v, "term").count() == 0


def test_tfidf_rows_unit_norm(spark, split):
    m = V.TermVectorizer.tfidf().fit(split.where("split = 'train'"))
    sp = m.transform_sparse(split, carry=["label"])
    norms = sp.select(F.aggregate("values", F.lit(0.0), lambda a, v: a + v * v).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 or r["s"] == 0.0 for r in norms)
    assert sp.count() == split.count()  # documents without terms keep a row


def test_max_features_ties_by_term(spark):
    df = spark.createDataFrame([(1, "bb aa cc dd"), (2, "dd cc bb aa"), (3, "ee ff")], "doc_id long, text string")
    m = V.TermVectorizer.counts("word", (1, 1), max_features=2, min_df=1, max_df=1.0).fit(df)
    assert [r["term"] for r in m.vocabulary.orderBy("term_idx").collect()] == ["aa", "bb"]


def test_empty_vocabulary_and_bad_bounds_raise(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "cc dd")], "doc_id long, text string")
    with pytest.raises(ValueError):
        V.TermVectorizer.counts("word", (1, 1), min_df=2, max_df=1.0).fit(df)
    with pytest.raises(ValueError):
        V.TermVectorizer.counts("word", (1, 1), min_df=5, max_df=0.5).fit(df)


def test_idf_formula_and_save_load(spark, scratch):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "aa bb dd")], "doc_id long, text string")
    m = V.TermVectorizer(analyzer="word", ngram_range=(1, 1), tfidf=True, sublinear_tf=True, norm="l2").fit(df)
    idf = {r["term"]: r["idf"] for r in m.vocabulary.collect()}
    assert abs(idf["aa"] - (math.log(4 / 4) + 1)) < 1e-12
    assert abs(idf["bb"] - (math.log(4 / 3) + 1)) < 1e-12
    m.save(f"{scratch}/vec")
    m2 = V.TermVectorizerModel.load(spark, f"{scratch}/vec")
    a = sorted(tuple(r) for r in m.transform(df).collect())
    b = sorted(tuple(r) for r in m2.transform(df).collect())
    assert a == b
    with pytest.raises(FileNotFoundError):
        V.TermVectorizerModel.load(spark, f"{scratch}/missing")


def test_vocabulary_join_is_broadcast(spark, split):
    m = V.TermVectorizer.tfidf().fit(split.where("split = 'train'"))
    plan = m.transform(split)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_unbounded_vocabulary_ranks_match_sorted_order(spark):
    from lexicarta.sources import tables as T
    from conftest import SF001
    d = T.read_table(spark, SF001, "documents")
    m = V.TermVectorizer.counts("word", (1, 2), max_features=None, min_df=1, max_df=1.0).fit(d)
    rows = m.vocabulary.select("term", "term_idx").collect()
    by_term = [r["term_idx"] for r in sorted(rows, key=lambda r: r["term"].encode("utf-8"))]
    assert by_term == list(range(len(rows)))


def test_top_k_equals_a_plain_ordering(spark):
    from lexicarta.sources import tables as T
    from conftest import SF001
    d = T.read_table(spark, SF001, "documents")
    stats = V.corpus_stats(V.term_counts(d, "word", (1, 2))).collect()
    top = sorted(stats, key=lambda r: (-r["tf"], r["term"].encode("utf-8")))[:700]
    expected = [(r["term"], i, r["tf"]) for i, r in enumerate(sorted(top, key=lambda r: r["term"].encode("utf-8")))]
    got = V.TermVectorizer.counts("word", (1, 2), max_features=700, min_df=1, max_df=1.0).fit(d)
    assert sorted((r["term"], r["term_idx"], r["tf"]) for r in got.vocabulary.collect()) == sorted(expected)
