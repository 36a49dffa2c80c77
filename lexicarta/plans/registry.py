"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, each over the whole driver tables.

Computed columns carry the same names as the DuckDB oracles in
``plans/oracles.py``; doubles that come out of floating-point sums are
rounded to 6 places in both so the comparison is order-insensitive.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as FX
from ..functions import text as X
from ..operators import corpus as C
from ..operators import profile as P
from ..session import ensure_checkpoint_dir, materialize, staged_table
from ..sources import files
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- shared inputs

def _docs_with_url(spark, sf):
    """Documents with a URL placeholder injected (the data has none)."""
    d = T.read_text_table(spark, sf, "documents")
    return d.select("doc_id", "source",
                    F.concat(F.col("text"), F.lit(" URL_"), F.col("doc_id").cast("string"), F.lit(" end")).alias("text"))


#: Columns of a split that need no text.
NARROW = ("doc_id", "label", "source")


def labelled_prepared(spark, sf, keep=None):
    """Labelled corpus -> P1 -> first-wins dedupe -> length >= 50."""
    return C.prepare_labelled(T.labelled_corpus(spark, sf), C.MIN_CHARS_MULTICLASS, keep=keep)


def multiclass_prepared(spark, sf):
    return C.prepare_multiclass(T.multiclass_raw(spark, sf), C.MIN_CHARS_MULTICLASS)


# ---------------------------------------------------------------- text (P*)

@query("clean_text")
def q_clean_text(spark, sf):
    d = _docs_with_url(spark, sf)
    t = X.clean_text("text")
    return d.select("doc_id", t.alias("text"), F.length(t).alias("n_chars"))


@query("clean_text_qa")
def q_clean_text_qa(spark, sf):
    d = _docs_with_url(spark, sf)
    t = X.clean_text_qa("text")
    return d.select("doc_id", t.alias("text"), F.length(t).alias("n_chars"))


@query("binarise_label")
def q_binarise(spark, sf):
    df = C.rename_multiclass(T.multiclass_raw(spark, sf))
    return df.select("doc_id", "pos", "source", "label")


@query("flatten_qa")
def q_flatten(spark, sf):
    return C.flatten_qa(T.nested_qa(spark, sf)).select(
        "item_id", "label", "part", "idx", "source", "question", "text")


@query("min_length_filter")
def q_min_length(spark, sf):
    d = T.read_text_table(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("text"))
    return C.min_length(d, C.MIN_CHARS_MULTICLASS).select("doc_id", F.length("text").alias("n_chars"))


@query("domain_filter")
def q_domain_filter(spark, sf):
    d = T.read_table(spark, sf, "documents").select("doc_id", "source", "lang")
    allowed = [f"src{i}" for i in range(20)]
    return C.domain_filter(d, "src3", allowed)


@query("dedupe_first")
def q_dedupe_first(spark, sf):
    d = T.read_text_table(spark, sf, "documents").select("doc_id", "source", X.clean_text("text").alias("text"))
    out = C.dedupe_first(d, ["doc_id"])
    return out.select("doc_id", "source", F.length("text").alias("n_chars"))


@query("dedupe_labelled")
def q_dedupe_labelled(spark, sf):
    return labelled_prepared(spark, sf).select("doc_id", "label", "source", F.length("text").alias("n_chars"))


@query("dedupe_per_split")
def q_dedupe_per_split(spark, sf):
    return multiclass_prepared(spark, sf).select("doc_id", "pos", "split", "label", "source",
                                                 F.length("text").alias("n_chars"))


@query("split_leakage")
def q_split_leakage(spark, sf):
    d = T.read_text_table(spark, sf, "documents").select("doc_id", X.clean_text("text").alias("text"))
    return C.split_leakage(T.given_splits(d)).select(
        "text_key", "n_train", "n_test", "n_chars")


# ---------------------------------------------------------------- profiles

@query("label_distribution")
def q_label_distribution(spark, sf):
    return P.label_distribution(labelled_prepared(spark, sf, keep=NARROW))


@query("length_stats")
def q_length_stats(spark, sf):
    s = P.length_stats(labelled_prepared(spark, sf), keys=["source"])
    return s.select("source", "n_rows", r6(F.col("avg_chars")).alias("avg_chars"))


@query("null_counts")
def q_null_counts(spark, sf):
    d = T.read_table(spark, sf, "documents")
    lab = T.read_table(spark, sf, "labels")
    return P.null_counts(d.join(lab, "doc_id", "left"))


@query("domain_label_crosstab")
def q_crosstab(spark, sf):
    return P.domain_label_crosstab(labelled_prepared(spark, sf, keep=NARROW))


@query("row_funnel")
def q_row_funnel(spark, sf):
    nested = T.nested_qa(spark, sf)
    position = ["item_id", "label", "part", "idx"]
    flat = C.flatten_qa(nested).withColumn("text", X.clean_text_qa("text"))
    firsts = materialize(C.distinct_texts(flat, position, [*position, "source"]))  # no text, read by every stage
    kept = firsts.where(F.col("n_chars") >= C.MIN_CHARS_QA).withColumn("key", F.concat_ws("-", *position))
    split = S.fit_split(kept, ("label", "source"), key="key", test_size=0.2, seed=42).transform(kept)
    return P.row_funnel(nested.select("item_id").distinct(), firsts, C.MIN_CHARS_QA, split)


@query("head_sample")
def q_head_sample(spark, sf):
    return P.head_sample(T.read_table(spark, sf, "documents"), 3, 200)


# ---------------------------------------------------------------- splits

from ..operators import split as S  # noqa: E402


def labelled_split_model(spark, sf):
    """Cut-offs of the labelled corpus' split, from its narrow columns."""
    return S.fit_split(labelled_prepared(spark, sf, keep=NARROW), ("label", "source"), key="doc_id", test_size=0.2, seed=42)


@query("stratified_split")
def q_stratified_split(spark, sf):
    s = labelled_split_model(spark, sf).transform(labelled_prepared(spark, sf, keep=NARROW))
    return s.select(*NARROW, "split")


@query("stratified_subsample")
def q_stratified_subsample(spark, sf):
    s = S.stratified_subsample(labelled_prepared(spark, sf, keep=NARROW), 100, ("label",), key="doc_id", seed=42)
    return s.select(*NARROW)


@query("validation_split")
def q_validation_split(spark, sf):
    s = labelled_split_model(spark, sf).transform(labelled_prepared(spark, sf, keep=NARROW))
    v = S.validation_split(s.where(F.col("split") == "train").drop("split"), 0.1, ("label",), key="doc_id", seed=42)
    return v.select("doc_id", "label", "split")


@query("random_split")
def q_random_split(spark, sf):
    d = T.read_table(spark, sf, "documents").select("doc_id", "source")
    return S.random_split(d, 0.2, key="doc_id", seed=42).select("doc_id", "split")


@query("shuffled_rank")
def q_shuffled_rank(spark, sf):
    d = T.read_table(spark, sf, "documents").select("doc_id", "source")
    return S.shuffled_rank(d, key="doc_id", seed=42).select("doc_id", "shuffle_rank")


# ---------------------------------------------------------------- tokens, n-grams, vocabulary

from ..operators import vocab as V  # noqa: E402


def labelled_split(spark, sf):
    """Prepared corpus with its stratified split, written once as Parquet:
    every feature / model flow reads parts of it several times."""
    return staged_table(labelled_split_model(spark, sf).transform(labelled_prepared(spark, sf)), "labelled-split")


def _train_test(spark, sf):
    s = labelled_split(spark, sf)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@query("whitespace_tokens")
def q_whitespace_tokens(spark, sf):
    d = T.read_text_table(spark, sf, "documents")
    return X.explode_tokens(d, "doc_id", X.whitespace_tokens("text"))


@query("word_tokens")
def q_word_tokens(spark, sf):
    d = T.read_text_table(spark, sf, "documents")
    return X.explode_tokens(d, "doc_id", X.word_tokens("text"))


@query("word_ngrams")
def q_word_ngrams(spark, sf):
    return V.term_counts(T.read_text_table(spark, sf, "documents"), "word", (1, 3))


@query("char_wb_ngrams")
def q_char_wb_ngrams(spark, sf):
    return V.term_counts(T.read_text_table(spark, sf, "documents"), "char_wb", (2, 4))


@query("char_ngrams")
def q_char_ngrams(spark, sf):
    return V.term_counts(T.read_text_table(spark, sf, "documents"), "char", (2, 4))


@query("term_counts")
def q_term_counts(spark, sf):
    return V.term_counts(T.read_text_table(spark, sf, "documents"), "word", (1, 2))


def _tfidf_model(spark, sf):
    train, test = _train_test(spark, sf)
    return V.TermVectorizer.tfidf().fit(train), train, test


@query("vocabulary")
def q_vocabulary(spark, sf):
    m, _, _ = _tfidf_model(spark, sf)
    return m.vocabulary.select("term", "term_idx", "tf", "df")


@query("vocabulary_top_k")
def q_vocabulary_top_k(spark, sf):
    d = T.read_text_table(spark, sf, "documents")
    m = V.TermVectorizer.counts("word", (1, 2), 5_000, 2, 0.95).fit(d)
    return m.vocabulary.select("term", "term_idx", "tf", "df")


@query("idf")
def q_idf(spark, sf):
    m, _, _ = _tfidf_model(spark, sf)
    return m.vocabulary.select("term_idx", r6(F.col("idf")).alias("idf"))


@query("tfidf")
def q_tfidf(spark, sf):
    m, train, _ = _tfidf_model(spark, sf)
    return m.transform(train).select("doc_id", "term_idx", r6(F.col("value")).alias("value"))


@query("apply_vocabulary")
def q_apply_vocabulary(spark, sf):
    m, _, test = _tfidf_model(spark, sf)
    return m.transform(test).select("doc_id", "term_idx", r6(F.col("value")).alias("value"))


@query("ngram_count_features")
def q_ngram_count_features(spark, sf):
    train, test = _train_test(spark, sf)
    m = V.TermVectorizer.counts("word", FX.WORD_NGRAM_RANGE).fit(train)
    return m.transform(test).select("doc_id", "term_idx", "value")


@query("charwb_count_features")
def q_charwb_count_features(spark, sf):
    train, test = _train_test(spark, sf)
    m = V.TermVectorizer.counts("char_wb", FX.CHAR_WB_NGRAM_RANGE).fit(train)
    return m.transform(test).select("doc_id", "term_idx", "value")


# ---------------------------------------------------------------- metrics

from ..operators import metrics as M  # noqa: E402

_MCOLS = list(M.METRIC_COLUMNS)


def _r6_all(df, cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(T.prediction_set(spark, sf))


@query("classification_metrics")
def q_classification_metrics(spark, sf):
    m = M.classification_metrics(T.prediction_set(spark, sf))
    return _r6_all(m, _MCOLS + ["roc_auc"])


@query("roc_auc")
def q_roc_auc(spark, sf):
    a = M.roc_auc(T.prediction_set(spark, sf), ["source"])
    return a.select("source", r6(F.col("roc_auc")).alias("roc_auc"))


@query("domain_metrics")
def q_domain_metrics(spark, sf):
    m = M.domain_metrics(T.prediction_set(spark, sf), "source", include_overall=False)
    return _r6_all(m, _MCOLS + ["roc_auc"])


@query("metrics_report")
def q_metrics_report(spark, sf):
    m = M.domain_metrics(T.prediction_set(spark, sf), "source", include_overall=True)
    return _r6_all(m, _MCOLS + ["roc_auc"])


@query("results_table")
def q_results_table(spark, sf):
    ps = T.prediction_set(spark, sf)
    a = M.classification_metrics(ps)
    b = M.classification_metrics(ps.withColumn("prediction", (F.col("probability") >= 0.5).cast("int")), score=None)
    t = M.results_table({"parity_rule": a, "threshold_rule": b})
    return _r6_all(t.select("model", "n", *_MCOLS, "roc_auc"), _MCOLS + ["roc_auc"])


# ---------------------------------------------------------------- linear models

from ..operators import linear as L  # noqa: E402

LIN_EPOCHS, LIN_LR = FX.EPOCHS_SCRIPT_DEFAULT, FX.LEARNING_RATE


def _dense(spark, sf):
    return T.dense_features(spark, sf)


def _fit_dense(spark, sf, kind):
    return L.fit_linear(kind, _dense(spark, sf), LIN_EPOCHS, LIN_LR, dense_col="features")


def _weights(spark, m):
    return m.weights_frame(spark).select("idx", r6(F.col("weight")).alias("weight"))


def _hist(spark, m):
    return m.history(spark).select("epoch", r6(F.col("loss")).alias("loss"), r6(F.col("accuracy")).alias("accuracy"))


@query("lr_fit")
def q_lr_fit(spark, sf):
    return _weights(spark, _fit_dense(spark, sf, "lr"))


@query("lr_history")
def q_lr_history(spark, sf):
    return _hist(spark, _fit_dense(spark, sf, "lr"))


@query("lr_predict")
def q_lr_predict(spark, sf):
    m = _fit_dense(spark, sf, "lr")
    p = m.transform(_dense(spark, sf), dense_col="features")
    return p.select("doc_id", r6(F.col("probability")).alias("probability"), "prediction")


@query("svm_fit")
def q_svm_fit(spark, sf):
    return _weights(spark, _fit_dense(spark, sf, "svm"))


@query("svm_history")
def q_svm_history(spark, sf):
    return _hist(spark, _fit_dense(spark, sf, "svm"))


@query("svm_predict")
def q_svm_predict(spark, sf):
    m = _fit_dense(spark, sf, "svm")
    p = m.transform(_dense(spark, sf), dense_col="features")
    return p.select("doc_id", r6(F.col("raw")).alias("raw"), "prediction")


@query("lr_tfidf_predict")
def q_lr_tfidf_predict(spark, sf):
    vec, train, test = _tfidf_model(spark, sf)
    x_train = vec.transform_sparse(train, carry=["label"])
    m = L.fit_linear("lr", x_train, LIN_EPOCHS, LIN_LR, n_features=vec.vocab_size)
    p = m.transform(vec.transform_sparse(test, carry=["label"]))
    return p.select("doc_id", "label", r6(F.col("probability")).alias("probability"), "prediction")


def _evaluate_tfidf(spark, sf, kind):
    """Fit on the train split, score the test split, then all metrics."""
    vec, train, test = _tfidf_model(spark, sf)
    m = L.fit_linear(kind, vec.transform_sparse(train, carry=["label"]), LIN_EPOCHS, LIN_LR, n_features=vec.vocab_size)
    p = m.transform(vec.transform_sparse(test, carry=["label", "source"]))
    # equal margins must tie in the ranking, whatever the order of summation
    p = materialize(p.select("label", "source", "prediction", F.round("raw", 9).alias("score")))
    return _r6_all(M.domain_metrics(p, "source", score="score"), _MCOLS + ["roc_auc"])


@query("lr_tfidf_evaluate")
def q_lr_tfidf_evaluate(spark, sf):
    return _evaluate_tfidf(spark, sf, "lr")


@query("svm_tfidf_evaluate")
def q_svm_tfidf_evaluate(spark, sf):
    return _evaluate_tfidf(spark, sf, "svm")


@query("null_source_split")
def q_null_source_split(spark, sf):
    """Every fourth source taken away: rows with a null stratum keep the rule."""
    d = T.read_table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"))
    s = S.stratified_split(d, ("lang", "source"), key="doc_id", test_size=0.2, seed=42)
    return s.select("doc_id", "source", "split")


# ---------------------------------------------------------------- token vectors

from ..operators import scoring as SC  # noqa: E402
from ..operators import vectors as VE  # noqa: E402

VEC_DIM, MAX_LEN = 64, FX.TOKEN_VECTOR_MAX_LEN


def _vector_table(spark, sf):
    return VE.vector_table_from_corpus(T.read_text_table(spark, sf, "documents"), T.read_table(spark, sf, "embeddings"))


def _token_vectors(spark, sf, docs=None):
    docs = docs if docs is not None else T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    return VE.token_vectors(docs, _vector_table(spark, sf), VEC_DIM, MAX_LEN)


def _vsum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))


@query("vector_table")
def q_vector_table(spark, sf):
    return _vector_table(spark, sf).select("token", "rank", "n_occ")


@query("token_vectors")
def q_token_vectors(spark, sf):
    tv = _token_vectors(spark, sf)
    return tv.select("doc_id", "pos", "token", "in_vocab", r6(_vsum(F.col("vec"))).alias("vec_sum"))


@query("padded_sequence")
def q_padded_sequence(spark, sf):
    docs = T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    ps = VE.padded_documents(docs, _vector_table(spark, sf), VEC_DIM, MAX_LEN)
    total = F.aggregate(F.col("sequence"), F.lit(0.0), lambda a, v: a + _vsum(v))
    return ps.select("doc_id", F.size("sequence").alias("seq_len"), r6(total).alias("total"))


@query("mean_pool")
def q_mean_pool(spark, sf):
    """All tokens of every document; documents without tokens give zeros."""
    docs = T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    m = VE.mean_pool_long(VE.mean_pool(docs, _vector_table(spark, sf), VEC_DIM))
    return m.select("doc_id", "dim", r6(F.col("value")).alias("value"))


@query("mean_pool_masked")
def q_mean_pool_masked(spark, sf):
    """Only tokens of two letters or more count."""
    docs = T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    m = VE.mean_pool(docs, _vector_table(spark, sf), VEC_DIM, mask=F.length("token") > 1)
    return VE.mean_pool_long(m).select("doc_id", "dim", r6(F.col("value")).alias("value"))


# ---------------------------------------------------------------- scoring

@query("softmax_argmax")
def q_softmax_argmax(spark, sf):
    """Whole vectors as logits; odd rows twice over, so that every maximum ties."""
    twice = F.when(F.col("vec_id") % 2 == 1, F.concat("embedding", "embedding")).otherwise(F.col("embedding"))
    s = SC.with_softmax(T.read_table(spark, sf, "embeddings").select("vec_id", twice.alias("logits")), "logits")
    p = F.col("probabilities")
    return s.select("vec_id", F.size(p).alias("n_classes"), r6(p[0]).alias("p_first"), r6(F.element_at(p, -1)).alias("p_last"),
                    r6(F.array_max(p)).alias("p_max"), "prediction")


@query("batch_score")
def q_batch_score(spark, sf):
    e = T.read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    s = SC.batch_score(e, SC.half_sum_model(VEC_DIM), "embedding", VEC_DIM, batch_size=32)
    return s.select("vec_id", r6(F.col("probabilities")[1]).alias("p1"), "prediction")


NETWORK_EPOCHS, NETWORK_LR = 3, 0.5


@query("mlp_baseline")
def q_mlp_baseline(spark, sf):
    """A network trained on the pooled vectors of the labelled documents,
    from start weights given by a rule; every document scored."""
    docs = T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    pooled = materialize(VE.mean_pool(docs, _vector_table(spark, sf), VEC_DIM))
    labels = T.read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    hidden, out, _ = SC.train_network(pooled.join(labels, "doc_id"), "embedding", "label", *SC.example_mlp_weights(VEC_DIM), NETWORK_EPOCHS, NETWORK_LR)
    s = SC.batch_score(pooled, SC.mlp_model(hidden, out), "embedding", VEC_DIM, batch_size=512)
    return s.select("doc_id", r6(F.col("probabilities")[1]).alias("p1"))


# ---------------------------------------------------------------- diagnostics

from ..operators import diagnostics as D  # noqa: E402


@query("probability_histogram")
def q_probability_histogram(spark, sf):
    h = D.probability_histogram(T.prediction_set(spark, sf), "label", "probability", 20)
    return h.select("label", "bin", r6(F.col("bin_lo")).alias("bin_lo"), r6(F.col("bin_hi")).alias("bin_hi"), "n")


@query("box_stats")
def q_box_stats(spark, sf):
    b = D.box_stats(T.prediction_set(spark, sf), "label", "probability")
    cols = ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]
    return b.select("label", *[r6(F.col(c)).alias(c) for c in cols], "n_outliers")


@query("training_curves")
def q_training_curves(spark, sf):
    m = _fit_dense(spark, sf, "lr")
    c = D.training_curves(m.history(spark))
    return c.select("epoch", "series", r6(F.col("value")).alias("value"))


def _history(spark, sf):
    """Epoch history derived from the documents: one run per source,
    epochs in doc_id order, metric = (n_chars % 1000) / 1000."""
    d = T.read_table(spark, sf, "documents")
    return d.select(F.col("source").alias("run"), F.col("doc_id").alias("epoch"),
                    ((F.col("n_chars") % 1000).cast("double") / F.lit(1000.0)).alias("val_f1"))


@query("best_epoch")
def q_best_epoch(spark, sf):
    return D.best_and_stop(_history(spark, sf), patience=2).select("run", "epoch", "val_f1", "is_best")


@query("early_stop")
def q_early_stop(spark, sf):
    return D.best_and_stop(_history(spark, sf), patience=2).select("run", "epoch", "n_no_improve", "ran")


@query("run_summary")
def q_run_summary(spark, sf):
    s = D.run_summary(D.best_and_stop(_history(spark, sf), patience=2))
    return s.select("run", "best_epoch", r6(F.col("best_metric")).alias("best_metric"), "stop_epoch", "n_epochs_run")


# ---------------------------------------------------------------- datasets

from . import catalog as CAT  # noqa: E402


@query("qa_split")
def q_qa_split(spark, sf):
    return CAT.qa_dataset(spark, sf).select("item_id", "label", "part", "idx", "source", "split")


@query("combined_union")
def q_combined_union(spark, sf):
    c = CAT.combined_dataset(spark, sf)
    return c.select("corpus", "item_id", "part", "idx", "doc_id", "pos", "label", "source", "split",
                    F.length("text").alias("n_chars"), F.col("question").isNotNull().alias("has_question"),
                    "shuffle_rank")


@query("corpus_summary")
def q_corpus_summary(spark, sf):
    tagged = C.combine({n: CAT.load_dataset(spark, sf, n, register=False) for n in CAT.DATASETS if n != CAT.UNION})
    tagged = tagged.withColumnRenamed("corpus", "dataset")
    s = P.corpus_summary(tagged, ("dataset", "split"), union=CAT.UNION)
    return s.select("dataset", "split", "n_rows", "n_label0", "n_label1", r6(F.col("avg_chars")).alias("avg_chars"),
                    "n_null_text")


@query("text_encoder")
def q_text_encoder(spark, sf):
    d = T.read_text_table(spark, sf, "documents").select("doc_id", "text")
    e = SC.embed_texts(d, SC.count_encoder(), "text", batch_size=64)
    return e.select("doc_id", F.col("embedding")[0].alias("n_chars"), F.col("embedding")[1].alias("n_spaces"))


# ---------------------------------------------------------------- files and datasets

def _scratch_path(spark, name):
    """A fresh folder name in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("split_csv_records")
def q_split_csv_records(spark, sf):
    """The multi-class corpus written as the reference's two CSVs and read
    again by splits; positions are the ids."""
    base = _scratch_path(spark, "split-csvs")
    files.write_split_csvs(C.rename_multiclass(T.multiclass_raw(spark, sf)), base, "turingbench", order=("doc_id", "pos"))
    return files.read_split_csvs(spark, base, "turingbench").select("doc_id", "split", "label", "source", "text")


@query("dataset_domain")
def q_dataset_domain(spark, sf):
    df = CAT.load_dataset(spark, sf, "hc3", register=False, domain="conv3", domains=[f"conv{i}" for i in range(5)])
    return df.select("item_id", "label", "part", "idx", "source", "split")


@query("load_summary")
def q_load_summary(spark, sf):
    """Every fourth source taken away, so that a column has nulls."""
    df = CAT.load_dataset(spark, sf, "turingbench", register=False)
    df = df.select("text", "label", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), "split")
    return P.load_summary(df).select("split", "measure", r6("value").alias("value"))


@query("vector_table_file")
def q_vector_table_file(spark, sf):
    """The vector table written as text lines and read again."""
    path = _scratch_path(spark, "vectors")
    files.write_vector_table(_vector_table(spark, sf), path)
    v = files.read_vector_table(spark, path, VEC_DIM)
    return v.select("token", F.posexplode("vec").alias("dim", "value")).select(
        "token", F.col("dim").cast("int").alias("dim"), r6(F.col("value").cast("double")).alias("value"))
