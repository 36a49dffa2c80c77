"""Bag-of-n-grams features: term counts, vocabulary fit, TF-IDF.

Fit (on the training split only):

1. terms are counted as packed codes in runs of documents
   (``functions/grams.py``), so (doc, term, tf) rows appear without a shuffle,
   and a fit makes one row per term and run;
2. one aggregate by ``term`` over these gives corpus tf and df;
3. df pruning (``min_df``, ``max_df``), the ``max_features`` most frequent
   terms (ties: term ascending), ids in ascending term order, smoothed IDF;
4. the vocabulary (at most ``max_features`` rows) is checkpointed, which
   cuts the lineage and survives executor loss.

Transform: in-row counts -> inner join with the vocabulary, broadcast
because its size is bounded by ``max_features`` (checked when unbounded)
-> counts, or sublinear TF x IDF with an L2 norm per document.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed as FX
from ..functions import grams as G
from ..functions import text as X
from ..session import materialize
from .joins import join_small

ANALYZERS = ("word", "char", "char_wb")


@dataclass
class VectorizerParams:
    analyzer: str = "word"
    ngram_range: tuple[int, int] = (1, 1)
    min_df: float = 1
    max_df: float = 1.0
    max_features: int | None = None
    tfidf: bool = False
    sublinear_tf: bool = False
    smooth_idf: bool = True
    norm: str | None = None  # "l2" or None
    extra: dict = field(default_factory=dict)


def analyze(df: DataFrame, analyzer: str, ngram_range: Sequence[int], key: str = "doc_id",
            text_col: str = "text", carry: Sequence[str] = (), out: str = "__terms") -> DataFrame:
    """(key, carry.., out: array<string>) of each document's terms,
    lower-cased as the reference's library does by default.  The token
    array / normalised text is projected first, so the n-gram lambdas read
    a column instead of re-running the regex for every n-gram."""
    n1, n2 = int(ngram_range[0]), int(ngram_range[1])
    if analyzer == "word":
        d = df.select(key, *carry, X.word_tokens(F.col(text_col)).alias("__tok"))
        return X.with_ngrams(d, "__tok", n1, n2, out).select(key, *carry, out)
    if analyzer == "char_wb":
        return df.select(key, *carry, X.char_wb_ngrams(F.col(text_col), n1, n2).alias(out))
    if analyzer == "char":
        d = df.select(key, *carry, X.code_points(X.char_text(F.col(text_col))).alias("__cp"))
        return X.with_ngrams(d, "__cp", n1, n2, out, sep="").select(key, *carry, out)
    raise ValueError(f"analyzer must be one of {ANALYZERS}")


def term_counts(df: DataFrame, analyzer: str = "word", ngram_range=(1, 1), key: str = "doc_id",
                text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(key, term, tf) for every term of every document; no shuffle.
    N-grams are counted as packed codes (``functions/grams.py``)."""
    n1, n2 = int(ngram_range[0]), int(ngram_range[1])
    if analyzer == "word":
        return G.word_document_counts(df, n1, n2, [key, *carry], text_col)
    if analyzer in ("char", "char_wb"):
        return G.document_counts(df, analyzer, n1, n2, [key, *carry], text_col)
    raise ValueError(f"analyzer must be one of {ANALYZERS}")


def corpus_stats(tf_rows: DataFrame) -> DataFrame:
    """Per term, total tf and document frequency."""
    return tf_rows.groupBy("term").agg(F.sum("tf").cast("bigint").alias("tf"),
                                       F.count(F.lit(1)).alias("df"))


def _doc_bound(x: float, n_docs: int) -> float:
    return float(x) * n_docs if isinstance(x, float) else float(x)


def fit_vocabulary(df: DataFrame, params: VectorizerParams, key: str = "doc_id", text_col: str = "text",
                   n_docs: int | None = None, checkpoint: bool = True) -> tuple[DataFrame, int]:
    """F4 + D3 + A9: vocabulary (term, term_idx, tf, df, idf) and n_docs."""
    if n_docs is None:
        n_docs = df.count()
    max_doc = _doc_bound(params.max_df, n_docs)
    min_doc = _doc_bound(params.min_df, n_docs)
    if max_doc < min_doc:
        raise ValueError(f"no document frequency lies between {min_doc} and {max_doc}")
    if params.analyzer in ("char", "char_wb"):
        stats = G.corpus_counts(df, params.analyzer, int(params.ngram_range[0]), int(params.ngram_range[1]), text_col)
    else:
        stats = G.word_corpus_counts(df, int(params.ngram_range[0]), int(params.ngram_range[1]), text_col)
    kept = stats.where((F.col("df") >= F.lit(min_doc)) & (F.col("df") <= F.lit(max_doc)))
    k = params.max_features
    if k is not None:
        kept = top_k_terms(materialize(kept), int(k))
    vocab = _rank_terms(kept)
    if params.tfidf:
        n = float(n_docs)
        if params.smooth_idf:
            idf = F.log((F.lit(1.0 + n)) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)
        else:
            idf = F.log(F.lit(n) / F.col("df")) + F.lit(1.0)
        vocab = vocab.withColumn("idf", idf)
    else:
        vocab = vocab.withColumn("idf", F.lit(None).cast("double"))
    vocab = vocab.select("term", "term_idx", "tf", "df", "idf")
    if checkpoint:
        vocab = materialize(vocab)
        if vocab.isEmpty():
            raise ValueError(f"no term is in {min_doc} to {max_doc} documents")
    return vocab, n_docs


def top_k_terms(stats: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` terms by (tf desc, term asc), one plan for every ``k``.

    A histogram of tf values (one row per distinct frequency) gives the
    cut-off frequency T; terms above T are all kept, and only the tie group at
    T is ranked by term (two-level, ``_rank_terms``) to take the remaining
    slots.  No step gathers k rows per task in one place.  ``stats`` is read
    three times: pass a materialised table."""
    hist = stats.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("tf")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("cum", F.sum("n").over(w))
    cut = hist.where(F.col("cum") >= k).orderBy(F.desc("tf")).select("tf", "n", "cum").limit(1).collect()
    if not cut:
        return stats  # fewer than k terms
    t, n_at, cum_at = cut[0]["tf"], cut[0]["n"], cut[0]["cum"]
    need = k - (cum_at - n_at)
    above = stats.where(F.col("tf") > F.lit(t))
    tied = _rank_terms(stats.where(F.col("tf") == F.lit(t))).where(F.col("term_idx") < F.lit(need)).drop("term_idx")
    return above.unionByName(tied)


def rank_by_ranges(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """0-based rank (bigint) of each row in ``order`` without a global window:
    rows are dealt into ranges of about equal size, a rank inside each range
    is shifted by the sizes of the ranges before it (one number per range)."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    at, shifts = 0, []
    for r in sorted(dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()):
        shifts.append((r["__range"], at))
        at += r["n"]
    shift = rows.sparkSession.createDataFrame(shifts, "__range int, __shift bigint")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return (dealt.withColumn("__inside", inside).join(F.broadcast(shift), "__range")
            .withColumn(out, F.col("__shift") + F.col("__inside") - 1).drop("__range", "__shift", "__inside"))


def _rank_terms(kept: DataFrame) -> DataFrame:
    """0-based rank of each term in ascending term order; an int, or an error
    where the terms do not fit one."""
    index = F.col("term_idx")
    fits = F.when(index < F.lit(1 << 31), index.cast("int")).otherwise(
        F.raise_error(F.lit("the terms do not fit an int index; give max_features or a higher min_df")).cast("int"))
    return rank_by_ranges(kept, [F.asc("term")], "term_idx").withColumn("term_idx", fits)


class TermVectorizer:
    """X1-X4 estimator: ``fit(train) -> TermVectorizerModel``.

    ``TermVectorizer.tfidf()`` and ``TermVectorizer.counts(...)`` give the two
    configurations the reference uses.
    """

    def __init__(self, params: VectorizerParams | None = None, **kw):
        self.params = params or VectorizerParams(**kw)
        if self.params.analyzer not in ANALYZERS:
            raise ValueError(f"analyzer must be one of {ANALYZERS}")

    @classmethod
    def tfidf(cls, max_features: int | None = FX.MAX_FEATURES, ngram_range=FX.TFIDF_NGRAM_RANGE,
              max_df: float = FX.MAX_DF, min_df: float = FX.MIN_DF) -> "TermVectorizer":
        return cls(analyzer="word", ngram_range=tuple(ngram_range), min_df=min_df, max_df=max_df,
                   max_features=max_features, tfidf=True, sublinear_tf=True, smooth_idf=True, norm="l2")

    @classmethod
    def counts(cls, analyzer: str = "word", ngram_range=FX.WORD_NGRAM_RANGE,
               max_features: int | None = FX.MAX_FEATURES, min_df: float = FX.MIN_DF,
               max_df: float = FX.MAX_DF) -> "TermVectorizer":
        return cls(analyzer=analyzer, ngram_range=tuple(ngram_range), min_df=min_df, max_df=max_df,
                   max_features=max_features)

    def fit(self, df: DataFrame, key: str = "doc_id", text_col: str = "text") -> "TermVectorizerModel":
        vocab, n_docs = fit_vocabulary(df, self.params, key, text_col)
        return TermVectorizerModel(self.params, vocab, n_docs)


class TermVectorizerModel:
    """Fitted vocabulary; ``transform`` applies it to any documents."""

    def __init__(self, params: VectorizerParams, vocabulary: DataFrame, n_docs: int,
                 vocab_size: int | None = None):
        self.params = params
        self.vocabulary = vocabulary
        self.n_docs = int(n_docs)
        self._size = vocab_size

    @property
    def vocab_size(self) -> int:
        if self._size is None:
            self._size = self.vocabulary.count()
        return self._size

    def _vocab_join(self, rows: DataFrame) -> DataFrame:
        v = self.vocabulary.select("term", "term_idx", "idf")
        return join_small(rows, v, "term", known_rows=self.params.max_features or self.vocab_size)

    def term_rows(self, df: DataFrame, key: str = "doc_id", text_col: str = "text",
                  carry: Sequence[str] = ()) -> DataFrame:
        """(key, carry.., term_idx, tf, idf) for in-vocabulary terms."""
        tf = term_counts(df, self.params.analyzer, self.params.ngram_range, key, text_col, carry)
        return self._vocab_join(tf)

    def _weighted(self, df: DataFrame, key: str, text_col: str, carry: Sequence[str]) -> DataFrame:
        """Long form before normalisation: counts, or (sublinear) tf x idf."""
        rows = self.term_rows(df, key, text_col, carry)
        p = self.params
        if not p.tfidf:
            return rows.select(key, *carry, "term_idx", F.col("tf").cast("double").alias("value"))
        tf = (F.lit(1.0) + F.log(F.col("tf"))) if p.sublinear_tf else F.col("tf").cast("double")
        return rows.select(key, *carry, "term_idx", (tf * F.col("idf")).alias("value"))

    def transform(self, df: DataFrame, key: str = "doc_id", text_col: str = "text",
                  carry: Sequence[str] = ()) -> DataFrame:
        """Long form (key, carry.., term_idx, value).  Documents with no
        vocabulary term have no rows (an all-zero feature row).  Counts and
        un-normalised weights need no shuffle; the L2 norm goes through the
        per-document sparse rows (one shuffle)."""
        if self.params.tfidf and self.params.norm == "l2":
            return to_long(self.transform_sparse(df, key, text_col, carry, keep_empty=False), key, carry)
        return self._weighted(df, key, text_col, carry)

    def transform_sparse(self, df: DataFrame, key: str = "doc_id", text_col: str = "text",
                         carry: Sequence[str] = (), keep_empty: bool = True) -> DataFrame:
        """Sparse-row form (key, carry.., indices array<int>, values
        array<double>) sorted by index; the input of the linear models.
        With ``keep_empty`` a document with no vocabulary term keeps a row
        with empty arrays (its documents are unioned into the same
        aggregation, so there is no extra join)."""
        long = self._weighted(df, key, text_col, carry)
        if keep_empty:
            empty = df.select(key, *carry, F.lit(None).cast("int").alias("term_idx"),
                              F.lit(None).cast("double").alias("value"))
            long = long.unionByName(empty)
        sp = to_sparse_rows(long, key, carry)
        if self.params.tfidf and self.params.norm == "l2":
            sp = l2_normalize(sp)
        return sp

    # ------------------------------------------------------------ persistence
    def save(self, path: str) -> None:
        spark = self.vocabulary.sparkSession
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        meta = asdict(self.params)
        meta["ngram_range"] = list(meta["ngram_range"])
        meta["n_docs"] = self.n_docs
        spark.createDataFrame([(json.dumps(meta),)], "params string").write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TermVectorizerModel":
        try:
            meta = json.loads(spark.read.json(f"{path}/params").first()["params"])
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"Vectorizer not found: {path}") from e
        n_docs = meta.pop("n_docs")
        meta["ngram_range"] = tuple(meta["ngram_range"])
        vocab = spark.read.parquet(f"{path}/vocabulary")
        return cls(VectorizerParams(**meta), vocab, n_docs)


def to_sparse_rows(long: DataFrame, key: str = "doc_id", carry: Sequence[str] = (),
                   idx_col: str = "term_idx", val_col: str = "value") -> DataFrame:
    """Long form -> one row per document with sorted index/value arrays.
    ``collect_list`` is combined map-side, so the shuffle carries each
    document's entries once."""
    entry = F.when(F.col(idx_col).isNotNull(), F.struct(idx_col, val_col))
    g = long.groupBy(key, *carry).agg(F.sort_array(F.collect_list(entry)).alias("__e"))
    return g.select(key, *carry, F.col(f"__e.{idx_col}").alias("indices"), F.col(f"__e.{val_col}").alias("values"))


def to_long(sparse: DataFrame, key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Sparse rows -> long form (key, term_idx, value)."""
    z = F.arrays_zip(F.col("indices").alias("term_idx"), F.col("values").alias("value"))
    return sparse.select(key, *carry, F.inline_outer(z)).where(F.col("term_idx").isNotNull())


def l2_normalize(sparse: DataFrame, values: str = "values") -> DataFrame:
    """A10: divide each row's values by their L2 norm (zero rows stay zero).
    The norm is projected first and passed as an array, so it is computed
    once per row, not once per element inside the lambda."""
    d = sparse.withColumn("__norm", F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)))
    scaled = F.zip_with(F.col(values), F.array_repeat(F.col("__norm"), F.size(values)),
                        lambda v, n: F.when(n > 0, v / n).otherwise(F.lit(0.0)))
    return d.withColumn(values, scaled).drop("__norm")
