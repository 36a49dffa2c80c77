"""Composed user-level flows: corpus preparation to a partitioned dataset
and the feature-set runner (X7) that fits each extractor on the training
split and applies it to both splits."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as FX
from ..operators import scoring as SC
from ..operators import vectors as VE
from ..operators import vocab as V
from ..session import staged_table
from ..sources import files

FEATURE_KINDS = ("tfidf", "word_ngram", "char_ngram", "token_vectors", "padded", "mean_pool", "encoder")


def _vectorizer(kind: str) -> V.TermVectorizer:
    if kind == "tfidf":
        return V.TermVectorizer.tfidf()
    if kind == "word_ngram":
        return V.TermVectorizer.counts("word", FX.WORD_NGRAM_RANGE)
    if kind == "char_ngram":
        return V.TermVectorizer.counts("char_wb", FX.CHAR_WB_NGRAM_RANGE)
    raise ValueError(kind)


def extract(dataset: DataFrame, kind: str, vectors: DataFrame | None = None, dim: int | None = None,
            max_len: int = FX.TOKEN_VECTOR_MAX_LEN, encoder: Callable | None = None) -> DataFrame:
    """Features of one kind for a dataset with a ``split`` column; the
    vocabulary is fitted on the train split only (X4).  ``max_len`` cuts the
    token sequences only; pooling reads all tokens.  ``padded`` gives one
    sequence of exactly ``max_len`` vectors per row; ``encoder`` (a factory of
    ``encode(texts) -> array[n, dim]``, see ``scoring.embed_texts``) one vector
    per whole text.  Output keeps ``doc_id``, ``label`` and ``split`` beside
    the features."""
    carry = ["label", "split"]
    if kind == "encoder":
        if encoder is None:
            raise ValueError("encoder needs an encoder factory")
        return SC.embed_texts(dataset.select("doc_id", *carry, "text"), encoder).drop("text")
    if kind in ("tfidf", "word_ngram", "char_ngram"):
        model = _vectorizer(kind).fit(dataset.where(F.col("split") == "train"))
        return model.transform_sparse(dataset, carry=carry)
    if vectors is None or dim is None:
        raise ValueError(f"{kind} needs a vector table and its dimension")
    if kind == "token_vectors":
        return VE.token_vectors(dataset, vectors, dim, max_len, carry=carry)
    if kind == "padded":
        # ids need only be unique inside a split
        ids = F.struct("split", "doc_id")
        keyed = dataset.withColumn("row", ids)
        padded = VE.padded_documents(keyed, vectors, dim, max_len, key="row")
        return keyed.select("row", "label").join(padded, "row").select("row.doc_id", "label", "row.split", "sequence")
    if kind == "mean_pool":
        # ids need only be unique inside a split
        keys = ["doc_id", "split"]
        pooled = VE.mean_pool(dataset, vectors, dim, keys=keys)
        return dataset.select(*keys, "label").join(pooled, keys)
    raise ValueError(f"kind must be one of {FEATURE_KINDS}")


def run_features(spark: SparkSession, dataset: DataFrame, kinds: Iterable[str], out_dir: str,
                 vectors: DataFrame | None = None, dim: int | None = None, encoder: Callable | None = None,
                 max_len: int = FX.TOKEN_VECTOR_MAX_LEN) -> dict[str, str]:
    """Extract every requested kind and write it partitioned by split.
    The prepared dataset is written once as Parquet in the shared folder
    (cut lineage, read in part by all kinds and safe against executor loss)."""
    ds = staged_table(dataset.select("doc_id", "text", "label", "source", "split"), "dataset")
    written = {}
    for kind in kinds:
        path = f"{out_dir.rstrip('/')}/{kind}"
        files.save_features(extract(ds, kind, vectors, dim, max_len, encoder), path)
        written[kind] = path
    return written
