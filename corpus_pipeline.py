"""Corpus pipeline: language ID, near-duplicate removal, substring removal,
benchmark decontamination and packing of ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept and returns a DataFrame, which is written as Parquet and read again for
the next.  All but the last return the columns of ``documents``; packing
returns one row per packed piece.

Defined cases are those of the operators: rows without a text or a letter go
at the first stage; repeated rows of one id and text become one document at
the second; a document whose words all were repeated keeps its row with an
empty text; empty tables stay empty; further columns of ``documents``,
whatever their names, are carried along with their values (``n_chars`` is
counted again at the third stage).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicarta.llm import langid, ngram_join, packing, phrase_dedup, winnow
from lexicarta.llm.common import Staged
from lexicarta.llm.queries import read, tokenizer_path


def carried(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the ``used`` ones under generated names,
    so that no operator's working column meets one of the caller's, and the
    way back to the caller's columns."""
    names = {c: c if c in used else f"carried_{i}" for i, c in enumerate(docs.columns)}
    back = lambda df: df.select(*[F.col(new).alias(old) for old, new in names.items()])
    return docs.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()]), back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letters, or no language clearly ahead."""
    docs, back = carried(docs, "doc_id", "text", "lang")
    model = langid.fit(docs, F.lit(True))
    return back(langid.predict(docs, model, keep=True).where(~F.col("rejected")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the least id."""
    docs, back = carried(docs, "doc_id", "text")
    return back(ngram_join.keep_one(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a document with a smaller id has go."""
    kind = docs.schema["n_chars"].dataType
    docs, back = carried(docs, "doc_id", "text")
    kept = back(phrase_dedup.remove_repeats(docs))
    return kept.withColumn("n_chars", F.length("text").cast(kind))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    docs, back = carried(docs, "doc_id", "text")
    return back(winnow.clean_documents(docs, read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Compression sizes and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    staged = Staged(spark)
    steps = [partial(stage, spark, sf_dir=sf_dir) for _, stage in STAGES]
    docs = read(spark, sf_dir, "documents")
    for step in steps:
        docs = staged.write(step(docs))
    return docs
