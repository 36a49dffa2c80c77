"""Explicit schemas and shared constants (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixed import HUMAN_LABEL  # noqa: F401  (re-exported)

# Flat labelled corpus (the reference's processed split).
LABELLED = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("question", T.StringType(), True),
])

# Processed split as CSV on disk: text, label, source[, question].
SPLIT_CSV = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("question", T.StringType(), True),
])

# Raw multi-class corpus: generated text and generator name ("human" = human).
MULTICLASS_RAW = T.StructType([
    T.StructField("Generation", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
])

# Nested Q&A corpus.  ``part`` numbers bounded slices of one item's answers
# (0 for a source that keeps every answer of an item in one record).
NESTED_QA = T.StructType([
    T.StructField("item_id", T.LongType(), False),
    T.StructField("part", T.IntegerType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("human_answers", T.ArrayType(T.StringType()), True),
    T.StructField("chatgpt_answers", T.ArrayType(T.StringType()), True),
])

# Token-vector table.
VECTORS = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType()), False),
])

# Epoch history of a training run.
HISTORY = T.StructType([
    T.StructField("run", T.StringType(), False),
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("train_loss", T.DoubleType(), True),
    T.StructField("val_loss", T.DoubleType(), True),
    T.StructField("val_f1", T.DoubleType(), True),
])


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
