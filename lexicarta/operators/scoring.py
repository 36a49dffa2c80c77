"""Scoring with user-supplied models: softmax / argmax over logits,
batched NumPy models through ``predict_batch_udf`` (Arrow batches, one
model instance per Python worker), an MLP baseline from Spark ML, and a
network of one tanh layer trained by full-batch back-propagation over matrix
blocks (``operators/blocks.py``)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B


def softmax(logits) -> F.Column:
    """exp(x - max) / sum(exp(x - max)).  The max is taken once and
    passed in as an array, so it is not recomputed per element."""
    c = F.col(logits) if isinstance(logits, str) else logits
    mx = F.array_repeat(F.array_max(c), F.size(c))
    ex = F.zip_with(c, mx, lambda x, m: F.exp(x.cast("double") - m))
    tot = F.array_repeat(F.aggregate(ex, F.lit(0.0), lambda a, v: a + v), F.size(c))
    return F.zip_with(ex, tot, lambda e, t: e / t)


def argmax(arr) -> F.Column:
    """0-based index of the largest element, first one on ties."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def with_softmax(df: DataFrame, logits: str, prob_col: str = "probabilities",
                 pred_col: str = "prediction") -> DataFrame:
    d = df.withColumn(prob_col, softmax(logits))
    return d.withColumn(pred_col, argmax(logits))


def batch_score(df: DataFrame, make_predict_fn: Callable, input_col: str, dim: int,
                batch_size: int = 32, out: str = "logits") -> DataFrame:
    """Score ``input_col`` (array<float>) with a user model.

    ``make_predict_fn()`` is called once per Python worker and returns
    ``predict(batch: np.ndarray[n, d]) -> np.ndarray[n, k]``; Spark feeds it
    Arrow batches of ``batch_size`` rows.  Probabilities and the predicted
    class are then built-in expressions (P18, P19)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[int(dim)]])
    d = df.withColumn(out, udf(F.col(input_col)))
    return with_softmax(d, out)


def half_sum_model(dim: int) -> Callable:
    """A small NumPy model for examples and tests: logits are the sums of
    the first and the second half of the vector."""
    half = dim // 2

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            x = np.asarray(x, dtype=np.float64).reshape(-1, dim)
            return np.stack([x[:, :half].sum(axis=1), x[:, half:].sum(axis=1)], axis=1)
        return predict
    return make


def mlp_baseline(train: DataFrame, test: DataFrame, features: str = "embedding", label: str = "label",
                 hidden: int = 16, max_iter: int = 50, seed: int = 42) -> DataFrame:
    """L9 (re-aimed): a multilayer perceptron on pooled document vectors,
    trained with Spark ML (distributed L-BFGS); returns test predictions."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    tr = train.select("*", array_to_vector(F.col(features)).alias("__f"), F.col(label).cast("double").alias("__y"))
    dim = len(tr.select(features).first()[0])
    n_classes = 2
    mlp = MultilayerPerceptronClassifier(featuresCol="__f", labelCol="__y", layers=[dim, hidden, n_classes],
                                         maxIter=max_iter, seed=seed)
    model = mlp.fit(tr)
    te = test.select("*", array_to_vector(F.col(features)).alias("__f"))
    out = model.transform(te)
    return out.select(*test.columns, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("probability")).drop(features)


def embed_texts(df: DataFrame, make_encoder_fn: Callable, text_col: str = "text", out: str = "embedding",
                batch_size: int = 32) -> DataFrame:
    """X6 with a user encoder (U3): ``make_encoder_fn()`` returns
    ``encode(texts: np.ndarray[str]) -> np.ndarray[n, dim]``; Spark hands it
    Arrow batches of ``batch_size`` texts, one encoder instance per Python
    worker (loaded once, reused across batches)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_encoder_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


def count_encoder() -> Callable:
    """A deterministic NumPy encoder for examples and tests: [code points,
    spaces] of each text."""
    def make():
        def encode(texts: np.ndarray) -> np.ndarray:
            t = np.asarray(texts, dtype=np.dtypes.StringDType())
            return np.stack([np.strings.str_len(t), np.strings.count(t, " ")], axis=1).astype(np.float64)
        return encode
    return make


def mlp_model(hidden: np.ndarray, out: np.ndarray) -> Callable:
    """One tanh layer of given weights (d x h) and a linear layer (h x k)."""
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            return np.tanh(np.asarray(x, dtype=np.float64).reshape(-1, hidden.shape[0]) @ hidden) @ out
        return predict
    return make


def example_mlp_weights(dim: int, units: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights from a rule: ((3 i + 5 j) mod 7 - 3) / 2 and (j + 2 k) mod 5 - 2."""
    i, j, k = np.arange(dim)[:, None], np.arange(units), np.arange(2)
    return ((3 * i + 5 * j[None, :]) % 7 - 3) / 2, ((j[:, None] + 2 * k[None, :]) % 5 - 2).astype(float)


def network_terms(block: B.Block, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of one block: gradients of both layers, cross-entropy, correct."""
    hidden, out = weights
    a = np.tanh(block.times(hidden))
    z = a @ out
    z = z - z.max(1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
    y = block.y.astype(np.int64)
    error = np.exp(log_p)
    error[np.arange(len(y)), y] -= 1.0
    back = (error @ out.T) * (1.0 - a * a)
    return np.concatenate([block.transposed_times(back, len(hidden)).ravel(), (a.T @ error).ravel(),
                           [-log_p[np.arange(len(y)), y].sum(), (z.argmax(1) == y).sum()]])


def train_network(train: DataFrame, features: str, label: str, hidden: np.ndarray, out: np.ndarray, epochs: int,
                  learning_rate: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float, float]]]:
    """Full-batch gradient descent on the cross-entropy of
    ``softmax(tanh(X hidden) out)`` from the given start weights; labels are
    0..k-1, rows without one take no part.  Returns both layers and the
    history (epoch, loss, accuracy), measured before each update."""
    blocks = B.build(train, label, None, features)
    try:
        seen = B.shape(blocks)
        if seen.n == 0:
            raise ValueError("no training rows")
        history = []
        for epoch in range(int(epochs)):
            sums = B.total(blocks, network_terms, (hidden, out), seen.parts)
            loss, correct = sums[-2:]
            history.append((epoch, float(loss / seen.n), float(correct / seen.n)))
            step = learning_rate * sums[:-2] / seen.n
            hidden, out = hidden - step[: hidden.size].reshape(hidden.shape), out - step[hidden.size:].reshape(out.shape)
        return hidden, out, history
    finally:
        blocks.unpersist()
