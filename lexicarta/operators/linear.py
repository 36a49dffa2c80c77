"""Linear classifiers trained by full-batch gradient descent.

Logistic regression: ``p = sigmoid(Xw + b)``, ``w -= lr * X'(p - y) / n``,
``b -= lr * sum(p - y) / n``.  Linear SVM (hinge, L2 on w, bias not
regularised): ``m = y*z < 1`` with y in {-1, +1},
``w -= lr * (-(C/n) X'(y*m) + w)``, ``b -= lr * (-(C/n) sum(y*m))``.
Weights start at zero; history (loss, accuracy) is measured before the
update of every ``max(1, epochs // 200)``-th epoch.

Plan: rows become matrix blocks once (``operators/blocks.py``), kept with
MEMORY_AND_DISK, so a lost executor only recomputes its partitions.  Each
epoch is one pass over the blocks: products of a block with the weights, one
array of (d + 3) sums per task (gradient, bias gradient, loss, correct), a
tree of bounded fan-in that merges the arrays, and an update on the driver.
No row is made per feature value.

Input layouts: sparse rows (``indices array<int>``, ``values
array<double>``) or a dense ``array<float|double>`` column (L6).
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed as FX
from . import blocks as B


def as_sparse(df: DataFrame, dense_col: str | None = None) -> DataFrame:
    """Dense ``array`` column -> (indices 0..d-1, values as double)."""
    if dense_col is None:
        return df
    vals = F.transform(F.col(dense_col), lambda x: x.cast("double"))
    return (df.withColumn("values", vals)
              .withColumn("indices", F.sequence(F.lit(0), F.size(dense_col) - 1))
              .drop(dense_col))


def dot(indices: str = "indices", values: str = "values", w: str = "__w", b: str = "__b"):
    """In-row ``b + sum(values[k] * w[indices[k]])`` (``w`` is a column)."""
    s = F.aggregate(F.arrays_zip(F.col(indices).alias("i"), F.col(values).alias("v")), F.lit(0.0),
                    lambda acc, e: acc + e["v"] * F.coalesce(F.get(F.col(w), e["i"]), F.lit(0.0)))
    return F.col(b) + s


def sigmoid(z):
    """1 / (1 + exp(-z)); the denominator is >= 1, so no ANSI error."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip_probability(p, eps: float = FX.PROBABILITY_CLIP):
    """P21."""
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def to_pm1(label):
    """P20: {0,1} -> {-1,+1}."""
    return F.when(label == 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def _weights_row(spark: SparkSession, w: np.ndarray, b: float) -> DataFrame:
    schema = T.StructType([T.StructField("__w", T.ArrayType(T.DoubleType()), False),
                           T.StructField("__b", T.DoubleType(), False)])
    return spark.createDataFrame([([float(x) for x in w], float(b))], schema)


class LinearModel:
    """Fitted weights; ``transform`` adds ``raw``, ``probability`` (LR) and
    ``prediction``.  Persistence is Parquet + JSON (S10)."""

    def __init__(self, kind: str, weights: np.ndarray, bias: float, params: dict,
                 history: list[tuple[int, float, float]] | None = None):
        self.kind = kind
        self.weights = np.asarray(weights, dtype=float)
        self.bias = float(bias)
        self.params = params
        self.history_rows = history or []

    def transform(self, df: DataFrame, dense_col: str | None = None) -> DataFrame:
        """L2 / L4: in-row scoring against a one-row broadcast of the
        weights; no shuffle.  LR: ``prediction = p >= 0.5``; SVM:
        ``prediction = 0 if z < 0 else 1`` (z = 0 gives 1)."""
        spark = df.sparkSession
        d = as_sparse(df, dense_col).crossJoin(F.broadcast(_weights_row(spark, self.weights, self.bias)))
        d = d.withColumn("raw", dot())
        if self.kind == "lr":
            d = d.withColumn("probability", sigmoid(F.col("raw")))
            d = d.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
        else:
            d = d.withColumn("prediction", F.when(F.col("raw") < 0, F.lit(0)).otherwise(F.lit(1)))
        return d.drop("__w", "__b")

    def history(self, spark: SparkSession) -> DataFrame:
        """(epoch, loss, accuracy)."""
        return spark.createDataFrame(self.history_rows, "epoch int, loss double, accuracy double")

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        """(idx, weight) with idx = -1 for the bias."""
        rows = [(-1, self.bias)] + [(i, float(x)) for i, x in enumerate(self.weights)]
        return spark.createDataFrame(rows, "idx int, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.weights_frame(spark).write.mode("overwrite").parquet(f"{path}/weights")
        meta = {"kind": self.kind, "params": self.params, "history": self.history_rows}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearModel":
        try:
            meta = json.loads(spark.read.json(f"{path}/meta").first()["meta"])
        except Exception as e:  # noqa: BLE001
            raise FileNotFoundError(f"model not found: {path}") from e
        rows = spark.read.parquet(f"{path}/weights").collect()  # bounded: one row per feature
        bias = next(r["weight"] for r in rows if r["idx"] == -1)
        d = max(r["idx"] for r in rows) + 1
        w = np.zeros(d)
        for r in rows:
            if r["idx"] >= 0:
                w[r["idx"]] = r["weight"]
        hist = [tuple(h) for h in meta.get("history", [])]
        return cls(meta["kind"], w, bias, meta["params"], hist)


class _LinearGD:
    kind = "lr"

    def __init__(self, learning_rate: float = FX.LEARNING_RATE, epochs: int = FX.EPOCHS_CLASS_DEFAULT,
                 n_features: int | None = None):
        self.learning_rate = float(learning_rate)
        self.epochs = int(epochs)
        self.n_features = n_features

    #: (z, y) -> per-row arrays: residual of the gradient, loss, correct
    _row_terms = None

    def _update(self, w, b, g, gb, n):
        raise NotImplementedError

    def fit(self, df: DataFrame, label: str = "label", dense_col: str | None = None) -> LinearModel:
        """Rows without a label take no part."""
        blocks = B.build(df, label, None if dense_col else "indices", dense_col or "values")
        try:
            seen = B.shape(blocks)
            if seen.n == 0:
                raise ValueError("no training rows")
            n, d = seen.n, self.n_features if self.n_features is not None else seen.width
            w, b = np.zeros(d), 0.0
            step = max(1, self.epochs // FX.HISTORY_POINTS)
            history = []
            for epoch in range(self.epochs):
                sums = B.total(blocks, _pass_terms, (w, b, self._row_terms), seen.parts)
                gb, loss, correct = sums[d:]
                if epoch % step == 0:
                    history.append((int(epoch), float(loss / n), float(correct / n)))
                w, b = self._update(w, b, sums[:d], gb, n)
            params = {"learning_rate": self.learning_rate, "epochs": self.epochs, "n_features": d}
            params.update(self._extra_params())
            return LinearModel(self.kind, w, b, params, history)
        finally:
            blocks.unpersist()

    def _extra_params(self) -> dict:
        return {}


def _pass_terms(block: B.Block, parameters) -> np.ndarray:
    """(d + 3) sums of one block: gradient, bias gradient, loss, correct."""
    w, b, row_terms = parameters
    r, loss, correct = row_terms(block.times(w) + b, block.y)
    return np.concatenate([block.transposed_times(r, len(w)), [r.sum(), loss.sum(), correct.sum()]])


def _lr_terms(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):  # exp(-z) may overflow to infinity: p = 0
        p = 1.0 / (1.0 + np.exp(-z))
    pc = np.clip(p, FX.PROBABILITY_CLIP, 1.0 - FX.PROBABILITY_CLIP)
    return p - y, -(y * np.log(pc) + (1.0 - y) * np.log(1.0 - pc)), (p >= 0.5) == y


def _svm_terms(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ys = np.where(y == 0, -1.0, 1.0)
    return ys * (ys * z < 1), np.maximum(0.0, 1.0 - ys * z), (z >= 0) == y


class LogisticRegressionGD(_LinearGD):
    """L1: logistic regression, class defaults lr 0.01 and 1000 epochs."""
    kind = "lr"

    _row_terms = staticmethod(_lr_terms)

    def _update(self, w, b, g, gb, n):
        return w - self.learning_rate * (g / n), b - self.learning_rate * (gb / n)


class LinearSVMGD(_LinearGD):
    """L3: linear SVM by full-batch subgradient descent."""
    kind = "svm"

    def __init__(self, learning_rate: float = FX.LEARNING_RATE, epochs: int = FX.EPOCHS_CLASS_DEFAULT,
                 C: float = FX.SVM_C, n_features: int | None = None):
        super().__init__(learning_rate, epochs, n_features)
        self.C = float(C)

    def _extra_params(self) -> dict:
        return {"C": self.C}

    _row_terms = staticmethod(_svm_terms)

    def _update(self, w, b, g, gb, n):
        dw = -(self.C / n) * g + w
        db = -(self.C / n) * gb
        return w - self.learning_rate * dw, b - self.learning_rate * db


def fit_linear(kind: str, df: DataFrame, epochs: int = FX.EPOCHS_SCRIPT_DEFAULT,
               learning_rate: float = FX.LEARNING_RATE,
               dense_col: str | None = None, label: str = "label", **kw) -> LinearModel:
    est = LogisticRegressionGD(learning_rate, epochs, **kw) if kind == "lr" else LinearSVMGD(learning_rate, epochs, **kw)
    return est.fit(df, label=label, dense_col=dense_col)

