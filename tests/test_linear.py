import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.operators import linear as L
from lexicarta.sources import tables as T
from conftest import SF01


def _numpy_fit(X, y, kind, epochs, lr=0.01, C=1.0):
    n, d = X.shape
    w, b = np.zeros(d), 0.0
    hist = []
    for _ in range(epochs):
        z = X @ w + b
        if kind == "lr":
            p = 1 / (1 + np.exp(-z))
            pc = np.clip(p, 1e-15, 1 - 1e-15)
            hist.append((-np.mean(y * np.log(pc) + (1 - y) * np.log(1 - pc)), np.mean((p >= .5).astype(int) == y)))
            w = w - lr * (X.T @ (p - y)) / n
            b = b - lr * np.sum(p - y) / n
        else:
            ys = np.where(y == 0, -1, 1)
            m = (ys * z < 1).astype(float)
            hist.append((np.mean(np.maximum(0, 1 - ys * z)), np.mean(np.where(np.sign(z) == -1, 0, 1) == y)))
            w = w - lr * (-(C / n) * (X.T @ (ys * m)) + w)
            b = b - lr * (-(C / n) * np.sum(ys * m))
    return w, b, hist


@pytest.fixture(scope="module")
def dense(spark):
    return T.dense_features(spark, SF01).cache()


@pytest.mark.parametrize("kind", ["lr", "svm"])
def test_dense_matches_numpy(spark, dense, kind):
    rows = dense.orderBy("doc_id").collect()
    X = np.array([r["features"] for r in rows], dtype=np.float64)
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    w, b, hist = _numpy_fit(X, y, kind, 4)
    m = L.fit_linear(kind, dense.repartition(5), 4, 0.01, dense_col="features")
    assert np.max(np.abs(m.weights - w)) < 1e-12 and abs(m.bias - b) < 1e-12
    assert [(e, round(a, 9), round(c, 9)) for e, a, c in m.history_rows] == \
        [(i, round(h[0], 9), round(h[1], 9)) for i, h in enumerate(hist)]


def test_zero_epochs_predicts_one(spark, dense):
    for kind in ("lr", "svm"):
        m = L.fit_linear(kind, dense, 0, dense_col="features")
        assert {r["prediction"] for r in m.transform(dense, dense_col="features").collect()} == {1}


def test_sparse_with_empty_document(spark, scratch):
    df = spark.createDataFrame([(1, [0, 2], [1.0, 2.0], 1), (2, [], [], 0), (3, [1], [0.5], 0)],
                               "doc_id long, indices array<int>, values array<double>, label int")
    m = L.fit_linear("lr", df, 3, 0.1, n_features=3)
    X = np.array([[1.0, 0, 2.0], [0, 0, 0], [0, 0.5, 0]])
    w, b, _ = _numpy_fit(X, np.array([1.0, 0, 0]), "lr", 3, 0.1)
    assert np.max(np.abs(m.weights - w)) < 1e-12 and abs(m.bias - b) < 1e-12
    p = {r["doc_id"]: r["raw"] for r in m.transform(df).collect()}
    assert abs(p[2] - m.bias) < 1e-15  # no terms: z = bias
    m.save(spark, f"{scratch}/lr")
    m2 = L.LinearModel.load(spark, f"{scratch}/lr")
    assert np.allclose(m2.weights, m.weights) and m2.bias == m.bias and m2.kind == "lr"


def test_scoring_plan_is_shuffle_free(spark, dense):
    m = L.fit_linear("lr", dense, 1, dense_col="features")
    plan = m.transform(dense, dense_col="features")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "PythonUDF" not in plan
