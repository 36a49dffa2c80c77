"""Row blocks and sums over them; the trained network; selection; ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.operators import blocks as B
from lexicarta.operators import diagnostics as D
from lexicarta.operators import joins as J
from lexicarta.operators import linear as L
from lexicarta.operators import metrics as M
from lexicarta.operators import scoring as SC


@pytest.mark.parametrize("values_in_block, fan_in", [(1 << 20, 16), (7, 2)])
def test_sums_over_dense_sparse_and_ragged_rows(spark, monkeypatch, values_in_block, fan_in):
    monkeypatch.setattr(B, "BLOCK_VALUES", values_in_block)
    monkeypatch.setattr(B, "FAN_IN", fan_in)
    def _moments(block, parameters):
        return np.concatenate([block.times(parameters).sum(0, keepdims=True).ravel(), block.transposed_times(block.y, 4), [len(block.y)]])

    rng = np.random.default_rng(0)
    x = rng.normal(size=(57, 4)) * (rng.random((57, 4)) < 0.6)
    y = rng.integers(0, 2, 57).astype(float)
    targets = y.tolist()
    w = rng.normal(size=4)
    expected = np.concatenate([[(x @ w).sum()], x.T @ y, [57]])
    dense = spark.createDataFrame([(r.tolist(), t) for r, t in zip(x, targets)] + [([9.0] * 4, None)], "v array<double>, y double").repartition(11)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist(), t) for r, t in zip(x, targets)]
    sparse = spark.createDataFrame(rows, "indices array<int>, values array<double>, y double").repartition(11)
    ragged = spark.createDataFrame([(r[: np.flatnonzero(r).max(initial=-1) + 1].tolist() or None, t) for r, t in zip(x, targets)],
                                   "v array<double>, y double").repartition(11)
    for blocks in (B.build(dense, "y", None, "v"), B.build(sparse, "y"), B.build(ragged, "y", None, "v")):
        seen = B.shape(blocks)
        assert seen.n == 57 and seen.width == 4
        got = B.total(blocks, _moments, w, seen.parts)
        assert np.abs(got - expected).max() < 1e-9
        assert (B.total(blocks, _moments, w, seen.parts) == got).all()
        blocks.unpersist()


def test_no_row_per_value_in_training(spark, monkeypatch):
    """Features beyond ``n_features`` are left out, a null label too."""
    rows = [([0, 3], [1.0, 5.0], 1), ([1], [2.0], 0), ([0, 1], [1.0, None], 1), ([2], [1.0], None), (None, None, 0)]
    df = spark.createDataFrame(rows, "indices array<int>, values array<double>, label int")
    m = L.fit_linear("lr", df, 2, 0.1, n_features=3)
    x, y = np.array([[1.0, 0, 0], [0, 2.0, 0], [1.0, 0, 0], [0, 0, 0]]), np.array([1.0, 0, 1, 0])
    w, b = np.zeros(3), 0.0
    for _ in range(2):
        r = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.1 * x.T @ r / 4, b - 0.1 * r.sum() / 4
    assert np.abs(m.weights - w).max() < 1e-12 and abs(m.bias - b) < 1e-12
    with pytest.raises(ValueError, match="no training rows"):
        L.fit_linear("svm", df.where("label is null"), 1)


def test_network_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    hidden, out = rng.normal(size=(5, 4)), rng.normal(size=(4, 3))
    df = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y)], "v array<double>, label int").repartition(7)
    got_h, got_o, history = SC.train_network(df, "v", "label", hidden, out, 4, 0.3)
    for epoch in range(4):
        a = np.tanh(x @ hidden)
        p = np.exp(a @ out)
        p /= p.sum(1, keepdims=True)
        assert history[epoch][1] == pytest.approx(-np.log(p[np.arange(90), y]).mean()) and history[epoch][2] == pytest.approx((p.argmax(1) == y).mean())
        e = (p - np.eye(3)[y]) / 90
        hidden, out = hidden - 0.3 * x.T @ ((e @ out.T) * (1 - a * a)), out - 0.3 * a.T @ e
    assert np.abs(got_h - hidden).max() < 1e-12 and np.abs(got_o - out).max() < 1e-12
    assert history[-1][1] < history[0][1]


# ---------------------------------------------------------------- figures

def _scores(spark, rng, n=4000):
    v = np.concatenate([rng.normal(0.4, 0.2, n), np.round(rng.random(n // 4), 2), [0.0, -0.0, 1e-300, -1e300, 7.0, 7.0]])
    g = np.where(rng.random(len(v)) < 0.1, "small", "large")
    rows = list(zip(g.tolist(), v.tolist())) + [("large", float("nan")), ("small", None), ("none", None), ("none", float("nan")), ("one", 0.25)]
    return g, v, spark.createDataFrame(rows, "label string, probability double").repartition(9)


def test_box_stats_leave_out_nan_and_match_numpy(spark):
    g, v, df = _scores(spark, np.random.default_rng(1))
    found = {r.label: r for r in D.box_stats(df).collect()}
    assert set(found) == {"small", "large", "one"}
    for name in ("small", "large"):
        x, r = v[g == name], found[name]
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        lo, hi = x[x >= q1 - 1.5 * (q3 - q1)].min(), x[x <= q3 + 1.5 * (q3 - q1)].max()
        assert np.allclose([r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high], [q1, q2, q3, lo, hi], rtol=0, atol=1e-12)
        assert r.n_outliers == ((x < lo) | (x > hi)).sum()
    assert found["one"].q1 == found["one"].whisker_high == 0.25 and found["one"].n_outliers == 0
    assert {r.label: r.excluded_rows for r in D.excluded_scores(df).collect()} == {"small": 1, "large": 1, "none": 2, "one": 0}


def test_approximate_box_stats_stay_within_their_error(spark):
    g, v, df = _scores(spark, np.random.default_rng(2), 20_000)
    r = D.box_stats(df.where("label = 'large'"), accuracy=100).first()
    x = np.sort(v[g == "large"])
    for q, got in ((0.25, r.q1), (0.5, r["median"]), (0.75, r.q3)):
        assert got in x
        lo, hi = np.searchsorted(x, got, "left"), np.searchsorted(x, got, "right")
        assert lo - len(x) / 100 - 1 <= q * len(x) <= hi + len(x) / 100 + 1


def test_order_statistics_of_any_double(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-(1 << 62), 1 << 62, 300).view(np.float64), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    v = v[~np.isnan(v)]
    df = spark.createDataFrame([("a", float(x)) for x in v], "g string, v double")
    got = D.order_statistics(D._with_bits(df, "g"), "g", lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.rank)] == np.sort(v + 0.0).tolist()


def test_histogram_leaves_out_nan(spark):
    _, v, df = _scores(spark, np.random.default_rng(1), 50)
    df = df.where("label <> 'one' and abs(probability) < 10 or isnan(probability) or probability is null")
    h = D.probability_histogram(df).collect()
    assert {r.label for r in h} == {"small", "large"} and sum(r.n for r in h) == (np.abs(v) < 10).sum()
    assert not any(np.isnan(r.bin_lo) or np.isnan(r.bin_hi) for r in h)


# ---------------------------------------------------------------- ranges

def test_auc_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.random() < 0.3 + s / 4), float(s), "hot" if rng.random() < 0.8 else None) for s in np.round(rng.random(5000), 3)]
    rows += [(1, float("nan"), "hot"), (0, None, "hot"), (None, 0.5, "hot"), (1, 0.5, "single")]
    df = spark.createDataFrame(rows, "label int, probability double, source string").repartition(5)

    def auc(part):
        pos, neg = (np.array([p for y, p, _ in part if y == k]) for k in (1, 0))
        return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / len(pos) / len(neg)

    plain = [r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]]
    got = {r.source: r.roc_auc for r in M.roc_auc(df, ["source"]).collect()}
    assert got["hot"] == pytest.approx(auc([r for r in plain if r[2] == "hot"]), abs=1e-12) and got["single"] is None
    report = {(r.scope, r.domain): r for r in M.domain_metrics(df.withColumn("prediction", F.lit(1))).collect()}
    assert report["overall", None].roc_auc == pytest.approx(auc(plain), abs=1e-12)
    assert report["domain", "hot"].roc_auc == got["hot"] and set(report) == {("overall", None), ("domain", "hot"), ("domain", "single")}


def test_report_plan_has_few_exchanges(spark):
    df = spark.createDataFrame([(0, 0, .1, "a"), (1, 1, .8, "b")], "label int, prediction int, probability double, source string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = M.domain_metrics(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = [x for x in plan.splitlines() if "Exchange " in x and "ReusedExchange" not in x]
    assert len(lines) <= 8, plan


def test_broadcast_bound_is_in_bytes(spark):
    wide = spark.createDataFrame([("a", [1.0])], "token string, vec array<double>")
    assert J.fits_broadcast(wide, 10_000) and not J.fits_broadcast(wide, 1_000_000) and not J.fits_broadcast(wide, 10_000, elements=4096)
