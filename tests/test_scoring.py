"""Training of the multilayer perceptron."""

import random

import pytest

from lexicarta.operators import scoring as SC


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes that no plane separates: inside and outside of a circle."""
    rng = random.Random(0)
    points = [[rng.uniform(-1, 1), rng.uniform(-1, 1)] for _ in range(600)]
    rows = [(k, p, int(p[0] ** 2 + p[1] ** 2 > 0.5)) for k, p in enumerate(points)]
    table = spark.createDataFrame(rows, "doc_id long, embedding array<double>, label int")
    return table.where("doc_id < 400"), table.where("doc_id >= 400")


def test_mlp_learns_what_no_plane_separates(rings):
    found = SC.mlp_baseline(*rings, max_iter=100).collect()
    assert len(found) == 200 and all(0 <= r.probability <= 1 for r in found)
    assert sum(r.prediction == r.label for r in found) / len(found) > 0.93
    assert all(r.prediction == int(r.probability > 0.5) for r in found)


def test_mlp_training_is_reproducible(rings):
    first, again = ({r.doc_id: r.probability for r in SC.mlp_baseline(*rings, max_iter=30).collect()} for _ in range(2))
    assert first == pytest.approx(again, abs=1e-9)
