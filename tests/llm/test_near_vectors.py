"""op6's default margin against all pairs, with pairs placed across the cells' boundaries."""

import numpy as np
import pytest

from colonnade.llm import embeddings


def brute(x, labels, threshold=0.93):
    """Links of each unit vector and the least place it is connected to."""
    near = (x @ x.T >= threshold) & np.equal.outer(labels, labels)
    np.fill_diagonal(near, False)
    of = np.arange(len(x))
    while True:
        new = np.minimum(of, np.where(near, of[None], len(x)).min(axis=1))
        if (new == of).all():
            return near.sum(axis=1), of
        of = new


def same(spark, x, labels, **options):
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.near_vectors(df, **options).collect()))
    links, of = brute(x, labels)
    assert got == [(i, int(n), int(c), i == c) for i, (n, c) in enumerate(zip(links, of))]
    return links.sum()


def test_default_margin_loses_no_link_at_low_rank_and_many_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 8)) @ rng.normal(size=(8, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert same(spark, x, np.zeros(len(x)), cell_size=50) > 500


@pytest.mark.parametrize("options", [{"cell_size": 60}, {"cell_size": 15, "max_cells": 8}, {"cell_size": 40, "max_cells": 8, "block": 50}])
@pytest.mark.parametrize("dim", [64, 384])
def test_pairs_across_boundaries(spark, dim, options):
    """Vectors between two centres, in steps along the line from one to the other: the direction in which cells part them."""
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(25, dim))
    rows = []
    for _ in range(300):
        a, b = centres[rng.choice(25, 2, replace=False)]
        at = rng.uniform(0.3, 0.7)
        rows += [a + at * (b - a), a + (at + rng.uniform(0.02, 0.16)) * (b - a), a + 0.3 * rng.normal(size=dim)]
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert same(spark, x, rng.integers(0, 2, len(x)), **options) > 200


def test_lengths_are_compared_apart(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.1, 0.0], 1), (5, [1.0], 1), (6, [1e200, 1.0], 1), (7, [1e-200, 0.0], 2), (8, [1e-200, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (2, 1, False), 7: (1, 7, True), 8: (1, 7, False)}


@pytest.mark.parametrize("options", [{"block": 100, "cell_size": 30}, {"block": 64, "cell_size": 20, "max_cells": 6}, {}])
def test_tight_groups_repeated_vectors_and_labels_of_any_size(spark, options):
    """Groups whose vectors all link, copies of a vector, one label of half the rows and many of a few, blocks that a group spans."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 48))
    x = centres[rng.integers(0, 6, 900)] + rng.choice([0.02, 0.2, 0.4], size=(900, 1)) * rng.normal(size=(900, 48))
    x[rng.integers(0, 900, 60)] = x[rng.integers(0, 900, 60)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = np.where(rng.random(900) < 0.5, 0, rng.integers(1, 120, 900))
    assert same(spark, x, labels, **options) > 5000


def test_vectors_travel_a_few_times_however_many_cells_they_are_near(spark):
    """Vectors without cells to speak of, each near dozens of boundaries: what is shuffled follows the rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64)) + 0.5 * rng.normal(size=(1, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    assert embeddings.near_vectors(df, cell_size=50).count() == 3000
    assert written() - before < 6 * x.nbytes


@pytest.mark.parametrize("clash", [False, True])
def test_rows_find_their_vector_by_a_code_even_if_others_have_it(spark, monkeypatch, clash):
    """Zeros of either sign are equal; clash: all vectors have one code."""
    if clash:
        monkeypatch.setattr(embeddings.F, "xxhash64", lambda *c: embeddings.F.lit(7).cast("long") if isinstance(c[0], str) and c[0] == "label" else embeddings.F.hash(*c).cast("long"))
    rows = [(1, [0.0, 1.0], 1), (2, [-0.0, 1.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, -0.0], 1), (5, [1.0, 0.0], 2), (6, [1.0, 0.1], 2), (7, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
