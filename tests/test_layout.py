"""Repulsion by the distributed quadtree against the sum over all pairs, and what the maps keep of the neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.plans.layout import Tree, domains_of, repulsion


# lambdas, since the workers cannot import this file
student = lambda s: 1.0 / (1.0 + s) ** 2
kernel = lambda s: 1.0 / (1.0 + s)
steep = lambda s: np.minimum(1.8 / ((0.001 + s) * (1.0 + 1.6 * s**0.9)), 4.0 / np.sqrt(np.maximum(s, 1e-12)))


def all_pairs(y, force, step=1):
    """Forces on every ``step``-th row from all rows."""
    mine = y[::step]
    out, z = np.zeros_like(mine), np.zeros(len(mine))
    for i in range(0, len(mine), 256):
        gap = mine[i : i + 256, None, :] - y[None, :, :]
        squared = (gap**2).sum(axis=2)
        out[i : i + 256] = (force(squared)[:, :, None] * gap).sum(axis=1)
        z[i : i + 256] = kernel(squared).sum(axis=1) - 1.0
    return out, z


def places(n, dims=2, scale=1.0):
    """Clusters of unequal density, so that half of the rows lie in a small share of the plane."""
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(12, dims)) * 8
    width = np.geomspace(0.05, 2.0, 12)
    group = rng.choice(12, size=n, p=np.geomspace(6, 1, 12) / np.geomspace(6, 1, 12).sum())
    return (centre[group] + rng.normal(size=(n, dims)) * width[group][:, None]) * scale


def frame(spark, y):
    columns = ", ".join(f"y{j} double" for j in range(y.shape[1]))
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(y)], "id long, " + columns)


def forces(df, dims, count, *how):
    got = repulsion(df, dims, domains_of(df, dims, count), *how).toPandas().sort_values("id")
    return got[[f"p{j}" for j in range(dims)]].to_numpy(), got["z"].to_numpy()


@pytest.mark.parametrize("n", [2_000, 20_000])
@pytest.mark.parametrize("force", [student, steep])
def test_forces_are_within_one_per_cent_of_all_pairs(spark, n, force):
    y = places(n)
    got, z = forces(frame(spark, y), 2, n, force, kernel)
    step = n // 2_000
    want, pairs = all_pairs(y, force, step)
    assert np.linalg.norm(got[::step] - want) < 0.01 * np.linalg.norm(want)
    assert abs(z[::step].sum() - pairs.sum()) < 0.001 * pairs.sum()


@pytest.mark.parametrize("dims", [1, 3])
def test_other_dimensions(spark, dims):
    y = places(1_500, dims)
    got, _ = forces(frame(spark, y), dims, 1_500, student)
    want, _ = all_pairs(y, student)
    assert np.linalg.norm(got - want) < 0.01 * np.linalg.norm(want)


def test_forces_do_not_depend_on_partitions(spark):
    y = places(3_000)
    df = frame(spark, y)
    first, _ = forces(df.repartition(1), 2, 3_000, student)
    later, _ = forces(df.repartition(13, F.col("y0")), 2, 3_000, student)
    assert np.allclose(first, later, rtol=1e-9, atol=1e-9)


def test_rows_at_one_place_and_single_rows(spark):
    y = np.vstack([np.zeros((3_000, 2)), places(3_000)])
    got, _ = forces(frame(spark, y), 2, len(y), student)
    want, _ = all_pairs(y, student)
    assert np.linalg.norm(got - want) < 0.01 * np.linalg.norm(want)
    alone, z = forces(frame(spark, np.ones((1, 2))), 2, 1, student, kernel)
    assert not alone.any() and not z.any()


def test_domains_share_the_rows_and_cells_follow_the_density(spark):
    y = places(20_000)
    domains = domains_of(frame(spark, y), 2, len(y))
    sizes = np.bincount(domains.of(y), minlength=domains.count)
    assert domains.count > 8 and sizes.max() < 3 * len(y) / domains.count
    tree = Tree(y, np.ones(len(y)))
    assert tree.weight[0] == len(y) and (tree.last - tree.first)[tree.leaf].max() <= 16
    assert (tree.last - tree.first)[tree.leaf].sum() == len(y)


@pytest.mark.parametrize("mapper", [dl.TSNE(perplexity=10.0, max_iter=30), dl.UMAP(n_neighbors=10, max_iter=30)])
def test_maps_keep_neighbours_together(spark, blobs, mapper):
    """Most of the ten nearest rows on the map carry the same blob as the row itself."""
    placed = mapper.fit_transform(blobs).toPandas()
    at = np.array(placed[mapper.setting("output_col")].tolist())
    label = placed["blob"].to_numpy()
    gap = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1)[:, :10]
    assert (label[near] == label[:, None]).mean() > 0.9
