"""Products of blocks: rows with many features, where no cell rules anything out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.operators.datasets import make_gaussian
from distlearn.plans import blocks, density, lineage, nearest
from test_scale import check_density, check_nearest


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks, partitions and tiles so small that a small table has many of each."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(blocks, "TILE", 16)
    monkeypatch.setattr(blocks, "PART_BYTES", 40_000)
    monkeypatch.setattr(blocks, "TASK_BLOCKS", 2)


def test_many_features_have_no_tree(spark):
    df = make_gaussian(600, 20, spark=spark)
    model = dl.NearestNeighbors(n_neighbors=5, cell_rows=20).fit(df)
    assert model.tables["nodes"].isEmpty() and model.tables["points"].count() == 600


@pytest.mark.parametrize("d", [9, 64])
def test_nearest_of_many_features(spark, small_blocks, d):
    df = make_gaussian(700, d, spark=spark)
    check_nearest(df, df, 6, cell_rows=20)


def test_nearest_of_many_features_with_ties(spark, small_blocks):
    """Half of the rows are copies of a few, so that most candidates tie."""
    value = F.when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(F.col("id") % 7).cast("double")
    df = spark.range(500).select("id", F.array(*[value + F.lit(float(j)) for j in range(12)]).alias("features"))
    check_nearest(df, df, 8, cell_rows=30)


def test_a_row_that_is_no_number_hides_no_neighbour(spark, small_blocks):
    df = make_gaussian(200, 10, spark=spark)
    odd = df.withColumn("features", F.when(F.col("id") == 7, F.transform("features", lambda v: F.lit(float("nan")))).otherwise(F.col("features")))
    found = dl.NearestNeighbors(n_neighbors=3).fit(odd).kneighbors(df.where("id <> 7"))
    assert found.where("neighbor_id = 7").isEmpty() and found.count() == 199 * 3


def test_more_neighbours_than_a_block_has_rows(spark, small_blocks):
    df = make_gaussian(120, 10, spark=spark)
    check_nearest(df, df.where("id < 9"), 100)


def test_votes_of_many_features(spark, small_blocks):
    df = make_gaussian(400, 16, spark=spark).withColumn("label", (F.col("features")[0] > 0).cast("int"))
    found = dl.NearestNeighbors(n_neighbors=5).fit(df).kneighbors(df)
    votes = found.join(df.select(F.col("id").alias("neighbor_id"), "label"), "neighbor_id").groupBy("query_id").agg(F.avg("label").alias("p"))
    want = {r["query_id"]: r["p"] for r in votes.collect()}
    model = dl.KNeighborsClassifier(n_neighbors=5, cell_rows=20, output_col="p").fit(df)
    assert model.tables["nodes"].isEmpty()
    shares = {r["id"]: r["p"][1] for r in model.predict_proba(df).collect()}
    assert {k: np.round(v, 6) for k, v in shares.items()} == {k: np.round(v, 6) for k, v in want.items()}
    assert {r["id"]: r["prediction"] for r in model.predict(df).collect()} == {k: int(v > 0.5) for k, v in want.items()}


@pytest.mark.parametrize(("eps", "need"), [(3.6, 3), (4.2, 9), (1e-6, 2), (100.0, 5)])
def test_density_where_eps_reaches_most_cells(spark, small_blocks, monkeypatch, eps, need):
    monkeypatch.setattr(density, "_core_points", None)  # no point is sent to the cells
    monkeypatch.setattr(density, "VISITS", -1)
    check_density(make_gaussian(500, 12, spark=spark), eps, need, cell_rows=20)


def test_density_of_copies_in_blocks(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(density, "COPIES", 20)
    monkeypatch.setattr(density, "VISITS", -1)
    value = F.when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(F.col("id") % 37).cast("double")
    df = spark.range(400).select("id", F.array(*[value * (j + 1) for j in range(5)]).alias("features"))
    check_density(df, 8.0, 12, cell_rows=40)


def test_a_point_is_not_sent_to_every_cell(spark, monkeypatch):
    """In 40 dimensions eps reaches nearly all of the cells."""
    monkeypatch.setattr(density, "_core_points", None)
    check_density(make_gaussian(600, 40, spark=spark), 6.5, 3, cell_rows=20)


def files_on_disk(spark):
    return {f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")}


def test_a_settled_step_leaves_no_shuffle_files(spark):
    before, cleanup = files_on_disk(spark), spark.conf.get(lineage.CLEANUP)
    lineage.settle(spark.range(1000).repartition(3).groupBy(F.col("id") % 7).count())
    assert files_on_disk(spark) <= before and spark.conf.get(lineage.CLEANUP) == cleanup


@pytest.mark.parametrize("make", [lambda **o: dl.TSNE(perplexity=5.0, **o), lambda **o: dl.UMAP(n_neighbors=5, **o)])
def test_a_map_holds_no_disk_of_earlier_epochs(spark, make):
    """Neither the neighbour search nor an epoch leaves its shuffles behind."""
    df = make_gaussian(200, 12, spark=spark).cache()
    df.count()
    before = files_on_disk(spark)
    assert make(max_iter=4, cell_rows=20).fit_transform(df).count() == 200
    left = files_on_disk(spark) - before
    assert len(left) < 40  # of the searches' counts, not of the steps


def test_a_search_keeps_few_tables(spark):
    """Steps of the walks and of the tree go when later ones no longer read them."""
    from pathlib import Path

    folder = Path(lineage.shared_folder(spark).removeprefix("file:")) / "distlearn"
    df = make_gaussian(1500, 2, spark=spark).withColumn("label", F.col("features")[0])
    before = set(folder.iterdir())
    model = dl.KNeighborsRegressor(n_neighbors=3, cell_rows=10).fit(df)
    assert sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before) == ["nodes", "points"]
    before = set(folder.iterdir())
    assert model.predict(df).count() == 1500
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before if "hot_nodes" not in p.name] == ["found"]


def test_queries_walk_in_parts(spark, monkeypatch):
    """Parts of the queries one after the other find what all find together; repeated ids stay in one part."""
    monkeypatch.setattr(nearest, "QUERY_ROWS", 150)
    df = make_gaussian(400, 2, spark=spark)
    walks, search = [], nearest._search
    monkeypatch.setattr(nearest, "_search", lambda *a: walks.append(1) or search(*a))
    check_nearest(df, df, 4, cell_rows=40)
    assert len(walks) == 3
    twice = df.unionByName(df.where("id < 50"))
    model = dl.NearestNeighbors(n_neighbors=4, cell_rows=40).fit(df)
    assert model.kneighbors(twice).count() == 400 * 4
