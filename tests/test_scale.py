"""Exactness under copies, hot keys and many cells; plans without all-pairs joins."""

from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.operators.datasets import make_gaussian
from distlearn.plans import cells, components, density, grid, lineage, nearest, tree
from distlearn.plans.components import connected_components
from distlearn.plans.lineage import settle
from distlearn.plans.order import dense_index, running_totals
from distlearn.plans.skew import hot_join


@pytest.fixture
def tight(monkeypatch):
    """Limits so low that small tables take the paths of large ones."""
    monkeypatch.setattr(nearest, "COLLAPSE_ROWS", 100)
    monkeypatch.setattr(nearest, "COPIES", 20)
    monkeypatch.setattr(density, "COPIES", 20)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(tree, "SPREAD_ROWS", 150)
    monkeypatch.setattr(tree, "PIECE", 32)
    monkeypatch.setattr(tree, "FAN", 4)
    monkeypatch.setattr(cells, "SLICE_ROWS", 150)
    monkeypatch.setattr(cells, "QUERY_SLICE_ROWS", 120)
    monkeypatch.setattr(cells, "BLOCK_ROWS", 64)
    monkeypatch.setattr(cells, "CHUNK_ROWS", 32)


def local(df):
    out = df.orderBy("id").collect()
    return np.array([r["id"] for r in out]), np.array([r["features"] for r in out], dtype=float)


def copies(spark, n=1200):
    """A third of the rows are one point; the rest lie on a grid with ties."""
    spot = F.array(F.lit(1.0), F.lit(2.0))
    grid = F.array((F.col("id") % 97).cast("double"), (F.col("id") % 11).cast("double"))
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, spot).otherwise(grid).alias("features"))


def check_nearest(points, queries, k, **options):
    got = {}
    for r in dl.NearestNeighbors(n_neighbors=k, **options).fit(points).kneighbors(queries).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    ids, x = local(points)
    qids, q = local(queries)
    assert len(got) == len(qids)
    for i, qid in enumerate(qids):
        d = np.sqrt(((x - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))[:k]
        found = sorted(got[qid])
        assert [f[1] for f in found] == ids[order].tolist()
        assert np.allclose([f[2] for f in found], d[order])


@pytest.mark.parametrize("cell_rows", [30, 300, 10_000])
def test_nearest_with_copies(spark, tight, cell_rows):
    df = copies(spark)
    check_nearest(df, df, 6, cell_rows=cell_rows)


def test_nearest_with_a_hot_cell(spark, tight):
    crowd = make_gaussian(900, 3, spark=spark).withColumn(
        "features", F.when(F.col("id") % 3 == 0, F.transform("features", lambda v: v * 1e-3)).otherwise(F.col("features"))
    )
    check_nearest(crowd, crowd, 4, cell_rows=100)


def test_leaves_visited_stay_few_as_rows_grow(spark):
    at_2000 = nearest_visits(spark, 2_000)
    assert nearest_visits(spark, 8_000) <= at_2000 + 1 and at_2000 < 8


def nearest_visits(spark, n):
    """Leaves visited per query for its 5 nearest rows."""
    points = make_gaussian(n, 2, spark=spark).select("id", F.col("features").alias("x"))
    placed, nodes = tree.grow(points, n, 50)
    leaves = nodes.where("leaf")
    assert leaves.agg(F.sum("rows")).head()[0] == n and leaves.agg(F.max("rows")).head()[0] <= 50
    assert placed.join(leaves.select(F.col("id").alias("node")), "node", "left_anti").isEmpty()
    asked = points.where("id % 20 = 0")
    far = nearest.nearest(asked, placed, nodes, 5).groupBy(F.col("query_id").alias("id")).agg(F.max("distance").alias("bound"))
    start = asked.join(far, "id").selectExpr("id", "x", "0L as node", "bound", "-1L as home")
    return nearest._walk(start, nodes, tree.levels(nodes), nearest._possible, None, None).count() / asked.count()


def test_tree_of_copies_ends(spark):
    same = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    placed, nodes = tree.grow(same, 300, 20)
    assert placed.count() == 300 and nodes.count() == 1 and nodes.head()["rows"] == 300


def test_nearest_far_from_the_origin(spark):
    df = make_gaussian(300, 2, spark=spark).withColumn("features", F.transform("features", lambda v: v + 1e6))
    check_nearest(df, df, 3, cell_rows=20)


def test_nearest_more_copies_than_kept(spark, tight):
    df = copies(spark, 600)
    model = dl.NearestNeighbors(n_neighbors=2, cell_rows=50).fit(df)
    found = model.kneighbors(df.where("id = 0"), n_neighbors=5).orderBy("rank").collect()
    assert [r["neighbor_id"] for r in found] == [0, 3, 6, 9, 12]


def reference_density(ids, x, eps, need):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(axis=1) >= need
    root = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        least = np.where(near & core[None, :], root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.where(core, np.minimum(root, least), root)
        if (new == root).all():
            break
        root = new
    names = {r: i for i, r in enumerate(sorted(set(root[core])))}
    out = np.full(len(ids), -1)
    for i in range(len(ids)):
        reach = [names[root[j]] for j in np.flatnonzero(near[i] & core)]
        out[i] = names[root[i]] if core[i] else min(reach, default=-1)
    return out


def check_density(df, eps, need, **options):
    out = dl.DBSCAN(eps=eps, min_samples=need, **options).fit_predict(df).orderBy("id").collect()
    ids, x = local(df)
    assert [r["prediction"] for r in out] == reference_density(ids, x, eps, need).tolist()


@pytest.mark.parametrize("eps, need, cell_rows", [(0.1, 5, 30), (0.5, 5, 8), (0.07, 3, 5000)])
def test_density_in_the_plane(spark, tight, eps, need, cell_rows):
    check_density(make_gaussian(900, 2, spark=spark), eps, need, cell_rows=cell_rows)


def test_density_with_copies(spark, tight):
    check_density(copies(spark, 900), 1.0, 9, cell_rows=40)


def test_density_all_noise_and_all_one(spark):
    df = make_gaussian(200, 4, spark=spark)
    check_density(df, 1e-6, 2)
    check_density(df, 100.0, 5)


@pytest.fixture(params=[5, 1_000_000])
def small_contract(request, monkeypatch):
    monkeypatch.setattr(components, "CONTRACT_ROWS", request.param)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_components(spark, small_contract, pairs):
    edges = spark.createDataFrame([(a, b) for a, b in pairs], "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    parent = {n: n for p in pairs for n in p}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


def test_components_of_a_long_path_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "CONTRACT_ROWS", 40)
    edges = spark.range(0, 400, 1, 20).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).repartition(20)
    assert connected_components(edges).where("root <> 0").count() == 0
    assert connected_components(edges).count() == 401


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 7")
    salted = hot_join(left, right, "k", "n", F.xxhash64("id"), how, hot_rows=100).select("id", "k", "top")
    plain = left.join(right, "k", how).select("id", "k", "top")
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_dense_index_over_partitions(spark):
    values = spark.range(500).select((F.col("id") * 7 % 501).alias("v"))
    out = dense_index(values, "v", "i", small=10).orderBy("i").collect()
    assert [r["i"] for r in out] == list(range(500))
    assert [r["v"] for r in out] == sorted(r["v"] for r in out)


def test_running_totals(spark):
    df = spark.range(300).select((F.col("id") * 11 % 307).alias("k"), F.col("id").alias("a"))
    out = running_totals(df, "k", ["a"]).orderBy("k").collect()
    assert [r["total_a"] for r in out] == np.cumsum([r["a"] for r in out]).tolist()


def test_settled_tables_have_no_lineage(spark):
    table = settle(spark.range(10).withColumn("v", F.col("id") * 2))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and table.count() == 10


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_all_pairs_join(spark, train, blobs):
    near = dl.NearestNeighbors(n_neighbors=3, cell_rows=100).fit(train)
    frames = [
        near.kneighbors(train),
        dl.KNeighborsClassifier(label_col="two").fit(train).predict(train),
        dl.LabelEncoder(label_col="three").fit_transform(train),
        dl.DBSCAN(eps=3.0).fit_predict(blobs),
        dl.StandardScaler().fit_transform(train),
    ]
    for df in frames:
        plan = physical(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    out = dl.StandardScaler(features_col=["p_size"]).fit_transform(part).select("p_partkey", "scaled")
    plan = physical(out)
    assert "p_retailprice" not in plan and "p_name" not in plan
    assert "WholeStageCodegen" in plan or "*(1)" in plan


class Session:
    """Stands in for a session whose settings cannot be changed once it runs."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_shared_folder_follows_the_session_setting():
    assert lineage.shared_folder(Session("spark://a:7077", "hdfs://a/shared/")) == "hdfs://a/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session("spark://a:7077"))


def test_superseded_tables_are_removed(spark):
    table = settle(spark.range(3))
    assert table._settled_path.startswith(lineage.shared_folder(spark))
    assert Path(table._settled_path).exists()
    lineage.discard(table)
    assert not Path(table._settled_path).exists()


@pytest.mark.parametrize("width,eps,need", [(1, 0.02, 4), (2, 0.15, 4), (3, 0.4, 5)])
def test_density_on_the_grid(spark, monkeypatch, width, eps, need):
    """Against all pairs, once with every comparison of cells row by row and once through ever smaller parts."""
    df = make_gaussian(700, width, spark=spark)
    for compared in (grid.COMPARED, 4):
        monkeypatch.setattr(grid, "COMPARED", compared)
        check_density(df, eps, need)


def test_density_of_two_crowded_cells(spark, monkeypatch):
    """Two clouds whose cells touch within eps only at one pair of rows, and a dense cell with nine tenths of the rows."""
    monkeypatch.setattr(grid, "COMPARED", 50)
    spot = F.when(F.col("id") < 150, 0.0).when(F.col("id") < 300, 1.05).otherwise(40.0)
    df = spark.range(1000).select("id", F.array(spot + (F.col("id") * 37 % 101) / 2000.0, (F.col("id") * 53 % 97) / 3000.0).alias("features"))
    for eps in (0.98, 1.0, 1.02, 1.2):
        check_density(df, eps, 5)


def test_density_beyond_the_grid(spark):
    """So many cells that their numbers don't fit, and infinite eps, go by pivots or one cell."""
    df = make_gaussian(300, 2, spark=spark).withColumn("features", F.transform("features", lambda v: v * 1e12))
    check_density(df, 1e-3, 2)
    check_density(make_gaussian(200, 2, spark=spark), 50.0, 5)
