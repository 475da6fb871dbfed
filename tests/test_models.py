"""Verbs, settings, persistence and independence from partitioning."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.operators.datasets import make_gaussian, make_regression
from distlearn.operators.selection import GridSearch, cross_val_report, train_test_split

LEARNERS = [
    dl.StandardScaler(), dl.MinMaxScaler(), dl.PCA(n_components=3), dl.TruncatedSVD(n_components=3),
    dl.GaussianRandomProjection(n_components=3), dl.LinearRegression(), dl.Lasso(alpha=0.1, solver="cd"), dl.LogisticRegression(label_col="two"),
    dl.MBSGDClassifier(label_col="two", epochs=3), dl.SVC(label_col="two", n_landmarks=20), dl.SVR(n_landmarks=20),
    dl.RandomForestClassifier(label_col="two", n_estimators=5), dl.RandomForestRegressor(n_estimators=5),
    dl.KNeighborsClassifier(label_col="two"), dl.KNeighborsRegressor(), dl.KMeans(n_clusters=2), dl.LabelEncoder(label_col="three"),
]


def rows(df):
    return sorted(map(str, df.drop("features").collect()))


@pytest.mark.parametrize("learner", LEARNERS, ids=lambda v: type(v).__name__)
def test_reload_gives_identical_output(spark, train, test, learner):
    store = dl.ModelStore(spark, tempfile.mkdtemp(prefix="run-"))
    model = learner.fit(train)
    part = test.limit(50)
    store.save(model, "m")
    again = store.load("m")
    assert rows(again.transform(part)) == rows(model.transform(part))
    assert again.get_params() == model.get_params() and type(again) is type(model)
    store.save(learner.fit(train), "m")  # replaces
    assert rows(store.load("m").transform(part)) == rows(model.transform(part)) or "Forest" in type(model).__name__


def test_reload_of_maps_and_clusters(spark, blobs):
    store = dl.ModelStore(spark, tempfile.mkdtemp(prefix="run-"))
    small = blobs.where("id < 120")
    clusters = dl.DBSCAN(eps=3.0)
    labels = clusters.fit_predict(small)
    clusters.save(store.path("dbscan"))
    assert rows(store.load("dbscan").predict(small)) == rows(labels)
    umap = dl.UMAP(max_iter=2, n_neighbors=5)
    placed = umap.fit(small).transform(blobs.where("id >= 500"))
    store.save(umap.model_, "umap")
    assert rows(store.load("umap").transform(blobs.where("id >= 500"))) == rows(placed)
    tsne = dl.TSNE(max_iter=2, perplexity=5.0)
    first = tsne.fit_transform(small)
    store.save(tsne.model_, "tsne")
    assert rows(store.load("tsne").transform(small)) == rows(first)


def test_store_lists_loads_chains_and_checks_names(spark, train):
    store = dl.ModelStore(spark, tempfile.mkdtemp(prefix="run-") + "/models")
    assert store.list_saved().count() == 0
    chain = Pipeline(stages=[dl.StandardScaler(), dl.LogisticRegression(features_col="scaled", label_col="two")]).fit(train)
    store.save(chain, "b-chain")
    store.save(dl.Ridge(alpha=2.0).fit(train), "a.ridge")
    listed = store.list_saved().collect()
    assert [r["name"] for r in listed] == ["a.ridge", "b-chain"] and listed[0]["class"] == "LinearModel"
    assert rows(store.load("b-chain").transform(train)) == rows(chain.transform(train))
    with pytest.raises(FileNotFoundError):
        store.load("none")
    for bad in ("../x", "", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            store.save(chain, bad)


def test_model_with_tables_is_not_overwritten_by_itself(spark, train):
    store = dl.ModelStore(spark, tempfile.mkdtemp(prefix="run-"))
    store.save(dl.KNeighborsRegressor().fit(train), "k")
    loaded = store.load("k")
    with pytest.raises(ValueError, match="another name"):
        store.save(loaded, "k")
    assert loaded.predict(train).count() == 800


def test_verbs(train):
    with pytest.raises(dl.UnsupportedVerb):
        dl.StandardScaler().predict(train)
    with pytest.raises(dl.UnsupportedVerb):
        dl.DBSCAN().fit(train)
    with pytest.raises(dl.UnsupportedVerb):
        dl.TSNE().transform(train)
    with pytest.raises(dl.UnsupportedVerb):
        dl.Ridge().inverse_transform(train)
    with pytest.raises(dl.UnsupportedVerb):
        dl.NearestNeighbors().predict(train)
    with pytest.raises(ValueError, match="fit"):
        dl.Ridge().predict(train)
    with pytest.raises(KeyError, match="unknown operator"):
        dl.create("Nope")
    assert len(dl.OPERATORS) >= 23


def test_settings(train):
    forest = dl.create("RandomForestClassifier", n_estimators=10, max_depth=3, label_col="two")
    assert forest.get_params()["n_estimators"] == 10 and "max_depth=3" in repr(forest)
    forest.fit(train)
    forest.set_params(n_estimators=20, max_depth=5)
    assert forest.model_ is None and forest.get_params()["max_depth"] == 5
    assert forest.fit(train).native["forest"].getNumTrees == 20
    with pytest.raises(TypeError, match="no setting"):
        dl.Ridge(beta=1)


def test_bad_input(spark, train):
    with pytest.raises(ValueError, match="not found"):
        dl.StandardScaler(features_col="nope").fit(train)
    with pytest.raises(TypeError):
        dl.StandardScaler(features_col="name").fit(spark.createDataFrame([("a",)], "name string"))
    with pytest.raises(ValueError, match="empty"):
        dl.StandardScaler().fit(train.where("id < 0"))
    with pytest.raises(ValueError, match="n_components"):
        dl.PCA(n_components=21).fit(train)
    holes = train.withColumn("features", F.when(F.col("id") == 3, None).otherwise(F.col("features")))
    with pytest.raises(Exception, match="null in features"):
        dl.PCA().fit(holes)
    assert dl.PCA(handle_invalid="skip").fit_transform(holes).count() == 799


@pytest.mark.parametrize("kind", ["float", "int", "bigint", "double"])
def test_number_types(spark, kind):
    df = spark.range(100).select("id", F.transform(F.array(*[F.col("id") * j for j in (1, 2, 3)]), lambda v: v.cast(kind)).alias("features"))
    assert dl.PCA(n_components=1).fit_transform(df).count() == 100
    assert np.allclose(dl.StandardScaler().fit(df).state["mean"], [49.5, 99.0, 148.5])


@pytest.mark.parametrize(
    "learner",
    [dl.StandardScaler(), dl.PCA(n_components=2), dl.Ridge(), dl.MBSGDRegressor(epochs=2, batch_size=200), dl.SVR(n_landmarks=20),
     dl.LogisticRegression(label_col="two"), dl.KNeighborsClassifier(label_col="two")],
    ids=lambda v: type(v).__name__,
)
def test_partitions_do_not_matter(train, learner):
    seen = []
    for parts in (1, 4, 13):
        state = learner.fit(train.repartition(parts).sortWithinPartitions(F.xxhash64("id", F.lit(parts)))).state
        seen.append({k: v for k, v in state.items() if isinstance(v, np.ndarray)})
    for other in seen[1:]:
        for k, v in seen[0].items():
            assert np.allclose(v, other[k], rtol=1e-5, atol=1e-6), k


def test_makers_do_not_depend_on_partitions(spark):
    whole = make_gaussian(500, 5, spark=spark)
    again = make_gaussian(spark.range(500).repartition(13), 5)
    assert rows(whole.select("id", F.col("features").alias("f"))) == rows(again.select("id", F.col("features").alias("f")))
    x = np.array([r[0] for r in make_gaussian(20000, 3, spark=spark).select("features").collect()])
    assert np.abs(x.mean(axis=0)).max() < 0.03 and np.abs(x.std(axis=0) - 1).max() < 0.03
    assert np.abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.03


def test_split_and_validation(spark, train):
    a, b = train_test_split(train, 0.25, seed=3)
    c, d = train_test_split(train.repartition(7), 0.25, seed=3)
    assert a.count() + b.count() == 800 and abs(b.count() - 200) < 60
    assert rows(b.select("id")) == rows(d.select("id"))
    report = cross_val_report({"ols": dl.LinearRegression()}, train, folds=3).collect()[0]
    assert report["mean"] > 0.9 and len(report["scores"]) == 3
    search = GridSearch(dl.Ridge(), {"alpha": [0.1, 1e6]}, folds=3).fit(train)
    assert search.best_params_ == {"alpha": 0.1}


def test_spark_cross_validator(train):
    ridge = dl.Ridge()
    grid = ParamGridBuilder().addGrid(ridge.alpha, [0.1, 1e6]).build()
    best = CrossValidator(estimator=ridge, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=2).fit(train)
    assert best.bestModel.score(train) > 0.9 and best.avgMetrics[0] < best.avgMetrics[1]


def test_regression_maker(spark):
    assert dl.LinearRegression().fit(make_regression(500, noise=0.0, spark=spark)).score(make_regression(500, noise=0.0, spark=spark)) > 1 - 1e-9
