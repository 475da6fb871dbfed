"""Quality thresholds on generated data."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.operators.datasets import make_blobs, make_gaussian, make_nonnegative


def column(df, name):
    return np.array([r[0] for r in df.orderBy("id").select(name).collect()], dtype=float)


def test_standard_scaler(train):
    scaler = dl.StandardScaler()
    out = scaler.fit_transform(train)
    z = column(out, "scaled")
    assert np.abs(z.mean(axis=0)).max() < 1e-9 and np.abs(z.std(axis=0) - 1).max() < 1e-9
    back = column(scaler.inverse_transform(out), "restored")
    assert np.abs(back - column(train, "features")).max() < 1e-9


def test_standard_scaler_constant_and_single_row(spark):
    df = spark.createDataFrame([(0, [1.5, 2.0]), (1, [1.5, 4.0])], "id long, features array<double>")
    assert column(dl.StandardScaler().fit_transform(df), "scaled").tolist() == [[0.0, -1.0], [0.0, 1.0]]
    assert column(dl.StandardScaler().fit_transform(df.limit(1)), "scaled").tolist() == [[0.0, 0.0]]


def test_minmax_scaler(train, test):
    scaler = dl.MinMaxScaler()
    z = column(scaler.fit_transform(train), "scaled")
    assert z.min() >= -1e-12 and z.max() <= 1 + 1e-12
    assert column(scaler.transform(test), "scaled").shape == (200, 20)


def test_minmax_constant_maps_to_low_end(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 3.0)], "id long, v double")
    out = dl.MinMaxScaler(features_col=["v"], feature_range=[2.0, 5.0]).fit_transform(df)
    assert column(out, "scaled").ravel().tolist() == [2.0, 2.0]


def test_label_encoder_sorts_numbers_as_numbers(spark, gauss):
    df = spark.createDataFrame([(0, 10.0), (1, -1.0), (2, 2.0), (3, 10.0)], "id long, label double")
    encoder = dl.LabelEncoder()
    out = encoder.fit_transform(df)
    assert column(out, "code").tolist() == [2, 0, 1, 2]
    assert encoder.inverse_transform(out).where("restored <> label").count() == 0
    with pytest.raises(Exception, match="not seen"):
        encoder.transform(df.withColumn("label", F.lit(7.0))).collect()


def test_pca_shapes_and_inverse(train):
    pca = dl.PCA(n_components=10)
    out = pca.fit_transform(train)
    x, z, back = column(train, "features"), column(out, "projected"), column(pca.inverse_transform(out), "restored")
    assert z.shape == (800, 10) and back.shape == (800, 20) and np.isfinite(z).all()
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(pca.model_.state["singular_values"], s[:10])
    assert np.allclose(np.abs(z), np.abs((x - x.mean(axis=0)) @ vt[:10].T), atol=1e-6)


def test_truncated_svd(spark):
    df = make_nonnegative(1000, spark=spark).where("id < 800")
    model = dl.TruncatedSVD(n_components=8)
    z = column(model.fit_transform(df), "projected")
    assert z.shape == (800, 8)
    assert np.allclose(model.model_.state["singular_values"], np.linalg.svd(column(df, "features"))[1][:8])


def test_pca_wide(spark):
    df = make_gaussian(5000, 100, spark=spark)
    z = column(dl.PCA(n_components=10).fit_transform(df), "projected")
    assert z.shape == (5000, 10) and np.isfinite(z).all()


@pytest.mark.parametrize(
    "learner, least",
    [
        (dl.LinearRegression(), 0.99), (dl.Ridge(alpha=1.0), 0.99), (dl.Lasso(alpha=0.01), 0.99),
        (dl.ElasticNet(alpha=0.01, l1_ratio=0.5), 0.99), (dl.MBSGDRegressor(epochs=30), 0.9), (dl.SVR(kernel="rbf", C=10.0), 0.3),
        (dl.RandomForestRegressor(n_estimators=30, random_state=0, max_depth=8), 0.3), (dl.KNeighborsRegressor(n_neighbors=5), 0.3),
    ],
    ids=lambda v: repr(v).split("(")[0],
)
def test_regressors(train, test, learner, least):
    assert learner.fit(train).score(test) > least


@pytest.mark.parametrize(
    "learner, least",
    [
        (dl.LogisticRegression(max_iter=200), 0.9), (dl.MBSGDClassifier(epochs=20, loss="log"), 0.8), (dl.SVC(kernel="rbf", C=10.0), 0.7),
        (dl.SVC(kernel="linear"), 0.9), (dl.KNeighborsClassifier(n_neighbors=5), 0.7),
        (dl.RandomForestClassifier(n_estimators=30, random_state=0), 0.8),
    ],
    ids=lambda v: repr(v).split("(")[0],
)
def test_two_classes(train, test, learner, least):
    learner.set_params(label_col="two")
    assert learner.fit(train).score(test) > least
    assert learner.score(test) == learner.model_.score(test)


def test_three_classes(train, test):
    assert dl.LogisticRegression(max_iter=200, label_col="three").fit(train).score(test) > 0.5
    assert dl.SVC(C=10.0, label_col="three", n_landmarks=100).fit(train).score(test) > 0.5


def test_text_labels(train, test):
    named = train.withColumn("name", F.when(F.col("two") == 1, "yes").otherwise("no"))
    model = dl.LogisticRegression(label_col="name").fit(named)
    assert {r[0] for r in model.predict(test).select("prediction").distinct().collect()} == {"yes", "no"}
    p = column(model.predict_proba(test), "probability")
    assert np.allclose(p.sum(axis=1), 1.0)


def test_solvers_agree_with_closed_forms(train):
    x, y = column(train, "features"), column(train, "label")
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(20), xc.T @ yc)
    assert np.allclose(dl.Ridge(alpha=5.0).fit(train).state["coef"], w, atol=1e-9)
    a = dl.ElasticNet(alpha=0.1, l1_ratio=0.3).fit(train).state["coef"]
    b = dl.ElasticNet(alpha=0.1, l1_ratio=0.3, solver="cd").fit(train).state["coef"]
    assert np.allclose(a, b, atol=1e-6)


def test_svc_is_near_the_hinge_optimum(train):
    x, y = column(train, "features"), np.where(column(train, "two") == 1, 1.0, -1.0)
    model = dl.SVC(kernel="linear", label_col="two", smoothing=0.02).fit(train)
    w, b = model.state["coef"][0], model.state["intercept"][0]

    def cost(w, b):
        return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w + b)).sum()

    base, rng = cost(w, b), np.random.default_rng(0)
    for size in (0.3, 0.1, 0.03):
        for _ in range(50):
            assert cost(w + size * rng.normal(size=20), b + size * rng.normal()) > base * 0.99


def test_kmeans(blobs):
    km = dl.KMeans(n_clusters=3, random_state=0)
    out = km.fit_predict(blobs)
    assert out.select("prediction").distinct().count() == 3
    assert out.groupBy("blob").agg(F.countDistinct("prediction").alias("n")).where("n > 1").count() == 0
    fresh = make_blobs(50, seed=5, spark=blobs.sparkSession)
    assert km.predict(fresh).where("prediction not in (0, 1, 2)").count() == 0
    assert km.score(blobs) == pytest.approx(-km.model_.state["cost"], rel=1e-6)


def test_dbscan(blobs):
    out = dl.DBSCAN(eps=3.0, min_samples=5).fit_predict(blobs)
    assert out.where("prediction >= 0").select("prediction").distinct().count() >= 1
    assert out.where("prediction < -1").count() == 0


def test_nearest_neighbors_shapes(train, test):
    nn = dl.NearestNeighbors(n_neighbors=5)
    nn.fit(train)
    wide = nn.kneighbors(test.limit(20), n_neighbors=3, wide=True).collect()
    assert len(wide) == 20 and all(len(r["distances"]) == len(r["indices"]) == 3 and min(r["distances"]) >= 0 for r in wide)
    assert nn.kneighbors(test.limit(2), return_distance=False).columns == ["query_id", "rank", "neighbor_id"]


def test_maps_keep_blobs_together(spark):
    tiny = make_blobs(150, spark=spark)
    for learner in (dl.UMAP(max_iter=15, random_state=42), dl.TSNE(max_iter=30, perplexity=10.0, random_state=42)):
        out = learner.fit_transform(tiny).orderBy("id").select("embedding", "blob").collect()
        y, blob = np.array([r[0] for r in out]), np.array([r[1] for r in out])
        assert y.shape == (150, 2) and np.isfinite(y).all()
        gaps = ((y[:, None] - y[None]) ** 2).sum(-1)
        np.fill_diagonal(gaps, np.inf)
        assert (blob[gaps.argmin(axis=1)] == blob).mean() > 0.8
        if isinstance(learner, dl.UMAP):
            fresh = make_blobs(20, seed=9, spark=spark).withColumn("id", F.col("id") + 1000)
            assert learner.transform(fresh).count() == 20


def test_chain(train, test):
    chain = Pipeline(stages=[dl.StandardScaler(), dl.LogisticRegression(features_col="scaled", label_col="two", max_iter=300)])
    out = chain.fit(train).transform(test)
    assert out.agg(F.avg((F.col("two") == F.col("prediction")).cast("double"))).head()[0] > 0.7


def test_repeated_scoring_sees_its_own_input(spark, train):
    model = dl.StandardScaler().fit(train)
    means = []
    for i in range(1, 6):
        probe = spark.range(100).select("id", F.array_repeat(F.lit(float(i)), 20).alias("features"))
        means.append(column(model.transform(probe), "scaled").mean())
    assert (np.diff(means) > 0.5).all()
