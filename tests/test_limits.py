"""No cap drops data: plan limits change plans only, and what cannot be done is refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import distlearn as dl
from distlearn.operators import metrics
from distlearn.operators.datasets import make_gaussian, make_regression
from distlearn.operators.text import CountVectorizer, token_counts
from distlearn.plans import cells, gram, nearest, skew
from distlearn.streaming.scoring import register


def copies(spark, n):
    return spark.range(n).withColumn("features", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)))


def test_all_copies_stay_reachable(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(nearest, "COLLAPSE_ROWS", 100)
    monkeypatch.setattr(nearest, "COPIES", 10)
    df = copies(spark, 600)
    model = dl.NearestNeighbors(n_neighbors=2, cell_rows=50).fit(df)
    assert model.state["total"] == 600 and model.tables["points"].count() < 600
    store = dl.ModelStore(spark, str(tmp_path))
    store.save(model, "near")
    for m in (model, store.load("near")):
        found = m.kneighbors(df.where("id = 0"), n_neighbors=300).orderBy("rank").collect()
        assert len(found) == 300 and [r["neighbor_id"] for r in found[:200]] == list(range(0, 600, 3))


def test_landmarks_are_given_or_refused(spark, monkeypatch):
    df = make_regression(300, 5, spark=spark)
    model = dl.SVR(n_landmarks=64).fit(df)
    assert len(model.state["landmarks"]) == 64
    monkeypatch.setattr(cells, "DRAWN_VALUES", 100)
    with pytest.raises(ValueError, match="ask for fewer"):
        dl.SVR(n_landmarks=64).fit(df)
    assert cells.draw_rows(df.select(F.col("features").alias("x")), 64, 300).shape == (20, 5)  # pivots: fewer


def test_more_than_a_thousand_classes(spark):
    df = spark.range(2400).select("id", (F.col("id") % 1200).alias("label"), F.array((F.col("id") % 1200).cast("double")).alias("features"))
    model = dl.KNeighborsClassifier(n_neighbors=1).fit(df)
    assert model.score(df) == 1.0
    assert len(dl.RandomForestClassifier(n_estimators=1, max_depth=2).fit(df).state["classes"]) == 1200


@pytest.mark.parametrize("operator", [dl.PCA, dl.TruncatedSVD], ids=lambda o: o.__name__)
def test_wide_decomposition(spark, monkeypatch, operator):
    df = make_gaussian(400, 30, spark=spark).withColumn("features", F.transform("features", lambda v, j: v * (j + 1) * (j + 1)))
    narrow = operator(n_components=3).fit(df)
    monkeypatch.setattr(gram, "MAX_GRAM_WIDTH", 10)
    monkeypatch.setattr("distlearn.operators.decomposition.MAX_GRAM_WIDTH", 10)
    wide = operator(n_components=3).fit(df)
    assert np.allclose(narrow.state["components"], wide.state["components"], atol=1e-4)
    for name in {"singular_values", "explained_variance_ratio"} & wide.state.keys():
        assert np.allclose(narrow.state[name], wide.state[name], rtol=1e-6)


def test_vocabulary_is_whole(spark):
    df = spark.createDataFrame([(1, "aa bb bb cc dd ee")], "id long, text string")
    assert CountVectorizer().fit(df).vocabulary[0] == "bb" and len(CountVectorizer().fit(df).vocabulary) == 5
    assert len(CountVectorizer(max_features=2).fit(df).vocabulary) == 2


def test_hot_id_in_token_counts(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("id"), F.lit("aa bb").alias("text"))
    got = {(r["id"], r["token"]): r["n"] for r in token_counts(df, "id", "text").collect()}
    assert got[7, "aa"] == 900 and len(got) == 202
    assert "Partial" in token_counts(df, "id", "text")._jdf.queryExecution().toString() or "partial_count" in token_counts(df, "id", "text")._jdf.queryExecution().toString()


def test_hot_join_with_a_long_list(spark, monkeypatch):
    left = spark.range(3000).select((F.col("id") % 30).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    plain = sorted(map(tuple, left.join(right.drop("n"), "k").collect()))
    for listed in (100_000, 5):
        monkeypatch.setattr(skew, "LISTED_KEYS", listed)
        got = skew.hot_join(left, right, "k", "n", F.xxhash64("id"), hot_rows=20)
        assert sorted(map(tuple, got.select("k", "id", "s").collect())) == plain


REGRESSORS = [dl.LinearRegression(), dl.Ridge(), dl.Lasso(solver="cd"), dl.MBSGDRegressor(epochs=3), dl.SVR(n_landmarks=8)]
CLASSIFIERS = [dl.LogisticRegression(), dl.MBSGDClassifier(epochs=3), dl.SVC(n_landmarks=8), dl.RandomForestClassifier(n_estimators=2)]


@pytest.mark.parametrize("learner", REGRESSORS + CLASSIFIERS, ids=lambda v: type(v).__name__)
def test_null_labels(spark, learner):
    label = (F.col("id") % 2).cast("int") if learner in CLASSIFIERS else F.col("label")
    df = make_regression(120, 3, spark=spark).withColumn("label", F.when(F.col("id") != 5, label))
    with pytest.raises(Exception, match="null in label"):
        learner.copy().fit(df)
    fitted = learner.copy().set_params(handle_invalid="skip").fit(df)
    assert fitted.predict(df).count() == 120


def test_encoder_skips_nulls_both_times(spark):
    df = spark.createDataFrame([("b", {"x": 1}), (None, {}), ("a", None)], "label string, m map<string,int>")
    out = dl.LabelEncoder(handle_invalid="skip").fit_transform(df)
    assert sorted((r["label"], r["code"]) for r in out.collect()) == [("a", 0), ("b", 1)]
    model = dl.LabelEncoder().fit(df)
    with pytest.raises(Exception, match="null; handle_invalid"):
        model.transform(df).collect()


def test_report_of_a_constant_label(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert metrics.regression_report(df).head()["r2"] == 0.0
    assert metrics.regression_report(df.where("prediction = 1")).head()["r2"] == 1.0


def test_batches_do_not_change_bits(spark):
    df = make_regression(300, 5, spark=spark).cache()
    model = dl.SVR(n_landmarks=40).fit(df)
    whole = {r["id"]: r["prediction"] for r in model.transform(df.coalesce(1)).collect()}
    for part in (df.repartition(7), df.limit(50), df.where("id % 3 = 0")):
        assert all(whole[r["id"]] == r["prediction"] for r in model.transform(part).collect())


def test_classifiers_in_sql(spark):
    df = make_gaussian(200, 3, spark=spark).withColumn("label", (F.col("features")[0] > 0).cast("int")).cache()
    for learner in (dl.LogisticRegression(), dl.SVC(n_landmarks=20), dl.MBSGDClassifier(epochs=5)):
        model = learner.fit(df)
        register(spark, model, "label_of")
        want = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
        assert {r["id"]: int(r["p"]) for r in df.selectExpr("id", "label_of(features) AS p").collect()} == want


def test_neighbour_probabilities(spark):
    df = spark.createDataFrame([(0, [0.0], "a"), (1, [0.1], "a"), (2, [0.2], "b"), (3, [9.0], "c")], "id long, features array<double>, label string")
    model = dl.KNeighborsClassifier(n_neighbors=3, output_col="p").fit(df)
    row = model.predict_proba(df.where("id = 0")).head()
    assert np.allclose(row["p"], [2 / 3, 1 / 3, 0])


def test_wide_directions_meet_their_residual_or_raise(spark, monkeypatch):
    """Uniform rows have a flat spectrum, where neighbouring directions are hard to tell apart."""
    monkeypatch.setattr(gram, "BASIS_NUMBERS", 300 * 100)  # restarts after five blocks
    df = make_gaussian(800, 300, kind="uniform", spark=spark).cache()
    x = np.array([r["features"] for r in df.select("features").collect()])
    mean = x.mean(axis=0)
    scatter = (x - mean).T @ (x - mean)
    values, vectors = gram.leading_subspace(df, F.col("features"), 300, 10, mean)
    assert np.linalg.norm(scatter @ vectors.T - vectors.T * values, axis=0).max() <= 1e-6 * values[0]
    assert np.allclose(values, np.linalg.eigvalsh(scatter)[::-1][:10], rtol=1e-9)
    with pytest.raises(ValueError, match="residual"):
        gram.leading_subspace(df, F.col("features"), 300, 10, mean, passes=2)
