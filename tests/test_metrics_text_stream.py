import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import distlearn as dl
from conftest import SMALL
from distlearn.operators import metrics
from distlearn.sources.tables import stream_of, table
from distlearn.streaming.online import OnlineRegression
from distlearn.streaming.scoring import register, score_stream


def test_classification_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report[0]["precision"] == 5 / 6 and report[0]["recall"] == 5 / 7 and report[2]["f1"] == 0.0
    assert metrics.accuracy(df) == 8 / 11
    f = [2 * 5 / 13, 2 * 3 / 8, 0.0]
    assert metrics.f1_score(df) == pytest.approx(np.mean(f))
    assert metrics.f1_score(df, average="weighted") == pytest.approx((f[0] * 7 + f[1] * 3) / 11)


def test_roc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.1)], "label int, score double")
    pos, neg = [0.9, 0.8, 0.1], [0.8, 0.1]
    wins = np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    assert metrics.roc_auc(df) == pytest.approx(wins)
    last = metrics.roc_curve(df).orderBy("threshold").head()
    assert (last["false_positive_rate"], last["true_positive_rate"]) == (1.0, 1.0)
    with pytest.raises(ValueError):
        metrics.roc_auc(df.where("label = 1"))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")
    assert metrics.mean_squared_error(df) == pytest.approx(1.25 / 3)
    assert metrics.mean_absolute_error(df) == pytest.approx(0.5)
    assert metrics.r2_score(df) == pytest.approx(1 - 1.25 / (14 / 3))


def test_text_vectors(spark):
    df = spark.createDataFrame([(0, "Red fox, red DOG"), (1, "fox a"), (2, None)], "id long, text string")
    model = dl.CountVectorizer().fit(df)
    assert sorted(model.vocabulary) == ["dog", "fox", "red"]
    counts = {r["id"]: r["features"].sum() if hasattr(r["features"], "sum") else r["features"].toArray().sum() for r in model.transform(df).collect()}
    assert counts == {0: 4.0, 1: 1.0, 2: 0.0}
    weighted = dl.TfidfVectorizer().fit(df)
    at = weighted.vocabulary.index("red")
    assert weighted.transform(df).where("id = 0").head()["features"][at] == pytest.approx(2 * np.log(4 / 2))
    grams = dl.CountVectorizer(ngram=2).fit(df)
    assert sorted(grams.vocabulary) == ["fox red", "red dog", "red fox"]


def test_stream_scoring_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    model = dl.MinMaxScaler(features_col=["value"]).fit(table(spark, SMALL, "events"))
    score_stream(model, stream_of(spark, SMALL, "events"), folder + "/out", folder + "/progress", ["event_id", "scaled"])
    batch = model.transform(table(spark, SMALL, "events")).select("event_id", "scaled")
    stream = spark.read.parquet(folder + "/out")
    assert stream.count() == batch.count() and batch.exceptAll(stream).count() == 0


def test_online_training_is_replay_safe(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    rows = spark.range(200).select((F.col("id") / 100.0).alias("x"), (F.col("id") / 50.0 + 1).alias("y"))
    trainer = OnlineRegression(spark, folder, ["x"], "y", rate=0.3)
    for batch in range(4):
        trainer.step(rows, batch)
    first = trainer.model().state
    trainer.step(rows, 3)
    assert np.allclose(trainer.model().state["coef"], first["coef"])
    assert trainer.model().predict(rows).count() == 200


def test_sql_functions(spark, gauss):
    gauss.createOrReplaceTempView("gauss_rows")
    for learner in (dl.LinearRegression(), dl.SVR(n_landmarks=20), dl.KMeans(n_clusters=2)):
        model = learner.fit(gauss)
        register(spark, model, "score_rows")
        by_sql = spark.sql("SELECT id, CAST(score_rows(features) AS DOUBLE) AS p FROM gauss_rows")
        both = by_sql.join(model.predict(gauss).select("id", "prediction"), "id")
        assert both.where(F.abs(F.col("p") - F.col("prediction")) > 1e-9).count() == 0
    register(spark, dl.PCA(n_components=2).fit(gauss), "axes")
    assert spark.sql("SELECT size(axes(features)) AS n FROM gauss_rows").distinct().collect()[0]["n"] == 2


def test_sums_of_sparse_vectors_do_not_spread_them_out(spark):
    """A vector as long as a vocabulary of two billion words holds three numbers."""
    from pyspark.ml.linalg import Vectors

    from distlearn.queries import _vector_sums

    df = spark.createDataFrame([(0, Vectors.sparse(2_000_000_000, [1, 5, 1_999_999_999], [1.0, 2.0, 4.0])), (1, Vectors.sparse(9, [], [])), (2, Vectors.dense([1.0, 2.5]))], ["id", "features"])
    assert {r["id"]: r["s"] for r in df.select("id", _vector_sums(df).alias("s")).collect()} == {0: 7.0, 1: 0.0, 2: 3.5}


@pytest.mark.parametrize("options", [{}, {"ngram": 2}, {"min_df": 2.0}, {"max_features": 3}])
def test_vectors_of_a_vocabulary_that_is_a_table(spark, monkeypatch, options):
    """A large text's words never reach the driver; vectors are those of the vocabulary it would hold."""
    from distlearn.operators import text

    texts = ["Red fox, red DOG", "fox a", None, "red fox red dog red", "Red fox, red DOG", "", "zebra dog dog red"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for make in (dl.CountVectorizer, dl.TfidfVectorizer):
        held = make(**options).fit(df)
        with monkeypatch.context() as patched:
            patched.setattr(text, "DRIVER_CHARACTERS", 0)
            model = make(**options).fit(df)
        assert not model.native and len(model.vocabulary) == len(held.vocabulary)

        def named(m):
            words = m.vocabulary
            return {r["id"]: {words[i]: pytest.approx(v) for i, v in zip(r["features"].indices, r["features"].values)} for r in m.transform(df).collect()}

        if "max_features" not in options:
            assert named(model) == named(held)
        assert sorted(named(model)) == list(range(7)) and model.transform(df).columns == held.transform(df).columns
