"""Queries over the driver's tables, one per operator, with equal SQL where SQL can say it.

Every query reads whole tables. Values are rounded on both sides, far coarser than the
float noise of summing in another order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import metrics
from .operators.clustering import DBSCAN, KMeans
from .operators.datasets import make_blobs, make_classification, make_gaussian, make_nonnegative, make_regression
from .operators.decomposition import PCA, GaussianRandomProjection, SparseRandomProjection, TruncatedSVD
from .operators.forest import RandomForestClassifier, RandomForestRegressor
from .operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge
from .operators.manifold import TSNE, UMAP
from .operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors
from .operators.preprocessing import LabelEncoder, MinMaxScaler, StandardScaler
from .operators.selection import GridSearch, cross_val_score, train_test_split
from .operators.sgd import MBSGDClassifier, MBSGDRegressor
from .operators.svm import SVC, SVR
from .operators.text import TOKEN, CountVectorizer, HashingVectorizer, TfidfVectorizer, tf_idf, token_counts
from .plans.lineage import shared_folder
from .sources.store import ModelStore
from .sources.tables import stream_of, table
from .streaming.online import OnlineRegression
from .streaming.scoring import register, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def rounded(column: Column | str, digits: int, name: str) -> Column:
    """Rounded double without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.round(column, digits) + F.lit(0.0)).alias(name)


def sql_round(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


def scratch(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/distlearn/{kind}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- scalers and encoder

PART = ["p_size", "p_retailprice"]


def _scaled_part(spark: SparkSession, folder: str, *features: str) -> DataFrame:
    return StandardScaler(features_col=list(features)).fit_transform(table(spark, folder, "part"))


def sql_scaled(source: str, column: str) -> str:
    return f"({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER ()"


@query(
    "standard_scaler",
    f"""SELECT p_partkey, {sql_round(sql_scaled('part', 'p_size'), 6, 'size_scaled')},
    {sql_round(sql_scaled('part', 'p_retailprice'), 6, 'price_scaled')} FROM part""",
)
def standard_scaler(spark, folder):
    df = _scaled_part(spark, folder, *PART)
    return df.select("p_partkey", rounded(F.col("scaled")[0], 6, "size_scaled"), rounded(F.col("scaled")[1], 6, "price_scaled"))


@query(
    "standard_scaler_wide",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
    SELECT vec_id, pos, round((v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos), 6) + 0.0 AS value
    FROM e""",
)
def standard_scaler_wide(spark, folder):
    df = StandardScaler(features_col="embedding").fit_transform(table(spark, folder, "embeddings"))
    long = df.select("vec_id", F.posexplode("scaled").alias("pos", "v"))
    return long.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded("v", 6, "value"))


@query(
    "standard_scaler_inverse",
    "SELECT p_partkey, round(p_size::DOUBLE, 6) AS size_back, round(p_retailprice, 6) AS price_back FROM part",
)
def standard_scaler_inverse(spark, folder):
    scaler = StandardScaler(features_col=PART)
    df = scaler.inverse_transform(scaler.fit_transform(table(spark, folder, "part")))
    return df.select("p_partkey", rounded(F.col("restored")[0], 6, "size_back"), rounded(F.col("restored")[1], 6, "price_back"))


@query(
    "minmax_scaler",
    f"""SELECT o_orderkey,
    {sql_round('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())', 6, 'price_scaled')},
    {sql_round('(o_custkey - min(o_custkey) OVER ()) / (max(o_custkey) OVER () - min(o_custkey) OVER ())::DOUBLE', 6, 'cust_scaled')}
    FROM orders""",
)
def minmax_scaler(spark, folder):
    df = MinMaxScaler(features_col=["o_totalprice", "o_custkey"]).fit_transform(table(spark, folder, "orders"))
    return df.select("o_orderkey", rounded(F.col("scaled")[0], 6, "price_scaled"), rounded(F.col("scaled")[1], 6, "cust_scaled"))


@query("minmax_scaler_inverse", "SELECT o_orderkey, round(o_totalprice, 4) AS price_back FROM orders")
def minmax_scaler_inverse(spark, folder):
    scaler = MinMaxScaler(features_col=["o_totalprice"], feature_range=[-1.0, 1.0])
    df = scaler.inverse_transform(scaler.fit_transform(table(spark, folder, "orders")))
    return df.select("o_orderkey", rounded(F.col("restored")[0], 4, "price_back"))


@query("label_encoder", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
def label_encoder(spark, folder):
    df = LabelEncoder(label_col="c_mktsegment").fit_transform(table(spark, folder, "customer"))
    return df.select("c_custkey", "code")


@query("label_encoder_numbers", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS code FROM orders")
def label_encoder_numbers(spark, folder):
    df = LabelEncoder(label_col="o_custkey").fit_transform(table(spark, folder, "orders"))
    return df.select("o_orderkey", "code")


@query("label_encoder_inverse", "SELECT o_orderkey, o_orderpriority AS restored FROM orders")
def label_encoder_inverse(spark, folder):
    encoder = LabelEncoder(label_col="o_orderpriority")
    return encoder.inverse_transform(encoder.fit_transform(table(spark, folder, "orders"))).select("o_orderkey", "restored")


# ---------------------------------------------------------------- linear models

TWO = ["p_size", "p_partkey"]
MOMENTS = """m AS (SELECT count(*) AS n, avg(p_size) AS m1, avg(p_partkey) AS m2, avg(p_retailprice) AS my,
    var_pop(p_size) AS a11, var_pop(p_partkey) AS a22, covar_pop(p_size, p_partkey) AS a12,
    covar_pop(p_size, p_retailprice) AS b1, covar_pop(p_partkey, p_retailprice) AS b2 FROM part)"""


def sql_ridge(l2: str) -> str:
    """Two-feature ridge by Cramer's rule; l2 is the penalty per row."""
    return f"""WITH {MOMENTS}, r AS (SELECT *, (a11 + {l2}) * (a22 + {l2}) - a12 * a12 AS det FROM m),
    w AS (SELECT *, (b1 * (a22 + {l2}) - b2 * a12) / det AS w1, (b2 * (a11 + {l2}) - b1 * a12) / det AS w2 FROM r)
    SELECT p_partkey, round(my + w1 * (p_size - m1) + w2 * (p_partkey - m2), 3) + 0.0 AS prediction FROM part, w"""


def sql_descent(l1: float, l2: float) -> str:
    """Two-feature coordinate descent on the centred moments, 300 rounds."""
    soft = lambda e, a: f"(sign({e}) * greatest(abs({e}) - {l1}, 0) / ({a} + {l2}))"
    return f"""WITH RECURSIVE {MOMENTS}, w AS (SELECT 0 AS i, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 UNION ALL
    SELECT i + 1, v1, {soft('(b2 - a12 * v1)', 'a22')} FROM
    (SELECT i, a12, a22, b2, {soft('(b1 - a12 * w2)', 'a11')} AS v1 FROM w, m WHERE i < 300) AS step)
    SELECT p_partkey, round(my + w1 * (p_size - m1) + w2 * (p_partkey - m2), 3) + 0.0 AS prediction
    FROM part, m, (SELECT * FROM w WHERE i = 300) AS last"""


def _part_predictions(learner, spark, folder):
    part = table(spark, folder, "part")
    learner.set_params(features_col=TWO, label_col="p_retailprice")
    return learner.fit(part).predict(part).select("p_partkey", rounded("prediction", 3, "prediction"))


CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query(
    "linear_regression",
    f"""WITH l AS (SELECT {CHARGE} AS y, l_extendedprice AS x1, l_quantity AS x2 FROM lineitem),
    m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS a11, var_pop(x2) AS a22,
    covar_pop(x1, x2) AS a12, covar_pop(x1, y) AS b1, covar_pop(x2, y) AS b2, var_pop(y) AS vy FROM l),
    w AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
    (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM m)
    SELECT round(w1, 6) + 0.0 AS price_coef, round(w2, 3) + 0.0 AS quantity_coef,
    round(my - w1 * m1 - w2 * m2, 2) + 0.0 AS intercept, round((w1 * b1 + w2 * b2) / vy, 6) + 0.0 AS r2 FROM w""",
)
def linear_regression(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        "l_extendedprice", "l_quantity",
    )
    model = LinearRegression(features_col=["l_extendedprice", "l_quantity"], label_col="charge").fit(rows)
    (w1, w2), b = model.state["coef"], model.state["intercept"]
    scored = metrics.regression_report(model.predict(rows), "charge")
    return scored.select(
        rounded(F.lit(float(w1)), 6, "price_coef"), rounded(F.lit(float(w2)), 3, "quantity_coef"),
        rounded(F.lit(float(b)), 2, "intercept"), rounded("r2", 6, "r2"),
    )


@query("linear_regression_predict", sql_ridge("0"))
def linear_regression_predict(spark, folder):
    return _part_predictions(LinearRegression(), spark, folder)


@query("ridge", sql_ridge("50000.0 / n"))
def ridge(spark, folder):
    return _part_predictions(Ridge(alpha=50000.0), spark, folder)


@query("lasso", sql_descent(200.0, 0.0))
def lasso(spark, folder):
    return _part_predictions(Lasso(alpha=200.0), spark, folder)


@query("lasso_coordinate_descent", sql_descent(200.0, 0.0))
def lasso_coordinate_descent(spark, folder):
    return _part_predictions(Lasso(alpha=200.0, solver="cd"), spark, folder)


@query("elasticnet", sql_descent(0.5 * 0.4, 0.5 * 0.6))
def elasticnet(spark, folder):
    return _part_predictions(ElasticNet(alpha=0.5, l1_ratio=0.4), spark, folder)


@query("elasticnet_coordinate_descent", sql_descent(0.5 * 0.4, 0.5 * 0.6))
def elasticnet_coordinate_descent(spark, folder):
    return _part_predictions(ElasticNet(alpha=0.5, l1_ratio=0.4, solver="cd"), spark, folder)


SCALED = f"""s AS (SELECT p_partkey, {sql_scaled('part', 'p_size')} AS x1, {sql_scaled('part', 'p_partkey')} AS x2,
    CASE WHEN p_retailprice > avg(p_retailprice) OVER () THEN 1 ELSE 0 END AS y, p_retailprice AS t FROM part)"""


def sql_solve3(h: dict[str, str], g: tuple[str, str, str]) -> list[str]:
    """Cramer's rule for a symmetric 3 x 3 system with named entries."""
    rows = [[h["00"], h["01"], h["02"]], [h["01"], h["11"], h["12"]], [h["02"], h["12"], h["22"]]]

    def det(m):
        return (
            f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]})"
            f" - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
            f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
        )

    whole, out = det(rows), []
    for j in range(3):
        swapped = [[g[i] if c == j else rows[i][c] for c in range(3)] for i in range(3)]
        out.append(f"({det(swapped)} / {whole})")
    return out


def sql_logistic(c: float) -> str:
    """Newton rounds for two scaled features; leaves the last round in table ``last``."""
    step = sql_solve3({k: f"h{k}" for k in ("00", "01", "02", "11", "12", "22")}, ("g0", "g1", "g2"))
    return f"""WITH RECURSIVE {SCALED}, newton AS (
    SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
    SELECT i + 1, b0 - {step[0]}, b1 - {step[1]}, b2 - {step[2]} FROM (
      SELECT i, b0, b1, b2, {c} * sum(p - y) AS g0, {c} * sum((p - y) * x1) + b1 AS g1, {c} * sum((p - y) * x2) + b2 AS g2,
      {c} * sum(p * (1 - p)) AS h00, {c} * sum(p * (1 - p) * x1) AS h01, {c} * sum(p * (1 - p) * x2) AS h02,
      {c} * sum(p * (1 - p) * x1 * x1) + 1 AS h11, {c} * sum(p * (1 - p) * x1 * x2) AS h12,
      {c} * sum(p * (1 - p) * x2 * x2) + 1 AS h22
      FROM (SELECT n.*, s.*, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM newton AS n, s WHERE i < 12) AS d
      GROUP BY i, b0, b1, b2) AS sums), last AS (SELECT * FROM newton WHERE i = 12) """


def _flagged(df: DataFrame) -> DataFrame:
    """Above or below the average price."""
    mean = df.agg(F.avg("p_retailprice")).head()[0]
    return df.withColumn("high", (F.col("p_retailprice") > F.lit(mean)).cast("int"))


@query(
    "logistic_regression",
    sql_logistic(0.1) + "SELECT round(b0, 4) + 0.0 AS intercept, round(b1, 4) + 0.0 AS size_coef, round(b2, 4) + 0.0 AS key_coef FROM last",
)
def logistic_regression(spark, folder):
    rows = _flagged(_scaled_part(spark, folder, *TWO))
    model = LogisticRegression(features_col="scaled", label_col="high", C=0.1, tol=1e-12).fit(rows)
    (w1, w2), b = model.state["coef"][0], model.state["intercept"][0]
    return rows.select("p_partkey").agg(F.count(F.lit(1))).select(
        rounded(F.lit(float(b)), 4, "intercept"), rounded(F.lit(float(w1)), 4, "size_coef"), rounded(F.lit(float(w2)), 4, "key_coef")
    )


def scaler_logistic_chain() -> Pipeline:
    return Pipeline(
        stages=[
            StandardScaler(features_col=TWO),
            LogisticRegression(features_col="scaled", label_col="high", C=0.1, tol=1e-12),
        ]
    )


@query(
    "chain_scaler_logistic",
    sql_logistic(0.1) + "SELECT p_partkey, CASE WHEN b0 + b1 * x1 + b2 * x2 > 0 THEN 1 ELSE 0 END AS prediction FROM s, last",
)
def chain_scaler_logistic(spark, folder):
    rows = _flagged(table(spark, folder, "part"))
    return scaler_logistic_chain().fit(rows).transform(rows).select("p_partkey", "prediction")


def sql_multinomial(c: float, steps: int) -> str:
    """Gradient descent on the penalised softmax loss: three classes, two scaled features and an intercept."""
    names = [f"w{k}{j}" for k in range(3) for j in range(3)]  # class k; j = 0 is the intercept
    xs = ("1", "x1", "x2")
    margin = [f"w{k}0 + w{k}1 * x1 + w{k}2 * x2 AS f{k}" for k in range(3)]
    soft = [f"exp(f{k} - greatest(f0, f1, f2)) / (exp(f0 - greatest(f0, f1, f2)) + exp(f1 - greatest(f0, f1, f2)) + exp(f2 - greatest(f0, f1, f2))) AS p{k}" for k in range(3)]
    moves = []
    for k in range(3):
        for j in range(3):
            decay = f" + w{k}{j}" if j else ""
            moves.append(f"w{k}{j} - ({c} * sum((p{k} - CASE WHEN y = {k} THEN 1 ELSE 0 END) * {xs[j]}){decay}) / ({c} * count(*) + 1)")
    return f"""WITH RECURSIVE s AS (SELECT p_partkey, {sql_scaled('part', 'p_size')} AS x1, {sql_scaled('part', 'p_partkey')} AS x2,
    CASE WHEN gap > 0.5 THEN 2 WHEN gap > -0.5 THEN 1 ELSE 0 END AS y
    FROM (SELECT *, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS gap FROM part) AS part),
    w AS (SELECT 0 AS i, {', '.join(f'0.0::DOUBLE AS {n}' for n in names)} UNION ALL
    SELECT i + 1, {', '.join(moves)} FROM (SELECT *, {', '.join(soft)} FROM
      (SELECT w.*, x1, x2, y, {', '.join(margin)} FROM w, s WHERE i < {steps}) AS a) AS b GROUP BY i, {', '.join(names)}),
    last AS (SELECT * FROM w WHERE i = {steps})
    SELECT p_partkey, y AS band, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 >= f2 THEN 1 ELSE 2 END AS prediction
    FROM (SELECT s.*, {', '.join(margin)} FROM s, last) AS t"""


@query("logistic_multinomial", sql_multinomial(0.01, 600))
def logistic_multinomial(spark, folder):
    rows = _scaled_part(spark, folder, *TWO)
    stats = rows.agg(F.avg("p_retailprice").alias("mean"), F.stddev("p_retailprice").alias("sd")).head()
    gap = (F.col("p_retailprice") - F.lit(stats["mean"])) / F.lit(stats["sd"])
    rows = rows.withColumn("band", F.when(gap > 0.5, 2).when(gap > -0.5, 1).otherwise(0))
    model = LogisticRegression(features_col="scaled", label_col="band", C=0.01, tol=1e-12).fit(rows)
    return model.predict(rows).select("p_partkey", "band", "prediction")


STEPS, RATE, DECAY = 20, 0.1, 0.01


def sql_descend(slope: str, y: str) -> str:
    """Full-batch gradient steps with an L2 penalty on the weights."""
    return f"""WITH RECURSIVE {SCALED}, w AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
    SELECT i + 1, b0 - {RATE} * avg(g), b1 - {RATE} * (avg(g * x1) + {DECAY} * b1), b2 - {RATE} * (avg(g * x2) + {DECAY} * b2)
    FROM (SELECT i, b0, b1, b2, x1, x2, {slope} AS g FROM
      (SELECT w.*, x1, x2, {y} AS z, b0 + b1 * x1 + b2 * x2 AS f FROM w, s WHERE i < {STEPS}) AS a) AS d
    GROUP BY i, b0, b1, b2), last AS (SELECT * FROM w WHERE i = {STEPS}) """


SGD_SETTINGS = {"features_col": "scaled", "epochs": STEPS, "eta0": RATE, "alpha": DECAY, "tol": 0.0, "n_iter_no_change": STEPS}


@query(
    "sgd_regressor",
    sql_descend("f - z", "t") + "SELECT p_partkey, round(b0 + b1 * x1 + b2 * x2, 4) + 0.0 AS prediction FROM s, last",
)
def sgd_regressor(spark, folder):
    rows = _scaled_part(spark, folder, *TWO)
    model = MBSGDRegressor(label_col="p_retailprice", **SGD_SETTINGS).fit(rows)
    return model.predict(rows).select("p_partkey", rounded("prediction", 4, "prediction"))


@query(
    "sgd_classifier",
    sql_descend("CASE WHEN z * f < 1 THEN -z ELSE 0 END", "2 * y - 1")
    + "SELECT p_partkey, CASE WHEN b0 + b1 * x1 + b2 * x2 > 0 THEN 1 ELSE 0 END AS prediction FROM s, last",
)
def sgd_classifier(spark, folder):
    rows = _flagged(_scaled_part(spark, folder, *TWO))
    return MBSGDClassifier(label_col="high", **SGD_SETTINGS).fit(rows).predict(rows).select("p_partkey", "prediction")


@query("sql_score_classes", ORACLES["sgd_classifier"])
def sql_score_classes(spark, folder):
    """The same classifier, called from SQL."""
    rows = _flagged(_scaled_part(spark, folder, *TWO))
    register(spark, MBSGDClassifier(label_col="high", **SGD_SETTINGS).fit(rows), "is_high")
    return rows.selectExpr("p_partkey", "cast(is_high(scaled) AS int) AS prediction")


@query("sgd_classifier_minibatch")
def sgd_classifier_minibatch(spark, folder):
    rows = _flagged(_scaled_part(spark, folder, *TWO))
    rows_per_step = max(1, rows.count() // 4)
    model = MBSGDClassifier(
        features_col="scaled", label_col="high", id_col="p_partkey", loss="log", batch_size=rows_per_step
    ).fit(rows)
    return model.predict(rows).select("p_partkey", "high", "prediction")


# ---------------------------------------------------------------- kernel machines and forests


@query("svc")
def svc(spark, folder):
    rows = _flagged(_scaled_part(spark, folder, *TWO))
    model = SVC(kernel="rbf", C=10.0, features_col="scaled", label_col="high").fit(rows)
    return model.predict(rows).select("p_partkey", "high", "prediction")


@query("svr")
def svr(spark, folder):
    rows = _scaled_part(spark, folder, *TWO)
    model = SVR(kernel="rbf", C=10.0, features_col="scaled", label_col="p_retailprice").fit(rows)
    return model.predict(rows).select("p_partkey", "p_retailprice", "prediction")


def sql_svr(c: float, eps: float) -> str:
    """Active-set Newton for the squared epsilon-insensitive loss, two scaled features."""
    gap, sums = "(t - b0 - b1 * x1 - b2 * x2)", []
    on = f"(i = 0 OR abs{gap} > {eps})"
    target = f"(CASE WHEN i = 0 THEN t ELSE t - {eps} * sign{gap} END)"
    for name, e in {"h00": "1", "h01": "x1", "h02": "x2", "h11": "x1 * x1", "h12": "x1 * x2", "h22": "x2 * x2",
                    "g0": "z", "g1": "z * x1", "g2": "z * x2"}.items():
        extra = {"h11": " + 1", "h22": " + 1", "h00": " + 1e-12"}.get(name, "")
        sums.append(f"2 * {c} * sum(CASE WHEN a THEN {e} ELSE 0 END){extra} AS {name}")
    new = sql_solve3({k: f"h{k}" for k in ("00", "01", "02", "11", "12", "22")}, ("g0", "g1", "g2"))
    return f"""WITH RECURSIVE {SCALED}, newton AS (SELECT 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 UNION ALL
    SELECT i + 1, {new[0]}, {new[1]}, {new[2]} FROM (SELECT i, {', '.join(sums)} FROM
      (SELECT i, x1, x2, {on} AS a, {target} AS z FROM newton, s WHERE i < 15) AS d GROUP BY i) AS sums)
    SELECT p_partkey, round(b0 + b1 * x1 + b2 * x2, 3) + 0.0 AS prediction FROM s, (SELECT * FROM newton WHERE i = 15) AS last"""


@query("svr_linear", sql_svr(1.0, 5.0))
def svr_linear(spark, folder):
    rows = _scaled_part(spark, folder, *TWO)
    model = SVR(kernel="linear", C=1.0, epsilon=5.0, features_col="scaled", label_col="p_retailprice", tol=1e-12).fit(rows)
    return model.predict(rows).select("p_partkey", rounded("prediction", 3, "prediction"))


@query("random_forest_classifier")
def random_forest_classifier(spark, folder):
    rows = _flagged(table(spark, folder, "part"))
    model = RandomForestClassifier(features_col=TWO, label_col="high").fit(rows)
    return model.predict(rows).select("p_partkey", "high", "prediction")


@query("random_forest_regressor")
def random_forest_regressor(spark, folder):
    rows = table(spark, folder, "part")
    model = RandomForestRegressor(features_col=TWO, label_col="p_retailprice").fit(rows)
    return model.predict(rows).select("p_partkey", "p_retailprice", "prediction")


def sql_stump(source: str, y: str) -> str:
    """Means of ``y`` on both sides of the best split on p_size: the largest sum of squared sums over counts."""
    return f"""WITH p AS ({source}), v AS (SELECT p_size AS s, count(*) AS n, sum({y}) AS y FROM p GROUP BY 1),
    c AS (SELECT s, sum(n) OVER (ORDER BY s) AS ln, sum(y) OVER (ORDER BY s) AS ly, sum(n) OVER () AS tn, sum(y) OVER () AS ty FROM v),
    best AS (SELECT s, ly / ln AS low, (ty - ly) / (tn - ln) AS high_mean FROM c WHERE ln < tn
      ORDER BY ly * ly / ln + (ty - ly) * (ty - ly) / (tn - ln) DESC, s LIMIT 1)
    SELECT p_partkey, round(CASE WHEN p_size <= s THEN low ELSE high_mean END, 6) + 0.0 AS prediction FROM p, best"""


STUMP = {"n_estimators": 1, "bootstrap": False, "max_depth": 1, "max_features": "all", "features_col": ["p_size"]}
FLAGGED = "SELECT *, CASE WHEN p_retailprice > avg(p_retailprice) OVER () THEN 1 ELSE 0 END AS high FROM part"


@query("forest_stump_regressor", sql_stump("SELECT * FROM part", "p_retailprice"))
def forest_stump_regressor(spark, folder):
    rows = table(spark, folder, "part")
    model = RandomForestRegressor(label_col="p_retailprice", **STUMP).fit(rows)
    return model.predict(rows).select("p_partkey", rounded("prediction", 6, "prediction"))


@query("forest_stump_probability", sql_stump(FLAGGED, "high::DOUBLE"))
def forest_stump_probability(spark, folder):
    rows = _flagged(table(spark, folder, "part"))
    model = RandomForestClassifier(label_col="high", **STUMP).fit(rows)
    return model.predict_proba(rows).select("p_partkey", rounded(F.col("probability")[1], 6, "prediction"))


# ---------------------------------------------------------------- decomposition and projection


def sql_two_axes(a: str, b: str, c: str, x1: str, x2: str, moments: str) -> str:
    """Scores on the eigenvectors of [[a, b], [b, c]], largest loading positive."""
    return f"""WITH m AS (SELECT {moments}, {a} AS a, {b} AS b, {c} AS c FROM part),
    v AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS big FROM m),
    u AS (SELECT *, b / sqrt(b * b + (big - a) ** 2) AS u1, (big - a) / sqrt(b * b + (big - a) ** 2) AS u2 FROM v),
    e AS (SELECT *, CASE WHEN abs(u1) >= abs(u2) THEN sign(u1) ELSE sign(u2) END AS f,
    CASE WHEN abs(u2) >= abs(u1) THEN sign(-u2) ELSE sign(u1) END AS g FROM u)
    SELECT p_partkey, round(f * (u1 * {x1} + u2 * {x2}), 4) + 0.0 AS first_score,
    round(g * (-u2 * {x1} + u1 * {x2}), 4) + 0.0 AS second_score FROM part, e"""


def _scores(df: DataFrame) -> DataFrame:
    z = F.col("projected")
    return df.select("p_partkey", rounded(z[0], 4, "first_score"), rounded(z[1], 4, "second_score"))


@query(
    "pca",
    sql_two_axes("var_samp(p_size)", "covar_samp(p_size, p_retailprice)", "var_samp(p_retailprice)", "(p_size - m1)",
                 "(p_retailprice - m2)", "avg(p_size) AS m1, avg(p_retailprice) AS m2"),
)
def pca(spark, folder):
    return _scores(PCA(n_components=2, features_col=PART).fit_transform(table(spark, folder, "part")))


@query(
    "truncated_svd",
    sql_two_axes("sum(p_size * p_size)::DOUBLE", "sum(p_size * p_retailprice)", "sum(p_retailprice * p_retailprice)",
                 "p_size", "p_retailprice", "count(*) AS n"),
)
def truncated_svd(spark, folder):
    return _scores(TruncatedSVD(n_components=2, features_col=PART).fit_transform(table(spark, folder, "part")))


LONG_EMBEDDINGS = """SELECT vec_id, pos, round(v, 6) + 0.0 AS value
    FROM (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings) AS e"""


def _long(df: DataFrame, column: str) -> DataFrame:
    pairs = df.select("vec_id", F.posexplode(column).alias("pos", "v"))
    return pairs.select("vec_id", F.col("pos").cast("long").alias("pos"), rounded("v", 6, "value"))


@query("pca_inverse", LONG_EMBEDDINGS)
def pca_inverse(spark, folder):
    model = PCA(n_components=64, features_col="embedding")
    return _long(model.inverse_transform(model.fit_transform(table(spark, folder, "embeddings"))), "restored")


@query("truncated_svd_inverse", LONG_EMBEDDINGS)
def truncated_svd_inverse(spark, folder):
    model = TruncatedSVD(n_components=64, features_col="embedding")
    return _long(model.inverse_transform(model.fit_transform(table(spark, folder, "embeddings"))), "restored")


@query(
    "pca_variance",
    """WITH e AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
    SELECT round(sum(s), 6) + 0.0 AS total_variance FROM (SELECT var_samp(v) AS s FROM e GROUP BY pos) AS t""",
)
def pca_variance(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = PCA(n_components=64, features_col="embedding").fit(rows)
    return rows.agg(F.count(F.lit(1))).select(rounded(F.lit(float(model.state["explained_variance"].sum())), 6, "total_variance"))


def sql_projection(matrix: np.ndarray) -> str:
    picks = [
        f"round(list_dot_product(embedding::DOUBLE[], [{', '.join(repr(float(v)) for v in row)}]::DOUBLE[]), 6) + 0.0 AS z{j}"
        for j, row in enumerate(matrix)
    ]
    return f"SELECT vec_id, {', '.join(picks)} FROM embeddings"


GAUSSIAN = GaussianRandomProjection(n_components=4, features_col="embedding", random_state=7)
SPARSE = SparseRandomProjection(n_components=4, features_col="embedding", random_state=7)


def _projected(learner, spark, folder):
    df = learner.copy().fit_transform(table(spark, folder, "embeddings"))
    return df.select("vec_id", *[rounded(F.col("projected")[j], 6, f"z{j}") for j in range(4)])


@query("random_projection_gaussian", sql_projection(GAUSSIAN._matrix(4, 64)))
def random_projection_gaussian(spark, folder):
    return _projected(GAUSSIAN, spark, folder)


@query("random_projection_sparse", sql_projection(SPARSE._matrix(4, 64)))
def random_projection_sparse(spark, folder):
    return _projected(SPARSE, spark, folder)


# ---------------------------------------------------------------- neighbours


def sql_nearest(queries: str, points: str, distance: str, k: int) -> str:
    """Tables q(qid, ...) and p(pid, ...) -> near(query_id, rank, neighbor_id, distance)."""
    return f"""WITH q AS ({queries}), p AS ({points}),
    d AS (SELECT qid, pid, {distance} AS distance FROM q, p),
    near AS (SELECT qid AS query_id, row_number() OVER (PARTITION BY qid ORDER BY distance, pid) AS rank, pid AS neighbor_id,
    distance FROM d QUALIFY rank <= {k}) """


EMBEDDED = "SELECT vec_id AS {0}, embedding::DOUBLE[] AS {1} FROM embeddings"
NEAR_EMBEDDINGS = sql_nearest(EMBEDDED.format("qid", "qx"), EMBEDDED.format("pid", "px"), "list_distance(qx, px)", 5)
NEAR_OUT = "SELECT query_id, rank, neighbor_id, round(distance, 6) + 0.0 AS distance FROM near"


def _near_out(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "neighbor_id", rounded("distance", 6, "distance"))


@query("kneighbors", NEAR_EMBEDDINGS + NEAR_OUT)
def kneighbors(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = NearestNeighbors(n_neighbors=5, features_col="embedding", id_col="vec_id", cell_rows=100).fit(rows)
    return _near_out(model.kneighbors(rows))


@query(
    "kneighbors_pruned",
    sql_nearest("SELECT c_custkey AS qid, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer",
                "SELECT s_suppkey AS pid, s_acctbal AS u, s_nationkey * 100.0 AS v FROM supplier",
                "sqrt((x - u) ** 2 + (y - v) ** 2)", 3) + NEAR_OUT,
)
def kneighbors_pruned(spark, folder):
    points = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey") * 100.0).alias("features"))
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey") * 100.0).alias("features"))
    return _near_out(NearestNeighbors(n_neighbors=3, cell_rows=25).fit(points).kneighbors(rows))


@query(
    "knn_classifier",
    NEAR_EMBEDDINGS + """, votes AS (SELECT query_id, label, count(*) AS n FROM near JOIN embeddings ON neighbor_id = vec_id GROUP BY ALL)
    SELECT query_id AS vec_id, label AS prediction FROM votes
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1""",
)
def knn_classifier(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = KNeighborsClassifier(n_neighbors=5, features_col="embedding", id_col="vec_id", cell_rows=100).fit(rows)
    return model.predict(rows).select("vec_id", "prediction")


@query(
    "knn_probability",
    NEAR_EMBEDDINGS + """, ends AS (SELECT min(label) AS first, max(label) AS last FROM embeddings),
    votes AS (SELECT query_id, label, count(*) AS n FROM near JOIN embeddings ON neighbor_id = vec_id GROUP BY ALL)
    SELECT query_id AS vec_id, sum(CASE WHEN label = first THEN n ELSE 0 END) / 5.0 AS p_first,
    sum(CASE WHEN label = last THEN n ELSE 0 END) / 5.0 AS p_last, max(n) / 5.0 AS p_most FROM votes, ends GROUP BY query_id""",
)
def knn_probability(spark, folder):
    rows = table(spark, folder, "embeddings")
    model = KNeighborsClassifier(
        n_neighbors=5, features_col="embedding", id_col="vec_id", cell_rows=100, output_col="p"
    ).fit(rows)
    p = F.col("p")
    return model.predict_proba(rows).select("vec_id", p[0].alias("p_first"), F.element_at(p, -1).alias("p_last"), F.array_max(p).alias("p_most"))


@query(
    "knn_regressor",
    sql_nearest("SELECT p_partkey AS qid, p_size AS a, p_partkey AS b FROM part",
                "SELECT p_partkey AS pid, p_size AS c, p_partkey AS d FROM part", "sqrt(((a - c) ** 2 + (b - d) ** 2)::DOUBLE)", 5)
    + """SELECT query_id AS p_partkey, round(avg(p_retailprice), 6) + 0.0 AS prediction
    FROM near JOIN part ON neighbor_id = p_partkey GROUP BY query_id""",
)
def knn_regressor(spark, folder):
    rows = table(spark, folder, "part")
    model = KNeighborsRegressor(n_neighbors=5, features_col=TWO, id_col="p_partkey", label_col="p_retailprice", cell_rows=400).fit(rows)
    return model.predict(rows).select("p_partkey", rounded("prediction", 6, "prediction"))


# ---------------------------------------------------------------- clusters

CENTRES = [[10.0, 920.0], [25.0, 950.0], [40.0, 980.0]]


def sql_lloyd(rounds: int) -> str:
    gap = lambda j: f"((p_size - c{j}x) ** 2 + (p_retailprice - c{j}y) ** 2)"
    near = "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"
    state = [f"c{j}{axis}" for j in range(3) for axis in "xy"]
    start = ", ".join(f"{v}::DOUBLE AS {n}" for n, v in zip(state, np.ravel(CENTRES)))
    mean = lambda j, c: f"coalesce(avg(CASE WHEN k = {j} THEN {c} END), any_value(c{j}{'x' if c == 'p_size' else 'y'}))"
    means = ", ".join(mean(j, c) for j in range(3) for c in PART)
    return f"""WITH RECURSIVE c AS (SELECT 0 AS i, {start} UNION ALL
    SELECT i + 1, {means} FROM (SELECT *, {near} AS k FROM
      (SELECT c.*, p_size, p_retailprice, {gap(0)} AS d0, {gap(1)} AS d1, {gap(2)} AS d2 FROM c, part WHERE i < {rounds}) AS a) AS b
    GROUP BY i)
    SELECT p_partkey, {near} AS prediction, round(sqrt(d0), 4) AS to_0, round(sqrt(d1), 4) AS to_1, round(sqrt(d2), 4) AS to_2
    FROM (SELECT p_partkey, {gap(0)} AS d0, {gap(1)} AS d1, {gap(2)} AS d2 FROM part, (SELECT * FROM c WHERE i = {rounds}) AS z) AS y"""


@query("kmeans_lloyd", sql_lloyd(5))
def kmeans_lloyd(spark, folder):
    rows = table(spark, folder, "part")
    model = KMeans(n_clusters=3, init=CENTRES, max_iter=5, tol=0.0, features_col=PART).fit(rows)
    out = model.transform(rows)
    return out.select("p_partkey", "prediction", *[rounded(F.col("distances")[j], 4, f"to_{j}") for j in range(3)])


@query("kmeans")
def kmeans(spark, folder):
    rows = table(spark, folder, "lineitem")
    scaled = StandardScaler(features_col=["l_quantity", "l_extendedprice", "l_discount"]).fit_transform(rows)
    model = KMeans(n_clusters=8, random_state=0, features_col="scaled").fit(scaled)
    return metrics.cluster_summary(model.predict(scaled))


def sql_density(points: str, near: str, need: int) -> str:
    """Points p(id, ...) -> (id, prediction): closure over core pairs, then borders."""
    return f"""WITH RECURSIVE p AS ({points}),
    pairs AS (SELECT a.id AS a, b.id AS b FROM p AS a, p AS b WHERE {near}),
    core AS (SELECT a AS id FROM pairs GROUP BY a HAVING count(*) >= {need}),
    links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT l.b, r.root FROM reach AS r JOIN links AS l ON r.id = l.a
      WHERE r.root < l.b),
    rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
    named AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM rooted),
    border AS (SELECT a AS id, min(cluster) AS cluster FROM pairs JOIN named ON b = named.id
      WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT p.id, coalesce(named.cluster, border.cluster, -1) AS prediction
    FROM p LEFT JOIN named ON p.id = named.id LEFT JOIN border ON p.id = border.id"""


@query("dbscan", sql_density("SELECT c_custkey AS id, c_acctbal AS x FROM customer", "abs(a.x - b.x) <= 10.005", 5))
def dbscan(spark, folder):
    rows = table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")
    return DBSCAN(eps=10.005, min_samples=5, features_col=["c_acctbal"], cell_rows=300).fit_predict(rows).select("id", "prediction")


@query(
    "dbscan_plane",
    sql_density("SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer",
                "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 150.005", 7),
)
def dbscan_plane(spark, folder):
    rows = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_nationkey") * 100.0).alias("features"))
    return DBSCAN(eps=150.005, min_samples=7, cell_rows=200).fit_predict(rows).select("id", "prediction")


@query(
    "dbscan_embeddings",
    sql_density("SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings", "list_distance(a.x, b.x) <= 1.15", 3),
)
def dbscan_embeddings(spark, folder):
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")
    return DBSCAN(eps=1.15, min_samples=3, features_col="embedding", cell_rows=100).fit_predict(rows).select("id", "prediction")


@query("tsne")
def tsne(spark, folder, **options):
    rows = table(spark, folder, "embeddings")
    df = TSNE(features_col="embedding", id_col="vec_id", perplexity=10.0, random_state=42, cell_rows=100, **options).fit_transform(rows)
    return df.select("vec_id", F.col("embedding")[0].alias("y0"), F.col("embedding")[1].alias("y1"))


@query("umap")
def umap(spark, folder, **options):
    rows = table(spark, folder, "embeddings")
    df = UMAP(features_col="embedding", id_col="vec_id", random_state=42, cell_rows=100, **options).fit_transform(rows)
    return df.select("vec_id", F.col("embedding")[0].alias("y0"), F.col("embedding")[1].alias("y1"))


# ---------------------------------------------------------------- metrics and selection

STATUS = """SELECT o_orderstatus AS label, CASE WHEN o_totalprice > 300000 THEN 'F' WHEN o_totalprice > 150000 THEN 'O' ELSE 'P' END
    AS prediction FROM orders"""


def _status(spark, folder) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("label"),
        F.when(price > 300000, "F").when(price > 150000, "O").otherwise("P").alias("prediction"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_f"),
        "o_totalprice",
    )


@query("confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM ({STATUS}) AS t GROUP BY ALL")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_status(spark, folder))


@query(
    "classification_report",
    f"""WITH t AS ({STATUS}), c AS (SELECT label AS class FROM t UNION SELECT prediction FROM t),
    s AS (SELECT class, (SELECT count(*) FROM t WHERE label = class) AS support, (SELECT count(*) FROM t WHERE prediction = class)
      AS said, (SELECT count(*) FROM t WHERE label = class AND prediction = class) AS hit FROM c)
    SELECT class, support, round(CASE WHEN said = 0 THEN 0 ELSE hit / said END, 8) + 0.0 AS precision,
    round(CASE WHEN support = 0 THEN 0 ELSE hit / support END, 8) + 0.0 AS recall,
    round(2.0 * hit / (said + support), 8) + 0.0 AS f1 FROM s""",
)
def classification_report(spark, folder):
    report = metrics.classification_report(_status(spark, folder))
    return report.select(
        "class", "support", rounded("precision", 8, "precision"), rounded("recall", 8, "recall"), rounded("f1", 8, "f1"))


@query("accuracy", f"SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM ({STATUS}) AS t")
def accuracy(spark, folder):
    df = _status(spark, folder)
    value = metrics.accuracy(df)
    return df.agg(F.count(F.lit(1))).select(rounded(F.lit(value), 8, "accuracy"))


@query(
    "regression_report",
    """WITH t AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 + l_discount * 1000.0 AS p FROM lineitem)
    SELECT round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae,
    round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(corr(y, p), 8) AS corr FROM t""",
)
def regression_report(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0 + F.col("l_discount") * 1000.0).alias("prediction"))
    report = metrics.regression_report(df)
    return report.select(*[rounded(c, d, c) for c, d in (("rmse", 4), ("mae", 4), ("r2", 8), ("corr", 8))])


@query(
    "roc_auc",
    """WITH r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, rank() OVER (ORDER BY o_totalprice)
    + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS k FROM orders)
    SELECT round((sum(k * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 8) AS auc FROM r""",
)
def roc_auc(spark, folder):
    df = _status(spark, folder)
    value = metrics.roc_auc(df, "is_f", "o_totalprice")
    return df.agg(F.count(F.lit(1))).select(rounded(F.lit(float(value)), 8, "auc"))


@query(
    "roc_curve",
    """WITH g AS (SELECT o_totalprice AS threshold, count(*) FILTER (o_orderstatus = 'F') AS p,
      count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders GROUP BY 1)
    SELECT threshold, round(sum(n) OVER w / sum(n) OVER (), 8) + 0.0 AS false_positive_rate,
    round(sum(p) OVER w / sum(p) OVER (), 8) + 0.0 AS true_positive_rate FROM g WINDOW w AS (ORDER BY threshold DESC)""",
)
def roc_curve(spark, folder):
    curve = metrics.roc_curve(_status(spark, folder), "is_f", "o_totalprice")
    return curve.select("threshold", rounded("false_positive_rate", 8, "false_positive_rate"),
                        rounded("true_positive_rate", 8, "true_positive_rate"))


@query(
    "log_loss",
    """SELECT round(avg(-ln(CASE WHEN o_orderstatus = 'F' THEN 0.1 + 0.8 * q ELSE 0.9 - 0.8 * q END)), 8) AS log_loss
    FROM (SELECT *, o_totalprice / max(o_totalprice) OVER () AS q FROM orders) AS t""",
)
def log_loss(spark, folder):
    rows = MinMaxScaler(features_col=["o_totalprice"]).fit(table(spark, folder, "orders"))
    top = float(rows.state["max"][0])
    p = F.lit(0.1) + F.lit(0.8) * F.col("o_totalprice") / F.lit(top)
    df = _status(spark, folder).withColumn("probability", F.array(1.0 - p, p))
    value = metrics.log_loss(df, [0, 1], "is_f")
    return df.agg(F.count(F.lit(1))).select(rounded(F.lit(value), 8, "log_loss"))


@query(
    "silhouette",
    """WITH t AS (SELECT p_partkey AS id, p_size AS x, p_retailprice AS y, floor(p_size / 17.0)::INT AS k FROM part),
    n AS (SELECT k, count(*) AS n FROM t GROUP BY k),
    d AS (SELECT a.id, a.k AS own, b.k AS k, sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS s FROM t AS a, t AS b GROUP BY ALL),
    m AS (SELECT id, max(CASE WHEN own = d.k THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> d.k THEN s / n END) AS b,
      max(CASE WHEN own = d.k THEN n END) AS size FROM d JOIN n ON d.k = n.k GROUP BY id)
    SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM m""",
)
def silhouette(spark, folder):
    df = table(spark, folder, "part").withColumn("prediction", F.floor(F.col("p_size") / 17.0).cast("int"))
    value = metrics.silhouette(df, PART)
    return df.agg(F.count(F.lit(1))).select(rounded(F.lit(value), 6, "silhouette"))


@query(
    "cluster_summary",
    """SELECT o_orderpriority AS cluster, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share
    FROM orders GROUP BY o_orderpriority""",
)
def cluster_summary(spark, folder):
    out = metrics.cluster_summary(table(spark, folder, "orders"), "o_orderpriority")
    return out.select("cluster", "n", rounded("share", 8, "share"))


def sql_folds(alphas: list[float]) -> str:
    """Held-out R-squared per alpha and fold of one-feature ridge; folds by key."""
    options = ", ".join(f"({a})" for a in alphas)
    return f"""WITH t AS (SELECT p_partkey % 5 AS f, p_partkey AS x, p_retailprice AS y FROM part),
    fit AS (SELECT g.f, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
      FROM (SELECT DISTINCT f FROM t) AS g JOIN t ON t.f <> g.f GROUP BY g.f),
    w AS (SELECT f, alpha, mx, my, sxy / (sxx + alpha) AS w FROM fit, (VALUES {options}) AS o(alpha)),
    r AS (SELECT alpha, w.f, 1 - avg((y - my - w * (x - mx)) ** 2) / var_pop(y) AS score FROM w JOIN t ON t.f = w.f GROUP BY ALL) """


@query("kfold_scores", sql_folds([0.0]) + "SELECT f::INT AS fold, round(score, 6) + 0.0 AS score FROM r")
def kfold_scores(spark, folder):
    rows = table(spark, folder, "part").withColumn("fold", (F.col("p_partkey") % 5).cast("int"))
    learner = LinearRegression(features_col=["p_partkey"], label_col="p_retailprice")
    scores = cross_val_score(learner, rows, fold_col="fold", folds=5)
    by_fold = F.element_at(F.array(*[F.lit(float(s)) for s in scores]), F.col("fold") + 1)
    return rows.select("fold").distinct().select("fold", rounded(by_fold, 6, "score"))


@query(
    "grid_search",
    sql_folds([1.0, 1e8, 1e9]) + "SELECT alpha::DOUBLE AS alpha, round(avg(score), 6) + 0.0 AS mean_score, round(stddev_pop(score), 6) + 0.0 AS std_score FROM r GROUP BY alpha",
)
def grid_search(spark, folder):
    rows = table(spark, folder, "part").withColumn("fold", (F.col("p_partkey") % 5).cast("int"))
    search = GridSearch(
        Ridge(features_col=["p_partkey"], label_col="p_retailprice"), {"alpha": [1.0, 1e8, 1e9]}, folds=5, fold_col="fold"
    ).fit(rows)
    out = spark.createDataFrame([(p["alpha"], m, s) for p, m, s in search.results_], "alpha double, mean_score double, std_score double")
    return out.select("alpha", rounded("mean_score", 6, "mean_score"), rounded("std_score", 6, "std_score"))


@query(
    "hash_split",
    "SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, 0::BIGINT AS n_in_both, TRUE AS near_a_fifth FROM orders",
)
def hash_split(spark, folder):
    train, test = train_test_split(table(spark, folder, "orders").select("o_orderkey"), 0.2, 1, "o_orderkey")
    sides = train.withColumn("held", F.lit(0)).unionByName(test.withColumn("held", F.lit(1)))
    keys = sides.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("a"), F.max("held").alias("b"))
    share = F.sum("b") / F.count(F.lit(1))
    return keys.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("n_in_both"),
        ((share > 0.18) & (share < 0.22)).alias("near_a_fifth"),
    )


# ---------------------------------------------------------------- data makers, keyed by the ids of a table


@query(
    "dataset_makers",
    """SELECT kind, count(*) AS n_rows, TRUE AS mean_fits, TRUE AS spread_fits
    FROM orders, (VALUES ('gaussian'), ('regression'), ('classification'), ('nonnegative')) AS k(kind) GROUP BY kind""",
)
def dataset_makers(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    out = None
    for kind, make in {"gaussian": make_gaussian, "regression": make_regression, "classification": make_classification,
                       "nonnegative": make_nonnegative}.items():
        first, n = F.col("features")[0], F.count(F.lit(1))
        # a normal number has mean 0 and spread 1; its absolute value + 0.01 has 0.8079 and 0.6028
        mean, spread = (0.8079, 0.6028) if kind == "nonnegative" else (0.0, 1.0)
        part = make(ids, n_features=4).agg(
            n.alias("n_rows"), (F.abs(F.avg(first) - mean) < 5.0 / F.sqrt(n)).alias("mean_fits"),
            (F.abs(F.stddev(first) - spread) < 5.0 / F.sqrt(n)).alias("spread_fits"),
        ).select(F.lit(kind).alias("kind"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("blob_maker", "SELECT count(*) AS n_rows, 3::BIGINT AS n_blobs, TRUE AS even FROM orders")
def blob_maker(spark, folder):
    ids = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    sizes = make_blobs(ids, n_features=4).groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_blobs"),
                     (F.max("n") < F.min("n") * 1.2).alias("even"))


# ---------------------------------------------------------------- text

WORDS = f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM documents"


@query("token_counts", f"SELECT doc_id, token, count(*) AS n FROM ({WORDS}) AS w GROUP BY ALL")
def token_count_table(spark, folder):
    return token_counts(table(spark, folder, "documents"), "doc_id", "text")


SQL_TF = f"""WITH w AS ({WORDS}), c AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL),
    d AS (SELECT token, count(*) AS df FROM c GROUP BY token),
    x AS (SELECT doc_id, token, tf, df, tf * ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) AS v FROM c JOIN d USING (token)) """


@query("tf_idf", SQL_TF + "SELECT doc_id, token, tf, df, round(v, 6) + 0.0 AS tf_idf FROM x")
def tf_idf_table(spark, folder):
    out = tf_idf(table(spark, folder, "documents"), "doc_id", "text")
    return out.select("doc_id", "token", "tf", "df", rounded("tf_idf", 6, "tf_idf"))


def _vector_sums(df: DataFrame) -> Column:
    """Sums of the numbers that sparse vectors hold; as arrays they would be as long as the vocabulary."""
    return F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, v: a + v)


@query(
    "count_vectors",
    f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}'))::BIGINT AS n_words FROM documents",
)
def count_vectors(spark, folder):
    df = CountVectorizer().fit_transform(table(spark, folder, "documents"))
    return df.select("doc_id", _vector_sums(df).cast("long").alias("n_words"))


@query(
    "hashed_counts",
    f"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}'))::BIGINT AS n_words FROM documents",
)
def hashed_counts(spark, folder):
    df = HashingVectorizer(n_features=1 << 12).fit_transform(table(spark, folder, "documents"))
    return df.select("doc_id", _vector_sums(df).cast("long").alias("n_words"))


@query("tf_idf_vectors", SQL_TF + "SELECT doc_id, round(sum(v), 3) + 0.0 AS total FROM x GROUP BY doc_id")
def tf_idf_vectors(spark, folder):
    df = TfidfVectorizer().fit_transform(table(spark, folder, "documents"))
    return df.select("doc_id", rounded(_vector_sums(df), 3, "total"))


# ---------------------------------------------------------------- model store and streams


@query("save_load_predict", sql_ridge("50000.0 / n"))
def save_load_predict(spark, folder):
    rows = table(spark, folder, "part")
    store = ModelStore(spark, scratch(spark, "models"))
    store.save(Ridge(alpha=50000.0, features_col=TWO, label_col="p_retailprice").fit(rows), "price-ridge")
    return store.load("price-ridge").predict(rows).select("p_partkey", rounded("prediction", 3, "prediction"))


@query("stream_score", f"SELECT event_id, {sql_round(sql_scaled('events', 'value'), 6, 'value_scaled')} FROM events")
def stream_score(spark, folder):
    model = StandardScaler(features_col=["value"]).fit(table(spark, folder, "events"))
    out = scratch(spark, "scored")
    score_stream(model, stream_of(spark, folder, "events"), out, scratch(spark, "progress"), ["event_id", "scaled"])
    return spark.read.parquet(out).select("event_id", rounded(F.col("scaled")[0], 6, "value_scaled"))


@query("sql_score", sql_ridge("0"))
def sql_score(spark, folder):
    rows = table(spark, folder, "part")
    register(spark, LinearRegression(features_col=TWO, label_col="p_retailprice").fit(rows), "part_price")
    rows.createOrReplaceTempView("part_rows")
    return spark.sql(
        "SELECT p_partkey, round(part_price(array(CAST(p_size AS DOUBLE), CAST(p_partkey AS DOUBLE))), 3) + 0.0D AS prediction FROM part_rows"
    )


@query(
    "online_sgd",
    "SELECT round(0.0001 * avg(user_id * value), 8) + 0.0 AS coef, round(0.0001 * avg(value), 8) + 0.0 AS intercept FROM events",
)
def online_sgd(spark, folder):
    events = table(spark, folder, "events")
    trainer = OnlineRegression(spark, scratch(spark, "weights"), ["user_id"], "value", rate=1e-4)
    trainer.train(stream_of(spark, folder, "events"), scratch(spark, "progress"))
    state = trainer.model().state
    return events.agg(F.count(F.lit(1))).select(
        rounded(F.lit(float(state["coef"][0])), 8, "coef"), rounded(F.lit(float(state["intercept"])), 8, "intercept"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Scaler and logistic regression as one chain, scored on all rows."""
    return chain_scaler_logistic(spark, folder)


__all__ = ["ORACLES", "QUERIES", "flagship"]
