"""Quality measures: single aggregates, and ordered sums without a global sort in one task."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import r_squared
from ..functions.vectors import feature_vector
from ..plans.order import running_totals

LABEL, PREDICTION = "label", "prediction"


def accuracy(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> float:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double"))).head()[0]


def r2_score(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> float:
    return r_squared(df, F.col(label).cast("double"), F.col(prediction).cast("double"))


def correlated(a: Column, b: Column) -> Column:
    """Pearson correlation; null if either side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression_report(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """One row: mse, rmse, mae, r2, corr."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    r2 = F.when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0)).otherwise(F.lit(1.0) - F.try_divide(mse, spread))
    return df.agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
        r2.alias("r2"), correlated(y, p).alias("corr"),
    )


def mean_squared_error(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> float:
    return regression_report(df, label, prediction).head()["mse"]


def mean_absolute_error(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> float:
    return regression_report(df, label, prediction).head()["mae"]


def correlation(df: DataFrame, a: str, b: str) -> float:
    return df.agg(correlated(F.col(a), F.col(b))).head()[0]


def confusion_matrix(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """(label, prediction, n) for the pairs that occur."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """(class, support, precision, recall, f1), from the confusion counts."""
    cells = confusion_matrix(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    ends = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("hit")),
                F.struct(F.col("prediction").cast(cells.schema["label"].dataType).alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("e")
    ).select("e.*")
    sums = ends.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    rate = lambda a, b: F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))
    both = F.col("support") + F.col("said")
    return sums.select(
        "class", "support", rate("hit", "said").alias("precision"), rate("hit", "support").alias("recall"),
        F.when(both == 0, F.lit(0.0)).otherwise(2.0 * F.col("hit") / both).alias("f1"),
    )


def f1_score(df: DataFrame, label: str = LABEL, prediction: str = PREDICTION, average: str = "macro") -> float:
    weight = {"macro": F.lit(1.0), "weighted": F.col("support")}[average]
    report = classification_report(df, label, prediction)
    return report.agg(F.sum(F.col("f1") * weight) / F.sum(weight)).head()[0]


def log_loss(df: DataFrame, classes: list, label: str = LABEL, probability: str = "probability") -> float:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int")
    p = F.greatest(F.element_at(probability, at), F.lit(1e-15))
    return df.agg(F.avg(-F.log(F.least(p, F.lit(1.0))))).head()[0]


def _by_score(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    hit = (F.col(label) == F.lit(positive)).cast("long")
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )


def roc_auc(df: DataFrame, label: str = LABEL, score: str = "score", positive=1) -> float:
    """Area under the ROC curve by ranks; equal scores count one half."""
    ranked = running_totals(_by_score(df, label, score, positive), "score", ["neg"])
    below = F.col("total_neg") - F.col("neg") + F.col("neg") / 2.0
    row = ranked.agg(F.sum(F.col("pos") * below).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).head()
    if not row["p"] or not row["n"]:
        raise ValueError("ROC needs rows of both classes")
    return row["wins"] / (row["p"] * row["n"])


def roc_curve(df: DataFrame, label: str = LABEL, score: str = "score", positive=1) -> DataFrame:
    """(threshold, false_positive_rate, true_positive_rate): rows with score >= threshold are positive."""
    grouped = _by_score(df, label, score, positive).withColumn("_down", -F.col("score"))
    ranked = running_totals(grouped, "_down", ["pos", "neg"])
    sums = grouped.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).head()
    return ranked.select(
        F.col("score").alias("threshold"),
        (F.col("total_neg") / float(sums["n"])).alias("false_positive_rate"),
        (F.col("total_pos") / float(sums["p"])).alias("true_positive_rate"),
    )


def silhouette(df: DataFrame, features="features", prediction: str = PREDICTION) -> float:
    """Mean silhouette under squared Euclidean distance, from per-cluster sums."""
    rows = df.select(feature_vector(df, features).alias("features"), F.col(prediction).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def cluster_summary(df: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """(cluster, n, share); noise is cluster -1."""
    total = float(df.count())
    counts = df.groupBy(F.col(prediction).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.lit(total))
