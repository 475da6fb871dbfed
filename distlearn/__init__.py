"""distlearn: machine-learning analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .base import Fitted, Learner, UnsupportedVerb  # noqa: E402
from .operators.clustering import DBSCAN, KMeans  # noqa: E402
from .operators.decomposition import (  # noqa: E402
    PCA,
    GaussianRandomProjection,
    SparseRandomProjection,
    TruncatedSVD,
)
from .operators.forest import RandomForestClassifier, RandomForestRegressor  # noqa: E402
from .operators.linear import ElasticNet, Lasso, LinearRegression, LogisticRegression, Ridge  # noqa: E402
from .operators.manifold import TSNE, UMAP  # noqa: E402
from .operators.neighbors import KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors  # noqa: E402
from .operators.preprocessing import LabelEncoder, MinMaxScaler, StandardScaler  # noqa: E402
from .operators.sgd import MBSGDClassifier, MBSGDRegressor  # noqa: E402
from .operators.svm import SVC, SVR  # noqa: E402
from .operators.text import CountVectorizer, HashingVectorizer, TfidfVectorizer  # noqa: E402
from .sources.store import ModelStore  # noqa: E402

OPERATORS = {
    c.__name__: c
    for c in (
        StandardScaler, MinMaxScaler, LabelEncoder, PCA, TruncatedSVD, TSNE, UMAP, LinearRegression, Ridge, Lasso,
        ElasticNet, LogisticRegression, MBSGDClassifier, MBSGDRegressor, SVC, SVR, RandomForestClassifier,
        RandomForestRegressor, KNeighborsClassifier, KNeighborsRegressor, NearestNeighbors, KMeans, DBSCAN,
        GaussianRandomProjection, SparseRandomProjection, CountVectorizer, HashingVectorizer, TfidfVectorizer,
    )
}


def create(name: str, **settings) -> Learner:
    """An operator by class name."""
    if name not in OPERATORS:
        raise KeyError(f"unknown operator {name!r}; known: {sorted(OPERATORS)}")
    return OPERATORS[name](**settings)


__all__ = ["OPERATORS", "Fitted", "Learner", "ModelStore", "UnsupportedVerb", "create", *sorted(OPERATORS)]
