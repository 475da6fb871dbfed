"""PCA and truncated SVD from one distributed Gram matrix; random projection without a pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..base import Fitted, Learner
from ..functions.algebra import affine
from ..functions.vectors import to_matrix, width
from ..plans.gram import MAX_GRAM_WIDTH, centred_gram, column_moments, gram, leading_subspace


def fix_signs(rows: np.ndarray) -> np.ndarray:
    """Make the entry of largest absolute value in each row positive."""
    lead = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    return rows * np.where(lead < 0, -1.0, 1.0)[:, None]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (clipped at 0) and their vectors as rows."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return np.maximum(values[order], 0.0), fix_signs(vectors[:, order].T)


class _ProjectionModel(Fitted):
    HYPER = {"output_col": "projected", "restored_col": "restored"}
    VERBS = frozenset({"fit", "transform", "fit_transform", "inverse_transform"})

    def _transform(self, df: DataFrame) -> DataFrame:
        df = self._input(df)
        parts, mean = self.state["components"], self.state["mean"]
        out = affine(df, self.setting("features_col"), parts, -parts @ mean, self.setting("handle_invalid"))
        return df.withColumn(self.setting("output_col"), out)

    def _inverse(self, df: DataFrame) -> DataFrame:
        back = affine(df, self.setting("output_col"), self.state["components"].T, self.state["mean"])
        return df.withColumn(self.setting("restored_col"), back)


class PCAModel(_ProjectionModel):
    """state: components, mean, explained_variance, explained_variance_ratio, singular_values."""


class PCA(Learner):
    """Projection of centred rows on the leading covariance eigenvectors."""

    HYPER = {**_ProjectionModel.HYPER, "n_components": 2}
    VERBS = _ProjectionModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        d = width(df, self.setting("features_col"))
        k = _checked(self.setting("n_components"), d)
        if d <= MAX_GRAM_WIDTH:
            n, mean, scatter = centred_gram(df, self._x(df), d)
            values, vectors = leading(scatter, k)
            total = np.trace(scatter)
        else:
            stats = column_moments(df, self.setting("features_col"), "mean", "std")
            n, mean, total = stats["count"], stats["mean"], stats["count"] * (stats["std"] ** 2).sum()
            values, vectors = leading_subspace(df, self._x(df), d, k, mean)
            vectors = fix_signs(vectors)
        return PCAModel(
            {
                "components": vectors,
                "mean": mean,
                "explained_variance": values / max(n - 1, 1),
                "explained_variance_ratio": values / total if total > 0 else values,
                "singular_values": np.sqrt(values),
            }
        )


class TruncatedSVDModel(_ProjectionModel):
    """state: components, mean (zero), singular_values."""


class TruncatedSVD(Learner):
    """Projection on the leading right singular vectors, without centring."""

    HYPER = {**_ProjectionModel.HYPER, "n_components": 2}
    VERBS = _ProjectionModel.VERBS

    def _train(self, df: DataFrame) -> Fitted:
        d = width(df, self.setting("features_col"))
        k = _checked(self.setting("n_components"), d)
        if d <= MAX_GRAM_WIDTH:
            values, vectors = leading(gram(df, [self._x(df)], lambda b: to_matrix(b, d), d), k)
        else:
            values, vectors = leading_subspace(df, self._x(df), d, k, np.zeros(d))
            vectors = fix_signs(vectors)
        return TruncatedSVDModel(
            {"components": vectors, "mean": np.zeros(d), "singular_values": np.sqrt(values)}
        )


class RandomProjectionModel(_ProjectionModel):
    VERBS = frozenset({"fit", "transform", "fit_transform"})


class _RandomProjection(Learner):
    HYPER = {"output_col": "projected", "n_components": 2, "random_state": 0}
    VERBS = RandomProjectionModel.VERBS

    def _matrix(self, k: int, d: int) -> np.ndarray:
        raise NotImplementedError

    def _train(self, df: DataFrame) -> Fitted:
        d = width(df, self.setting("features_col"))
        return RandomProjectionModel({"components": self._matrix(self.setting("n_components"), d), "mean": np.zeros(d)})


class GaussianRandomProjection(_RandomProjection):
    """Entries drawn from N(0, 1/k), fixed by the seed."""

    def _matrix(self, k, d):
        return np.random.default_rng(self.setting("random_state")).normal(0.0, 1.0 / np.sqrt(k), (k, d))


class SparseRandomProjection(_RandomProjection):
    """Entries ±sqrt(1/(density k)) with probability density/2 each, else 0 (Li et al. 2006)."""

    HYPER = {"density": None}

    def _matrix(self, k, d):
        density = self.setting("density") or 1.0 / np.sqrt(d)
        draw = np.random.default_rng(self.setting("random_state")).random((k, d))
        size = np.sqrt(1.0 / (density * k))
        return np.where(draw < density / 2, -size, np.where(draw < density, size, 0.0))


def _checked(k: int, d: int) -> int:
    if not 1 <= k <= d:
        raise ValueError(f"n_components={k} must be between 1 and the number of features {d}")
    return k
