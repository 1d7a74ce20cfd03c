"""Small dense least-squares systems, many at a time."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's functions with the task, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Eigenvalues of a correlation matrix below this, times its size, count as zero.
RANK_CUTOFF = 1e-13


def solve_centred(cov: np.ndarray, right: np.ndarray, means: np.ndarray, y_mean: np.ndarray) -> np.ndarray:
    """Minimum-norm least-squares coefficients, intercept first, of a stack of centred systems.

    ``cov`` (n, f, f) and ``right`` (n, f) are covariances of the regressors with each other and
    with y.  Centring keeps the digits of a regressor that varies little around a large mean.
    """
    n, f = right.shape
    if not f:
        return y_mean[:, None].copy()
    scale = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0))
    # What varies by rounding only is constant.
    scale = np.where(scale > 4 * np.finfo(float).eps * np.abs(means), scale, 0.0)
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    values, vectors = np.linalg.eigh(cov * inverse[:, :, None] * inverse[:, None, :])
    kept = values > RANK_CUTOFF * f
    weights = np.divide(1.0, values, out=np.zeros_like(values), where=kept)
    slopes = np.einsum("nij,nj->ni", vectors, weights * np.einsum("nij,ni->nj", vectors, right * inverse)) * inverse
    beta = np.column_stack((y_mean - np.einsum("ni,ni->n", means, slopes), slopes))
    for i in np.flatnonzero(~kept.all(axis=1)):
        # Any solution minus its part in the null space of (1, X) is the one of least norm.  A
        # constant column has no scale; with the intercept it makes a null vector of its own.
        axes = np.column_stack((vectors[i][:, ~kept[i]] * inverse[i][:, None], np.eye(f)[:, scale[i] == 0]))
        axes = axes[:, np.abs(axes).max(axis=0) > 0]
        basis, weight, _ = np.linalg.svd(np.vstack((-means[i] @ axes, axes)), full_matrices=False)
        basis = basis[:, weight > 1e-12 * max(weight.max(initial=0.0), 1e-300)]
        beta[i] -= basis @ (basis.T @ beta[i])
    return beta


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_packed(cov: pd.Series, right: pd.Series, means: pd.Series, y_mean: pd.Series) -> pd.Series:
    """Row-wise: packed upper triangle, right side and means to coefficients, intercept first."""
    if cov.empty:
        return pd.Series([], dtype=object)
    sides = np.stack(right.to_numpy()).astype(float).reshape(len(right), -1)
    packed = np.stack(cov.to_numpy()).astype(float).reshape(len(right), -1)
    f = sides.shape[1]
    full = np.zeros((len(sides), f, f))
    rows, cols = np.triu_indices(f)
    full[:, rows, cols] = packed
    full[:, cols, rows] = packed
    centres = np.stack(means.to_numpy()).astype(float).reshape(len(sides), -1)
    return pd.Series(list(solve_centred(full, sides, centres, y_mean.to_numpy(dtype=float))))
