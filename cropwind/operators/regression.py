"""Ordinary least squares for many series at once.

The normal equations are grouped centred moments, combined on the map side, so the data of a
series never has to meet in one task, and a regressor that is nearly constant keeps its digits.  Only the k x k system of each series goes to Python,
in Arrow batches.  A second pass over the design sums the squared residuals, which is exact
where ``y'y - b'X'y`` would cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropwind.functions.columns import quoted, text
from cropwind.functions.linalg import solve_packed
from cropwind.operators.design import Design


def fit_ols(design: Design, date: str = "date") -> DataFrame:
    """One row per series: ``intercept``, ``coeffs`` map, ``resid_var``, ``n_obs``, ``n_coef``.

    ``resid_var`` is SSE / max(1, n - k) with the intercept counted in k.  ``exog_last`` maps
    each ``exog_*`` regressor to its last value in the design.
    """
    keys, features = list(design.keys), design.features
    exog = [f for f in features if f.startswith("exog_")]
    usable = design.frame.dropna(subset=["y", *features]).select(*keys, date, "y", *features)
    # The row vector x starts with the intercept's 1.
    x = ["1D", *[quoted(f) for f in features]]
    k = len(x)
    # Covariances are running moments around the mean: they merge without cancelling.
    moments = [f"covar_pop({x[i]}, {x[j]})" for i in range(1, k) for j in range(i, k)]
    right = [f"covar_pop({c}, y)" for c in x[1:]]
    doubles = lambda parts: f"CAST(array({', '.join(parts)}) AS array<double>)"
    sums = usable.groupBy(*keys).agg(
        F.expr("count(*) AS n_obs"),
        F.expr(f"{doubles(moments)} AS _cov"),
        F.expr(f"{doubles(right)} AS _right"),
        F.expr(f"{doubles([f'avg({c})' for c in x[1:]])} AS _means"),
        F.expr("avg(y) AS _y"),
        F.expr(f"{_map({f: f'max_by({quoted(f)}, {quoted(date)})' for f in exog})} AS exog_last"),
    )
    solved = sums.select(*keys, "n_obs", "exog_last", solve_packed("_cov", "_right", "_means", "_y").alias("_beta"))
    fitted = " + ".join(f"_beta[{i}] * {x[i]}" for i in range(k))
    # What is constant within a series rides along as a minimum of plain numbers.
    scored = (
        usable.join(solved, keys, "inner")
        .groupBy(*keys)
        .agg(
            F.expr("min(n_obs) AS n_obs"),
            F.expr(f"sum(pow(y - ({fitted}), 2)) AS sse"),
            *[F.expr(f"min(_beta[{i}]) AS b_{i}") for i in range(k)],
            *[F.expr(f"min(exog_last[{text(f)}]) AS {quoted('last_' + f)}") for f in exog],
        )
    )
    return scored.selectExpr(
        *[quoted(key) for key in keys],
        "n_obs",
        f"{k} AS n_coef",
        "b_0 AS intercept",
        f"{_map({f: f'b_{i}' for i, f in enumerate(features, 1)})} AS coeffs",
        f"sse / greatest(1, n_obs - {k}) AS resid_var",
        f"CAST(array({', '.join(text(f) for f in features)}) AS array<string>) AS feature_cols",
        f"{_map({f: quoted('last_' + f) for f in exog})} AS exog_last",
    )


def _map(entries: dict[str, str]) -> str:
    """SQL map of names to double expressions."""
    return f"CAST(map({', '.join(f'{text(name)}, {value}' for name, value in entries.items())}) AS map<string,double>)"
