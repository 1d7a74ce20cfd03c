"""Design tables of the return model: target, lags, season, extra regressors.

Row order is the week within a series.  All frames here have one row per series and
week, so a window group is as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropwind.functions.columns import as_names, require_columns
from cropwind.functions.numeric import season_cosine, season_sine
from cropwind.operators.market import in_order, log_returns

RISK = "global_risk_0_100"
MODES = ("legacy", "auto")


@dataclass(frozen=True)
class Design:
    """A design table with the regressors in model order."""

    frame: DataFrame
    features: tuple[str, ...]
    keys: tuple[str, ...]


def _checked_extras(extra: Iterable[str] | None, columns: Iterable[str]) -> list[str]:
    extra = list(extra or [])
    for name in extra:
        if not name.startswith("exog_"):
            raise ValueError(f"extra regressor {name!r} must start with 'exog_'")
    require_columns(columns, extra)
    return extra


def join_price_and_risk(
    price: DataFrame, risk: DataFrame, price_col: str, risk_col: str = RISK, keys: str | Iterable[str] = "commodity",
    risk_keys: str | Iterable[str] | None = None,
) -> DataFrame:
    """Weeks with both a price and a risk row; every column of ``risk`` is kept.

    Where many price series share a risk series, ``risk_keys`` names the columns of ``price`` that tell
    which one (a region, say): the risk is then one row for each of these and week, and is not
    copied for each price series before the join.
    """
    keys = as_names(keys)
    shared = keys if risk_keys is None else as_names(risk_keys)
    named = list(dict.fromkeys([*keys, *shared]))
    require_columns(price.columns, [*named, "date", price_col])
    require_columns(risk.columns, [*shared, "date", risk_col])
    return price.select(*named, "date", price_col).join(risk, [*shared, "date"], "inner")


def merge_price_and_risk(
    price: DataFrame,
    risk: DataFrame,
    price_col: str = "price_front_fut",
    risk_col: str = RISK,
    lags: int = 1,
    mode: str = "legacy",
    exog_cols: Iterable[str] | None = None,
    keys: str | Iterable[str] = "commodity",
) -> Design:
    """Training table of log returns and risk on a 0-1 scale.

    ``legacy`` adds ``lags`` lags of both and drops rows with a NULL in any column, the extra
    columns of ``risk`` included.  ``auto`` keeps ``y``, ``risk`` and ``exog_cols`` and leaves
    the lags to :func:`auto_features`.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    keys = as_names(keys)
    merged = log_returns(join_price_and_risk(price, risk, price_col, risk_col, keys), price_col, keys)
    merged = merged.dropna(subset=[price_col, risk_col, "y"])
    if mode == "auto":
        extra = list(exog_cols or [])
        require_columns(merged.columns, extra)
        frame = merged.select(*keys, "date", "y", (F.col(risk_col) / 100.0).alias("risk"), *extra)
        return Design(frame.dropna(subset=["y", "risk", *extra]), (), tuple(keys))
    order = in_order(keys)
    features = []
    lagged = merged.withColumn("risk_norm", F.col(risk_col) / 100.0)
    for i in range(1, lags + 1):
        lagged = lagged.withColumns(
            {f"y_lag{i}": F.lag("y", i).over(order), f"risk_lag{i}": F.lag("risk_norm", i).over(order)}
        )
        features += [f"y_lag{i}", f"risk_lag{i}"]
    complete = lagged.dropna(subset=[c for c in lagged.columns if c not in keys])
    return Design(complete.select(*keys, "date", "y", *features), tuple(features), tuple(keys))


def unit_risk(base: str, keys: str | Iterable[str]) -> Column:
    """Risk on a 0-1 scale: a series that exceeds 1.5 anywhere is taken as 0-100."""
    top = F.max(base).over(Window.partitionBy(*as_names(keys)))
    return F.when(top > 1.5, F.col(base) / 100.0).otherwise(F.col(base))


def auto_features(
    df: DataFrame,
    p: int = 2,
    q: int = 2,
    include_seasonal: bool = True,
    season_period: int = 52,
    extra_exog: Iterable[str] | None = None,
    keys: str | Iterable[str] = "commodity",
) -> Design:
    """Lags of ``y`` and risk, one seasonal harmonic and ``exog_*`` columns.

    Lags count rows of ``df`` as given, at least one of each kind.  Existing ``risk_lag*``
    columns are used when there are enough of them; else they come from ``risk`` or
    ``global_risk_0_100``.  The harmonic runs over the row position, before rows with NULLs
    are dropped.
    """
    keys = as_names(keys)
    require_columns(df.columns, [*keys, "date", "y"])
    extra = _checked_extras(extra_exog, df.columns)
    order = in_order(keys)
    n_y, n_risk = max(1, p), max(1, q)
    y_lags = [f"y_lag{k}" for k in range(1, n_y + 1)]
    risk_lags = [f"risk_lag{k}" for k in range(1, n_risk + 1)]

    given = [c for c in df.columns if c.startswith("risk_lag")]
    base = next((c for c in ("risk", RISK) if c in df.columns), None)
    work = df
    if len(given) < n_risk:
        if base is None:
            raise ValueError(f"neither 'risk' nor '{RISK}' found and fewer than {n_risk} risk_lag columns")
        work = work.withColumn("_risk", unit_risk(base, keys))
        risk = {name: F.lag("_risk", k).over(order) for k, name in enumerate(risk_lags, 1)}
    else:
        require_columns(df.columns, risk_lags)
        risk = {}
    added = {name: F.lag("y", k).over(order) for k, name in enumerate(y_lags, 1)} | risk
    features = [*y_lags, *risk_lags]
    if include_seasonal:
        t = F.row_number().over(order) - 1
        added |= {"season_sin": season_sine(t, season_period), "season_cos": season_cosine(t, season_period)}
        features += ["season_sin", "season_cos"]
    work = work.withColumns(added).drop("_risk")
    features += extra
    return Design(work.dropna(subset=["y", *features]), tuple(features), tuple(keys))


def tail_in_order(df: DataFrame, value: str, n: int, keys: str | Iterable[str] = "commodity", output: str = "tail") -> DataFrame:
    """Last ``n`` values of each series, oldest first, as one array per series."""
    keys = as_names(keys)
    newest_first = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    last = df.withColumn("_rank", F.row_number().over(newest_first)).where(F.col("_rank") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("date", value)))
    return last.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(output))


def latest_row(df: DataFrame, keys: str | Iterable[str] = "commodity", date: str = "date") -> DataFrame:
    """The row of the greatest date of each series."""
    keys = as_names(keys)
    values = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(date)).alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def last_two(df: DataFrame, value: str, keys: str | Iterable[str] = "commodity") -> DataFrame:
    """Last and previous value of each series; a single row is its own predecessor."""
    keys = as_names(keys)
    order = in_order(keys)
    paired = df.withColumn("_prev", F.lag(value).over(order)).withColumn("_rank", F.row_number().over(order))
    newest = F.struct(F.col(value).alias("last"), F.when(F.col("_rank") == 1, F.col(value)).otherwise(F.col("_prev")).alias("prev"))
    return (
        paired.groupBy(*keys)
        .agg(F.max_by(newest, F.col("date")).alias("_two"))
        .select(*keys, F.col("_two.last").alias(f"last_{value}"), F.col("_two.prev").alias(f"prev_{value}"))
    )
