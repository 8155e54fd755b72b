"""Standardising and adjusting by group.

Everything works from sums per group, combined on the map side, and joins one small row per
group back; a group is never sorted or collected, so a hot one costs no more than others. The small table is
written first: Spark then sees its true size and, up to the broadcast threshold, joins without
moving the rows at all; beyond it the join is a shuffled one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.operators.ordering import null_safe_on, row_index
from traitloom.session import cut


def join_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], cols: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns ``cols`` of its group's row in ``stats``; NULL keys meet."""
    joined = df.alias("a").join(stats.alias("b"), null_safe_on(keys, "a", "b"), how)
    return joined.select("a.*", *[F.col(f"b.{c}").alias(c) for c in cols])


def residualise_factor(df: DataFrame, keys: Sequence[str], y: str, factor: str) -> DataFrame:
    """Residual of ``y`` on a factor within ``keys``: the deviation from the level's mean."""
    means = cut(df.groupBy(*keys, factor).agg(F.avg(y).alias("__mean")))
    joined = join_stats(df, means, [*keys, factor], ["__mean"])
    return joined.withColumn(y, F.col(y) - F.col("__mean")).select(*df.columns)


def zscore(df: DataFrame, keys: Sequence[str], cols: Sequence[str], constant: float | None = None) -> DataFrame:
    """Population z-scores per group. A constant column gives ``constant`` (NULL by default)."""
    aggs = [f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = cut(df.groupBy(*keys).agg(*aggs))
    out = join_stats(df, stats, keys, [f"__{n}_{c}" for c in cols for n in "ms"])
    for c in cols:
        z = (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))
        if constant is not None:
            z = F.when(F.col(f"__s_{c}") == 0, F.when(F.col(c).isNotNull(), F.lit(float(constant)))).otherwise(z)
        out = out.withColumn(c, z)
    return out.select(*df.columns)


def ols_sums(y: str, xs: Sequence[str]) -> list[Column]:
    """Aggregates for least squares of ``y`` on ``xs``, over rows where all are present."""
    terms = [*xs, y]
    whole = F.lit(True)
    for c in terms:
        whole = whole & F.col(c).isNotNull()

    def part(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(whole, value.cast("double"))), F.lit(0.0))

    sums = [part(F.lit(1.0))] + [part(F.col(c)) for c in terms]
    sums += [part(F.col(a) * F.col(b)) for k, a in enumerate(terms) for b in terms[k:]]
    return [s.alias(f"__ols{i}") for i, s in enumerate(sums)]


def _solve_sums(row: np.ndarray) -> np.ndarray:
    # Length is 1 + t + t(t+1)/2 for t terms, the outcome being the last one.
    t = int((np.sqrt(8 * len(row) + 1) - 3) / 2 + 0.5)
    n, first, second = row[0], row[1 : 1 + t], row[1 + t :]
    if n <= 0:
        return np.full(t, np.nan)
    cross = np.zeros((t, t))
    cross[np.triu_indices(t)] = second
    cross = cross + np.triu(cross, 1).T
    centred = cross - np.outer(first, first) / n
    scale = np.sqrt(np.clip(np.diag(centred), 0, None)[:-1])
    # A column that is constant but for rounding has no slope.
    live = scale > 1e-9 * np.sqrt(np.diag(cross)[:-1] + 1e-300)
    slope = np.zeros(t - 1)
    if live.any():
        s = scale[live]
        a = centred[:-1, :-1][np.ix_(live, live)] / np.outer(s, s)
        b = centred[:-1, -1][live] / s
        slope[live] = np.linalg.lstsq(a, b, rcond=1e-10)[0] / s
    mean = first / n
    return np.concatenate([[mean[-1] - slope @ mean[:-1]], slope])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ols_coefficients(sums: pd.Series) -> pd.Series:
    """Intercept and slopes from the sums of one group; rank-deficient systems are fine."""
    return pd.Series([_solve_sums(np.asarray(row, dtype=float)) for row in sums])


def ols(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """One row per key: ``coef`` (intercept first) and the number of rows used, ``n_used``."""
    sums = ols_sums(y, xs)
    stats = df.groupBy(*keys).agg(*sums)
    packed = F.array(*[F.col(f"__ols{i}") for i in range(len(sums))])
    return stats.select(*keys, F.col("__ols0").cast("bigint").alias("n_used"), ols_coefficients(packed).alias("coef"))


def fitted(xs: Sequence[str], coef: str = "coef") -> Column:
    value = F.col(coef)[0]
    for k, x in enumerate(xs):
        value = value + F.col(coef)[k + 1] * F.col(x)
    return value


def residualise(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Replace ``y`` by its residual on ``xs`` within ``keys``; NULL where an input is."""
    coefs = cut(ols(df, keys, y, xs))
    joined = join_stats(df, coefs, keys, ["coef"])
    return joined.withColumn(y, F.col(y) - fitted(xs)).select(*df.columns)


def level_codes(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Add ``name``: the place of the level from 0 in alphabetical order, NULL where the level is.

    The levels are a joined table, so there may be as many as there are rows.
    """
    levels = row_index(df.where(F.col(col).isNotNull()).select(col).distinct(), [col], "__place")
    coded = join_stats(df, levels.withColumn("__place", F.col("__place") - 1), [col], ["__place"], "left")
    return coded.withColumnRenamed("__place", name)


def one_hot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Indicator columns ``<col>_<level>``; the alphabetically first level is left out.

    The levels become the schema, so they are read on the driver: for factors of a
    model. A column with very many levels is better coded with ``level_codes``.
    """
    for c in cols:
        levels = sorted(row[0] for row in df.where(F.col(c).isNotNull()).select(c).distinct().collect())
        df = df.select(
            "*", *[F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for v in levels[1:]]
        ).drop(c)
    return df
