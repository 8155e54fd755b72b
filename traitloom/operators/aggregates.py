"""Grouped operators. All of them combine on the map side, so a hot key is cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur on more than one row, with their count ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def arg_best(
    df: DataFrame, keys: Sequence[str], col: str, how: str, tie: Sequence[Column | str], first_of: str | None = None
) -> DataFrame:
    """The row with the smallest (``how='min'``) or largest value of ``col`` per key.

    Missing values are passed over, the first row by ``tie`` wins among equals, and a group
    without any value gives no row. With ``first_of`` the smallest value of that column over
    the whole group, rows without a value included, comes along as ``group_first``.
    """
    dtype = dict(df.dtypes)[col]
    value = F.col(col)
    if dtype in ("double", "float"):
        value = F.when(~F.isnan(value), value)
    rank = value if how == "min" else -value
    ties = [t if isinstance(t, Column) else F.col(t) for t in tie]
    order = F.when(value.isNotNull(), F.struct(rank.alias("r"), *[t.alias(f"t{i}") for i, t in enumerate(ties)]))
    rest = [c for c in df.columns if c not in keys]
    aggs = [F.min_by(F.struct(*rest), order).alias("__best")]
    if first_of:
        aggs.append(F.min(first_of).alias("group_first"))
    best = df.groupBy(*keys).agg(*aggs).where(F.col("__best").isNotNull())
    extra = ["group_first"] if first_of else []
    names = [c if c in keys else f"__best.{c}" for c in df.columns]
    return best.select(*names, *extra)


def complete_case(df: DataFrame, keys: Sequence[str], n: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly ``n`` times, ``n`` given per ``group`` (column ``n``)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__seen"))
    passing = counts.join(n, list(group)).where(F.col("__seen") == F.col("n")).select(*keys)
    return df.join(passing, list(keys), "left_semi")


def average_measures(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def collapse(df: DataFrame, keys: Sequence[str], col: str, sep: str, order: Sequence[str] = (), distinct: bool = False) -> DataFrame:
    """Join the texts of a group into one, in a stated order (or distinct and sorted)."""
    if distinct:
        text = F.array_join(F.sort_array(F.collect_set(col)), sep)
    else:
        pairs = F.sort_array(F.collect_list(F.struct(*order, F.col(col).alias("__v"))))
        text = F.array_join(F.transform(pairs, lambda p: p["__v"]), sep)
    return df.groupBy(*keys).agg(text.alias(col))


def trait_sizes(df: DataFrame, keys: Sequence[str], variant: str, sample: str) -> DataFrame:
    """Numbers of distinct variants and samples per trait.

    Counting goes through distinct pairs, one at a time, so that no set is held per trait.
    """
    n_var = df.select(*keys, variant).distinct().groupBy(*keys).agg(F.count(variant).alias("n_variants"))
    n_smp = df.select(*keys, sample).distinct().groupBy(*keys).agg(F.count(sample).alias("n_samples"))
    return n_var.join(n_smp, list(keys))
