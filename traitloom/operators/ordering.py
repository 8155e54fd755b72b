"""Ranks, indices, running sums and exact quantiles without one-task windows.

A window ``partitionBy(key).orderBy(x)`` puts a whole key into one task. Here rows are
range-partitioned on ``(key, x)`` instead, so a key that holds a third of the table is
spread over many tasks; only one total per partition and one per key is combined later.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.session import cut

_MASK = (1 << 33) - 1


def null_safe_on(keys: Sequence[str], left: str, right: str) -> Column:
    """Join condition on ``keys`` that lets NULL keys meet."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    weight: str | None = None,
) -> DataFrame:
    """Add ``name``: the inclusive running sum of ``weight`` (row count if None) per key.

    ``order`` has to be unique within a key for a deterministic result. The sorted rows
    are checkpointed, so both passes over them see the same partitioning.
    """
    keys = list(keys)
    ordered = df.orderBy(*keys, *order).withColumn("__mid", F.monotonically_increasing_id())
    ordered = ordered.withColumn("__part", F.shiftright("__mid", 33))
    if weight is None:
        ordered = ordered.withColumn("__run", F.col("__mid").bitwiseAND(F.lit(_MASK)) + 1)
        step, zero = F.lit(1), F.lit(0)
    else:
        dtype = dict(df.dtypes)[weight]
        whole = dtype in ("int", "bigint", "smallint", "tinyint")
        ordered = ordered.withColumn("__run", F.col(weight).cast("bigint" if whole else "double"))

        def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            carry = 0
            for pdf in batches:
                total = np.cumsum(pdf["__run"].to_numpy()) + carry
                if len(total):
                    carry = total[-1]
                yield pdf.assign(__run=total)

        ordered = ordered.mapInPandas(accumulate, ordered.schema)
        step, zero = F.col(weight), F.lit(0)
    ordered = cut(ordered.drop("__mid"))
    # One row per partition of the sort: the bound is the number of shuffle partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ordered.groupBy("__part")
        .agg(F.max("__run").alias("__total"))
        .select("__part", F.coalesce(F.sum("__total").over(before), zero).alias("__base"))
    )
    out = ordered.join(F.broadcast(starts), "__part").withColumn("__run", F.col("__run") + F.col("__base"))
    if not keys:
        return out.withColumn(name, F.col("__run")).drop("__run", "__base", "__part")
    # One row per key, written so that its size is known: while it is small the rows stay
    # where the sort put them instead of gathering by key.
    first = cut(out.groupBy(*keys).agg(F.min(F.col("__run") - step).alias("__first")))
    joined = out.alias("a").join(first.alias("b"), null_safe_on(keys, "a", "b"))
    return joined.select(
        *[F.col(f"a.{c}").alias(c) for c in df.columns], (F.col("a.__run") - F.col("b.__first")).alias(name)
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weights: dict[str, str]) -> DataFrame:
    """Add the inclusive running sums of several columns of either sign per key (one or more), in one sort.

    ``weights`` maps new names to columns without NULL; ``order`` is unique within a key. Like
    ``running_sum`` this spreads a hot key over the partitions of a sort.
    """
    keys, names = list(keys), list(weights)
    ordered = df.orderBy(*keys, *order).withColumn("__mid", F.monotonically_increasing_id())
    ordered = ordered.withColumns({f"__run_{n}": F.col(c).cast("double") for n, c in weights.items()})

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = np.zeros(len(names))
        columns = [f"__run_{n}" for n in names]
        for pdf in batches:
            total = np.cumsum(pdf[columns].to_numpy(), axis=0) + carry
            if len(total):
                carry = total[-1]
            yield pdf.assign(**{c: total[:, k] for k, c in enumerate(columns)})

    ordered = cut(ordered.mapInPandas(accumulate, ordered.schema).withColumn("__part", F.shiftright("__mid", 33)))
    # One row per partition of the sort: the bound is the number of shuffle partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = ordered.groupBy("__part").agg(*[F.max_by(f"__run_{n}", "__mid").alias(n) for n in names])
    starts = last.select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"__base_{n}") for n in names])
    out = ordered.join(F.broadcast(starts), "__part")
    out = out.withColumns({f"__run_{n}": F.col(f"__run_{n}") + F.col(f"__base_{n}") for n in names})
    begun = F.struct(*[(F.col(f"__run_{n}") - F.col(c)).alias(n) for n, c in weights.items()])
    first = cut(out.groupBy(*keys).agg(F.min_by(begun, "__mid").alias("__first")))
    joined = out.alias("a").join(first.alias("b"), null_safe_on(keys, "a", "b"))
    return joined.select(
        *[F.col(f"a.{c}").alias(c) for c in df.columns], *[(F.col(f"a.__run_{n}") - F.col(f"b.__first.{n}")).alias(n) for n in names]
    )


def row_index(df: DataFrame, order: Sequence[Column | str], name: str = "row_id", keys: Sequence[str] = ()) -> DataFrame:
    """Dense index from 1 in the given order, within ``keys`` if any."""
    return running_sum(df, keys, order, name)


def average_rank(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Rank with ties sharing their mean rank; NULL values get no rank.

    Ties are counted first, so a value shared by a third of the rows is one row in the sort.
    """
    keys = list(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    ranks = running_sum(counts, keys, [col], "__cum", weight="__n").select(
        *keys, col, (F.col("__cum") - (F.col("__n") - 1) / F.lit(2.0)).alias(name)
    )
    joined = df.alias("a").join(ranks.alias("b"), null_safe_on([*keys, col], "a", "b"), "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in df.columns], F.col(f"b.{name}").alias(name))


def exact_quantile(df: DataFrame, keys: Sequence[str], col: str, q: float, name: str) -> DataFrame:
    """One row per key: the linearly interpolated quantile ``q`` of the non-null values.

    Equal values are counted first; only the two neighbouring order statistics of each
    key leave the sort, so nothing is buffered per key.
    """
    keys = list(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_sum(counts, keys, [col], "__cum", weight="__n")
    sizes = cut(cum.groupBy(*keys).agg(F.max("__cum").alias("__size")))
    if keys:
        cum = cum.alias("a").join(sizes.alias("b"), null_safe_on(keys, "a", "b")).select("a.*", "b.__size")
    else:
        cum = cum.withColumn("__size", F.lit(sizes.first()[0]))
    h = (F.col("__size") - 1) * F.lit(float(q))
    lo, hi = F.floor(h) + 1, F.ceil(h) + 1

    def covers(k: Column) -> Column:
        return (F.col("__cum") >= k) & (F.col("__cum") - F.col("__n") < k)

    near = cum.where(covers(lo) | covers(hi)).select(
        *keys,
        F.when(covers(lo), F.col(col)).alias("__lo"),
        F.when(covers(hi), F.col(col)).alias("__hi"),
        (h - F.floor(h)).alias("__frac"),
    )
    picked = near.groupBy(*keys).agg(F.max("__lo").alias("lo"), F.max("__hi").alias("hi"), F.max("__frac").alias("f"))
    return picked.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).cast(T.DoubleType()).alias(name))


def median_of(df: DataFrame, keys: Sequence[str], col: str, name: str = "median") -> DataFrame:
    return exact_quantile(df, keys, col, 0.5, name)
