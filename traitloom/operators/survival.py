"""Cox regression from risk-set sums.

Samples are summed by (key, stratum, time) on the map side; what follows works on distinct
times. No task sees the samples of a key, only one row of sums per distinct time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.operators.ordering import null_safe_on, running_sums
from traitloom.session import cut, drop_cut, spread

# Fixed value: the 97.5 % point of the normal distribution.
Z975 = 1.959963984540054


def risk_set(df: DataFrame, strata: Sequence[str], time: str, sums: dict[str, Column]) -> DataFrame:
    """Sums over the samples still at risk at each distinct time of a stratum.

    ``sums`` maps a name to a value per sample. Samples are summed per time first; the running
    sums over the times are spread over the partitions of a sort, so a stratum may have as
    many distinct times as samples.
    """
    per_time = df.groupBy(*strata, time).agg(*[F.sum(v).alias(f"__at_{k}") for k, v in sums.items()])
    kinds = {k: dict(per_time.dtypes)[f"__at_{k}"] for k in sums}
    out = running_sums(per_time, strata, [F.col(time).desc()], {k: f"__at_{k}" for k in sums})
    return out.select(*strata, time, *[F.col(k).cast(kinds[k]).alias(k) if kinds[k] != "bigint" else F.round(k).cast("bigint").alias(k) for k in sums])


def cox_score_test(df: DataFrame, keys: Sequence[str], time: str, event: str, x: str, strata: Sequence[str] = ()) -> DataFrame:
    """Score statistic ``u``, its variance ``v`` and ``chisq`` of one covariate at zero."""
    groups = [*keys, *strata]
    xx = F.col(x).cast("double")
    at_risk = risk_set(df, groups, time, {"s0": F.lit(1.0), "s1": xx, "s2": xx * xx})
    events = df.where(F.col(event) == 1).groupBy(*groups, time).agg(
        F.count(F.lit(1)).alias("d"), F.sum(xx).alias("dx")
    )
    j = events.join(at_risk, [*groups, time])
    mean = F.col("s1") / F.col("s0")
    out = j.groupBy(*keys).agg(
        F.sum(F.col("dx") - F.col("d") * mean).alias("u"),
        F.sum(F.col("d") * (F.col("s2") / F.col("s0") - mean * mean)).alias("v"),
    )
    return out.withColumn("chisq", F.col("u") * F.col("u") / F.nullif(F.col("v"), F.lit(0.0)))


def _unpack(packed: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(packed), k, k))
    i, j = np.triu_indices(k)
    out[:, i, j] = packed
    out[:, j, i] = packed
    return out


def event_ties(times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For event times with equals side by side: number of the tie of each event, first event of
    each tie, and the share of the tied events that Efron's method has taken out at each event."""
    first = np.flatnonzero(np.r_[True, times[1:] != times[:-1]])
    d = np.diff(np.append(first, len(times)))
    g = np.repeat(np.arange(len(first)), d)
    return g, first, (np.arange(len(times)) - first[g]) / d[g]


def _stratum(times: pd.DataFrame, k: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and information of one stratum, ties by Efron's method."""
    # Rows come per (time, event); latest time first, both sorts of a time side by side.
    t = times.sort_values("time", ascending=False)
    when, first = np.unique(-t["time"].to_numpy(), return_index=True)
    ev = np.where(t["event"].to_numpy() == 1, 1.0, 0.0)
    w0, w1 = t["s0"].to_numpy(), np.vstack(t["s1"].to_numpy())
    w2, d = _unpack(np.vstack(t["s2"].to_numpy()), k), t["n"].to_numpy() * ev

    def per_time(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(v, first, axis=0)

    s0 = np.cumsum(per_time(w0))
    s1 = np.cumsum(per_time(w1), axis=0)
    s2 = np.cumsum(per_time(w2), axis=0)
    d, d0 = per_time(d).astype(int), per_time(w0 * ev)
    d1, d2 = per_time(w1 * ev[:, None]), per_time(w2 * ev[:, None, None])
    dx = per_time(np.vstack(t["x"].to_numpy()) * ev[:, None])
    if not d.any():
        return 0.0, np.zeros(k), np.zeros((k, k))
    m = np.repeat(np.arange(len(d)), d)
    _, begin, share = event_ties(m)
    has = m[begin]
    z0 = s0[m] - share * d0[m]
    mean = (s1[m] - share[:, None] * d1[m]) / z0[:, None]
    info = np.tensordot(np.add.reduceat(1 / z0, begin), s2[has], 1) - np.tensordot(np.add.reduceat(share / z0, begin), d2[has], 1)
    ll = (dx[has] @ beta).sum() - np.log(z0).sum()
    return ll, dx[has].sum(axis=0) - mean.sum(axis=0), info - mean.T @ mean


def newton_step(
    beta: np.ndarray, prev: np.ndarray, old_ll: float, steps: int, ll: float, grad: np.ndarray, info: np.ndarray, tol: float
) -> dict:
    """State of a model after one step: a step that lowered the likelihood is halved, and
    directions without information stay where they are."""
    k = len(beta)
    scale = np.sqrt(np.clip(np.diag(info), 0, None))
    live = scale > 1e-8 * max(1.0, scale.max(initial=0.0))
    cov = np.zeros((k, k))
    if live.any() and np.isfinite(info).all():
        s = scale[live]
        inv = np.linalg.pinv(info[np.ix_(live, live)] / np.outer(s, s), rcond=1e-10, hermitian=True)
        cov[np.ix_(live, live)] = inv / np.outer(s, s)
    worse = steps > 0 and not pd.isna(old_ll) and not (ll >= old_ll - 1e-9 * (1 + abs(old_ll)))
    if worse:
        new, keep_ll, keep = (beta + prev) / 2, old_ll, prev
        done = float(np.abs(new - prev).max(initial=0.0)) < tol
    else:
        move = cov @ grad
        done = float(np.abs(move).max(initial=0.0)) < tol
        new, keep_ll, keep = (beta if done else beta + move), ll, beta
    return {"beta": new, "prev": keep, "ll": keep_ll, "steps": steps + 1, "open": not done, "se": np.sqrt(np.clip(np.diag(cov), 0, None))}


def cox_ph(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    event: str,
    covariates: Sequence[str],
    strata: Sequence[str] = (),
    max_iter: int = 50,
    tol: float = 1e-9,
) -> DataFrame:
    """Maximum partial likelihood per key: coef, se (arrays), converged, iterations, loglik.

    Newton's method. Each step is one aggregation over the samples of the keys still open:
    sums of the weights and of their products with the covariates per distinct time and
    event flag. Only those rows of one key meet in a task, never its samples. A step that lowers the likelihood is
    halved, and directions without information stay at zero. The state (one row per key)
    is written out after each step, so a lost executor costs at most one step.
    """
    keys, strata, covariates = list(keys), list(strata), list(covariates)
    k = len(covariates)
    pairs = list(zip(*np.triu_indices(k)))
    base = df.select(
        *keys, *[F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)],
        F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("event"),
        *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(covariates)],
    )
    complete = F.col("time").isNotNull() & F.col("event").isNotNull()
    for i in range(k):
        complete = complete & F.col(f"__x{i}").isNotNull()
    base = base.where(complete)
    # Every step is heavy per row, so the rows are dealt out evenly and written once, whatever
    # joins or hot keys they come from.
    base = cut(spread(base, *base.columns))
    groups = [*keys, *[f"__s{i}" for i in range(len(strata))]]
    types = dict(df.dtypes)
    state_cols = "beta array<double>, prev array<double>, ll double, steps int, open boolean, se array<double>"
    state_schema = "".join(f"{c} {types[c]}, " for c in keys) + state_cols
    zeros = F.array(*[F.lit(0.0)] * k)
    state = cut(
        base.select(*keys).distinct().select(
            *keys, zeros.alias("beta"), zeros.alias("prev"), F.lit(None).cast("double").alias("ll"),
            F.lit(0).alias("steps"), F.lit(True).alias("open"), zeros.alias("se"),
        )
    )

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        beta, prev = np.asarray(pdf["beta"].iloc[0]), np.asarray(pdf["prev"].iloc[0])
        old_ll, steps = pdf["ll"].iloc[0], int(pdf["steps"].iloc[0])
        ll, grad, info = 0.0, np.zeros(k), np.zeros((k, k))
        for _, part in pdf.groupby(groups[len(keys):], dropna=False) if strata else [(None, pdf)]:
            a, b, c = _stratum(part, k, beta)
            ll, grad, info = ll + a, grad + b, info + c
        row = {c: [pdf[c].iloc[0]] for c in keys}
        moved = newton_step(beta, prev, old_ll, steps, ll, grad, info, tol)
        return pd.DataFrame(row | {c: [v] for c, v in moved.items()})

    x = [F.col(f"__x{i}") for i in range(k)]
    eta = F.lit(0.0)
    for i in range(k):
        eta = eta + x[i] * F.col("beta")[i]
    w = F.col("__w")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("s0")]
    sums += [F.sum(x[i]).alias(f"x_{i}") for i in range(k)]
    sums += [F.sum(w * x[i]).alias(f"s1_{i}") for i in range(k)]
    sums += [F.sum(w * x[i] * x[j]).alias(f"s2_{n}") for n, (i, j) in enumerate(pairs)]
    arrays = [F.array(*[F.col(f"{a}_{i}") for i in range(k)]).alias(a) for a in ("x", "s1")]
    arrays.append(F.array(*[F.col(f"s2_{n}") for n in range(len(pairs))]).alias("s2"))

    for _ in range(max_iter):
        if state.where("open").isEmpty():
            break
        active = state.where("open").select(*keys, "beta")
        joined = base.alias("a").join(active.alias("b"), null_safe_on(keys, "a", "b")).select("a.*", "b.beta")
        per_time = joined.withColumn("__w", F.exp(eta)).groupBy(*groups, "time", "event").agg(*sums)
        per_time = per_time.select(*groups, "time", "event", "n", "s0", *arrays)
        fed = per_time.alias("a").join(state.alias("b"), null_safe_on(keys, "a", "b")).select(
            "a.*", *[f"b.{c}" for c in ("beta", "prev", "ll", "steps")]
        )
        moved = fed.groupBy(*keys).applyInPandas(step, state_schema)
        old, state = state, cut(state.where("NOT open").unionByName(moved))
        drop_cut(old)
    return state.select(
        *keys, F.col("beta").alias("coef"), "se", (~F.col("open")).alias("converged"),
        F.col("steps").alias("iterations"), F.col("ll").alias("loglik"),
    )


@F.pandas_udf(T.DoubleType())
def wald_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value of a z statistic."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


def hazard_ratios(fits: DataFrame, keys: Sequence[str], index: int = 0) -> DataFrame:
    """hr, hr_low, hr_high (95 %) and the Wald p-value of one covariate."""
    b, se = F.col("coef")[index], F.nullif(F.col("se")[index], F.lit(0.0))
    return fits.select(
        *keys,
        F.exp(b).alias("hr"),
        F.exp(b - Z975 * se).alias("hr_low"),
        F.exp(b + Z975 * se).alias("hr_high"),
        wald_p(b / se).alias("pvalue"),
        "converged",
    )
