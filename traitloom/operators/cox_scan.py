"""Cox regression of many scores over the same samples, by blocks of scores.

A cohort is put in time order once per phenotype and cut into chunks of samples. A row of the
chunk table holds the covariates of its samples once, next to the scores of a block of traits.
A Newton step is two passes over the chunks: sums of the weights, added up along the chunks, and
then the chunk's share of likelihood, gradient and information behind the sums before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitloom.operators.ordering import null_safe_on, row_index, running_sums
from traitloom.operators.survival import event_ties, newton_step
from traitloom.session import cut, cut_by, drop_cut

# Traits of a block, and samples of a chunk.
LANES = 64
CHUNK = 2048
# A residual with less than this share of the variance of its score is a constant.
CONSTANT = 1e-12


def score_blocks(scores: DataFrame, keys: Sequence[str], iid: str, score: str, lanes: int = LANES) -> tuple[DataFrame, DataFrame]:
    """The scores as rows (block, iid, entries) and the trait of each (block, lane).

    ``entries`` lists (lane, value), values with mean 0 and variance 1 per trait. NULL scores are left out. A
    trait that has several scores for one sample gives several rows, so each counts.
    """
    keys = list(keys)
    known = scores.where(F.col(score).isNotNull() & F.col(iid).isNotNull())
    traits = known.groupBy(*keys).agg(F.avg(score).alias("__mean"), F.stddev_pop(score).alias("__sd"))
    place = F.col("__place") - 1
    traits = cut(row_index(traits, keys, "__place").select(
        *keys, "__mean", "__sd", F.floor(place / lanes).alias("block"), (place % lanes).cast("int").alias("lane")
    ))
    z = (F.col(f"a.{score}") - F.col("b.__mean")) / F.nullif(F.col("b.__sd"), F.lit(0.0))
    placed = known.alias("a").join(traits.alias("b"), null_safe_on(keys, "a", "b")).select(
        "b.block", F.col(f"a.{iid}").alias("iid"), "b.lane", F.coalesce(z, F.lit(0.0)).alias("value")
    )
    # The window and the grouping both need no more than this partitioning.
    placed = placed.repartition("block", "iid")
    copy = F.row_number().over(Window.partitionBy("block", "iid", "lane").orderBy("value"))
    blocks = placed.withColumn("__copy", copy).groupBy("block", "iid", "__copy").agg(
        F.collect_list(F.struct("lane", "value")).alias("entries")
    )
    return blocks.drop("__copy"), traits.select(*keys, "block", "lane")


def time_chunks(cohort: DataFrame, groups: Sequence[str], time: str, event: str, spread_by: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Add ``chunk``: pieces of about ``size`` samples of a group, from the latest time to the first.

    At one time the samples without event come first. They may fall into several chunks; the events of one
    time never do. Samples are counted per time and only the counts are sorted, over all partitions.
    """
    groups = list(groups)
    happened = F.coalesce(F.col(event) == 1, F.lit(False))
    marked = cohort.withColumn("__happened", happened)
    per_time = marked.groupBy(*groups, time, "__happened").agg(F.count(F.lit(1)).alias("__n"))
    placed = running_sums(per_time, groups, [F.desc_nulls_last(time), F.col("__happened")], {"__run": "__n"})
    on = [*groups, time, "__happened"]
    inside = F.pmod(F.xxhash64(*[F.col(f"a.{c}") for c in spread_by]), F.col("b.__n"))
    before = F.col("b.__run") - F.col("b.__n") + F.when(F.col("a.__happened"), 0).otherwise(inside)
    return marked.alias("a").join(placed.alias("b"), null_safe_on(on, "a", "b")).select(
        *[F.col(f"a.{c}").alias(c) for c in cohort.columns], F.floor(before / size).cast("bigint").alias("chunk")
    )


class _Samples:
    """The samples of one chunk, latest time first and events last among equals."""

    def __init__(self, rows: pa.StructScalar, covariates: int, adjust: int):
        table = rows.values
        n = len(table)
        time = table.field("time").to_numpy(zero_copy_only=False)
        event = table.field("event").to_numpy(zero_copy_only=False)
        cov = table.field("cov").flatten().to_numpy(zero_copy_only=False).reshape(n, covariates)
        entries = table.field("entries")
        owner = np.repeat(np.arange(n), entries.value_lengths().to_numpy(zero_copy_only=False))
        flat = entries.flatten()
        order = np.lexsort((event == 1, -time))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        self.time, self.event, self.cov = time[order], event[order] == 1, cov[order]
        self.lane, self.owner = flat.field("lane").to_numpy(), rank[owner]
        self.value = flat.field("value").to_numpy()
        self.adjustable = np.isfinite(self.cov[:, :adjust]).all(axis=1)
        self.complete = np.isfinite(self.cov).all(axis=1) & np.isfinite(self.time) & np.isfinite(event[order])

    def of(self, lane: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the samples in ``among`` that have a score of the lane."""
        mine = self.lane == lane
        places, values = self.owner[mine], self.value[mine]
        order = np.argsort(places)
        places, values = places[order], values[order]
        return places[among[places]], values[among[places]]


def _pack(m: np.ndarray) -> np.ndarray:
    return m[np.triu_indices(len(m))]


def _unpack(v: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    i, j = np.triu_indices(k)
    out[i, j] = out[j, i] = v
    return out


def _moments(rows: _Samples, lane: int, adjust: int) -> np.ndarray:
    """Sums of products of (1, adjusting covariates, score): over the rows of the adjustment and over complete rows."""
    out = []
    for among in (rows.adjustable, rows.complete):
        at, y = rows.of(lane, among)
        z = np.column_stack([np.ones(len(at)), rows.cov[at, :adjust], y])
        out.append(_pack(z.T @ z))
    return np.concatenate(out)


def _adjustment(sums: np.ndarray, adjust: int) -> np.ndarray:
    """Coefficients of the score on the covariates, then mean and deviation of its residual over complete rows."""
    fit, full = (_unpack(s, adjust + 2) for s in np.split(sums, 2))
    coef = np.linalg.pinv(fit[:-1, :-1], rcond=1e-12, hermitian=True) @ fit[:-1, -1]
    weights = np.append(-coef, 1.0)
    n = full[0, 0]
    mean = weights @ full[:, 0] / n
    var = weights @ full @ weights / n - mean * mean
    return np.concatenate([coef, [mean, np.sqrt(var) if var > CONSTANT * max(1.0, full[-1, -1] / n) else 0.0]])


def _design(rows: _Samples, lane: int, model: np.ndarray, adjust: int) -> tuple[np.ndarray, np.ndarray]:
    at, y = rows.of(lane, rows.complete)
    cov, coef, mean, sd = rows.cov[at], model[: adjust + 1], model[adjust + 1], model[adjust + 2]
    x = (y - coef[0] - cov[:, :adjust] @ coef[1:] - mean) / sd if sd > 0 else np.zeros(len(y))
    return at, np.column_stack([x, cov])


def _weights(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.exp(x @ beta)


def _totals(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    w = _weights(x, beta)
    return np.concatenate([[w.sum()], w @ x, _pack((x.T * w) @ x)])


def _share(time: np.ndarray, event: np.ndarray, x: np.ndarray, beta: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Likelihood, gradient and information of the events of a chunk; ``before`` are the totals of the chunks before.

    The information needs no matrix per time: a sample's x x' counts with the sum of the hazards of the events after it.
    """
    k = len(beta)
    at = np.flatnonzero(event)
    if not len(at):
        return np.zeros(1 + k + k * (k + 1) // 2)
    w = _weights(x, beta)
    wx = w[:, None] * x
    g, first, share = event_ties(time[at])
    last = np.append(first[1:], len(at)) - 1
    s0 = before[0] + np.cumsum(w)[at[last]]
    s1 = before[1 : 1 + k] + np.cumsum(wx, axis=0)[at[last]]
    z0 = s0[g] - share * np.add.reduceat(w[at], first)[g]
    mean = (s1[g] - share[:, None] * np.add.reduceat(wx[at], first, axis=0)[g]) / z0[:, None]
    hazard = np.zeros(len(x))
    hazard[at[last]] = np.add.reduceat(1 / z0, first)
    total = hazard.sum()
    v = w * np.cumsum(hazard[::-1])[::-1]
    v[at] -= w[at] * np.add.reduceat(share / z0, first)[g]
    info = total * _unpack(before[1 + k :], k) + (x.T * v) @ x - mean.T @ mean
    ll = (x[at] @ beta).sum() - np.log(z0).sum()
    return np.concatenate([[ll], x[at].sum(axis=0) - mean.sum(axis=0), _pack(info)])


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.float64()))


def _per_lane(heads: Sequence[str], work: Callable, covariates: int, adjust: int, names: Sequence[str]) -> Callable:
    """One output row per (chunk, lane): ``work(rows, lane, params)`` gives the arrays ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _Samples(batch.column("samples")[i], covariates, adjust)
                params = batch.column("lanes")[i].as_py() if "lanes" in batch.schema.names else [{"lane": v} for v in np.unique(rows.lane).tolist()]
                made = [work(rows, p["lane"], p) for p in params]
                columns = [pa.repeat(batch.column(c)[i], len(params)) for c in heads]
                columns.append(pa.array([p["lane"] for p in params], type=pa.int32()))
                columns += [_lists([m[j] for m in made]) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=[*heads, "lane", *names])

    return run


def _summed(heads: Sequence[str], work: Callable, covariates: int, adjust: int) -> Callable:
    """One output row per (heads, lane) of a partition: the sum of ``work(rows, lane, params)`` over its chunks."""
    one = _per_lane(heads, lambda rows, lane, params: (work(rows, lane, params),), covariates, adjust, ["sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None
        for out in one(batches):
            schema = out.schema
            for i, where in enumerate(zip(*[out.column(c).to_pylist() for c in (*heads, "lane")])):
                sums = np.asarray(out.column("sums")[i].values)
                held[where] = held[where] + sums if where in held else sums
        if held:
            columns = [pa.array(list(c), type=schema.field(j).type) for j, c in enumerate(zip(*held))]
            yield pa.RecordBatch.from_arrays([*columns, _lists(list(held.values()))], schema=schema)

    return run


def cox_scan(
    cohort: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    iid: str,
    time: str,
    event: str,
    covariates: Sequence[str],
    adjust: int = 0,
    strata: Sequence[str] = (),
    max_iter: int = 50,
    tol: float = 1e-9,
    size: int = CHUNK,
) -> DataFrame:
    """Maximum partial likelihood of every score of ``blocks`` (see ``score_blocks``) per key of ``cohort``.

    The model of a score holds the score, adjusted for the first ``adjust`` covariates and scaled over its
    complete rows, and all ``covariates``. Returns keys, block, lane, coef and se (arrays, the score first),
    converged, iterations, loglik. A score without complete rows has no row; NULL anywhere leaves a sample out
    of the fit. Ties by Efron's method; Newton's method as in ``cox_ph``.

    What a task holds: a chunk of a block (``size`` samples, more only if more events share one time of one
    stratum), and for the sums along the chunks one short row per chunk of one score.
    """
    keys, p = list(keys), len(covariates)
    k = p + 1
    stratum = [f"__s{i}" for i in range(len(strata))]
    base = cohort.select(
        *keys, *[F.col(s).alias(n) for s, n in zip(strata, stratum)], F.col(iid).alias("iid"),
        F.col(time).cast("double").alias("time"), F.col(event).cast("double").alias("event"),
        F.array(*[F.col(c).cast("double") for c in covariates]).cast("array<double>").alias("cov"),
    )
    chunked = time_chunks(base, [*keys, *stratum], "time", "event", ["iid", "cov"], size)
    types = dict(chunked.dtypes)
    whole = [*keys, "block", *stratum, "chunk"]
    heads = [*keys, "block"]
    schema = {c: types.get(c, "bigint") for c in whole}
    joined = chunked.alias("a").join(blocks.alias("b"), F.col("a.iid") == F.col("b.iid")).select(
        *[F.col(f"{'b' if c == 'block' else 'a'}.{c}").alias(c) for c in whole],
        F.struct("a.time", "a.event", "a.cov", "b.entries").alias("sample"),
    )
    # The chunk table stays where it lies: a Newton step moves only what it asks of each chunk, by a key that is never NULL.
    unit = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(whole)]))
    rows = cut_by(joined.groupBy(*whole).agg(F.collect_list("sample").alias("samples")).withColumn("unit", unit), "unit")

    def ddl(columns: Sequence[str]) -> str:
        return "".join(f"`{c}` {schema[c]}, " for c in columns)

    def with_lanes(right: DataFrame, on: Sequence[str]) -> DataFrame:
        return rows.alias("a").join(right.alias("b"), null_safe_on(on, "a", "b")).select("a.*", "b.lanes")

    def with_own_lanes(right: DataFrame) -> DataFrame:
        own = right.select(unit.alias("unit"), "lanes")
        return rows.alias("a").join(own.hint("shuffle_hash"), "unit").select("a.*", "lanes")

    def adjusted(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.vstack(pdf["sums"]).sum(axis=0)
        row = {c: [pdf[c].iloc[0]] for c in (*heads, "lane")}
        if sums[len(sums) // 2] == 0:
            return pd.DataFrame(row | {"model": [None]}).iloc[:0]
        return pd.DataFrame(row | {"model": [_adjustment(sums, adjust)]})

    moments = rows.mapInArrow(
        _summed(heads, lambda r, lane, _: _moments(r, lane, adjust), p, adjust), f"{ddl(heads)}lane int, sums array<double>"
    )
    models = moments.groupBy(*heads, "lane").applyInPandas(adjusted, f"{ddl(heads)}lane int, model array<double>")
    zeros = F.array(*[F.lit(0.0)] * k)
    state = cut(models.select(
        *heads, "lane", "model", zeros.alias("beta"), zeros.alias("prev"), F.lit(None).cast("double").alias("ll"),
        F.lit(0).alias("steps"), F.lit(True).alias("open"), zeros.alias("se"),
    ))
    state_schema = f"{ddl(heads)}lane int, model array<double>, beta array<double>, prev array<double>, ll double, steps int, open boolean, se array<double>"

    def totals(r: _Samples, lane: int, params: dict) -> tuple[np.ndarray, ...]:
        model, beta = np.asarray(params["model"]), np.asarray(params["beta"])
        return model, beta, _totals(_design(r, lane, model, adjust)[1], beta)

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        # Latest chunk first in each stratum: what is at risk in a chunk are the chunks before it.
        pdf = pdf.sort_values([*stratum, "chunk"], na_position="last", ignore_index=True)
        sums = np.vstack(pdf["sums"])
        run = np.cumsum(sums, axis=0) - sums
        if stratum:
            fresh = pdf.groupby(stratum, dropna=False, sort=False).ngroup().to_numpy()
            begin = np.flatnonzero(np.r_[True, fresh[1:] != fresh[:-1]])
            for a, b in zip(begin, np.append(begin[1:], len(fresh))):
                run[a:b] = np.cumsum(sums[a:b], axis=0) - sums[a:b]
        return pdf.assign(sums=list(run))

    def share(r: _Samples, lane: int, params: dict) -> np.ndarray:
        model, beta = np.asarray(params["model"]), np.asarray(params["beta"])
        at, x = _design(r, lane, model, adjust)
        return _share(r.time[at], r.event[at], x, beta, np.asarray(params["sums"]))

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.vstack(pdf["sums"]).sum(axis=0)
        first = pdf.iloc[0]
        moved = newton_step(
            np.asarray(first["beta"]), np.asarray(first["prev"]), first["ll"], int(first["steps"]),
            sums[0], sums[1 : 1 + k], _unpack(sums[1 + k :], k), tol,
        )
        row = {c: [first[c]] for c in (*heads, "lane", "model")}
        return pd.DataFrame(row | {c: [v] for c, v in moved.items()})

    lane_ddl = "lane int, model array<double>, beta array<double>, sums array<double>"
    for _ in range(max_iter):
        live = state.where("open")
        if live.isEmpty():
            break
        ask = live.groupBy(*heads).agg(F.collect_list(F.struct("lane", "model", "beta")).alias("lanes"))
        sums = with_lanes(ask, heads).mapInArrow(_per_lane(whole, totals, p, adjust, ["model", "beta", "sums"]), ddl(whole) + lane_ddl)
        sums = sums.groupBy(*heads, "lane").applyInPandas(before, ddl(whole) + lane_ddl)
        ask = sums.groupBy(*whole).agg(F.collect_list(F.struct("lane", "model", "beta", "sums")).alias("lanes"))
        parts = with_own_lanes(ask).mapInArrow(_summed(heads, share, p, adjust), f"{ddl(heads)}lane int, sums array<double>")
        fed = parts.alias("a").join(live.alias("b"), null_safe_on([*heads, "lane"], "a", "b")).select("b.*", "a.sums")
        moved = fed.groupBy(*heads, "lane").applyInPandas(step, state_schema)
        old, state = state, cut(state.where("NOT open").unionByName(moved))
        drop_cut(old)
    drop_cut(rows)
    return state.select(
        *heads, "lane", F.col("beta").alias("coef"), "se", (~F.col("open")).alias("converged"),
        F.col("steps").alias("iterations"), F.col("ll").alias("loglik"),
    )
