"""Association of scores with disease: every platform, phecode and trait in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.operators.cox_scan import cox_scan, score_blocks
from traitloom.operators.regression import fitted, join_stats, ols_coefficients, ols_sums, one_hot, zscore
from traitloom.operators.survival import hazard_ratios
from traitloom.session import cut

KEYS = ["platform", "phecode", "trait"]
COMPONENTS = [f"PC{i}" for i in range(1, 11)]


def ancestry_subset(qc: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """Samples of the main ancestry group with array type and components."""
    return qc.where(F.col("in_ancestry_subset") == 1).select("sample_id", "array_type", *components)


def prepare_assoc(
    frame: DataFrame,
    keys: Sequence[str] = KEYS,
    components: Sequence[str] = COMPONENTS,
    category: str | None = "array_type",
    others: Sequence[str] = ("event", "time"),
) -> DataFrame:
    """Model frame per key: scaled components, indicators, and the score adjusted for the
    components, on complete rows, scaled again.

    The least-squares sums and the component scales come from one aggregation. Scaling the
    score before adjusting it would cancel in the last scaling, so it is left out.
    """
    # Written once: levels, sums, scales and result each read it, and the joins behind it move every sample.
    frame = cut(frame)
    if category is not None:
        frame = one_hot(frame, [category])
    sums = ols_sums("score", components)
    scales = [f(c).alias(f"__{n}_{c}") for c in components for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = frame.groupBy(*keys).agg(*sums, *scales)
    packed = F.array(*[F.col(f"__ols{i}") for i in range(len(sums))])
    names = [f"__{n}_{c}" for c in components for n in "ms"]
    stats = cut(stats.select(*keys, *names, ols_coefficients(packed).alias("coef")))
    joined = join_stats(frame, stats, keys, [*names, "coef"])
    joined = joined.withColumn("score", F.col("score") - fitted(components))
    for c in components:
        z = (F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0))
        joined = joined.withColumn(c, F.when(F.col(f"__s_{c}") == 0, 0.0).otherwise(z))
    complete = joined.select(*frame.columns).dropna(subset=["score", *components, *others])
    return zscore(complete, keys, ["score"], constant=0.0)


def phewas(scores: DataFrame, survival: DataFrame, qc: DataFrame, components: Sequence[str] = COMPONENTS) -> DataFrame:
    """platform, phecode, trait, hr, hr_low, hr_high, pvalue of every score.

    ``scores``: platform, trait, iid, score. ``survival``: phecode, eid, genid, sex, event,
    time. ``qc``: sample_id, array_type and components. Strata are the sexes; a phecode with
    one sex has one stratum. The scores go through in blocks of traits (``cox_scan``), so the covariates of a
    sample are held once per block. Indicators come from the levels of the QC table; a level that a
    phecode lacks carries no information there and leaves the score's estimate alone.
    """
    qc = one_hot(qc, ["array_type"])
    indicators = [c for c in qc.columns if c.startswith("array_type_")]
    # Scaled once over the samples: it keeps the sums of products well conditioned and changes no estimate.
    scales = qc.agg(*[f(c).alias(f"{n}_{c}") for c in components for n, f in (("m", F.avg), ("s", F.stddev_pop))] or [F.lit(0)]).first()
    scaled = [((F.col(c) - scales[f"m_{c}"]) / (scales[f"s_{c}"] or 1.0)).alias(c) for c in components]
    qc = qc.select("sample_id", *scaled, *indicators)
    cohort = survival.join(qc, survival["genid"] == qc["sample_id"]).select("phecode", "eid", "sex", "event", "time", *components, *indicators)
    blocks, traits = score_blocks(scores, ["platform", "trait"], "iid", "score")
    fits = cox_scan(cohort, blocks, ["phecode"], "eid", "time", "event", [*components, *indicators], len(components), ["sex"])
    named = fits.join(traits, ["block", "lane"])
    return hazard_ratios(named, KEYS)


def rank_associations(results: DataFrame, n: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """By p-value, missing last, equals by ``ties``; the best ``n`` if asked for."""
    ordered = results.orderBy(F.asc_nulls_last("pvalue"), *ties)
    return ordered if n is None else ordered.limit(n)
