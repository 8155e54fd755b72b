"""Cross-validated comparison of Bayesian ridge with the univariate score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import dot
from traitloom.operators.scoring import predict, score_metrics
from traitloom.operators.training import (
    FOLD_SEED,
    FOLDS,
    assign_folds,
    bayesian_ridge,
    gram,
    held_out,
)
from traitloom.session import cut


def fold_models(design: DataFrame, chunk_rows: int = 20_000, **priors) -> DataFrame:
    """One ridge model per (phenotype, fold), trained without that fold."""
    return bayesian_ridge(held_out(gram(design, ["phenotype", "fold"], chunk_rows), ["phenotype"]), ["phenotype", "fold"], **priors)


def cross_validate(
    design: DataFrame,
    weights: DataFrame,
    k: int = FOLDS,
    seed: int = FOLD_SEED,
    chunk_rows: int = 20_000,
    models: DataFrame | None = None,
    **priors,
) -> DataFrame:
    """Held-out fit per trait and fold of ridge (``br_``) and univariate score (``uni_``).

    ``design``: phenotype, iid, y, x. ``weights``: phenotype, w, the univariate effects in
    the order of ``x``. All traits go through together.
    """
    folded = cut(assign_folds(design, ["phenotype"], "iid", k, seed))
    if models is None:
        models = fold_models(folded, chunk_rows, **priors)
    scored = predict(models, folded, ["phenotype", "fold"], "br")
    scored = scored.join(weights.select("phenotype", "w"), "phenotype").withColumn("uni", dot("x", "w"))
    fit = score_metrics(
        scored.select("phenotype", "fold", "y", "br", "uni"), ["phenotype", "fold"], "y", {"br": "br", "uni": "uni"}
    )
    sizes = folded.groupBy("phenotype").agg(F.max(F.size("x")).alias("n_vars"))
    return fit.join(sizes, "phenotype").select(
        F.current_timestamp().alias("time"), "phenotype", "n_vars", "fold", "br_r2", "br_sr", "uni_r2", "uni_sr"
    )
