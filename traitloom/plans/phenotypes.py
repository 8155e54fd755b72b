"""Trait values adjusted for batch and ancestry, all platforms and traits in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.operators.aggregates import average_measures
from traitloom.operators.joins import restrict_to, right_join, union_with_source, update_join, with_covariates
from traitloom.operators.regression import residualise, residualise_factor
from traitloom.plans.qtl import drop_missing

COMPONENTS = [f"PC_{i}" for i in range(1, 11)]


def average_traits(values: DataFrame) -> DataFrame:
    """Mean over the measures of a trait per sample: phenotype, iid, value."""
    return average_measures(drop_missing(values, "value"), ["phenotype", "iid"], ["value"])


def batch_adjusted(values: DataFrame, batch: DataFrame) -> DataFrame:
    joined = with_covariates(values, batch.select("iid", "batch"))
    return residualise_factor(joined, ["phenotype"], "value", "batch").drop("batch")


def adjust_phenotypes(
    platforms: Mapping[str, DataFrame],
    pcs: DataFrame,
    batches: Mapping[str, DataFrame] | None = None,
    components: Sequence[str] = COMPONENTS,
) -> DataFrame:
    """(phenotype, platform, iid, value): averaged, batch-adjusted where a platform has
    batches, put together, and adjusted for genetic components."""
    batches = batches or {}
    parts = {}
    for name, values in platforms.items():
        means = average_traits(values)
        parts[name] = batch_adjusted(means, batches[name]) if name in batches else means
    stacked = union_with_source(parts, "platform")
    joined = with_covariates(stacked, pcs.select("iid", *components))
    return residualise(joined, ["phenotype"], "value", components).select("phenotype", "platform", "iid", "value")


def paired_lists(df: DataFrame, keys: Sequence[str], cols: Sequence[str], sep: str = ",") -> DataFrame:
    """Rows from parallel text lists; lists of unequal length are an error."""
    split = [F.split(c, sep) for c in cols]
    same = F.lit(True)
    for s in split[1:]:
        same = same & (F.size(s) == F.size(split[0]))
    zipped = F.arrays_zip(*[s.alias(c) for s, c in zip(split, cols)])
    checked = F.when(same, zipped).otherwise(F.raise_error(F.lit("parallel lists differ in length")).cast(_list_type(cols)))
    return df.select(*keys, F.inline(checked))


def _list_type(cols: Sequence[str]) -> str:
    return "array<struct<" + ",".join(f"`{c}`:string" for c in cols) + ">>"


def adjust_aptamers(
    wide: DataFrame,
    sheet: DataFrame,
    id_map: DataFrame,
    batch: DataFrame,
    pcs: DataFrame,
    keep: DataFrame,
    components: Sequence[str] = COMPONENTS,
    platform: str = "Somalogic",
) -> DataFrame:
    """Phenotypes of a wide aptamer matrix, adjusted for technical covariates only.

    ``wide``: aliquot_id and one column per aptamer. ``sheet``: phenotype and its aptamers
    as parallel lists seq_id, aptamer. ``id_map``: aliquot_id, iid. ``keep``: phenotypes wanted.
    """
    long = wide.unpivot(["aliquot_id"], [c for c in wide.columns if c != "aliquot_id"], "aptamer", "value")
    members = paired_lists(sheet, ["phenotype"], ["seq_id", "aptamer"]).select("phenotype", "aptamer")
    named = right_join(long, members, ["aptamer"])
    mapped = update_join(named, id_map, ["aliquot_id"], ["iid"])
    means = average_measures(mapped, ["phenotype", "iid"], ["value"])
    adjusted = batch_adjusted(means, batch)
    joined = with_covariates(adjusted, pcs.select("iid", *components))
    out = residualise(joined, ["phenotype"], "value", components)
    wanted = restrict_to(out, keep.select("phenotype").distinct(), ["phenotype"])
    return wanted.select("phenotype", F.lit(platform).alias("platform"), "iid", "value")


def trait_list(df: DataFrame) -> DataFrame:
    return df.select("phenotype").distinct()


def trait_values(df: DataFrame, name: str | Column) -> DataFrame:
    return df.where(F.col("phenotype") == name).select("iid", "value")
