"""Collation of summary statistics and selection of trait QTLs, all traits in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import finite
from traitloom.operators.aggregates import arg_best
from traitloom.operators.cis import cis_variants, extend_windows, make_windows
from traitloom.operators.joins import harmonise, restrict_to_variants, site_ids
from traitloom.session import large


def check_thresholds(p_trans: float, p_cis: float) -> None:
    """Genome-wide threshold at most 0.001, cis threshold between 0 and 1."""
    if p_trans is None or not 0 <= p_trans <= 0.001:
        raise ValueError("the genome-wide p-value threshold must lie in 0 .. 0.001")
    if p_cis is None or not 0 <= p_cis <= 1:
        raise ValueError("the cis p-value threshold must lie in 0 .. 1")


def filter_pvalue(df: DataFrame, p: float, col: str = "pval") -> DataFrame:
    return df.where(finite(F.col(col)) < p)


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))


def collate_sumstats(sumstats: DataFrame, variants: DataFrame, p: float = 0.01) -> DataFrame:
    """Rows below ``p`` at positions of the variant set; the threshold goes to the scan."""
    return restrict_to_variants(filter_pvalue(sumstats, p), variants)


def _variants_with_site_id(variants: DataFrame) -> DataFrame:
    return large(variants).join(site_ids(variants), ["chr", "pos"])


def measures_per_trait(sumstats: DataFrame) -> DataFrame:
    """How many measures (panels, aptamers) each phenotype has in its full results."""
    seen = sumstats.select("phenotype", "measure_id").distinct()
    return seen.groupBy("phenotype").agg(F.count(F.lit(1)).alias("n"))


def select_qtls(
    sumstats: DataFrame,
    variants: DataFrame,
    locations: DataFrame,
    regions: DataFrame,
    p_trans: float,
    p_cis: float,
    measures: DataFrame,
    flank: int = 1_000_000,
    boundary: str = "reference",
) -> DataFrame:
    """Trans and cis QTLs of every trait: phenotype, rsid, chr, pos, alleles, effect, pval.

    ``sumstats``: phenotype, chr, pos, effect_allele, other_allele, beta, pval, measure_id.
    ``measures``: phenotype, n; how many rows per variant a phenotype needs, from
    its info sheet or ``measures_per_trait`` of its full results. Among rows at one site the smallest mean p wins, then the
    first effect allele and other allele.
    """
    check_thresholds(p_trans, p_cis)
    weakest = filter_pvalue(sumstats, max(p_trans, p_cis))
    matched = drop_missing(harmonise(weakest, _variants_with_site_id(variants), carry=["rsid"]), "beta")
    # The site's ID depends on (chr, pos) alone: as a grouping column it costs no further
    # join, and the aggregation keeps to fixed-width sums (hashed, not sorted).
    means = matched.groupBy("phenotype", "chr", "pos", "effect_allele", "other_allele", "rsid").agg(
        F.count(F.lit(1)).alias("seen"), F.avg("beta").alias("effect"), F.avg("pval").alias("pval")
    )
    full = means.join(measures, "phenotype").where(F.col("seen") == F.col("n"))
    windows = extend_windows(make_windows(locations, flank), regions, boundary)
    # The two sets are disjoint by construction, so their union needs no distinct.
    trans = full.where(F.col("pval") < p_trans)
    cis = cis_variants(full.where((F.col("pval") >= p_trans) & (F.col("pval") < p_cis)), windows)
    hits = trans.unionByName(cis).select(
        "phenotype", "rsid", "chr", "pos", "effect_allele", "other_allele", "effect", "pval"
    )
    return arg_best(hits, ["phenotype", "chr", "pos"], "pval", "min", ["effect_allele", "other_allele"])


def select_trans_qtls(sumstats: DataFrame, variants: DataFrame, p: float, tie: list[str]) -> DataFrame:
    """Genome-wide QTLs of traits without a gene location: best p per trait and site."""
    matched = harmonise(filter_pvalue(sumstats, p), _variants_with_site_id(variants), carry=["rsid"])
    best = arg_best(matched, ["phenotype", "chr", "pos"], "pval", "min", tie)
    return best.select(
        "phenotype", "rsid", "chr", "pos", "effect_allele", "other_allele", F.col("beta").alias("effect"), "pval"
    )


def genomic_sort(df: DataFrame) -> DataFrame:
    return df.orderBy("phenotype", "chr", "pos")
