"""Variant curation: IDs, duplicates, multi-allelic sites, ambiguous alleles, thinning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import flip_strand, sorted_alleles
from traitloom.operators.aggregates import arg_best, duplicate_keys
from traitloom.operators.genotypes import filter_maf, maf, variant_counts
from traitloom.operators.joins import attach_info
from traitloom.operators.ld import ld_pairs, ld_prune
from traitloom.session import cut, large


def with_variant_key(variants: DataFrame) -> DataFrame:
    alleles = sorted_alleles("ref", "alt")
    return variants.withColumn("sorted_alleles", alleles).withColumn(
        "var_id", F.concat_ws(":", "chr", "pos", "sorted_alleles")
    )


def fill_missing_id(variants: DataFrame) -> DataFrame:
    """``.`` becomes the variant key."""
    return variants.withColumn("id", F.when(F.col("id") == ".", F.col("var_id")).otherwise(F.col("id")))


def flag_duplicates(variants: DataFrame, stats: DataFrame, stats_order: Sequence[str] = ()) -> DataFrame:
    """All variants with ``info`` and a ``remove`` flag for duplicates of a better one.

    Among duplicates by position and alleles, and then among duplicates by ID and alleles
    of a chromosome, the first with the highest information score stays. Duplicates without
    any score all go. Ties in the second step follow where the position group first occurs.
    """
    v = attach_info(fill_missing_id(with_variant_key(variants)), stats, stats_order)
    by_pos = ["chr", "pos", "sorted_alleles"]
    by_id = ["chr", "id", "sorted_alleles"]
    flagged = (
        v.join(duplicate_keys(v, by_pos).select(*by_pos, F.lit(True).alias("__p")), by_pos, "left")
        .join(duplicate_keys(v, by_id).select(*by_id, F.lit(True).alias("__i")), by_id, "left")
        .withColumn("__dup", F.coalesce("__p", "__i", F.lit(False)))
        .select(*v.columns, "__dup")
    )
    dups = flagged.where("__dup").select(*by_pos, "id", "row_id", "info")
    best_pos = arg_best(dups, by_pos, "info", "max", ["row_id"], first_of="row_id")
    best = arg_best(best_pos, by_id, "info", "max", ["group_first"])
    kept = best.select("row_id", F.lit(True).alias("__kept"))
    out = flagged.join(kept, "row_id", "left")
    return out.select(*v.columns, (F.col("__dup") & F.col("__kept").isNull()).alias("remove"))


def dedup_variants(variants: DataFrame, stats: DataFrame, stats_order: Sequence[str] = ()) -> DataFrame:
    return flag_duplicates(variants, stats, stats_order).where(~F.col("remove")).select(*variants.columns)


def tag_removed(flagged: DataFrame) -> DataFrame:
    """IDs made unique by the row, with ``:remove`` behind those to drop."""
    unique = F.concat_ws(":", "id", "row_id")
    return flagged.withColumn("id", F.when(F.col("remove"), F.concat_ws(":", unique, F.lit("remove"))).otherwise(unique))


def drop_tagged(tagged: DataFrame) -> DataFrame:
    return tagged.where(~F.col("id").contains("remove"))


def strip_row_suffix(tagged: DataFrame) -> DataFrame:
    return tagged.withColumn("id", F.regexp_replace("id", ":[0-9]+$", ""))


def drop_multiallelic(variants: DataFrame) -> DataFrame:
    """Without rs IDs that repeat, then without positions that repeat among other IDs.

    The second step removes every variant at such a position, rs ones too.
    """
    rs = F.col("id").startswith("rs")
    repeated_id = duplicate_keys(variants.where(rs), ["chr", "id"])
    left = large(variants).join(repeated_id, ["chr", "id"], "left_anti").select(*variants.columns)
    repeated_pos = duplicate_keys(left.where(~rs), ["chr", "pos"])
    return large(left).join(repeated_pos, ["chr", "pos"], "left_anti").select(*variants.columns)


def drop_ambiguous(variants: DataFrame) -> DataFrame:
    return variants.where(F.col("ref") != flip_strand("alt"))


def keep_snps(variants: DataFrame) -> DataFrame:
    return variants.where((F.length("ref") == 1) & (F.length("alt") == 1))


def identify_snps(variants: DataFrame) -> DataFrame:
    return keep_snps(drop_ambiguous(drop_multiallelic(variants)))


def thin_variants(
    variants: DataFrame,
    packed: DataFrame,
    min_maf: float = 0.005,
    window_bp: int = 1_000_000,
    max_r2: float = 0.8,
    **ld_options,
) -> DataFrame:
    """SNPs with enough minor alleles, none in a window correlated with a better one."""
    snps = identify_snps(variants)
    common = filter_maf(variant_counts(large(packed).join(snps.select("row_id"), "row_id", "left_semi")), min_maf)
    # Written once: it is used several times and costs a pass over the genotypes.
    common = cut(large(snps).join(common.select("row_id", maf("freq").alias("maf")), "row_id"))
    pairs = ld_pairs(packed, common, window_bp, min_r2=max_r2, **ld_options)
    kept = ld_prune(pairs, common, max_r2)
    return kept.select(*variants.columns)
