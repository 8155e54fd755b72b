"""Cis windows, complex-LD regions and position-binned range joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Regions of extended LD (GRCh37) that a cis window must not cut.
COMPLEX_LD_REGIONS = [
    (5, 44000000, 51500000, "r1"),
    (6, 25000000, 33500000, "MHC"),
    (8, 8000000, 12000000, "r3"),
    (11, 45000000, 57000000, "r4"),
]


def complex_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COMPLEX_LD_REGIONS, "region_chr int, region_start int, region_end int, region_name string"
    )


def make_windows(locations: DataFrame, flank: int = 1_000_000) -> DataFrame:
    """One window per trait and locus; ``chr`` and ``tss`` are paired ``|`` lists."""
    paired = F.arrays_zip(F.split("chr", r"\|").alias("c"), F.split("tss", r"\|").alias("t"))
    loci = locations.select("phenotype", F.inline(paired).alias("c", "t"))
    loci = loci.select(
        "phenotype", F.col("c").try_cast("int").alias("chr"), F.col("t").try_cast("int").alias("tss")
    ).where("chr IS NOT NULL AND tss IS NOT NULL")
    return loci.select(
        "*", F.greatest(F.lit(0), F.col("tss") - flank).alias("start"), (F.col("tss") + flank).alias("end")
    )


def extend_windows(windows: DataFrame, regions: DataFrame, boundary: str = "reference") -> DataFrame:
    """Move window edges that fall into a complex region.

    A start inside a region moves to the region's start. An end inside a region moves the
    *start* to that region's start with ``boundary='reference'``, or the end to the region's
    end with ``'symmetric'``. The region that starts last wins where several hold an edge.
    """
    if boundary not in ("reference", "symmetric"):
        raise ValueError("boundary is 'reference' or 'symmetric'")
    w, r = windows.alias("w"), regions.alias("r")
    near = (F.col("w.chr") == F.col("r.region_chr")) & (F.col("r.region_start") <= F.col("w.end")) & (
        F.col("r.region_end") >= F.col("w.start")
    )
    holds_start = F.col("r.region_start").isNotNull() & F.col("w.start").between(F.col("r.region_start"), F.col("r.region_end"))
    holds_end = F.col("r.region_start").isNotNull() & F.col("w.end").between(F.col("r.region_start"), F.col("r.region_end"))
    edge = F.struct(F.col("r.region_start").alias("start"), F.col("r.region_end").alias("end"))
    hits = (
        w.join(r, near, "left")
        .groupBy(*[F.col(f"w.{c}").alias(c) for c in windows.columns])
        .agg(F.max(F.when(holds_start, edge)).alias("__s"), F.max(F.when(holds_end, edge)).alias("__e"))
    )
    start = F.coalesce(F.col("__s.start"), F.col("start"))
    end = F.col("end")
    if boundary == "reference":
        start = F.coalesce(F.col("__e.start"), start)
    else:
        end = F.coalesce(F.col("__e.end"), end)
    moved = {"start": start, "end": end}
    return hits.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in windows.columns])


def cis_variants(sumstats: DataFrame, windows: DataFrame, on: Sequence[str] = ("phenotype",), bin_bp: int = 1_000_000) -> DataFrame:
    """Rows of ``sumstats`` that lie in a window of their own trait, each once.

    Windows are spread over position bins, which makes the range join an equi-join on
    (trait, chromosome, bin); a semi join keeps overlapping windows from doubling rows.
    """
    bins = windows.select(
        *on, "chr", "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / bin_bp), F.floor(F.col("end") / bin_bp))).alias("__bin"),
    ).alias("w")
    s = sumstats.withColumn("__bin", F.floor(F.col("pos") / bin_bp)).alias("s")
    cond = (F.col("s.chr") == F.col("w.chr")) & (F.col("s.__bin") == F.col("w.__bin"))
    for k in on:
        cond = cond & (F.col(f"s.{k}") == F.col(f"w.{k}"))
    cond = cond & F.col("s.pos").between(F.col("w.start"), F.col("w.end"))
    return s.join(bins, cond, "left_semi").drop("__bin")


def variant_pairs(variants: DataFrame, window_bp: int) -> DataFrame:
    """Pairs (i before j) on one chromosome at most ``window_bp`` bases apart.

    Every variant goes to its own bin and, as a left partner, to the next one, so a pair
    meets in exactly one bin: the one of its right member.
    """
    base = variants.select("chr", "pos", "row_id", F.floor(F.col("pos") / window_bp).alias("bin"))
    left = base.select(
        "chr", F.col("pos").alias("pos_i"), F.col("row_id").alias("i"),
        F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"),
    )
    right = base.select("chr", F.col("pos").alias("pos_j"), F.col("row_id").alias("j"), "bin")
    later = (F.col("pos_i") < F.col("pos_j")) | ((F.col("pos_i") == F.col("pos_j")) & (F.col("i") < F.col("j")))
    near = F.col("pos_j") - F.col("pos_i") <= window_bp
    return left.join(right, ["chr", "bin"]).where(later & near).select("chr", "i", "j", "pos_i", "pos_j")
