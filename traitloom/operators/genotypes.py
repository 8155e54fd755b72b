"""Genotype tables: packed and long form, per-variant counts and quality filters.

Long form: (iid, row_id, alt_dosage), one row per cell, NULL where missing.
Packed form: (row_id, sample_block, doses array<float>), NaN where missing; a block holds a
bounded run of samples in one fixed order, so no row grows with the cohort.
Sample manifest: (iid, sample_idx), ``sample_idx`` counting from 0 in file order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traitloom.functions.expressions import finite, genotype_sd, hard_call
from traitloom.session import large

SAMPLES_PER_BLOCK = 16_384
HARD_CALL = 0.1


def _nan() -> Column:
    return F.lit("NaN").cast("float")


def is_packed(genotypes: DataFrame) -> bool:
    return "doses" in genotypes.columns


def pack_genotypes(long: DataFrame, samples: DataFrame, block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    """Long cells into one dose array per variant and sample block.

    Cells that are absent are missing, exactly like NULL ones. A group holds at most
    ``block`` cells.
    """
    placed = samples.select(
        "iid",
        F.floor(F.col("sample_idx") / block).cast("int").alias("sample_block"),
        (F.col("sample_idx") % block).cast("int").alias("offset"),
    )
    # Length of each block: full but for the last one.
    sizes = placed.groupBy("sample_block").agg((F.max("offset") + 1).alias("size"))
    cells = large(long).join(placed.join(sizes, "sample_block"), "iid").select(
        "row_id", "sample_block", "size", "offset",
        F.coalesce(F.col("alt_dosage").cast("float"), _nan()).alias("dose"),
    )
    entries = cells.groupBy("row_id", "sample_block", "size").agg(
        F.sort_array(F.collect_list(F.struct("offset", "dose"))).alias("e")
    )

    def with_gap(entry: Column, i: Column) -> Column:
        before = F.when(i > 0, F.col("e")[i - 1]["offset"]).otherwise(-1)
        return F.concat(F.array_repeat(_nan(), entry["offset"] - before - 1), F.array(entry["dose"]))

    tail = F.array_repeat(_nan(), F.col("size") - F.element_at("e", -1)["offset"] - 1)
    doses = F.concat(F.flatten(F.transform("e", with_gap)), tail)
    return entries.select("row_id", "sample_block", doses.alias("doses"))


def unpack_genotypes(packed: DataFrame, samples: DataFrame, block: int = SAMPLES_PER_BLOCK) -> DataFrame:
    """Long cells (iid, row_id, alt_dosage) of a packed table."""
    cells = packed.select("row_id", "sample_block", F.posexplode("doses").alias("offset", "dose"))
    idx = F.col("sample_block").cast("bigint") * block + F.col("offset")
    return large(cells.withColumn("sample_idx", idx)).join(samples, "sample_idx").select(
        "iid", "row_id", finite(F.col("dose")).cast("double").alias("alt_dosage")
    )


COUNTS = ("n", "n_called", "dose_sum", "dose_sq", "n_hom_ref", "n_het", "n_hom_alt")


def _packed_counts(packed: DataFrame) -> DataFrame:
    """Counts of each packed row, all cells of a batch at once."""
    row_type = dict(packed.dtypes)["row_id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doses = batch.column(1)
            size = np.diff(doses.offsets.to_numpy())
            d = doses.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(size)), size)
            known = ~np.isnan(d)
            row_known, d = row[known], d[known]
            call = np.rint(d)
            called = np.abs(d - call) <= HARD_CALL

            def total(weights: np.ndarray | None, of: np.ndarray = row_known) -> np.ndarray:
                return np.bincount(of, weights=weights, minlength=len(size))

            values = [size, total(None), total(d), total(d * d)]
            values += [total((called & (call == g)).astype(float)) for g in (0, 1, 2)]
            kinds = [np.int64, np.int64, np.float64, np.float64, np.int64, np.int64, np.int64]
            columns = [pa.array(v.astype(t)) for v, t in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row_id", *COUNTS])

    schema = f"row_id {row_type}, " + ", ".join(f"{c} {'double' if c.startswith('dose') else 'bigint'}" for c in COUNTS)
    return packed.select("row_id", F.coalesce("doses", F.array().cast("array<float>")).alias("doses")).mapInArrow(count, schema)


def variant_counts(genotypes: DataFrame) -> DataFrame:
    """Per variant: samples, called samples, frequency, dosage variance, genotype counts.

    One pass serves every filter below. Packed rows are counted as arrays, a row per variant
    and sample block; long cells are summed before the shuffle.
    """
    if is_packed(genotypes):
        parts = _packed_counts(genotypes).groupBy("row_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
        mean = F.try_divide("dose_sum", "n_called")
        spread = F.greatest(F.try_divide("dose_sq", "n_called") - mean * mean, F.lit(0.0))
        return parts.select("row_id", "n", "n_called", (mean / 2).alias("freq"), spread.alias("dose_var"), *COUNTS[4:])
    cells = genotypes.select("row_id", finite(F.col("alt_dosage").cast("double")).alias("d"))
    d, g = F.col("d"), hard_call("d")
    return (
        cells.groupBy("row_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count(d).alias("n_called"),
            (F.avg(d) / 2).alias("freq"),
            F.var_pop(d).alias("dose_var"),
            F.count_if(g == 0).alias("n_hom_ref"),
            F.count_if(g == 1).alias("n_het"),
            F.count_if(g == 2).alias("n_hom_alt"),
        )
    )


def maf(freq: Column | str) -> Column:
    f = F.col(freq) if isinstance(freq, str) else freq
    return F.least(f, 1 - f)


def allele_freq(genotypes: DataFrame) -> DataFrame:
    return variant_counts(genotypes).select("row_id", "freq", maf("freq").alias("maf"), genotype_sd("freq").alias("sd"))


def call_missing() -> Column:
    """Share of samples without a hard call."""
    called = F.col("n_hom_ref") + F.col("n_het") + F.col("n_hom_alt")
    return 1 - called / F.col("n")


def mach_r2() -> Column:
    """Observed dosage variance over the one expected from the frequency."""
    expected = 2 * F.col("freq") * (1 - F.col("freq"))
    return F.col("dose_var") / F.nullif(expected, F.lit(0.0))


def filter_maf(counts: DataFrame, minimum: float) -> DataFrame:
    return counts.where(maf("freq") >= minimum)


def filter_call_rate(counts: DataFrame, max_missing: float = 0.05) -> DataFrame:
    return counts.where(call_missing() <= max_missing)


def filter_mach_r2(counts: DataFrame, minimum: float = 0.3) -> DataFrame:
    return counts.where(mach_r2() >= minimum)


class _Hets:
    """Probabilities of heterozygote counts given the alleles, for many variants at once.

    Counts go up and down in twos. All probabilities are relative to a given count, and sums
    run outwards until a term no longer changes them, a few standard deviations long.
    """

    def __init__(self, hom_ref: np.ndarray, het: np.ndarray, hom_alt: np.ndarray):
        self.n = hom_ref + het + hom_alt
        self.rare = 2 * np.minimum(hom_ref, hom_alt) + het
        log = np.log(np.arange(1, max(2, int(self.n.max(initial=1)) + 1)))
        self.log_fact = np.concatenate([[0.0], np.cumsum(log)])

    def log_p(self, h: np.ndarray) -> np.ndarray:
        hom = (self.rare - h) // 2
        f = self.log_fact
        return h * np.log(2.0) - f[h] - f[hom] - f[self.n - h - hom]

    def mode(self) -> np.ndarray:
        """The likeliest count, by halving over the rising stretch."""
        low, high = self.rare % 2, self.rare.copy()
        while (low < high).any():
            mid = low + (high - low) // 4 * 2
            rises = (mid < high) & (self.log_p(np.minimum(mid + 2, self.rare)) > self.log_p(mid))
            low = np.where(rises, mid + 2, low)
            high = np.where(rises, high, mid)
        return low

    def first_at_most(self, bound: np.ndarray, mode: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Next count beyond the mode, upwards or downwards, that is no likelier than ``bound``.

        Outside the possible counts (by one step) if there is none.
        """
        step = np.where(up, 2, -2)
        low, high = np.zeros(len(mode), np.int64), np.where(up, (self.rare - mode) // 2, (mode - self.rare % 2) // 2) + 1
        while (low < high).any():
            mid = (low + high) // 2
            at = np.clip(mode + step * mid, self.rare % 2, self.rare)
            inside = (mode + step * mid == at) & (self.log_p(at) > bound + 1e-9)
            low = np.where((low < high) & inside, mid + 1, low)
            high = np.where((low <= high) & ~inside, np.minimum(high, mid), high)
        return mode + step * low

    def tail(self, start: np.ndarray, up: np.ndarray, relative: np.ndarray) -> np.ndarray:
        """Sum of exp(log_p - relative) from ``start`` outwards."""
        total, live, h = np.zeros(len(start)), np.arange(len(start)), start.copy()
        ok = (h >= 0) & (h <= self.rare)
        live, h = live[ok], h[ok]
        hom = (self.rare[live] - h) // 2
        term = np.exp(self._at(live, h) - relative[live])
        while len(live):
            total[live] += term
            other = self.n[live] - h - hom
            higher = up[live]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(higher, 4.0 * hom * other / ((h + 2.0) * (h + 1.0)), h * (h - 1.0) / (4.0 * (hom + 1.0) * (other + 1.0)))
            term = term * ratio
            h, hom = h + np.where(higher, 2, -2), hom + np.where(higher, -1, 1)
            go = term > 1e-17 * total[live]
            live, h, hom, term = live[go], h[go], hom[go], term[go]
        return total

    def _at(self, live: np.ndarray, h: np.ndarray) -> np.ndarray:
        hom, f = (self.rare[live] - h) // 2, self.log_fact
        return h * np.log(2.0) - f[h] - f[hom] - f[self.n[live] - h - hom]


@F.pandas_udf(T.DoubleType())
def hwe_exact(hom_ref: pd.Series, het: pd.Series, hom_alt: pd.Series) -> pd.Series:
    """Exact Hardy-Weinberg p: probability of a heterozygote count at most as likely as ours."""
    a, h, b = (x.to_numpy(dtype=np.int64) for x in (hom_ref, het, hom_alt))
    hets = _Hets(a, h, b)
    mode, mine = hets.mode(), hets.log_p(h)
    top = hets.log_p(mode)
    yes = np.ones(len(h), bool)
    total = hets.tail(mode, yes, top) + hets.tail(mode - 2, ~yes, top)
    above = h >= mode
    same = hets.tail(h, above, mine)
    other = hets.tail(hets.first_at_most(mine, mode, ~above), ~above, mine)
    p = np.exp(mine - top) * (same + other) / total
    return pd.Series(np.where(mine >= top - 1e-9, 1.0, np.minimum(1.0, p)))


def hwe_chisq() -> Column:
    """Chi-square statistic of the Hardy-Weinberg test, for a quick look."""
    n = F.col("n_hom_ref") + F.col("n_het") + F.col("n_hom_alt")
    p = (2 * F.col("n_hom_ref") + F.col("n_het")) / (2 * n)
    q = 1 - p

    def term(seen: Column, expected: Column) -> Column:
        return (seen - expected) * (seen - expected) / F.nullif(expected, F.lit(0.0))

    return (
        term(F.col("n_hom_ref"), n * p * p) + term(F.col("n_het"), 2 * n * p * q) + term(F.col("n_hom_alt"), n * q * q)
    )


def with_hwe(counts: DataFrame) -> DataFrame:
    return counts.withColumn("hwe_p", hwe_exact("n_hom_ref", "n_het", "n_hom_alt"))


def filter_hwe(counts: DataFrame, minimum: float = 1e-6) -> DataFrame:
    return with_hwe(counts).where(F.col("hwe_p") >= minimum).drop("hwe_p")


def qc_variants(
    genotypes: DataFrame,
    max_missing: float = 0.05,
    min_hwe: float = 1e-6,
    min_mach_r2: float = 0.3,
    min_maf: float = 0.01,
) -> DataFrame:
    """Counts of the variants that pass call rate, Hardy-Weinberg, imputation r2 and MAF."""
    counts = filter_mach_r2(filter_call_rate(variant_counts(genotypes), max_missing), min_mach_r2)
    return filter_hwe(filter_maf(counts, min_maf), min_hwe)


def to_wide(long: DataFrame, row: str, column: str, value: str, names: list[str] | None = None) -> DataFrame:
    """Sample by variant matrix of one trait; ``names`` fixes the columns and saves a pass."""
    grouped = long.groupBy(row)
    pivoted = grouped.pivot(column, names) if names is not None else grouped.pivot(column)
    return pivoted.agg(F.first(value, ignorenulls=True))


def to_long(wide: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    cols = [c for c in wide.columns if c not in ids]
    return wide.unpivot(ids, cols, name, value)
