"""Equi, semi, anti, update and allele-aware joins.

No join here carries a broadcast hint for a side that grows with the data: Spark compares
the size of a side with its broadcast threshold and otherwise sorts and merges, where
adaptive execution splits a skewed key. Joins with genotypes or variants always sort and merge (``large``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import finite, sorted_alleles
from traitloom.operators.ordering import null_safe_on
from traitloom.session import large


def update_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    cols: Sequence[str],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Keep every ``left`` row; where ``right`` has the key, take ``cols`` from its last row.

    "Last" is by ``order_by``. The lookup side becomes one row per key before the join,
    so left rows never multiply. Columns ``left`` lacks are added, NULL where unmatched.
    """
    order = list(order_by) or list(cols)
    last = right.groupBy(*on).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("__new"), F.lit(True).alias("__hit")
    )
    joined = left.join(last, list(on), "left")
    for c in cols:
        old = F.col(c) if c in left.columns else F.lit(None)
        joined = joined.withColumn(c, F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(old))
    keep = [*left.columns, *[c for c in cols if c not in left.columns]]
    return joined.select(*keep)


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``keys``."""
    return df.join(keys, list(on), "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``, each once."""
    return df.join(keys, list(on), "left_semi")


keep_passing = restrict_to
keep_samples = restrict_to
extract_variants = restrict_to
remove_samples = exclude


def restrict_to_variants(sumstats: DataFrame, variants: DataFrame) -> DataFrame:
    """Positional inner join; two variants at one position double the row, as meant."""
    return large(sumstats).join(variants.select("chr", "pos"), ["chr", "pos"])


def right_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of ``keys``, with NULLs where ``df`` has no partner."""
    return df.join(keys, list(on), "right")


def with_covariates(df: DataFrame, covariates: DataFrame, on: Sequence[str] = ("iid",)) -> DataFrame:
    return df.join(covariates, list(on))


def align(values: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``values`` for the wanted variants or samples, next to the wanted columns."""
    return wanted.join(values, list(on))


def attach_info(variants: DataFrame, stats: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Add ``info`` from variant statistics listed in either allele order.

    Both sides are keyed by the sorted allele pair, so one join serves both orientations.
    A statistic in swapped orientation takes precedence over one in the same orientation,
    and a later row over an earlier one.
    """
    order = list(order_by) or ["information"]
    stats = stats.withColumn("information", finite(F.col("information").cast("double")))
    value = F.struct(F.col("information").alias("v"))
    a_first = F.col("A_allele") <= F.col("B_allele")
    by_pair = stats.groupBy(
        F.col("chromosome").alias("chr"),
        F.col("position").alias("pos"),
        sorted_alleles("A_allele", "B_allele").alias("sorted_alleles"),
    ).agg(
        F.max_by(value, F.when(a_first, F.struct(*order))).alias("__ab"),
        F.max_by(value, F.when(~a_first, F.struct(*order))).alias("__ba"),
    )
    keyed = variants.withColumn("sorted_alleles", sorted_alleles("ref", "alt"))
    joined = large(keyed).join(by_pair, ["chr", "pos", "sorted_alleles"], "left")
    ref_first = F.col("ref") <= F.col("alt")
    same = F.when(ref_first, F.col("__ab")).otherwise(F.col("__ba"))
    swapped = F.when(ref_first, F.col("__ba")).otherwise(F.col("__ab"))
    info = F.when(swapped.isNotNull(), swapped["v"]).otherwise(same["v"])
    return joined.withColumn("info", info).select(*variants.columns, "info")


def harmonise(sumstats: DataFrame, variants: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Rows whose alleles match a variant in either order (effect allele alt or ref).

    ``carry`` names further variant columns to take along.
    """
    pair = "__pair"
    left = sumstats.withColumn(pair, sorted_alleles("effect_allele", "other_allele"))
    right = variants.select("chr", "pos", sorted_alleles("ref", "alt").alias(pair), *carry)
    return large(left).join(right, ["chr", "pos", pair]).select(*sumstats.columns, *carry)


def snp_match(sumstats: DataFrame, variants: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Match summary statistics (a1 effect, a0 other) to a variant map and sign the effect.

    ``beta`` changes sign where the two alleles are listed the other way round, and a0/a1
    become those of the map. Positions matched more than once (per ``by``) are dropped whole.
    """
    pair = "__pair"
    left = sumstats.withColumn(pair, sorted_alleles("a0", "a1"))
    right = variants.select(
        "chr", "pos", sorted_alleles("ref", "alt").alias(pair), "row_id",
        F.col("ref").alias("__ref"), F.col("alt").alias("__alt"),
    )
    hit = large(left).join(right, ["chr", "pos", pair])
    matched = hit.select(
        *[c for c in sumstats.columns if c not in ("beta", "a0", "a1")],
        F.when(F.col("a1") == F.col("__alt"), F.col("beta")).otherwise(-F.col("beta")).alias("beta"),
        F.col("__ref").alias("a0"),
        F.col("__alt").alias("a1"),
        "row_id",
    )
    site = [*by, "chr", "pos"]
    repeated = matched.groupBy(*site).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    return matched.join(repeated, site, "left_anti")


def effect_dosage(genotypes: DataFrame, effects: DataFrame, variants: DataFrame) -> DataFrame:
    """Dosage of the effect allele for every (trait, sample, variant).

    ``genotypes`` is long (iid, row_id, alt_dosage). Effects are matched to variants first,
    which is a small join, so the genotype table is read and shuffled once for all traits.
    """
    chosen = match_effects(effects, variants)
    dose = F.when(F.col("counts_alt"), F.col("alt_dosage")).otherwise(2 - F.col("alt_dosage"))
    return large(genotypes).join(chosen, "row_id").select("phenotype", "iid", "row_id", "rsid", "effect", dose.alias("dosage"))


def match_effects(effects: DataFrame, variants: DataFrame) -> DataFrame:
    """Variant row of each effect, and whether its effect allele is the counted one."""
    pair = "__pair"
    left = effects.withColumn(pair, sorted_alleles("effect_allele", "other_allele"))
    right = variants.select("chr", "pos", sorted_alleles("ref", "alt").alias(pair), "row_id", F.col("alt").alias("__alt"))
    return large(left).join(right, ["chr", "pos", pair]).select(
        "phenotype", "rsid", "row_id", "effect", (F.col("effect_allele") == F.col("__alt")).alias("counts_alt")
    )


# Gene positions looked up by hand for proteins the annotation lacks.
LOCATION_OVERRIDES = [
    ("Q8WWJ7", "11", "60739113"),
    ("Q8NF90", "4", "81187742"),
    ("P16284", "17", "62396775"),
]
EXTRA_LOCATIONS = [("OID00195", "1", "11917521")]


def locate_genes(
    info: DataFrame,
    protein_to_gene: DataFrame,
    gene_location: DataFrame,
    overrides: DataFrame | None = None,
    extra: DataFrame | None = None,
) -> DataFrame:
    """``chr`` and ``tss`` lists per phenotype from its list of proteins.

    ``info``: phenotype, uniprot (several joined by ``.`` or ``;``).
    ``protein_to_gene``: uniprot, entrez. ``gene_location``: entrez, chr, start.
    Contigs with ``_`` in the name are left out, overrides replace what was found, and
    ``extra`` (phenotype, chr, start) adds locations of phenotypes without a protein.
    """
    members = info.select("phenotype", F.posexplode(F.split("uniprot", "[.;]")).alias("ord", "uniprot"))
    genes = protein_to_gene.select("uniprot", F.col("entrez").cast("string").try_cast("int").alias("entrez"))
    places = (
        genes.where(F.col("entrez").isNotNull())
        .join(gene_location, "entrez")
        .where(~F.col("chr").contains("_"))
        .select("uniprot", "entrez", F.col("chr").cast("string").alias("chr"), F.col("start").cast("string").alias("start"))
    )
    found = update_join(members, places, ["uniprot"], ["chr", "start"], ["entrez", "chr", "start"])
    if overrides is not None:
        found = update_join(found, overrides, ["uniprot"], ["chr", "start"])
    rows = found.select("phenotype", "ord", "chr", "start")
    if extra is not None:
        rows = rows.unionByName(extra.select("phenotype", F.lit(0).alias("ord"), "chr", "start"))
    # A phenotype names a handful of proteins, so its list fits in one row.
    lists = rows.where(F.col("chr").isNotNull()).groupBy("phenotype").agg(
        F.sort_array(F.collect_list(F.struct("ord", "chr", "start"))).alias("__all")
    )
    return lists.select(
        "phenotype",
        F.array_join(F.col("__all.chr"), "|").alias("chr"),
        F.array_join(F.col("__all.start"), "|").alias("tss"),
    )


def null_safe_match(left: DataFrame, right: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Inner join in which missing keys match; ``carry`` are the columns taken from the right."""
    joined = left.alias("a").join(right.alias("b"), null_safe_on(list(keys), "a", "b"))
    return joined.select("a.*", *[F.col(f"b.{c}") for c in carry])


def build_assoc_frame(scores: DataFrame, survival: DataFrame, qc: DataFrame) -> DataFrame:
    """Scores, survival and sample QC on their own key names: iid = eid and genid = sample_id."""
    cohort = survival.join(qc, survival["genid"] == qc["sample_id"]).drop(qc["sample_id"])
    return scores.join(cohort, scores["iid"] == cohort["eid"]).drop(cohort["eid"])


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_with_source(named: dict[str, DataFrame], label: str = "platform") -> DataFrame:
    return union_all([df.withColumn(label, F.lit(name)) for name, df in named.items()])


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def site_ids(variants: DataFrame) -> DataFrame:
    """One ID per position: that of the last variant there, in row order."""
    return variants.groupBy("chr", "pos").agg(F.max_by("id", "row_id").alias("rsid"))


