"""Info sheets of the trait platforms: names, gene locations, and the traits that have hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import finite
from traitloom.functions.names import aptamer_sheet, panel_match_name, panel_phenotype
from traitloom.operators.aggregates import average_measures, collapse
from traitloom.operators.joins import EXTRA_LOCATIONS, LOCATION_OVERRIDES, locate_genes, null_safe_match, update_join

_PLACE = "string, chr string, start string"


def panel_info(info: DataFrame, protein_to_gene: DataFrame, gene_location: DataFrame) -> DataFrame:
    """The panel sheet with ``phenotype`` and the ``chr`` and ``tss`` lists of its genes.

    ``info``: variable, uniprot, olink_id, panel, protein. Proteins that the annotation lacks take the
    positions looked up by hand. A phenotype measured by several panels is located once.
    """
    spark = info.sparkSession
    named = info.withColumn("phenotype", panel_phenotype("uniprot", "olink_id"))
    members = named.select("phenotype", F.regexp_replace("uniprot", ";", ".").alias("uniprot")).distinct()
    known = named.select("phenotype").distinct()
    overrides = spark.createDataFrame(LOCATION_OVERRIDES, "uniprot " + _PLACE)
    extra = spark.createDataFrame(EXTRA_LOCATIONS, "phenotype " + _PLACE).join(known, "phenotype", "left_semi")
    places = locate_genes(members, protein_to_gene, gene_location, overrides, extra)
    return update_join(named, places, ["phenotype"], ["chr", "tss"], ["chr"])


def name_panel_results(results: DataFrame, info: DataFrame, measure: str = "measure") -> DataFrame:
    """``phenotype`` of each row of the result files, by the cleaned-up name of the measure; NULL where no sheet has it."""
    matched = results.withColumn("__match", panel_match_name(measure))
    variables = info.select(F.col("variable").alias("__match"), "phenotype").distinct()
    return update_join(matched, variables, ["__match"], ["phenotype"], ["phenotype"]).drop("__match")


def _with_hits(df: DataFrame, hits: DataFrame) -> DataFrame:
    return df.join(hits.select("phenotype").where(F.col("phenotype").isNotNull()).distinct(), "phenotype", "left_semi")


def panel_sheet(info: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per phenotype with a hit: phenotype, uniprot, protein, chr, tss, panels.

    ``info`` comes from ``panel_info``; panels are listed in the order of their variables, proteins once each.
    """
    keys = ["phenotype", "uniprot", "chr", "tss"]
    own = _with_hits(info, hits)
    panels = collapse(own, keys, "panel", ",", ["variable"]).withColumnRenamed("panel", "panels")
    proteins = collapse(own, keys, "protein", "/", distinct=True)
    return null_safe_match(panels, proteins, keys, ["protein"]).select("phenotype", "uniprot", "protein", "chr", "tss", "panels")


def aptamer_info_sheet(info: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per aptamer phenotype with a hit; sequence and aptamer ids as lists in the order of the sequences."""
    own = _with_hits(aptamer_sheet(info), hits)
    keys = ["phenotype", "unique_short_name", "Target", "TargetFullName", "UniProt", "Gene", "chr", "tss"]
    rows = own.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("SeqId", "SOMAMER_ID"))).alias("__ids"))

    def listed(field: str) -> Column:
        return F.array_join(F.transform("__ids", lambda r: r[field]), ",")

    return rows.select(*keys, listed("SeqId").alias("SeqId"), listed("SOMAMER_ID").alias("SOMAMER_ID"))


def sheet_values(values: DataFrame, info: DataFrame, hits: DataFrame) -> DataFrame:
    """(phenotype, iid, value): mean of the measures of a phenotype, missing values left out, phenotypes with a hit only."""
    kept = values.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())
    named = kept.join(info.select("variable", "phenotype").distinct(), "variable")
    return average_measures(_with_hits(named, hits), ["phenotype", "iid"], ["value"])
