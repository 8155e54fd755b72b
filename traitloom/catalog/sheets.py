"""Info sheets of the trait platforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.fixtures import oracle, view
from traitloom.plans import sheets
from traitloom.plans.qtl import check_thresholds, genomic_sort

# The largest threshold that a genome-wide search takes, and one for the neighbourhood of the genes.
P_TRANS, P_CIS = 0.001, 0.5

_PANEL = """
named AS (SELECT *, CASE WHEN uniprot = '' THEN olink_id ELSE replace(uniprot, ';', '.') END AS phenotype FROM fx_panel),
hits AS (SELECT DISTINCT n.phenotype FROM fx_panel r JOIN named n
  ON n.variable = regexp_replace(replace(replace(lower(r.measure), '.', ''), '--', ''), '^inf1', 'inf') WHERE r.size < 25)"""

_PLACED = f"""{_PANEL},
members AS (SELECT phenotype, ord, u FROM (SELECT phenotype, unnest(regexp_split_to_array(x, '[.]')) AS u, unnest(range(len(regexp_split_to_array(x, '[.]')))) AS ord
  FROM (SELECT DISTINCT phenotype, replace(uniprot, ';', '.') AS x FROM named))),
gene AS (SELECT 'Q' || CAST(g AS VARCHAR) AS u, CAST(g % 22 + 1 AS VARCHAR) AS chr, CAST(g * 1000 + 5 AS VARCHAR) AS start FROM (SELECT DISTINCT g FROM fx_panel) WHERE g % 4 <> 3),
found AS (SELECT m.phenotype, m.ord, CASE WHEN m.u = 'Q8WWJ7' THEN '11' ELSE gene.chr END AS chr, CASE WHEN m.u = 'Q8WWJ7' THEN '60739113' ELSE gene.start END AS start
  FROM members m LEFT JOIN gene USING (u)
  UNION ALL SELECT DISTINCT phenotype, 0, '1', '11917521' FROM named WHERE phenotype = 'OID00195'),
places AS (SELECT phenotype, string_agg(chr, '|' ORDER BY ord) AS chr, string_agg(start, '|' ORDER BY ord) AS tss FROM found WHERE chr IS NOT NULL GROUP BY phenotype)"""


def panel_inputs(spark, sf):
    """Located sheet, and the results that pass, under the names of the sheet."""
    check_thresholds(P_TRANS, P_CIS)
    panel = view(spark, sf, "fx_panel")
    g = F.col("g")
    genes = panel.select("g").distinct()
    to_gene = genes.select(F.concat(F.lit("Q"), g).alias("uniprot"), F.when(g % 4 == 3, "none").otherwise(g.cast("string")).alias("entrez"))
    places = genes.select(g.cast("int").alias("entrez"), (g % 22 + 1).cast("string").alias("chr"), (g * 1000 + 5).alias("start"))
    info = sheets.panel_info(panel.select("variable", "uniprot", "olink_id", "panel", "protein"), to_gene, places)
    return info, sheets.name_panel_results(panel.where("size < 25").select("measure"), info)


@query(
    "panel_sheet",
    oracle(
        f"""{_PLACED}
SELECT n.phenotype, n.uniprot, string_agg(DISTINCT n.protein, '/' ORDER BY n.protein) AS protein, p.chr, p.tss, string_agg(n.panel, ',' ORDER BY n.variable) AS panels
FROM named n JOIN hits USING (phenotype) LEFT JOIN places p USING (phenotype) GROUP BY ALL""",
        "fx_panel",
    ),
)
def panel_sheet(spark, sf):
    """Sheet of the protein panels: located, named, one row per phenotype with a hit."""
    return sheets.panel_sheet(*panel_inputs(spark, sf))


@query(
    "panel_values",
    oracle(
        f"""{_PANEL}
SELECT n.phenotype, m.iid, round(avg(m.value), 6) + 0.0e0 AS value FROM fx_measured m JOIN named n USING (k) JOIN hits USING (phenotype)
WHERE m.value IS NOT NULL GROUP BY ALL""",
        "fx_panel", "fx_measured",
    ),
)
def panel_values(spark, sf):
    info, hits = panel_inputs(spark, sf)
    measured = view(spark, sf, "fx_measured").join(view(spark, sf, "fx_panel").select("k", "variable"), "k")
    return sheets.sheet_values(measured, info, hits).withColumn("value", r6("value"))


@query(
    "aptamer_info_sheet",
    oracle(
        """base AS (SELECT *, regexp_replace(SOMAMER_ID, '[.].*', '') AS n0 FROM fx_aptamer WHERE Type = 'Protein'),
named AS (SELECT SeqId, SOMAMER_ID, size, TargetFullName, UniProt, Gene, chr, tss, Target AS t0,
  CASE WHEN n0 = 'POMC' AND t0 NOT IN ('MPIF-1', '14-3-3') THEN replace(TargetFullName, '-', '.')
       WHEN t0 = '14-3-3' THEN '14.3.3' WHEN n0 IN ('VEGFA', 'F2') AND t0 NOT IN ('MPIF-1', 'Luteinizing hormone') THEN t0
       WHEN n0 = 'F2' AND t0 = 'Luteinizing hormone' THEN t0
       WHEN n0 = 'VEGFA' AND t0 = 'Luteinizing hormone' THEN 'CGA.LHB' WHEN t0 = 'MPIF-1' THEN 'MPIF.1'
       WHEN n0 = 'CGA' THEN CASE WHEN t0 = 'Luteinizing hormone' THEN 'CGA.LHB' ELSE t0 END
       WHEN n0 = 'CKB' THEN replace(t0, '-', '.') ELSE n0 END AS unique_short_name FROM (SELECT *, Target AS t0 FROM base)),
final AS (SELECT 'SeqId_' || replace(SeqId, '-', '_') AS phenotype, unique_short_name, CASE WHEN t0 = 'SEM6C' THEN 'SEMA6C' ELSE t0 END AS Target, TargetFullName,
  CASE WHEN unique_short_name = '14.3.3' THEN 'P61981|Q04917' ELSE UniProt END AS UniProt, Gene, chr, tss, SeqId, SOMAMER_ID, size FROM named)
SELECT phenotype, unique_short_name, Target, TargetFullName, UniProt, Gene, chr, tss, string_agg(SeqId, ',' ORDER BY SeqId, SOMAMER_ID) AS SeqId,
  string_agg(SOMAMER_ID, ',' ORDER BY SeqId, SOMAMER_ID) AS SOMAMER_ID FROM final
WHERE phenotype IN (SELECT 'SeqId_' || replace(SeqId, '-', '_') FROM fx_aptamer WHERE size < 25) GROUP BY ALL""",
        "fx_aptamer",
    ),
)
def aptamer_info_sheet(spark, sf):
    info = view(spark, sf, "fx_aptamer")
    hits = info.where("size < 25").select(F.concat(F.lit("SeqId_"), F.translate("SeqId", "-", "_")).alias("phenotype"))
    return sheets.aptamer_info_sheet(info.drop("size"), hits)


@query(
    "genomic_sort",
    oracle("SELECT phenotype, chr, pos, effect_allele, other_allele, pval FROM fx_gwas WHERE pval < 0.001 ORDER BY phenotype, chr, pos", "fx_pvar", "fx_gwas"),
)
def sorted_hits(spark, sf):
    """Hits in the order of the exported files."""
    hits = view(spark, sf, "fx_gwas").where(F.col("pval") < P_TRANS)
    return genomic_sort(hits).select("phenotype", "chr", "pos", "effect_allele", "other_allele", "pval")
