"""QTL collation and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.fixtures import oracle, view
from traitloom.operators import cis, joins
from traitloom.plans import qtl

FLANK = 600_000
P_TRANS, P_CIS = 0.001, 0.5

_SQL_WINDOWS = f"""
loci AS (
  SELECT phenotype, CAST(unnest(string_split(chr, '|')) AS INT) AS chr, CAST(unnest(string_split(tss, '|')) AS INT) AS tss FROM fx_loc),
win0 AS (SELECT *, greatest(0, tss - {FLANK}) AS w_start, tss + {FLANK} AS w_end FROM loci),
win AS (
  SELECT phenotype, chr, tss,
    coalesce((SELECT max(region_start) FROM fx_region r WHERE r.region_chr = w.chr AND w.w_end BETWEEN region_start AND region_end),
             (SELECT max(region_start) FROM fx_region r WHERE r.region_chr = w.chr AND w.w_start BETWEEN region_start AND region_end),
             w_start) AS w_start, w_end,
    coalesce((SELECT max(region_start) FROM fx_region r WHERE r.region_chr = w.chr AND w.w_start BETWEEN region_start AND region_end),
             w_start) AS s_start,
    coalesce((SELECT max(region_end) FROM fx_region r WHERE r.region_chr = w.chr AND w.w_end BETWEEN region_start AND region_end),
             w_end) AS s_end
  FROM win0 w)"""

_SQL_HARMONISED = """
ids AS (SELECT chr, pos, arg_max(id, row_id) AS rsid FROM fx_pvar GROUP BY chr, pos),
matched AS (
  SELECT s.*, ids.rsid FROM fx_gwas s JOIN fx_pvar v ON s.chr = v.chr AND s.pos = v.pos
    AND ((s.effect_allele = v.alt AND s.other_allele = v.ref) OR (s.effect_allele = v.ref AND s.other_allele = v.alt))
  JOIN ids ON s.chr = ids.chr AND s.pos = ids.pos)"""

_SQL_MEANS = f"""
npan AS (SELECT phenotype, count(DISTINCT measure_id) AS n FROM fx_gwas GROUP BY phenotype),
means AS (
  SELECT m.phenotype, chr, pos, effect_allele, other_allele, avg(beta) AS effect, avg(pval) AS pval, max(rsid) AS rsid
  FROM matched m JOIN npan USING (phenotype) WHERE pval < {max(P_TRANS, P_CIS)}
  GROUP BY ALL HAVING count(*) = any_value(npan.n))"""

QTL_SQL = oracle(
    f"""
{_SQL_HARMONISED},
{_SQL_MEANS},
{_SQL_WINDOWS},
hits AS (
  SELECT m.* FROM means m WHERE pval < {P_TRANS} OR (pval < {P_CIS} AND EXISTS (
    SELECT 1 FROM win w WHERE w.phenotype = m.phenotype AND w.chr = m.chr AND m.pos BETWEEN w.w_start AND w.w_end))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY phenotype, chr, pos ORDER BY pval, effect_allele, other_allele) AS rn FROM hits)
SELECT phenotype, rsid, chr, pos, effect_allele, other_allele,
  round(effect, 6) + 0.0e0 AS effect, round(pval, 6) + 0.0e0 AS pval FROM ranked WHERE rn = 1""",
    "fx_pvar", "fx_gwas", "fx_loc", "fx_region",
)


def selected_qtls(spark, sf, p_trans=P_TRANS, p_cis=P_CIS):
    return qtl.select_qtls(
        view(spark, sf, "fx_gwas"), view(spark, sf, "fx_pvar"), view(spark, sf, "fx_loc"),
        view(spark, sf, "fx_region"), p_trans, p_cis, qtl.measures_per_trait(view(spark, sf, "fx_gwas")), flank=FLANK,
    )


@query("qtl_select", QTL_SQL)
def qtl_select(spark, sf):
    return selected_qtls(spark, sf).withColumn("effect", r6("effect")).withColumn("pval", r6("pval"))


@query(
    "trans_qtl_select",
    oracle(
        f"""
{_SQL_HARMONISED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY phenotype, chr, pos ORDER BY pval, row_no, beta, beta_se, n_eff) AS rn
  FROM matched WHERE pval < {P_TRANS})
SELECT phenotype, rsid, chr, pos, effect_allele, other_allele, round(beta, 6) + 0.0e0 AS effect, round(pval, 6) + 0.0e0 AS pval
FROM ranked WHERE rn = 1""",
        "fx_pvar", "fx_gwas",
    ),
)
def trans_qtl_select(spark, sf):
    out = qtl.select_trans_qtls(
        view(spark, sf, "fx_gwas"), view(spark, sf, "fx_pvar"), P_TRANS, ["row_no", "beta", "beta_se", "n_eff"]
    )
    return out.withColumn("effect", r6("effect")).withColumn("pval", r6("pval"))


@query(
    "cis_windows",
    oracle(f"{_SQL_WINDOWS} SELECT phenotype, chr, tss, w_start AS start, w_end AS \"end\" FROM win", "fx_loc", "fx_region"),
)
def cis_windows(spark, sf):
    return cis.extend_windows(cis.make_windows(view(spark, sf, "fx_loc"), FLANK), view(spark, sf, "fx_region"))


@query(
    "complex_region_extend",
    oracle(f"{_SQL_WINDOWS} SELECT phenotype, chr, tss, s_start AS start, s_end AS \"end\" FROM win", "fx_loc", "fx_region"),
)
def complex_region_extend(spark, sf):
    return cis.extend_windows(
        cis.make_windows(view(spark, sf, "fx_loc"), FLANK), view(spark, sf, "fx_region"), boundary="symmetric"
    )


@query(
    "cis_range_join",
    oracle(
        f"""{_SQL_WINDOWS}
SELECT s.phenotype, s.chr, s.pos, s.row_no, round(s.beta, 6) + 0.0e0 AS beta FROM fx_gwas s WHERE EXISTS (
  SELECT 1 FROM win w WHERE w.phenotype = s.phenotype AND w.chr = s.chr AND s.pos BETWEEN w.w_start AND w.w_end)""",
        "fx_pvar", "fx_gwas", "fx_loc", "fx_region",
    ),
)
def cis_range_join(spark, sf):
    rows = cis.cis_variants(view(spark, sf, "fx_gwas"), cis_windows(spark, sf))
    return rows.select("phenotype", "chr", "pos", "row_no", r6("beta").alias("beta"))


@query(
    "collate_sumstats",
    oracle(
        """SELECT s.phenotype, s.row_no, s.chr, s.pos, s.measure_id AS platform, round(s.pval, 9) + 0.0e0 AS pval
FROM fx_gwas s JOIN fx_pvar v ON s.chr = v.chr AND s.pos = v.pos WHERE s.pval < 0.01""",
        "fx_pvar", "fx_gwas",
    ),
)
def collate_sumstats(spark, sf):
    out = qtl.collate_sumstats(view(spark, sf, "fx_gwas"), view(spark, sf, "fx_pvar"))
    return out.select("phenotype", "row_no", "chr", "pos", F.col("measure_id").alias("platform"), r6("pval", 9).alias("pval"))


@query(
    "harmonise",
    oracle(
        f"{_SQL_HARMONISED} SELECT phenotype, row_no, rsid, chr, pos, effect_allele, other_allele FROM matched",
        "fx_pvar", "fx_gwas",
    ),
)
def harmonise(spark, sf):
    variants = view(spark, sf, "fx_pvar")
    with_id = variants.join(joins.site_ids(variants), ["chr", "pos"])
    out = joins.harmonise(view(spark, sf, "fx_gwas"), with_id, carry=["rsid"])
    return out.select("phenotype", "row_no", "rsid", "chr", "pos", "effect_allele", "other_allele")


@query(
    "complete_case",
    oracle(
        f"""{_SQL_HARMONISED}, {_SQL_MEANS},
cc AS (SELECT m.phenotype, m.row_no, m.measure_id FROM matched m JOIN means k
  USING (phenotype, chr, pos, effect_allele, other_allele) WHERE m.pval < {max(P_TRANS, P_CIS)})
SELECT * FROM cc""",
        "fx_pvar", "fx_gwas",
    ),
)
def complete_case(spark, sf):
    from traitloom.operators.aggregates import complete_case as cc

    gwas = view(spark, sf, "fx_gwas")
    near = joins.harmonise(qtl.filter_pvalue(gwas, max(P_TRANS, P_CIS)), view(spark, sf, "fx_pvar"))
    out = cc(
        near, ["phenotype", "chr", "pos", "effect_allele", "other_allele"], qtl.measures_per_trait(gwas), ["phenotype"]
    )
    return out.select("phenotype", "row_no", "measure_id")


@query(
    "average_measures",
    oracle(
        f"""{_SQL_HARMONISED}, {_SQL_MEANS}
SELECT phenotype, chr, pos, effect_allele, other_allele, round(effect, 6) + 0.0e0 AS effect, round(pval, 6) + 0.0e0 AS pval FROM means""",
        "fx_pvar", "fx_gwas",
    ),
)
def average_measures(spark, sf):
    from traitloom.operators import aggregates as A

    gwas = view(spark, sf, "fx_gwas")
    keys = ["phenotype", "chr", "pos", "effect_allele", "other_allele"]
    near = joins.harmonise(qtl.filter_pvalue(gwas, max(P_TRANS, P_CIS)), view(spark, sf, "fx_pvar"))
    full = A.complete_case(near, keys, qtl.measures_per_trait(gwas), ["phenotype"])
    out = A.average_measures(full, keys, ["beta", "pval"])
    return out.select(*keys, r6("beta").alias("effect"), r6("pval").alias("pval"))


@query(
    "union_trans_cis",
    oracle(
        f"""{_SQL_WINDOWS},
t AS (SELECT * FROM fx_gwas WHERE pval < 0.01),
c AS (SELECT * FROM fx_gwas s WHERE pval < 0.5 AND EXISTS (
  SELECT 1 FROM win w WHERE w.phenotype = s.phenotype AND w.chr = s.chr AND s.pos BETWEEN w.w_start AND w.w_end))
SELECT DISTINCT phenotype, chr, pos, effect_allele, row_no FROM (SELECT * FROM t UNION ALL SELECT * FROM c)""",
        "fx_pvar", "fx_gwas", "fx_loc", "fx_region",
    ),
)
def union_trans_cis(spark, sf):
    gwas = view(spark, sf, "fx_gwas")
    trans = qtl.filter_pvalue(gwas, 0.01)
    cis_rows = cis.cis_variants(qtl.filter_pvalue(gwas, 0.5), cis_windows(spark, sf))
    cols = ["phenotype", "chr", "pos", "effect_allele", "row_no"]
    return joins.union_distinct(trans.select(*cols), cis_rows.select(*cols))


@query(
    "genomic_order",
    oracle(
        "SELECT phenotype, chr, pos, row_no, row_number() OVER (ORDER BY phenotype, chr, pos, row_no, beta, beta_se, n_eff) AS ord FROM fx_gwas WHERE pval < 0.01",
        "fx_pvar", "fx_gwas",
    ),
)
def genomic_order(spark, sf):
    from traitloom.operators.ordering import row_index

    hits = qtl.filter_pvalue(view(spark, sf, "fx_gwas"), 0.01)
    out = row_index(hits, ["phenotype", "chr", "pos", "row_no", "beta", "beta_se", "n_eff"], "ord")
    return out.select("phenotype", "chr", "pos", "row_no", "ord")
