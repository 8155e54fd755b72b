"""Variant curation and genotype quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.fixtures import oracle, view
from traitloom.functions import expressions as E
from traitloom.operators import aggregates as A
from traitloom.operators import genotypes as G
from traitloom.operators import joins, ordering
from traitloom.plans import curation as C

_KEYED = """
keyed AS (
  SELECT chr, pos, id AS raw_id, ref, alt, row_id, least(ref, alt) || ':' || greatest(ref, alt) AS sorted_alleles,
    concat_ws(':', chr, pos, least(ref, alt), greatest(ref, alt)) AS var_id,
    CASE WHEN id = '.' THEN concat_ws(':', chr, pos, least(ref, alt), greatest(ref, alt)) ELSE id END AS id
  FROM fx_pvar)"""

_INFO = f"""{_KEYED},
same AS (SELECT chromosome, position, A_allele, B_allele, arg_max(information, row_id) AS v FROM fx_snpstats GROUP BY ALL),
informed AS (
  SELECT k.*, CASE WHEN sw.chromosome IS NOT NULL THEN sw.v ELSE st.v END AS info
  FROM keyed k
  LEFT JOIN same st ON k.chr = st.chromosome AND k.pos = st.position AND k.ref = st.A_allele AND k.alt = st.B_allele
  LEFT JOIN same sw ON k.chr = sw.chromosome AND k.pos = sw.position AND k.ref = sw.B_allele AND k.alt = sw.A_allele)"""

_DEDUP = f"""{_INFO},
counted AS (
  SELECT *, count(*) OVER (PARTITION BY chr, var_id) AS np, count(*) OVER (PARTITION BY chr, id, sorted_alleles) AS ni,
    min(row_id) OVER (PARTITION BY chr, var_id) AS grp_first FROM informed),
pos_best AS (
  SELECT *, row_number() OVER (PARTITION BY chr, var_id ORDER BY info DESC, row_id) AS rp
  FROM counted WHERE (np > 1 OR ni > 1) AND info IS NOT NULL),
id_best AS (
  SELECT *, row_number() OVER (PARTITION BY chr, id, sorted_alleles ORDER BY info DESC, grp_first) AS ri FROM pos_best WHERE rp = 1),
flagged AS (
  SELECT c.*, ((np > 1 OR ni > 1) AND c.row_id NOT IN (SELECT row_id FROM id_best WHERE ri = 1)) AS remove FROM counted c)"""

_SITES = """
rs_multi AS (SELECT chr, id FROM {src} WHERE id LIKE 'rs%' GROUP BY chr, id HAVING count(*) > 1),
no_rs AS (SELECT * FROM {src} v WHERE NOT EXISTS (SELECT 1 FROM rs_multi m WHERE m.chr = v.chr AND m.id = v.id)),
pos_multi AS (SELECT chr, pos FROM no_rs WHERE id NOT LIKE 'rs%' GROUP BY chr, pos HAVING count(*) > 1),
biallelic AS (SELECT * FROM no_rs v WHERE NOT EXISTS (SELECT 1 FROM pos_multi m WHERE m.chr = v.chr AND m.pos = v.pos))"""

SNPS_SQL = f"""{_SITES.format(src='fx_pvar')},
snps AS (SELECT * FROM biallelic WHERE ref <> translate(alt, 'ACGTVXYZ', 'TGCATAGC') AND length(ref) = 1 AND length(alt) = 1)"""

COUNTS_SQL = """
counts AS (
  SELECT row_id, count(*) AS n, count(alt_dosage) AS n_called, avg(alt_dosage) / 2 AS freq, var_pop(alt_dosage) AS dose_var,
    count(*) FILTER (alt_dosage = 0) AS n_hom_ref, count(*) FILTER (alt_dosage = 1) AS n_het, count(*) FILTER (alt_dosage = 2) AS n_hom_alt
  FROM fx_dosage GROUP BY row_id)"""

# Exact test by enumeration of heterozygote counts, probabilities through log gamma.
HWE_SQL = f"""{COUNTS_SQL},
sized AS (SELECT *, n_hom_ref + n_het + n_hom_alt AS m, 2 * least(n_hom_ref, n_hom_alt) + n_het AS rare FROM counts),
terms AS (
  SELECT row_id, n_het, h,
    h * ln(2.0e0) - lgamma(h + 1) - lgamma((rare - h) // 2 + 1) - lgamma(m - h - (rare - h) // 2 + 1) AS lp
  FROM (SELECT *, unnest(range(rare % 2, rare + 1, 2)) AS h FROM sized)),
scaled AS (SELECT row_id, n_het, h, exp(lp - max(lp) OVER (PARTITION BY row_id)) AS p FROM terms),
hwe AS (
  SELECT s.row_id, least(1, sum(p) FILTER (p <= mine * (1 + 1e-9)) / sum(p)) AS hwe_p
  FROM scaled s JOIN (SELECT row_id, p AS mine FROM scaled WHERE h = n_het) o USING (row_id) GROUP BY s.row_id)"""


def pvar(spark, sf):
    return view(spark, sf, "fx_pvar")


@query("variant_key", oracle(f"{_KEYED} SELECT row_id, id, sorted_alleles, var_id FROM keyed", "fx_pvar"))
def variant_key(spark, sf):
    return C.fill_missing_id(C.with_variant_key(pvar(spark, sf))).select("row_id", "id", "sorted_alleles", "var_id")


@query(
    "row_index",
    oracle("SELECT row_id, chr, pos, row_number() OVER (ORDER BY chr, pos, row_id) AS idx FROM fx_pvar", "fx_pvar"),
)
def row_index(spark, sf):
    return ordering.row_index(pvar(spark, sf), ["chr", "pos", "row_id"], "idx").select("row_id", "chr", "pos", "idx")


@query("variant_info", oracle(f"{_INFO} SELECT row_id, id, round(info, 6) + 0.0e0 AS info FROM informed", "fx_pvar", "fx_snpstats"))
def variant_info(spark, sf):
    v = C.fill_missing_id(C.with_variant_key(pvar(spark, sf)))
    return joins.attach_info(v, view(spark, sf, "fx_snpstats"), ["row_id"]).select("row_id", "id", r6("info").alias("info"))


@query(
    "duplicate_keys",
    oracle(
        f"""{_KEYED}
SELECT 'position' AS kind, var_id AS dup_key, count(*) AS n FROM keyed GROUP BY chr, var_id HAVING count(*) > 1
UNION ALL SELECT 'id', id || ' ' || sorted_alleles, count(*) FROM keyed GROUP BY chr, id, sorted_alleles HAVING count(*) > 1""",
        "fx_pvar",
    ),
)
def duplicate_keys(spark, sf):
    v = C.fill_missing_id(C.with_variant_key(pvar(spark, sf)))
    by_pos = A.duplicate_keys(v, ["chr", "var_id"]).select(
        F.lit("position").alias("kind"), F.col("var_id").alias("dup_key"), "n"
    )
    by_id = A.duplicate_keys(v, ["chr", "id", "sorted_alleles"]).select(
        F.lit("id").alias("kind"), F.concat_ws(" ", "id", "sorted_alleles").alias("dup_key"), "n"
    )
    return joins.union_all([by_pos, by_id])


def flagged(spark, sf):
    return C.flag_duplicates(pvar(spark, sf), view(spark, sf, "fx_snpstats"), ["row_id"])


@query(
    "variant_dedup",
    oracle(
        f"{_DEDUP} SELECT row_id, chr, pos, id, ref, alt, round(info, 6) + 0.0e0 AS info, remove FROM flagged",
        "fx_pvar", "fx_snpstats",
    ),
)
def variant_dedup(spark, sf):
    return flagged(spark, sf).select("row_id", "chr", "pos", "id", "ref", "alt", r6("info").alias("info"), "remove")


@query(
    "variant_tags",
    oracle(
        f"{_DEDUP} SELECT row_id, CASE WHEN remove THEN id || ':' || row_id || ':remove' ELSE id || ':' || row_id END AS id FROM flagged",
        "fx_pvar", "fx_snpstats",
    ),
)
def variant_tags(spark, sf):
    return C.tag_removed(flagged(spark, sf)).select("row_id", "id")


@query(
    "variant_tags_stripped",
    oracle(f"{_DEDUP} SELECT row_id, chr, pos, id FROM flagged WHERE NOT remove", "fx_pvar", "fx_snpstats"),
)
def variant_tags_stripped(spark, sf):
    tagged = C.drop_tagged(C.tag_removed(flagged(spark, sf)))
    return C.strip_row_suffix(tagged).select("row_id", "chr", "pos", "id")


@query("drop_multiallelic", oracle(f"{_SITES.format(src='fx_pvar')} SELECT row_id, chr, pos, id FROM biallelic", "fx_pvar"))
def drop_multiallelic(spark, sf):
    return C.drop_multiallelic(pvar(spark, sf)).select("row_id", "chr", "pos", "id")


@query(
    "flip_strand",
    oracle("SELECT row_id, translate(ref, 'ACGTVXYZ', 'TGCATAGC') AS ref_flip, translate(alt, 'ACGTVXYZ', 'TGCATAGC') AS alt_flip FROM fx_pvar", "fx_pvar"),
)
def flip_strand(spark, sf):
    return pvar(spark, sf).select("row_id", E.flip_strand("ref").alias("ref_flip"), E.flip_strand("alt").alias("alt_flip"))


@query(
    "drop_ambiguous",
    oracle("SELECT row_id, ref, alt FROM fx_pvar WHERE ref <> translate(alt, 'ACGTVXYZ', 'TGCATAGC')", "fx_pvar"),
)
def drop_ambiguous(spark, sf):
    return C.drop_ambiguous(pvar(spark, sf)).select("row_id", "ref", "alt")


@query("keep_snps", oracle("SELECT row_id, ref, alt FROM fx_pvar WHERE length(ref) = 1 AND length(alt) = 1", "fx_pvar"))
def keep_snps(spark, sf):
    return C.keep_snps(pvar(spark, sf)).select("row_id", "ref", "alt")


@query("identify_snps", oracle(f"{SNPS_SQL} SELECT row_id, chr, pos, id, ref, alt FROM snps", "fx_pvar"))
def identify_snps(spark, sf):
    return C.identify_snps(pvar(spark, sf)).select("row_id", "chr", "pos", "id", "ref", "alt")


@query(
    "curated_snps",
    oracle(
        f"""{_DEDUP},
dd AS (SELECT row_id, chr, pos, id, ref, alt FROM flagged WHERE NOT remove),
{_SITES.format(src='dd')}
SELECT row_id, chr, pos, id, ref, alt FROM biallelic
WHERE ref <> translate(alt, 'ACGTVXYZ', 'TGCATAGC') AND length(ref) = 1 AND length(alt) = 1""",
        "fx_pvar", "fx_snpstats",
    ),
)
def curated_snps(spark, sf):
    kept = C.strip_row_suffix(C.drop_tagged(C.tag_removed(flagged(spark, sf))))
    return C.identify_snps(kept.select("row_id", "chr", "pos", "id", "ref", "alt"))


@query(
    "allele_freq",
    oracle(
        f"""{COUNTS_SQL} SELECT row_id, n, n_called, round(freq, 6) + 0.0e0 AS freq, round(least(freq, 1 - freq), 6) + 0.0e0 AS maf,
round(sqrt(2 * freq * (1 - freq)), 6) + 0.0e0 AS sd FROM counts""",
        "fx_dosage",
    ),
)
def allele_freq(spark, sf):
    counts = G.variant_counts(view(spark, sf, "fx_packed"))
    return counts.select(
        "row_id", "n", "n_called", r6("freq").alias("freq"), r6(G.maf("freq")).alias("maf"), r6(E.genotype_sd("freq")).alias("sd")
    )


@query(
    "allele_freq_long",
    oracle("SELECT row_id, round(avg(alt_dosage) / 2, 6) + 0.0e0 AS freq FROM fx_dosage GROUP BY row_id", "fx_dosage"),
)
def allele_freq_long(spark, sf):
    return G.allele_freq(view(spark, sf, "fx_dosage")).select("row_id", r6("freq").alias("freq"))


@query("maf_filter", oracle(f"{COUNTS_SQL} SELECT row_id FROM counts WHERE least(freq, 1 - freq) >= 0.005", "fx_dosage"))
def maf_filter(spark, sf):
    return G.filter_maf(G.variant_counts(view(spark, sf, "fx_packed")), 0.005).select("row_id")


@query(
    "call_rate_filter",
    oracle(f"{COUNTS_SQL} SELECT row_id, n - n_called AS n_missing FROM counts WHERE 1 - CAST(n_called AS DOUBLE) / n <= 0.0105", "fx_dosage"),
)
def call_rate_filter(spark, sf):
    kept = G.filter_call_rate(G.variant_counts(view(spark, sf, "fx_packed")), 0.0105)
    return kept.select("row_id", (F.col("n") - F.col("n_called")).alias("n_missing"))


@query(
    "hwe_chisq",
    oracle(
        f"""{COUNTS_SQL},
pq AS (SELECT *, (n_hom_ref + n_het + n_hom_alt) AS m, (2 * n_hom_ref + n_het) / (2.0e0 * (n_hom_ref + n_het + n_hom_alt)) AS p FROM counts)
SELECT row_id, round((n_hom_ref - m*p*p)**2 / nullif(m*p*p, 0) + (n_het - 2*m*p*(1-p))**2 / nullif(2*m*p*(1-p), 0)
  + (n_hom_alt - m*(1-p)*(1-p))**2 / nullif(m*(1-p)*(1-p), 0), 6) + 0.0e0 AS chisq FROM pq""",
        "fx_dosage",
    ),
)
def hwe_chisq(spark, sf):
    return G.variant_counts(view(spark, sf, "fx_packed")).select("row_id", r6(G.hwe_chisq()).alias("chisq"))


@query("hwe_exact", oracle(f"{HWE_SQL} SELECT row_id, round(hwe_p, 6) + 0.0e0 AS hwe_p FROM hwe", "fx_dosage"))
def hwe_exact(spark, sf):
    return G.with_hwe(G.variant_counts(view(spark, sf, "fx_packed"))).select("row_id", r6("hwe_p").alias("hwe_p"))


@query(
    "mach_r2_filter",
    oracle(
        f"""{COUNTS_SQL} SELECT row_id, round(dose_var / nullif(2 * freq * (1 - freq), 0), 6) + 0.0e0 AS mach_r2 FROM counts
WHERE dose_var / nullif(2 * freq * (1 - freq), 0) >= 0.3""",
        "fx_dosage",
    ),
)
def mach_r2_filter(spark, sf):
    kept = G.filter_mach_r2(G.variant_counts(view(spark, sf, "fx_packed")), 0.3)
    return kept.select("row_id", r6(G.mach_r2()).alias("mach_r2"))


@query(
    "genotype_qc",
    oracle(
        f"""{HWE_SQL} SELECT c.row_id, round(freq, 6) + 0.0e0 AS freq FROM counts c JOIN hwe USING (row_id)
WHERE 1 - CAST(n_called AS DOUBLE) / n <= 0.05 AND hwe_p >= 1e-6 AND least(freq, 1 - freq) >= 0.01
  AND dose_var / nullif(2 * freq * (1 - freq), 0) >= 0.3""",
        "fx_dosage",
    ),
)
def genotype_qc(spark, sf):
    return G.qc_variants(view(spark, sf, "fx_packed")).select("row_id", r6("freq").alias("freq"))


@query(
    "genotype_pack",
    oracle("SELECT iid, row_id, alt_dosage FROM fx_dosage", "fx_dosage"),
)
def genotype_pack(spark, sf):
    long = view(spark, sf, "fx_dosage")
    manifest = ordering.row_index(long.select("iid").distinct(), ["iid"], "k").select(
        "iid", (F.col("k") - 1).alias("sample_idx")
    )
    packed = G.pack_genotypes(long, manifest, block=64)
    return G.unpack_genotypes(packed, manifest, block=64)
