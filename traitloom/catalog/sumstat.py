"""Summary-statistic QC, LD-score regression and spike-and-slab chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import ORACLES, query, r6
from traitloom.catalog.ld import LD_SQL, panel_ld
from traitloom.catalog.traits import manifest
from traitloom.catalog.variants import COUNTS_SQL
from traitloom.fixtures import oracle, view
from traitloom.functions.expressions import log_spaced, pval_from_log10
from traitloom.operators import genotypes as G
from traitloom.operators import joins, ld
from traitloom.operators import sumstats as S
from traitloom.plans import ldpred
from traitloom.session import cut, large, work_path
from traitloom.sources import writers

LDSC_ROUNDS, LDSC_BLOCKS = 20, 200

# One estimate per trait and variant: the smallest p, as in the selection of QTLs.
_BEST = """
gw AS (SELECT phenotype, chr, pos, effect_allele AS a1, other_allele AS a0, beta, beta_se, n_eff, row_no FROM (
  SELECT *, row_number() OVER (PARTITION BY phenotype, chr, pos ORDER BY pval, row_no, beta, beta_se, n_eff) AS rn FROM fx_gwas) WHERE rn = 1)"""

_MATCH = f"""{_BEST},
m0 AS (SELECT g.phenotype, g.chr, g.pos, v.row_id, v.id AS rsid, v.ref AS a0, v.alt AS a1, CASE WHEN g.a1 = v.alt THEN beta ELSE -beta END AS beta, beta_se, n_eff
  FROM gw g JOIN fx_pvar v ON g.chr = v.chr AND g.pos = v.pos AND ((g.a1 = v.alt AND g.a0 = v.ref) OR (g.a1 = v.ref AND g.a0 = v.alt))),
matched AS (SELECT * FROM m0 WHERE (phenotype, chr, pos) IN (SELECT (phenotype, chr, pos) FROM m0 GROUP BY phenotype, chr, pos HAVING count(*) = 1))"""

_QC = f"""{COUNTS_SQL}, {_MATCH},
q0 AS (SELECT m.*, freq, sqrt(2 * freq * (1 - freq)) AS sd_val FROM matched m JOIN counts USING (row_id)),
q1 AS (SELECT *, CASE WHEN sd_val > 0 THEN median(CASE WHEN sd_val > 0 THEN sd_val * (beta_se * sqrt(n_eff)) END) OVER (PARTITION BY phenotype) END AS sd_y_est FROM q0),
q2 AS (SELECT *, CASE WHEN sd_val > 0 THEN sd_y_est / (beta_se * sqrt(n_eff)) END AS sd_ss FROM q1),
qc AS (SELECT *, (sd_ss < 0.5 * sd_val OR sd_ss > sd_val + 0.1 OR sd_ss < 0.1 OR sd_val < 0.05) AS fail_qc FROM q2)"""


def matched(spark, sf):
    from traitloom.operators.aggregates import arg_best

    gwas = view(spark, sf, "fx_gwas").select(
        "phenotype", "chr", "pos", F.col("effect_allele").alias("a1"), F.col("other_allele").alias("a0"),
        "beta", "beta_se", "n_eff", "row_no", "pval",
    )
    best = arg_best(gwas, ["phenotype", "chr", "pos"], "pval", "min", ["row_no", "beta", "beta_se", "n_eff"])
    out = joins.snp_match(best.drop("row_no", "pval"), view(spark, sf, "fx_pvar"), ["phenotype"])
    return large(out).join(view(spark, sf, "fx_pvar").select("row_id", F.col("id").alias("rsid")), "row_id")


def checked(spark, sf, stats=None):
    stats = matched(spark, sf) if stats is None else stats
    return S.sumstat_qc(stats, G.variant_counts(view(spark, sf, "fx_packed")))


@query("snp_match", oracle(f"{_MATCH} SELECT phenotype, chr, pos, row_id, rsid, a0, a1, round(beta, 6) + 0.0e0 AS beta FROM matched", "fx_pvar", "fx_gwas"))
def snp_match(spark, sf):
    return matched(spark, sf).select("phenotype", "chr", "pos", "row_id", "rsid", "a0", "a1", r6("beta").alias("beta"))


@query(
    "sumstat_qc",
    oracle(
        f"""{_QC} SELECT phenotype, row_id, round(sd_val, 6) + 0.0e0 AS sd_val, round(sd_y_est, 6) + 0.0e0 AS sd_y_est,
round(sd_ss, 6) + 0.0e0 AS sd_ss, fail_qc FROM qc""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def sumstat_qc(spark, sf):
    out = checked(spark, sf)
    return out.select("phenotype", "row_id", r6("sd_val").alias("sd_val"), r6("sd_y_est").alias("sd_y_est"), r6("sd_ss").alias("sd_ss"), "fail_qc")


# Every trait uses the LD scores of the genotyped panel's common variants.
_LDSC_IN = f"""{_QC}, {LD_SQL},
pass AS (SELECT row_id FROM counts WHERE least(freq, 1 - freq) >= 0.01),
inner_ld AS (SELECT * FROM ld WHERE i IN (SELECT row_id FROM pass) AND j IN (SELECT row_id FROM pass)),
scores AS (SELECT row_id, sum(r2) AS ld_score FROM (
  SELECT i AS row_id, r * r AS r2 FROM inner_ld UNION ALL SELECT j, r * r FROM inner_ld UNION ALL SELECT row_id, 1 FROM pass) GROUP BY row_id),
lin AS (SELECT phenotype, row_id, n_eff, (beta / beta_se) ** 2 AS chisq, ld_score FROM qc JOIN scores USING (row_id) WHERE NOT fail_qc),
rows AS (SELECT phenotype, chisq + 1e-8 AS y, greatest(ld_score, 1) AS w_ld, ld_score / count(*) OVER p * n_eff AS x, count(*) OVER p AS m,
  floor((row_number() OVER (PARTITION BY phenotype ORDER BY row_id) - 1) * {LDSC_BLOCKS} / count(*) OVER p) AS block
  FROM lin WINDOW p AS (PARTITION BY phenotype))"""


# Here every trait uses the LD scores of its own passing variants.
_OWN_SCORES = """
pass AS (SELECT phenotype, row_id FROM qc WHERE NOT fail_qc),
inner_ld AS (SELECT a.phenotype, ld.i, ld.j, ld.r FROM ld JOIN pass a ON a.row_id = ld.i JOIN pass b ON b.row_id = ld.j AND a.phenotype = b.phenotype),
scores AS (SELECT phenotype, row_id, sum(r2) AS ld_score FROM (
  SELECT phenotype, i AS row_id, r * r AS r2 FROM inner_ld UNION ALL SELECT phenotype, j, r * r FROM inner_ld UNION ALL SELECT phenotype, row_id, 1 FROM pass) GROUP BY ALL)"""


def _own_input() -> str:
    head, tail = _LDSC_IN.split("pass AS (", 1)
    lin = "lin AS (" + tail.split("lin AS (", 1)[1].replace("JOIN scores USING (row_id)", "JOIN scores USING (phenotype, row_id)")
    return f"{head.rstrip()}{_OWN_SCORES},\n{lin}"


def _ldsc_sql(rounds: int, digits: int, floor: bool = False, source: str = "") -> str:
    h2 = "CASE WHEN any_value(h2) < 0 THEN 0.001e0 ELSE any_value(h2) END" if floor else "any_value(h2)"
    parts = [source or _LDSC_IN, "a0 AS (SELECT DISTINCT phenotype, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS b FROM rows)"]
    for k in range(rounds):
        parts.append(f"""a{k + 1} AS MATERIALIZED (SELECT phenotype, (swy - b * swx) / sw AS a, b FROM (
  SELECT *, (sw * swxy - swx * swy) / (sw * swxx - swx * swx) AS b FROM (
    SELECT phenotype, sum(w) AS sw, sum(w * x) AS swx, sum(w * y) AS swy, sum(w * x * x) AS swxx, sum(w * x * y) AS swxy
    FROM (SELECT r.*, 1 / (coalesce(a + b * x, y) ** 2 * w_ld) AS w FROM rows r JOIN a{k} USING (phenotype) WHERE y < 30) GROUP BY phenotype)))""")
    n = rounds
    parts.append(f"s0 AS (SELECT phenotype, a, CAST(NULL AS DOUBLE) AS b FROM a{n})")
    for k in range(n):
        parts.append(f"""s{k + 1} AS MATERIALIZED (SELECT phenotype, any_value(a) AS a, (sum(w * x * y) - any_value(a) * sum(w * x)) / sum(w * x * x) AS b
  FROM (SELECT r.*, a, 1 / (coalesce(a + b * x, y) ** 2 * w_ld) AS w FROM rows r JOIN s{k} USING (phenotype)) GROUP BY phenotype)""")
    parts.append(f"""wt AS (SELECT r.*, CASE WHEN y < 30 THEN 1 / ((f.a + f.b * x) ** 2 * w_ld) ELSE 0 END AS u, 1 / ((s.a + s.b * x) ** 2 * w_ld) AS w
  FROM rows r JOIN a{n} f USING (phenotype) JOIN s{n} s USING (phenotype)),
blk AS MATERIALIZED (SELECT phenotype, block, m, count(*) AS size, sum(u) AS u0, sum(u * x) AS u1, sum(u * y) AS u2, sum(u * x * x) AS u3, sum(u * x * y) AS u4,
  sum(w * x) AS w1, sum(w * x * x) AS w3, sum(w * x * y) AS w4 FROM wt GROUP BY ALL),
tot AS (SELECT phenotype, sum(u0) AS u0, sum(u1) AS u1, sum(u2) AS u2, sum(u3) AS u3, sum(u4) AS u4, sum(w1) AS w1, sum(w3) AS w3, sum(w4) AS w4 FROM blk GROUP BY phenotype),
est AS (SELECT phenotype, i, (w4 - i * w1) / w3 AS h2 FROM (SELECT *, (u2 - (u0 * u4 - u1 * u2) / (u0 * u3 - u1 * u1) * u1) / u0 AS i FROM tot)),
del0 AS (SELECT b.phenotype, m, size, t.u0 - b.u0 AS u0, t.u1 - b.u1 AS u1, t.u2 - b.u2 AS u2, t.u3 - b.u3 AS u3, t.u4 - b.u4 AS u4,
  t.w1 - b.w1 AS w1, t.w3 - b.w3 AS w3, t.w4 - b.w4 AS w4 FROM blk b JOIN tot t USING (phenotype)),
del AS (SELECT *, (w4 - d_i * w1) / w3 AS d_h FROM (SELECT *, (u2 - (u0 * u4 - u1 * u2) / (u0 * u3 - u1 * u1) * u1) / u0 AS d_i FROM del0)),
ps AS (SELECT phenotype, CAST(m AS DOUBLE) / size AS h, CAST(m AS DOUBLE) / size * i - (CAST(m AS DOUBLE) / size - 1) * d_i AS p_i,
  CAST(m AS DOUBLE) / size * h2 - (CAST(m AS DOUBLE) / size - 1) * d_h AS p_h, i, h2, m FROM del JOIN est USING (phenotype)),
jk AS (SELECT *, sum(p_i / h) OVER q AS j_i, sum(p_h / h) OVER q AS j_h FROM ps WINDOW q AS (PARTITION BY phenotype))
SELECT phenotype, round(any_value(i), {digits}) + 0.0e0 AS intercept, round(sqrt(avg((p_i - j_i) ** 2 / (h - 1))), {digits}) + 0.0e0 AS intercept_se,
  round({h2}, {digits}) + 0.0e0 AS h2, round(sqrt(avg((p_h - j_h) ** 2 / (h - 1))), {digits}) + 0.0e0 AS h2_se, any_value(m) AS n_variants
FROM jk GROUP BY phenotype""")
    return ",\n".join(parts)


def ldsc_input(spark, sf):
    common = G.filter_maf(G.variant_counts(view(spark, sf, "fx_packed")), 0.01).select("row_id")
    scores = ld.ld_score(panel_ld(spark, sf), common)
    chisq = F.pow(F.col("beta") / F.col("beta_se"), F.lit(2.0))
    return large(S.passing(checked(spark, sf))).join(scores, "row_id").select("phenotype", "row_id", "n_eff", chisq.alias("chisq"), "ld_score")


# Twenty rounds in SQL stand for "until nothing moves"; hence the fewer digits.
@query("ldsc", oracle(_ldsc_sql(LDSC_ROUNDS, 4), "fx_pvar", "fx_gwas", "fx_dosage"))
def ldsc(spark, sf):
    """Both steps until the weights settle, and the block jackknife, at the library's settings."""
    out = S.ldsc(ldsc_input(spark, sf))
    return out.select("phenotype", *[r6(c, 4).alias(c) for c in ("intercept", "intercept_se", "h2", "h2_se")], "n_variants")


@query("ldsc_converged", oracle(_ldsc_sql(LDSC_ROUNDS, 4, floor=True), "fx_pvar", "fx_gwas", "fx_dosage"))
def ldsc_converged(spark, sf):
    """Reweighted until the predictions settle, negative heritability replaced."""
    out = S.initial_h2(S.ldsc(ldsc_input(spark, sf)))
    return out.select("phenotype", *[r6(c, 4).alias(c) for c in ("intercept", "intercept_se", "h2", "h2_se")], "n_variants")


@query("ld_score_by_trait", oracle(f"{_QC}, {LD_SQL},{_OWN_SCORES} SELECT phenotype, row_id, round(ld_score, 6) + 0.0e0 AS ld_score FROM scores", "fx_pvar", "fx_gwas", "fx_dosage"))
def ld_score_by_trait(spark, sf):
    out = ld.ld_score(panel_ld(spark, sf), S.passing(checked(spark, sf)), ["phenotype"])
    return out.select("phenotype", "row_id", r6("ld_score").alias("ld_score"))


def heritability(spark, sf, pairs=None):
    """Start of the chains: quality filter, LD scores of each trait's passing set, regression."""
    passed = cut(S.passing(checked(spark, sf)))
    scores = ld.ld_score(panel_ld(spark, sf) if pairs is None else pairs, passed, ["phenotype"])
    chisq = F.pow(F.col("beta") / F.col("beta_se"), F.lit(2.0))
    rows = large(passed).join(scores, ["phenotype", "row_id"]).select("phenotype", "row_id", "n_eff", chisq.alias("chisq"), "ld_score")
    return passed, S.initial_h2(S.ldsc(rows))


@query("ldsc_by_trait", oracle(_ldsc_sql(LDSC_ROUNDS, 4, floor=True, source=_own_input()), "fx_pvar", "fx_gwas", "fx_dosage"))
def ldsc_by_trait(spark, sf):
    _, out = heritability(spark, sf)
    return out.select("phenotype", *[r6(c, 4).alias(c) for c in ("intercept", "intercept_se", "h2", "h2_se")], "n_variants")


@query(
    "log10_pvalue",
    oracle("SELECT phenotype, row_no, round(10.0e0 ** log10(pval), 9) + 0.0e0 AS pval FROM fx_gwas WHERE log10(pval) < -2", "fx_pvar", "fx_gwas"),
)
def log10_pvalue(spark, sf):
    """Threshold on the log scale first, exponentiation after."""
    logged = view(spark, sf, "fx_gwas").select("phenotype", "row_no", F.log10("pval").alias("log_p"))
    return logged.where("log_p < -2").select("phenotype", "row_no", r6(pval_from_log10("log_p"), 9).alias("pval"))


# Chains: every label of ``embeddings`` is a trait, every vector one chain's correlations.
_CHAIN = """
ranges AS (SELECT trait, chain, list_max(corr_est)::DOUBLE - list_min(corr_est)::DOUBLE AS width, corr_est FROM fx_chain),
kept AS (SELECT *, width > 0.95 * quantile_cont(width, 0.95) OVER (PARTITION BY trait) AS keep FROM ranges)"""


@query(
    "chain_select",
    oracle(
        f"""{_CHAIN}, cells AS (SELECT trait, unnest(range(len(corr_est))) AS k, CAST(unnest(corr_est) AS DOUBLE) AS v FROM kept WHERE keep)
SELECT trait, CAST(k AS INT) AS k, round(avg(v), 6) + 0.0e0 AS beta FROM cells GROUP BY trait, k""",
        "fx_chain",
    ),
)
def chain_select(spark, sf):
    chains = view(spark, sf, "fx_chain").withColumn("corr_est", F.col("corr_est").cast("array<double>"))
    return S.select_chains(chains, ["trait"], "corr_est").withColumn("beta", r6("beta"))


@query("chain_keep", oracle(f"{_CHAIN} SELECT trait, chain, round(width, 6) + 0.0e0 AS width, keep FROM kept", "fx_chain"))
def chain_keep(spark, sf):
    chains = view(spark, sf, "fx_chain").withColumn("corr_est", F.col("corr_est").cast("array<double>"))
    return S.kept_chains(S.chain_ranges(chains, ["trait"]), ["trait"]).withColumn("width", r6("width"))


_P0 = f"exp(ln({ldpred.P_FIRST}) + (ln({ldpred.P_LAST}) - ln({ldpred.P_FIRST})) * (chain % {ldpred.CHAINS}) / {ldpred.CHAINS - 1}.0e0)"


@query(
    "chain_paths",
    oracle(
        """SELECT trait, chain AS paramset, CAST(unnest(range(1, len(corr_est) + 1)) AS INT) AS path_iter,
round(CAST(unnest(corr_est) AS DOUBLE), 6) + 0.0e0 AS p_est, round(CAST(unnest(list_transform(corr_est, lambda e: e * e)) AS DOUBLE), 6) + 0.0e0 AS h2_est FROM fx_chain""",
        "fx_chain",
    ),
)
def chain_paths(spark, sf):
    chains = view(spark, sf, "fx_chain").select(
        "trait", "chain", F.col("corr_est").alias("path_p_est"), F.transform("corr_est", lambda e: e * e).alias("path_h2_est")
    )
    out = S.chain_paths(chains, ["trait"])
    return out.select("trait", "paramset", "path_iter", r6("p_est").alias("p_est"), r6("h2_est").alias("h2_est"))


@query(
    "chain_params",
    oracle(
        f"""SELECT trait, chain AS paramset, round({_P0}, 9) + 0.0e0 AS p_init, 0.5e0 AS h2_init,
round(list_max(corr_est)::DOUBLE, 6) + 0.0e0 AS p_est, round(list_min(corr_est)::DOUBLE, 6) + 0.0e0 AS h2_est FROM fx_chain""",
        "fx_chain",
    ),
)
def chain_params(spark, sf):
    starts = log_spaced(ldpred.P_FIRST, ldpred.P_LAST, ldpred.CHAINS)
    chains = view(spark, sf, "fx_chain").select(
        "trait", "chain", F.get(starts, F.col("chain") % ldpred.CHAINS).alias("p_init"), F.lit(0.5).alias("h2_init"),
        F.array_max("corr_est").alias("p_est"), F.array_min("corr_est").alias("h2_est"),
    )
    out = S.chain_params(chains, ["trait"])
    return out.select("trait", "paramset", r6("p_init", 9).alias("p_init"), "h2_init", r6("p_est").alias("p_est"), r6("h2_est").alias("h2_est"))


@query(
    "model_export",
    oracle(
        f"""{_MATCH} SELECT phenotype, rsid, chr, pos, a1 AS effect_allele, a0 AS other_allele, round(avg(beta) OVER (PARTITION BY phenotype, row_id), 6) + 0.0e0 AS effect FROM matched""",
        "fx_pvar", "fx_gwas",
    ),
)
def model_export(spark, sf, stats=None):
    stats = matched(spark, sf) if stats is None else stats
    beta = stats.groupBy("phenotype", "row_id").agg(F.avg("beta").alias("beta"))
    return S.export_model(stats, beta).withColumn("effect", r6("effect"))


def auto_job(spark, sf):
    # Written once: the scores and the windows read them, and each time would cost the products anew.
    pairs = cut(panel_ld(spark, sf))
    passed, estimates = heritability(spark, sf, pairs)
    alleles = view(spark, sf, "fx_pvar").select("row_id", "alt")
    return passed, ldpred.auto_job(passed, pairs, estimates, view(spark, sf, "fx_packed"), alleles, manifest(spark, sf))


@query(
    "ldpred_auto_check",
    oracle(
        f"""{_QC} SELECT phenotype, count(*) AS n_variants, CAST({ldpred.CHAINS} AS BIGINT) AS chains, CAST(0 AS BIGINT) AS violations,
(SELECT count(DISTINCT iid) FROM fx_dosage) AS samples FROM qc WHERE NOT fail_qc GROUP BY phenotype""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def ldpred_auto_check(spark, sf):
    """The whole job as it is: all chains have all variants, values stay within bounds, models and scores are of the kept chains."""
    passed, job = auto_job(spark, sf)
    odd = (F.isnan("beta_est") | ~(F.abs("beta_est") < float("inf")) | ~(F.abs("corr_est") < float("inf"))).cast("bigint")
    # The chains of a variant lie together, so they are added up before anything moves; a chain, one of a few dozen, is a bit.
    own = F.bit_or(F.expr("shiftleft(1L, chain)")).alias("chains")
    variants = job["effects"].groupBy("phenotype", "row_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(odd).alias("odd"), own)
    seen = variants.join(passed.select("phenotype", "row_id"), ["phenotype", "row_id"])
    sizes = seen.groupBy("phenotype").agg(
        F.count_distinct("row_id").alias("n_variants"), F.bit_count(F.bit_or("chains")).cast("bigint").alias("chains"),
        F.sum("cells").alias("cells"), F.sum("odd").alias("odd"),
    )
    bad = (~((F.col("p_est") >= 0) & (F.col("p_est") <= 1) & (F.col("h2_est") > 0))).cast("bigint")
    wrong = job["params"].groupBy("phenotype").agg(F.sum(bad).alias("bad"))
    steps = job["paths"].groupBy("phenotype").agg(F.count(F.lit(1)).alias("steps"), F.max("path_iter").alias("rounds"))
    kept = job["heritability"].groupBy("phenotype").agg(F.sum(F.col("kept").cast("bigint")).alias("kept"), F.count(F.lit(1)).alias("told"))
    model = job["model"].groupBy("phenotype").agg(F.count(F.lit(1)).alias("modelled"))
    scored = job["scores"].groupBy("phenotype").agg(F.count(F.lit(1)).alias("samples"), F.sum((~(F.abs("score") < float("inf"))).cast("bigint")).alias("lost"))
    out = sizes
    for table in (wrong, steps, kept, model, scored):
        out = out.join(table, "phenotype")
    faults = [
        F.col("cells") != F.col("n_variants") * F.col("chains"), F.col("steps") != F.col("rounds") * F.col("chains"), F.col("rounds") != 10,
        (F.col("kept") < 1) | (F.col("told") != F.col("chains")), F.col("modelled") != F.col("n_variants"),
    ]
    total = F.col("odd") + F.col("bad") + F.col("lost") + sum((f.cast("bigint") for f in faults), F.lit(0))
    return out.select("phenotype", "n_variants", "chains", total.alias("violations"), "samples")


@query("written_ldpred", ORACLES["model_export"])
def written_ldpred(spark, sf):
    """Quality table and score model written together; the model read back."""
    path = work_path(spark, "ldpred")
    # Written once: the quality table reads the matched rows once, the model twice. Their file is far smaller than they are.
    stats = large(cut(matched(spark, sf)))
    writers.write_ldpred_outputs(path, {"qc": checked(spark, sf, stats), "model": model_export(spark, sf, stats)})
    return spark.read.parquet(f"{path}/model")


@query("ldpred_auto")
def ldpred_auto(spark, sf):
    """Score models of every trait: quality filter, LD-score heritability, all chains, kept-chain mean."""
    return auto_job(spark, sf)[1]["model"]
