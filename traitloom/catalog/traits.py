"""Trait adjustment, scoring and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import ORACLES, query, r6
from traitloom.catalog.variants import COUNTS_SQL
from traitloom.fixtures import oracle, view
from traitloom.functions import expressions as E
from traitloom.operators import aggregates as A
from traitloom.operators import genotypes as G
from traitloom.operators import joins, ordering, regression, scoring, training
from traitloom.plans import evaluation, phenotypes, qtl
from traitloom.session import cut, large, work_path
from traitloom.sources import readers, writers

PC = phenotypes.COMPONENTS

_TRAIT = """
avgd AS (SELECT phenotype, iid, avg(value) AS value FROM fx_trait WHERE value IS NOT NULL GROUP BY phenotype, iid),
batch AS (SELECT DISTINCT iid, batch FROM fx_trait),
resid AS (SELECT phenotype, iid, batch, value - avg(value) OVER (PARTITION BY phenotype, batch) AS value FROM avgd JOIN batch USING (iid))"""


def averaged(spark, sf):
    return phenotypes.average_traits(view(spark, sf, "fx_trait"))


def batches(spark, sf):
    return view(spark, sf, "fx_trait").select("iid", "batch").distinct()


@query("trait_average", oracle(f"{_TRAIT} SELECT phenotype, iid, round(value, 6) + 0.0e0 AS value FROM avgd", "fx_trait"))
def trait_average(spark, sf):
    return averaged(spark, sf).withColumn("value", r6("value"))


@query("batch_residual", oracle(f"{_TRAIT} SELECT phenotype, iid, round(value, 6) + 0.0e0 AS value FROM resid", "fx_trait"))
def batch_residual(spark, sf):
    return phenotypes.batch_adjusted(averaged(spark, sf), batches(spark, sf)).withColumn("value", r6("value"))


@query(
    "trait_zscore",
    oracle(
        f"""{_TRAIT} SELECT phenotype, iid, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) + 0.0e0 AS value
FROM avgd WINDOW w AS (PARTITION BY phenotype)""",
        "fx_trait",
    ),
)
def trait_zscore(spark, sf):
    return regression.zscore(averaged(spark, sf), ["phenotype"], ["value"]).withColumn("value", r6("value"))


@query(
    "trait_rank",
    oracle(
        """SELECT phenotype, event_id, (rank() OVER (PARTITION BY phenotype ORDER BY value)
 + (count(*) OVER (PARTITION BY phenotype, value) - 1) / 2.0e0) + 0.0e0 AS rank FROM fx_trait WHERE value IS NOT NULL""",
        "fx_trait",
    ),
)
def trait_rank(spark, sf):
    rows = view(spark, sf, "fx_trait").where("value IS NOT NULL")
    return ordering.average_rank(rows, ["phenotype"], "value", "rank").select("phenotype", "event_id", "rank")


@query(
    "trait_median",
    oracle(
        "SELECT phenotype, round(median(value), 6) + 0.0e0 AS median, round(quantile_cont(value, 0.95), 6) + 0.0e0 AS q95, round(max(value) - min(value), 6) + 0.0e0 AS value_range FROM fx_trait GROUP BY phenotype",
        "fx_trait",
    ),
)
def trait_median(spark, sf):
    t = view(spark, sf, "fx_trait")
    med = ordering.median_of(t, ["phenotype"], "value")
    q95 = ordering.exact_quantile(t, ["phenotype"], "value", 0.95, "q95")
    span = t.groupBy("phenotype").agg((F.max("value") - F.min("value")).alias("value_range"))
    out = med.join(q95, "phenotype").join(span, "phenotype")
    return out.select("phenotype", r6("median").alias("median"), r6("q95").alias("q95"), r6("value_range").alias("value_range"))


@query(
    "pc_residual_one",
    oracle(
        f"""{_TRAIT}, j AS (SELECT * FROM avgd JOIN fx_pc USING (iid))
SELECT phenotype, iid, round(value - (regr_intercept(value, PC_1) OVER w + regr_slope(value, PC_1) OVER w * PC_1), 6) + 0.0e0 AS value
FROM j WINDOW w AS (PARTITION BY phenotype)""",
        "fx_trait", "fx_pc",
    ),
)
def pc_residual_one(spark, sf):
    j = joins.with_covariates(averaged(spark, sf), view(spark, sf, "fx_pc").select("iid", "PC_1"))
    return regression.residualise(j, ["phenotype"], "value", ["PC_1"]).select("phenotype", "iid", r6("value").alias("value"))


@query(
    "pc_residual_check",
    oracle("SELECT DISTINCT phenotype, CAST(0 AS BIGINT) AS violations FROM fx_trait WHERE value IS NOT NULL", "fx_trait"),
)
def pc_residual_check(spark, sf):
    """Per trait, how many of the eleven sums of residual times covariate are not zero."""
    pcs = view(spark, sf, "fx_pc")
    out = phenotypes.adjust_phenotypes({"Panel": view(spark, sf, "fx_trait")}, pcs, {"Panel": batches(spark, sf)})
    j = out.join(pcs, "iid")
    bad = F.lit(0)
    for c in [F.lit(1.0), *[F.col(c) for c in PC]]:
        bad = bad + (F.abs(F.sum(F.col("value") * c)) > 1e-6).cast("bigint")
    return j.groupBy("phenotype").agg(bad.alias("violations"))


@query(
    "phenotype_assembly",
    oracle(
        f"""{_TRAIT},
stacked AS (SELECT phenotype, 'Panel' AS platform, iid, value FROM avgd
  UNION ALL SELECT 'SL_' || phenotype, 'Aptamer', iid, value FROM resid),
j AS (SELECT * FROM stacked JOIN fx_pc USING (iid))
SELECT phenotype, platform, iid, round(value - (regr_intercept(value, PC_2) OVER w + regr_slope(value, PC_2) OVER w * PC_2), 6) + 0.0e0 AS value
FROM j WINDOW w AS (PARTITION BY phenotype)""",
        "fx_trait", "fx_pc",
    ),
)
def phenotype_assembly(spark, sf):
    t = view(spark, sf, "fx_trait")
    second = t.withColumn("phenotype", F.concat(F.lit("SL_"), "phenotype"))
    out = phenotypes.adjust_phenotypes(
        {"Panel": t, "Aptamer": second}, view(spark, sf, "fx_pc"), {"Aptamer": batches(spark, sf)}, ["PC_2"]
    )
    return out.withColumn("value", r6("value"))


_MEASURES = [f"{t}_p{k}" for t in ("click", "error", "purchase", "signup", "view") for k in (0, 1)]
_WIDE = ", ".join(f"avg(value) FILTER (variable = '{m}') AS {m}" for m in _MEASURES)


@query(
    "aptamer_phenotypes",
    oracle(
        f"""
wide AS (SELECT iid + 500000 AS aliquot_id, {_WIDE} FROM fx_trait GROUP BY iid),
long AS (UNPIVOT wide ON {', '.join(_MEASURES)} INTO NAME aptamer VALUE value),
means AS (SELECT split_part(aptamer, '_', 1) AS phenotype, aliquot_id - 500000 AS iid, avg(value) AS value FROM long GROUP BY ALL),
batch AS (SELECT DISTINCT iid, batch FROM fx_trait),
res AS (SELECT phenotype, iid, value - avg(value) OVER (PARTITION BY phenotype, batch) AS value FROM means JOIN batch USING (iid)),
j AS (SELECT * FROM res JOIN fx_pc USING (iid))
SELECT phenotype, 'Somalogic' AS platform, iid, round(value - (regr_intercept(value, PC_3) OVER w + regr_slope(value, PC_3) OVER w * PC_3), 6) + 0.0e0 AS value
FROM j WINDOW w AS (PARTITION BY phenotype)""",
        "fx_trait", "fx_pc",
    ),
)
def aptamer_phenotypes(spark, sf):
    t = view(spark, sf, "fx_trait")
    wide = t.groupBy((F.col("iid") + 500000).alias("aliquot_id")).pivot("variable", _MEASURES).agg(F.avg("value"))
    sheet = (
        t.groupBy("phenotype").agg(F.array_join(F.sort_array(F.collect_set("variable")), ",").alias("aptamer"))
        .withColumn("seq_id", F.regexp_replace("aptamer", "_p", "-"))
    )
    ids = t.select((F.col("iid") + 500000).alias("aliquot_id"), "iid").distinct()
    out = phenotypes.adjust_aptamers(
        wide, sheet, ids, batches(spark, sf), view(spark, sf, "fx_pc"), t.select("phenotype"), ["PC_3"]
    )
    return out.withColumn("value", r6("value"))


@query(
    "trait_melt",
    oracle(
        """
wide AS (SELECT iid, avg(value) FILTER (batch = 0 OR batch = 1) AS early, avg(value) FILTER (batch = 2 OR batch = 3) AS late FROM fx_trait GROUP BY iid)
SELECT iid, name, round(value, 6) + 0.0e0 AS value FROM wide UNPIVOT INCLUDE NULLS (value FOR name IN (early, late))""",
        "fx_trait",
    ),
)
def trait_melt(spark, sf):
    b = F.col("batch")
    wide = view(spark, sf, "fx_trait").groupBy("iid").agg(
        F.avg(F.when(b < 2, F.col("value"))).alias("early"), F.avg(F.when(b >= 2, F.col("value"))).alias("late")
    )
    return G.to_long(wide, ["iid"], "name", "value").withColumn("value", r6("value"))


@query(
    "trait_one_hot",
    oracle(
        """SELECT event_id, iid, CAST(phenotype = l2 AS INT) AS is_second, CAST(phenotype = l3 AS INT) AS is_third FROM fx_trait,
(SELECT list(p ORDER BY p)[2] AS l2, list(p ORDER BY p)[3] AS l3 FROM (SELECT DISTINCT phenotype AS p FROM fx_trait))""",
        "fx_trait",
    ),
)
def trait_one_hot(spark, sf):
    hot = regression.one_hot(view(spark, sf, "fx_trait").select("event_id", "iid", "phenotype"), ["phenotype"])
    flags = sorted(c for c in hot.columns if c.startswith("phenotype_"))
    return hot.select("event_id", "iid", F.col(flags[0]).alias("is_second"), F.col(flags[1]).alias("is_third"))


# Univariate scores --------------------------------------------------------------------------

_EFFECTS = """
ids AS (SELECT chr, pos, arg_max(id, row_id) AS rsid FROM fx_pvar GROUP BY chr, pos),
matched AS (
  SELECT s.phenotype, ids.rsid, s.chr, s.pos, s.effect_allele, s.other_allele, s.beta AS effect, s.pval, v.row_id, (s.effect_allele = v.alt) AS counts_alt, s.row_no, s.beta_se, s.n_eff
  FROM fx_gwas s JOIN fx_pvar v ON s.chr = v.chr AND s.pos = v.pos
    AND ((s.effect_allele = v.alt AND s.other_allele = v.ref) OR (s.effect_allele = v.ref AND s.other_allele = v.alt))
  JOIN ids ON s.chr = ids.chr AND s.pos = ids.pos WHERE s.pval < 0.001),
best AS (
  SELECT phenotype, chr, pos, arg_min(rsid, (pval, row_no, effect, beta_se, n_eff)) AS rsid, arg_min(effect_allele, (pval, row_no, effect, beta_se, n_eff)) AS effect_allele,
    arg_min(other_allele, (pval, row_no, effect, beta_se, n_eff)) AS other_allele, arg_min(effect, (pval, row_no, effect, beta_se, n_eff)) AS effect
  FROM matched GROUP BY phenotype, chr, pos),
chosen AS (
  SELECT b.phenotype, b.rsid, v.row_id, b.effect, (b.effect_allele = v.alt) AS counts_alt FROM best b JOIN fx_pvar v ON b.chr = v.chr AND b.pos = v.pos
    AND least(v.ref, v.alt) = least(b.effect_allele, b.other_allele) AND greatest(v.ref, v.alt) = greatest(b.effect_allele, b.other_allele))"""


def chosen_effects(spark, sf):
    from traitloom.plans import qtl

    variants = view(spark, sf, "fx_pvar")
    hits = qtl.select_trans_qtls(view(spark, sf, "fx_gwas"), variants, 0.001, ["row_no", "beta", "beta_se", "n_eff"])
    return joins.match_effects(hits, variants)


def manifest(spark, sf):
    """Sample manifest of the genotyped panel, read off the genotype table itself."""
    cells = view(spark, sf, "fx_packed").select(F.size("doses").alias("n")).agg(F.max("n").alias("n"))
    return cells.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("iid")).select(
        "iid", F.col("iid").alias("sample_idx")
    )


@query(
    "effect_dosage",
    oracle(
        f"""{_EFFECTS} SELECT c.phenotype, d.iid, d.row_id, c.rsid, CASE WHEN counts_alt THEN alt_dosage ELSE 2 - alt_dosage END AS dosage
FROM chosen c JOIN fx_dosage d USING (row_id)""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def effect_dosage(spark, sf):
    variants = view(spark, sf, "fx_pvar")
    from traitloom.plans import qtl

    hits = qtl.select_trans_qtls(view(spark, sf, "fx_gwas"), variants, 0.001, ["row_no", "beta", "beta_se", "n_eff"])
    return joins.effect_dosage(view(spark, sf, "fx_dosage"), hits, variants).drop("effect")


_GRS = f"""{_EFFECTS},
raw AS (SELECT c.phenotype, d.iid, sum(CASE WHEN counts_alt THEN alt_dosage ELSE 2 - alt_dosage END * effect) AS s
  FROM chosen c JOIN fx_dosage d USING (row_id) GROUP BY c.phenotype, d.iid)"""


@query(
    "grs",
    oracle(
        f"{_GRS} SELECT phenotype, iid, round((s - avg(s) OVER w) / stddev_pop(s) OVER w, 6) + 0.0e0 AS score FROM raw WINDOW w AS (PARTITION BY phenotype)",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def grs(spark, sf):
    out = scoring.score(
        view(spark, sf, "fx_packed"), chosen_effects(spark, sf), manifest(spark, sf), standardise=True
    )
    return out.withColumn("score", r6("score"))


def _imputed_sql(fill: str) -> str:
    return oracle(
        f"""{COUNTS_SQL}, {_EFFECTS}, filled AS (SELECT row_id, {fill} AS fill FROM counts)
SELECT c.phenotype, d.iid, round(sum(CASE WHEN counts_alt THEN coalesce(alt_dosage, fill) ELSE 2 - coalesce(alt_dosage, fill) END * effect), 6) + 0.0e0 AS score
FROM chosen c JOIN fx_dosage d USING (row_id) JOIN filled USING (row_id) GROUP BY c.phenotype, d.iid""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    )


def _imputed(spark, sf, how):
    out = scoring.score_imputed(view(spark, sf, "fx_packed"), chosen_effects(spark, sf), how, manifest(spark, sf))
    return out.withColumn("score", r6("score"))


@query(
    "score_imputed_mode",
    _imputed_sql(
        "CASE WHEN n_hom_ref >= n_het AND n_hom_ref >= n_hom_alt THEN 0e0 WHEN n_het >= n_hom_alt THEN 1e0 ELSE 2e0 END"
    ),
)
def score_imputed_mode(spark, sf):
    return _imputed(spark, sf, "mode")


@query("score_imputed_mean", _imputed_sql("2 * freq"))
def score_imputed_mean(spark, sf):
    return _imputed(spark, sf, "mean")


@query(
    "score_imputed_median",
    oracle(
        f"""{_EFFECTS}, filled AS (SELECT row_id, median(alt_dosage) AS fill FROM fx_dosage GROUP BY row_id)
SELECT c.phenotype, d.iid, round(sum(CASE WHEN counts_alt THEN coalesce(alt_dosage, fill) ELSE 2 - coalesce(alt_dosage, fill) END * effect), 6) + 0.0e0 AS score
FROM chosen c JOIN fx_dosage d USING (row_id) JOIN filled USING (row_id) GROUP BY c.phenotype, d.iid""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def score_imputed_median(spark, sf):
    return _imputed(spark, sf, "median")


@query(
    "score_long",
    oracle(
        f"{_GRS} SELECT phenotype, iid, round(s, 6) + 0.0e0 AS score FROM raw",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def score_long(spark, sf):
    return scoring.score(view(spark, sf, "fx_dosage"), chosen_effects(spark, sf)).withColumn("score", r6("score"))


@query(
    "trait_sizes",
    oracle(
        f"""{_EFFECTS} SELECT c.phenotype, count(DISTINCT c.row_id) AS n_variants, count(DISTINCT d.iid) AS n_samples
FROM chosen c JOIN fx_dosage d USING (row_id) GROUP BY c.phenotype""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def trait_sizes(spark, sf):
    cells = large(view(spark, sf, "fx_dosage")).join(chosen_effects(spark, sf), "row_id")
    return A.trait_sizes(cells, ["phenotype"], "row_id", "iid")


@query(
    "dosage_wide",
    oracle(
        """SELECT iid, max(alt_dosage) FILTER (k = 0) AS v0, max(alt_dosage) FILTER (k = 1) AS v1, max(alt_dosage) FILTER (k = 2) AS v2, max(alt_dosage) FILTER (k = 3) AS v3
FROM (SELECT iid, row_id % 4 AS k, alt_dosage FROM fx_dosage) GROUP BY iid""",
        "fx_dosage",
    ),
)
def dosage_wide(spark, sf):
    """Per-group dosage maxima assembled from four pieces and put side by side."""
    d = view(spark, sf, "fx_dosage").withColumn("name", F.concat(F.lit("v"), F.col("row_id") % 4))
    best = d.groupBy("iid", "name").agg(F.max("alt_dosage").alias("dosage"))
    pieces = [best.where(F.col("name") == f"v{i}") for i in range(4)]
    return G.to_wide(joins.union_all(pieces), "iid", "name", "dosage", [f"v{i}" for i in range(4)])


# Training ------------------------------------------------------------------------------------

_HASH = f"((iid % 2147483647) * 48271 + {training.FOLD_SEED} * 69621) % 2147483647"

_DESIGN = f"""{_TRAIT},
design AS (SELECT a.phenotype, a.iid, a.value AS y, d.x FROM avgd a JOIN fx_design d USING (iid)),
folded AS (SELECT *, (row_number() OVER (PARTITION BY phenotype ORDER BY {_HASH}, iid) - 1) % 5 + 1 AS fold FROM design)"""

# Univariate effects of the 64 design variants: any fixed numbers do for scoring.
_WEIGHTS = """
w0 AS (SELECT phenotype, unnest(range(1, 65)) AS j FROM (SELECT DISTINCT phenotype FROM fx_trait)),
weights AS (SELECT phenotype, list(((j * 37) % 41 - 20) / 100.0e0 ORDER BY j) AS w FROM w0 GROUP BY phenotype)"""


def design(spark, sf):
    y = averaged(spark, sf).withColumnRenamed("value", "y")
    return y.join(view(spark, sf, "fx_design"), "iid").select("phenotype", "iid", "y", "x")


def weights(spark, sf):
    traits = view(spark, sf, "fx_trait").select("phenotype").distinct()
    w = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: ((j * 37) % 41 - 20) / F.lit(100.0))
    return traits.select("phenotype", w.alias("w"))


@query("cv_folds", oracle(f"{_DESIGN} SELECT phenotype, iid, fold FROM folded", "fx_trait", "fx_design"))
def cv_folds(spark, sf):
    return training.assign_folds(averaged(spark, sf).join(view(spark, sf, "fx_design"), "iid"), ["phenotype"]).select(
        "phenotype", "iid", "fold"
    )


_GRAM = f"""{_DESIGN},
full_x AS (SELECT phenotype, fold, iid, list_concat(list_concat([1e0], x), [y]) AS z FROM folded),
cells AS (SELECT phenotype, fold, iid, unnest(range(0, len(z))) AS i, unnest(z) AS v FROM full_x),
gram AS (SELECT a.phenotype, a.fold, a.i, b.i AS j, sum(a.v * b.v) AS value FROM cells a JOIN cells b
  ON a.phenotype = b.phenotype AND a.iid = b.iid AND a.i <= b.i GROUP BY ALL)"""


def fold_gram(spark, sf):
    return training.gram(training.assign_folds(design(spark, sf), ["phenotype"]), ["phenotype", "fold"])


@query(
    "gram_held_out",
    oracle(
        f"""{_GRAM} SELECT phenotype, fold, CAST(i AS INT) AS i, CAST(j AS INT) AS j,
round(sum(value) OVER (PARTITION BY phenotype, i, j) - value, 7) + 0.0e0 AS value FROM gram""",
        "fx_trait", "fx_design",
    ),
)
def gram_held_out(spark, sf):
    return training.held_out(fold_gram(spark, sf), ["phenotype"]).withColumn("value", r6("value", 7))


@query("cv_grs_metrics", oracle(
    f"""{_DESIGN}, {_WEIGHTS},
scored AS (SELECT f.phenotype, fold, iid, y, list_sum(list_transform(range(1, 65), lambda i: x[i] * w[i])) AS uni FROM folded f JOIN weights USING (phenotype)),
ranked AS (SELECT *, rank() OVER (PARTITION BY phenotype, fold ORDER BY y) + (count(*) OVER (PARTITION BY phenotype, fold, y) - 1) / 2.0e0 AS ry,
  rank() OVER (PARTITION BY phenotype, fold ORDER BY ru) + (count(*) OVER (PARTITION BY phenotype, fold, ru) - 1) / 2.0e0 AS rx
  FROM (SELECT *, round(uni, 9) AS ru FROM scored))
SELECT phenotype, fold, round(corr(y, uni), 6) + 0.0e0 AS uni_r, round(corr(y, uni) ** 2, 6) + 0.0e0 AS uni_r2,
  round(1 - avg((y - uni) ** 2) / var_pop(y), 6) + 0.0e0 AS uni_det, round(1 - var_pop(y - uni) / var_pop(y), 6) + 0.0e0 AS uni_evs,
  round(corr(ry, rx), 6) + 0.0e0 AS uni_sr FROM ranked GROUP BY phenotype, fold""",
    "fx_trait", "fx_design",
))
def cv_grs_metrics(spark, sf):
    folded = training.assign_folds(design(spark, sf), ["phenotype"])
    scored = folded.join(weights(spark, sf), "phenotype").withColumn("uni", F.round(E.dot("x", "w"), 9))
    out = scoring.score_metrics(scored.select("phenotype", "fold", "y", "uni"), ["phenotype", "fold"], "y", {"uni": "uni"})
    return out.select("phenotype", "fold", *[r6(c).alias(c) for c in out.columns if c.startswith("uni_")])


@query(
    "bayesian_ridge_check",
    oracle(
        f"{_DESIGN} SELECT DISTINCT phenotype, fold, CAST(0 AS BIGINT) AS violations FROM folded", "fx_trait", "fx_design"
    ),
)
def bayesian_ridge_check(spark, sf):
    """Per model, how many normal equations (X'X + lambda/alpha) w = X'y do not hold."""
    train = training.held_out(fold_gram(spark, sf), ["phenotype"])
    models = training.bayesian_ridge(train, ["phenotype", "fold"])
    keys = ["phenotype", "fold"]
    sums = train.where("i = 0").select(*keys, F.col("j").alias("k"), F.col("value").alias("s"))
    n = sums.where("k = 0").select(*keys, F.col("s").alias("n"))
    both = train.unionByName(train.where("i < j").select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    centred = (
        both.where("i > 0 AND j > 0").join(n, keys)
        .join(sums.select(*keys, F.col("k").alias("i"), F.col("s").alias("si")), [*keys, "i"])
        .join(sums.select(*keys, F.col("k").alias("j"), F.col("s").alias("sj")), [*keys, "j"])
        .select(*keys, "i", "j", (F.col("value") - F.col("si") * F.col("sj") / F.col("n")).alias("c"))
    )
    w = models.select(*keys, F.size("coef").alias("p"), F.col("alpha"), F.col("lambda"), F.col("coef"))
    rows = centred.join(w, keys).where("i <= p")
    term = F.when(F.col("j") <= F.col("p"), F.col("c") * F.get(F.col("coef"), F.col("j") - 1)).otherwise(-F.col("c"))
    ridge = F.when(F.col("i") == F.col("j"), F.col("lambda") / F.col("alpha") * F.get(F.col("coef"), F.col("i") - 1)).otherwise(0.0)
    gaps = rows.groupBy(*keys, "i").agg(F.sum(term + ridge).alias("gap"), F.max(F.abs("c")).alias("size"))
    bad = (F.abs("gap") > 1e-7 * (1 + F.col("size"))).cast("bigint")
    return gaps.groupBy(*keys).agg(F.sum(bad).alias("violations"))


@query("bayesian_ridge")
def bayesian_ridge(spark, sf):
    """Ridge models per trait and fold; checked against a direct solution in the tests."""
    train = training.held_out(fold_gram(spark, sf), ["phenotype"])
    out = training.bayesian_ridge(train, ["phenotype", "fold"])
    return out.select("phenotype", "fold", "n", "intercept", "alpha", "lambda", "n_iter", "coef")


_PRIOR = "2e-6"


def _one_variant_sql() -> str:
    """The evidence updates of a single variant are scalar, so a recursion runs them to the tolerance."""
    return f"""{_DESIGN},
one AS (SELECT phenotype, fold, iid, y, x[1] AS x1 FROM folded),
tr AS (SELECT k.phenotype, k.fold, CAST(count(*) AS DOUBLE) AS n, var_pop(x1) * count(*) AS s, covar_pop(x1, y) * count(*) AS d, var_pop(y) * count(*) AS yy,
  avg(x1) AS mx, avg(y) AS my FROM (SELECT DISTINCT phenotype, fold FROM one) k JOIN one f ON f.phenotype = k.phenotype AND f.fold <> k.fold GROUP BY ALL),
it AS (
  SELECT phenotype, fold, 0 AS step, CASE WHEN yy > 0 THEN n / yy ELSE 1.0e0 END AS alpha, 1.0e0 AS lam, CAST(NULL AS DOUBLE) AS w, false AS done FROM tr
  UNION ALL
  SELECT phenotype, fold, step + 1, (n - g + {_PRIOR}) / (greatest(yy - 2 * c * d + c * c * s, 0) + {_PRIOR}), (g + {_PRIOR}) / (c * c + {_PRIOR}), c,
    coalesce(step > 0 AND abs(w - c) < 1e-3, false)
  FROM (SELECT it.*, n, s, d, yy, d / (s + lam / alpha) AS c, alpha * s / (lam + alpha * s) AS g FROM it JOIN tr USING (phenotype, fold) WHERE NOT done AND step < 300)),
fin AS (SELECT phenotype, fold, max(step) AS steps, arg_max(alpha, step) AS alpha, arg_max(lam, step) AS lam FROM it GROUP BY ALL)
SELECT phenotype, fold, CAST(n AS BIGINT) AS n, round(d / (s + lam / alpha), 6) + 0.0e0 AS w, round(my - d / (s + lam / alpha) * mx, 6) + 0.0e0 AS intercept,
  round(ln(alpha), 5) + 0.0e0 AS log_alpha, round(ln(lam), 5) + 0.0e0 AS log_lambda, CAST(steps AS BIGINT) AS n_iter FROM fin JOIN tr USING (phenotype, fold)"""


@query("bayesian_ridge_one", oracle(_one_variant_sql(), "fx_trait", "fx_design").replace("WITH ", "WITH RECURSIVE ", 1))
def bayesian_ridge_one(spark, sf):
    """Ridge of the first variant alone."""
    one = training.assign_folds(design(spark, sf), ["phenotype"]).withColumn("x", F.slice("x", 1, 1))
    out = evaluation.fold_models(one)
    return out.select(
        "phenotype", "fold", "n", r6(F.get("coef", F.lit(0))).alias("w"), r6("intercept").alias("intercept"),
        r6(F.ln("alpha"), 5).alias("log_alpha"), r6(F.ln("lambda"), 5).alias("log_lambda"), "n_iter",
    )


@query("cross_validate")
def cross_validate(spark, sf):
    out = evaluation.cross_validate(design(spark, sf), weights(spark, sf))
    return out.drop("time")


@query("prior_search")
def prior_search(spark, sf):
    """Best priors per trait, trained without fold 1 and judged on it."""
    folds = fold_gram(spark, sf)
    first = F.col("fold") == 1
    train = training.held_out(folds, ["phenotype"]).where(first).drop("fold")
    tuned = training.tune_bayesian_ridge(train, folds.where(first).drop("fold"), ["phenotype"])
    return training.best_priors(tuned, ["phenotype"])


@query(
    "model_predict",
    oracle(
        f"""{_DESIGN}, {_WEIGHTS}
SELECT f.phenotype, iid, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * w[i])) + 0.25, 6) + 0.0e0 AS yhat FROM folded f JOIN weights USING (phenotype)""",
        "fx_trait", "fx_design",
    ),
)
def model_predict(spark, sf):
    models = weights(spark, sf).select("phenotype", F.col("w").alias("coef"), F.lit(0.25).alias("intercept"))
    out = scoring.predict(models, design(spark, sf), ["phenotype"])
    return out.select("phenotype", "iid", r6("yhat").alias("yhat"))


@query(
    "design_from_dosages",
    oracle(
        f"""{_EFFECTS}, {_TRAIT},
cells AS (SELECT c.phenotype, d.iid, c.rsid || '_' || c.row_id AS rsid, CASE WHEN counts_alt THEN alt_dosage ELSE 2 - alt_dosage END AS dosage
  FROM chosen c JOIN fx_dosage d USING (row_id)),
filled AS (SELECT *, coalesce(dosage, avg(dosage) OVER (PARTITION BY phenotype, rsid)) AS f FROM cells)
SELECT f.phenotype, f.iid, count(*) AS n_vars, round(sum(f.f), 4) + 0.0e0 AS x_sum, round(any_value(a.value), 4) + 0.0e0 AS y
FROM filled f JOIN avgd a ON a.iid = f.iid AND a.phenotype = 'click' GROUP BY f.phenotype, f.iid""",
        "fx_pvar", "fx_gwas", "fx_dosage", "fx_trait",
    ),
)
def design_from_dosages(spark, sf):
    variants = view(spark, sf, "fx_pvar")
    hits = qtl.select_trans_qtls(view(spark, sf, "fx_gwas"), variants, 0.001, ["row_no", "beta", "beta_se", "n_eff"])
    cells = joins.effect_dosage(view(spark, sf, "fx_dosage"), hits, variants)
    cells = cells.withColumn("rsid", F.concat_ws("_", "rsid", "row_id"))
    clicks = phenotypes.trait_values(averaged(spark, sf), "click").withColumnRenamed("value", "y")
    rows = training.design_rows(cells, _every_trait(cells, clicks), training.feature_index(cells))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rows.select("phenotype", "iid", F.size("x").cast("bigint").alias("n_vars"), r6(total, 4).alias("x_sum"), r6("y", 4).alias("y"))


@query(
    "dosage_export_all",
    oracle(
        f"""{_EFFECTS}
SELECT c.phenotype, d.iid, c.rsid || '_' || c.row_id AS rsid, round(CASE WHEN counts_alt THEN alt_dosage ELSE 2 - alt_dosage END, 6) + 0.0e0 AS dosage
FROM chosen c JOIN fx_dosage d USING (row_id)""",
        "fx_pvar", "fx_gwas", "fx_dosage",
    ),
)
def dosage_export_all(spark, sf):
    """Effect dosages of every trait and sample, written as one table and read back."""
    variants = view(spark, sf, "fx_pvar")
    hits = qtl.select_trans_qtls(view(spark, sf, "fx_gwas"), variants, 0.001, ["row_no", "beta", "beta_se", "n_eff"])
    cells = joins.effect_dosage(view(spark, sf, "fx_dosage"), hits, variants)
    path = work_path(spark, "dosages")
    writers.write_dosages(cells.select("phenotype", "iid", F.concat_ws("_", "rsid", "row_id").alias("rsid"), "dosage"), path)
    return readers.read_dosages(spark, path).withColumn("dosage", r6("dosage"))


@query(
    "written_metrics",
    ORACLES["cv_grs_metrics"],
)
def written_metrics(spark, sf):
    """Held-out fit written by fold, one append each, and read back."""
    path = work_path(spark, "metrics")
    fit = cut(cv_grs_metrics(spark, sf))
    for fold in range(1, training.FOLDS + 1):
        writers.write_metrics(fit.where(F.col("fold") == fold), path)
    return spark.read.parquet(path)


@query(
    "written_models",
    oracle(
        f"""{_DESIGN}, {_WEIGHTS}
SELECT f.phenotype, iid, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * w[i])) + 0.25, 6) + 0.0e0 AS yhat FROM folded f JOIN weights USING (phenotype)""",
        "fx_trait", "fx_design",
    ),
)
def written_models(spark, sf):
    """Models written, read back and applied."""
    path = work_path(spark, "models")
    writers.write_models(weights(spark, sf).select("phenotype", F.col("w").alias("coef"), F.lit(0.25).alias("intercept")), path)
    out = scoring.predict(spark.read.parquet(path), design(spark, sf), ["phenotype"])
    return out.select("phenotype", "iid", r6("yhat").alias("yhat"))


@query("written_phenotypes", ORACLES["trait_average"])
def written_phenotypes(spark, sf):
    path = work_path(spark, "phenotypes")
    writers.write_phenotypes(averaged(spark, sf), path)
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    return rows.select("phenotype", F.col("iid").cast("bigint").alias("iid"), r6(F.col("value").cast("double")).alias("value"))


def _every_trait(cells, values):
    """The same trait values for every phenotype that has dosages of a sample."""
    return cells.select("phenotype", "iid").distinct().join(values, "iid")
