"""Survival models and the phenome-wide scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.fixtures import oracle, view
from traitloom.operators import joins, survival
from traitloom.operators.regression import zscore
from traitloom.plans import phewas

_SURV = """
surv AS (SELECT *, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS x FROM fx_surv)"""

_AT_RISK = f"""{_SURV},
per_time AS (SELECT sex, censor_age, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2, count(*) FILTER (event = 1) AS d, sum(x) FILTER (event = 1) AS dx
  FROM surv GROUP BY sex, censor_age),
risk AS (SELECT sex, censor_age, d, dx, sum(n) OVER w AS n_risk, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2
  FROM per_time WINDOW w AS (PARTITION BY sex ORDER BY censor_age DESC))"""


def scaled_survival(spark, sf):
    rows = view(spark, sf, "fx_surv").withColumn("all", F.lit("all"))
    return zscore(rows, ["all"], ["score"]).withColumnRenamed("score", "x")


@query(
    "risk_set",
    oracle(f"{_AT_RISK} SELECT sex, censor_age, CAST(n_risk AS BIGINT) AS n_risk, round(s1, 4) + 0.0e0 AS s1, round(s2, 4) + 0.0e0 AS s2 FROM risk", "fx_surv"),
)
def risk_set(spark, sf):
    x = F.col("x")
    out = survival.risk_set(scaled_survival(spark, sf), ["sex"], "censor_age", {"n_risk": F.lit(1), "s1": x, "s2": x * x})
    return out.select("sex", "censor_age", "n_risk", r6("s1", 4).alias("s1"), r6("s2", 4).alias("s2"))


@query(
    "cox_score_test",
    oracle(
        f"""{_AT_RISK},
uv AS (SELECT sum(dx - d * s1 / n_risk) AS u, sum(d * (s2 / n_risk - (s1 / n_risk) ** 2)) AS v FROM risk WHERE d > 0)
SELECT 'all' AS phecode, round(u, 6) + 0.0e0 AS u, round(v, 4) + 0.0e0 AS v, round(u * u / v, 6) + 0.0e0 AS chisq FROM uv""",
        "fx_surv",
    ),
)
def cox_score_test(spark, sf):
    out = survival.cox_score_test(scaled_survival(spark, sf), ["all"], "censor_age", "event", "x", ["sex"])
    return out.select(F.col("all").alias("phecode"), r6("u").alias("u"), r6("v", 4).alias("v"), r6("chisq").alias("chisq"))


def _newton_sql(steps: int) -> str:
    """Newton steps with Efron ties, one chain of CTEs per step."""
    parts = [f"{_SURV}", "b0 AS (SELECT 0.0e0 AS b, 0.0e0 AS info)"]
    for k in range(steps):
        parts.append(f"""p{k} AS MATERIALIZED (SELECT sex, censor_age AS t, any_value(b) AS b, sum(exp(b*x)) AS s0, sum(x*exp(b*x)) AS s1, sum(x*x*exp(b*x)) AS s2,
  count(*) FILTER (event = 1) AS d, sum(x) FILTER (event = 1) AS dx, sum(exp(b*x)) FILTER (event = 1) AS e0,
  sum(x*exp(b*x)) FILTER (event = 1) AS e1, sum(x*x*exp(b*x)) FILTER (event = 1) AS e2 FROM surv, b{k} GROUP BY sex, censor_age),
c{k} AS MATERIALIZED (SELECT sex, t, b, d, dx, e0, e1, e2, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM p{k} WINDOW w AS (PARTITION BY sex ORDER BY t DESC)),
l{k} AS MATERIALIZED (SELECT b, dx / d AS g, s0 - l / d * e0 AS z0, s1 - l / d * e1 AS z1, s2 - l / d * e2 AS z2
  FROM (SELECT *, CAST(unnest(range(d)) AS DOUBLE) AS l FROM c{k} WHERE d > 0)),
b{k + 1} AS MATERIALIZED (SELECT any_value(b) + sum(g - z1 / z0) / sum(z2 / z0 - (z1 / z0) ** 2) AS b, sum(z2 / z0 - (z1 / z0) ** 2) AS info FROM l{k})""")
    parts.append(
        f"""SELECT 'all' AS phecode, round(exp(b), 6) + 0.0e0 AS hr, round(exp(b - {survival.Z975} / sqrt(info)), 6) + 0.0e0 AS hr_low,
round(exp(b + {survival.Z975} / sqrt(info)), 6) + 0.0e0 AS hr_high FROM b{steps}"""
    )
    return ",\n".join(parts[:-1]) + "\n" + parts[-1]


@query("cox_ph", oracle(_newton_sql(7), "fx_surv"))
def cox_ph(spark, sf):
    fits = survival.cox_ph(scaled_survival(spark, sf), ["all"], "censor_age", "event", ["x"], ["sex"])
    out = survival.hazard_ratios(fits, ["all"])
    return out.select(F.col("all").alias("phecode"), r6("hr").alias("hr"), r6("hr_low").alias("hr_low"), r6("hr_high").alias("hr_high"))


_SCAN = """
qc AS (SELECT sample_id, array_type, COLUMNS('PC.*') FROM fx_qc WHERE in_ancestry_subset = 1),
frame AS (SELECT s.platform, c.phecode, s.trait, s.iid, s.score, c.sex, c.event, c.time, qc.* FROM fx_scores s
  JOIN fx_phecode c ON s.iid = c.eid JOIN qc ON c.genid = qc.sample_id)"""


def scan_inputs(spark, sf):
    return view(spark, sf, "fx_scores"), view(spark, sf, "fx_phecode"), phewas.ancestry_subset(view(spark, sf, "fx_qc"))


@query(
    "ancestry_subset",
    oracle(
        "SELECT sample_id, array_type, round(PC1, 6) + 0.0e0 AS PC1 FROM fx_qc WHERE in_ancestry_subset = 1", "fx_qc"
    ),
)
def ancestry_subset(spark, sf):
    return phewas.ancestry_subset(view(spark, sf, "fx_qc")).select("sample_id", "array_type", r6("PC1").alias("PC1"))


@query(
    "assoc_frame",
    oracle(
        f"""{_SCAN} SELECT platform, phecode, trait, iid, sex, event, time, array_type, round(score, 6) + 0.0e0 AS score, round(PC10, 6) + 0.0e0 AS PC10 FROM frame""",
        "fx_qc", "fx_scores", "fx_phecode",
    ),
)
def assoc_frame(spark, sf):
    frame = joins.build_assoc_frame(*scan_inputs(spark, sf))
    cols = ["platform", "phecode", "trait", "iid", "sex", "event", "time", "array_type"]
    return frame.select(*cols, r6("score").alias("score"), r6("PC10").alias("PC10"))


@query(
    "assoc_prepare_check",
    oracle(f"{_SCAN} SELECT platform, phecode, trait, count(*) AS n, CAST(0 AS BIGINT) AS violations FROM frame GROUP BY ALL", "fx_qc", "fx_scores", "fx_phecode"),
)
def assoc_prepare_check(spark, sf):
    """Per model frame: score has mean 0 and variance 1 and is orthogonal to all components."""
    frame = joins.build_assoc_frame(*scan_inputs(spark, sf)).select(
        *phewas.KEYS, "sex", "event", "time", "array_type", "score", *phewas.COMPONENTS
    )
    model = phewas.prepare_assoc(frame)
    n = F.count(F.lit(1))
    bad = (F.abs(F.avg("score")) > 1e-9).cast("bigint") + (F.abs(F.var_pop("score") - 1) > 1e-9).cast("bigint")
    for c in phewas.COMPONENTS:
        bad = bad + (F.abs(F.sum(F.col("score") * F.col(c))) > 1e-6 * n).cast("bigint")
    return model.groupBy(*phewas.KEYS).agg(n.alias("n"), bad.alias("violations"))


# A prime larger than the order keys of the test tables, so no two samples share an age.
_AGE = "1 + (eid * 7919) % 1000003"


def _scan_sql(steps: int) -> str:
    """Newton steps of one score per platform, phecode and trait; ages are distinct, so there are no ties."""
    parts = [f"""
cohort AS (SELECT s.platform, c.phecode, s.trait, c.sex, c.event, {_AGE} AS age, s.score FROM fx_scores s
  JOIN fx_phecode c ON s.iid = c.eid JOIN fx_qc q ON c.genid = q.sample_id WHERE q.in_ancestry_subset = 1),
model AS MATERIALIZED (SELECT platform, phecode, trait, sex, event, age, (score - avg(score) OVER k) / stddev_pop(score) OVER k AS x
  FROM cohort WINDOW k AS (PARTITION BY platform, phecode, trait)),
b0 AS (SELECT DISTINCT platform, phecode, trait, 0.0e0 AS b, 0.0e0 AS info FROM model)"""]
    for k in range(steps):
        parts.append(f"""r{k} AS MATERIALIZED (SELECT platform, phecode, trait, b, event, x, sum(exp(b*x)) OVER w AS s0, sum(x*exp(b*x)) OVER w AS s1, sum(x*x*exp(b*x)) OVER w AS s2
  FROM model JOIN b{k} USING (platform, phecode, trait) WINDOW w AS (PARTITION BY platform, phecode, trait, sex ORDER BY age DESC)),
b{k + 1} AS MATERIALIZED (SELECT platform, phecode, trait, any_value(b) + sum(x - s1 / s0) / sum(s2 / s0 - (s1 / s0) ** 2) AS b,
  sum(s2 / s0 - (s1 / s0) ** 2) AS info FROM r{k} WHERE event = 1 GROUP BY ALL)""")
    low, high = (f"round(exp(b {sign} {survival.Z975} / sqrt(info)), 6) + 0.0e0" for sign in "-+")
    parts.append(f"SELECT platform, phecode, trait, round(exp(b), 6) + 0.0e0 AS hr, {low} AS hr_low, {high} AS hr_high, true AS converged FROM b{steps}")
    return ",\n".join(parts[:-1]) + "\n" + parts[-1]


@query("phewas_score_only", oracle(_scan_sql(7), "fx_qc", "fx_scores", "fx_phecode"))
def phewas_score_only(spark, sf):
    """The scan without components and array types, over as many ages as samples."""
    scores, surv, qc = scan_inputs(spark, sf)
    aged = surv.withColumn("time", F.expr(_AGE))
    out = phewas.phewas(scores, aged, qc.withColumn("array_type", F.lit("one")), components=[])
    return out.select(*phewas.KEYS, *[r6(c).alias(c) for c in ("hr", "hr_low", "hr_high")], "converged")


@query("phewas")
def phewas_scan(spark, sf):
    """Hazard ratios of every platform, phecode and trait; checked in the tests."""
    return phewas.rank_associations(phewas.phewas(*scan_inputs(spark, sf)))


@query(
    "strongest_associations",
    oracle(
        """agg AS (SELECT phenotype, chr, pos, min(pval) AS pvalue FROM fx_gwas GROUP BY ALL)
SELECT phenotype, chr, pos, round(pvalue, 12) + 0.0e0 AS pvalue FROM agg ORDER BY agg.pvalue NULLS LAST, phenotype, chr, pos LIMIT 25""",
        "fx_pvar", "fx_gwas",
    ),
)
def strongest_associations(spark, sf):
    """Top of an association table by p-value."""
    best = view(spark, sf, "fx_gwas").groupBy("phenotype", "chr", "pos").agg(F.min("pval").alias("pvalue"))
    return phewas.rank_associations(best, 25, ["phenotype", "chr", "pos"]).withColumn("pvalue", r6("pvalue", 12))
