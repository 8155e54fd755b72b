"""Joins, filters, names and reshaping on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.fixtures import oracle, view
from traitloom.functions import expressions as E
from traitloom.functions import names
from traitloom.operators import aggregates as A
from traitloom.operators import joins, scoring
from traitloom.plans import phenotypes, qtl
from traitloom.sources import writers


@query(
    "update_join",
    oracle(
        """
last AS (SELECT phenotype, iid, max(event_id) AS k FROM fx_trait GROUP BY phenotype, iid),
new AS (SELECT t.phenotype, t.iid, t.variable, t.value FROM fx_trait t JOIN last ON t.phenotype = last.phenotype AND t.event_id = last.k)
SELECT s.s_suppkey AS iid, p.phenotype, CASE WHEN n.iid IS NULL THEN 'none' ELSE n.variable END AS variable, round(n.value, 6) + 0.0e0 AS value
FROM supplier s, (SELECT DISTINCT phenotype FROM fx_trait) p LEFT JOIN new n ON n.iid = s.s_suppkey AND n.phenotype = p.phenotype""",
        "fx_trait",
    ),
)
def update_join(spark, sf):
    traits = view(spark, sf, "fx_trait")
    names_of = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    base = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").alias("iid"), F.explode(names_of).alias("phenotype"), F.lit("none").alias("variable")
    )
    out = joins.update_join(base, traits, ["phenotype", "iid"], ["variable", "value"], ["event_id"])
    return out.withColumn("value", r6("value"))


@query(
    "samples_keep_remove",
    oracle(
        """
late AS (SELECT DISTINCT iid FROM fx_trait WHERE batch >= 2)
SELECT 'keep' AS side, event_id, iid FROM fx_trait WHERE iid IN (SELECT iid FROM late)
UNION ALL SELECT 'remove', event_id, iid FROM fx_trait WHERE iid NOT IN (SELECT iid FROM late)""",
        "fx_trait",
    ),
)
def samples_keep_remove(spark, sf):
    t = view(spark, sf, "fx_trait")
    late = t.where("batch >= 2").select("iid")
    rows = t.select("event_id", "iid")
    kept = joins.keep_samples(rows, late, ["iid"]).select(F.lit("keep").alias("side"), "event_id", "iid")
    gone = joins.remove_samples(rows, late, ["iid"]).select(F.lit("remove").alias("side"), "event_id", "iid")
    return joins.union_all([kept, gone])


@query(
    "extract_variants",
    oracle(
        "SELECT row_id, id FROM fx_pvar v WHERE EXISTS (SELECT 1 FROM fx_gwas g WHERE g.chr = v.chr AND g.pos = v.pos AND g.pval < 1e-6)",
        "fx_pvar", "fx_gwas",
    ),
)
def extract_variants(spark, sf):
    hits = qtl.filter_pvalue(view(spark, sf, "fx_gwas"), 1e-6).select("chr", "pos")
    return joins.extract_variants(view(spark, sf, "fx_pvar"), hits, ["chr", "pos"]).select("row_id", "id")


@query(
    "right_join",
    oracle(
        "SELECT l.phenotype, l.tss, count(g.row_no) AS n FROM fx_gwas g RIGHT JOIN fx_loc l ON g.phenotype = l.phenotype AND g.pval < 1e-7 GROUP BY ALL",
        "fx_pvar", "fx_gwas", "fx_loc",
    ),
)
def right_join(spark, sf):
    hits = qtl.filter_pvalue(view(spark, sf, "fx_gwas"), 1e-7).select("phenotype", "row_no")
    joined = joins.right_join(hits, view(spark, sf, "fx_loc").select("phenotype", "tss"), ["phenotype"])
    return joined.groupBy("phenotype", "tss").agg(F.count("row_no").alias("n"))


@query(
    "covariate_join",
    oracle(
        "SELECT event_id, t.iid, round(PC_1, 6) + 0.0e0 AS pc_1, round(PC_10, 6) + 0.0e0 AS pc_10 FROM fx_trait t JOIN fx_pc p ON p.iid = t.iid",
        "fx_trait", "fx_pc",
    ),
)
def covariate_join(spark, sf):
    out = joins.with_covariates(view(spark, sf, "fx_trait"), view(spark, sf, "fx_pc"))
    return out.select("event_id", "iid", r6("PC_1").alias("pc_1"), r6("PC_10").alias("pc_10"))


@query(
    "align_samples",
    oracle(
        """
avgd AS (SELECT phenotype, iid, avg(value) AS value FROM fx_trait WHERE value IS NOT NULL GROUP BY phenotype, iid)
SELECT s_suppkey AS iid, phenotype, round(value, 6) + 0.0e0 AS value FROM supplier JOIN avgd ON iid = s_suppkey""",
        "fx_trait",
    ),
)
def align_samples(spark, sf):
    wanted = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("iid"))
    return joins.align(phenotypes.average_traits(view(spark, sf, "fx_trait")), wanted, ["iid"]).withColumn("value", r6("value"))


_GENES = """
info AS (SELECT 'T' || n_nationkey AS phenotype, 'U' || n_nationkey || CASE WHEN n_nationkey % 3 = 0 THEN ';U' || (n_nationkey + 1)
  WHEN n_nationkey % 3 = 1 THEN '.X' || n_nationkey ELSE '' END AS uniprot FROM nation),
up AS (SELECT 'U' || n_nationkey AS uniprot, CASE WHEN n_nationkey % 7 = 3 THEN 'none' ELSE CAST(s_suppkey AS VARCHAR) END AS entrez
  FROM nation JOIN supplier ON s_nationkey = n_nationkey),
loc AS (SELECT s_suppkey AS entrez, CASE WHEN s_suppkey % 11 = 5 THEN 'HG_1' ELSE CAST(s_nationkey AS VARCHAR) END AS chr, s_suppkey * 1000 + 17 AS start FROM supplier)"""


@query(
    "gene_locations",
    oracle(
        f"""{_GENES},
members AS (SELECT phenotype, ord, u AS uniprot FROM (SELECT phenotype, unnest(regexp_split_to_array(uniprot, '[.;]')) AS u,
  unnest(range(len(regexp_split_to_array(uniprot, '[.;]')))) AS ord FROM info)),
places AS (SELECT up.uniprot, e AS entrez, CAST(loc.chr AS VARCHAR) AS chr, CAST(start AS VARCHAR) AS start
  FROM (SELECT uniprot, try_cast(entrez AS INT) AS e FROM up) up JOIN loc ON loc.entrez = e WHERE chr NOT LIKE '%\\_%' ESCAPE '\\'),
last AS (SELECT uniprot, arg_max(chr, entrez) AS chr, arg_max(start, entrez) AS start FROM places GROUP BY uniprot),
found AS (SELECT m.phenotype, m.ord, CASE WHEN m.uniprot = 'U5' THEN '9' ELSE l.chr END AS chr, CASE WHEN m.uniprot = 'U5' THEN '4242' ELSE l.start END AS start
  FROM members m LEFT JOIN last l USING (uniprot))
SELECT phenotype, string_agg(chr, '|' ORDER BY ord) AS chr, string_agg(start, '|' ORDER BY ord) AS tss FROM found WHERE chr IS NOT NULL GROUP BY phenotype""",
    ),
)
def gene_locations(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    supplier = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("n_nationkey")
    own = F.concat(F.lit("U"), k)
    second = F.when(k % 3 == 0, F.concat(F.lit(";U"), k + 1)).when(k % 3 == 1, F.concat(F.lit(".X"), k)).otherwise("")
    info = nation.select(F.concat(F.lit("T"), k).alias("phenotype"), F.concat(own, second).alias("uniprot"))
    entrez = F.when(k % 7 == 3, "none").otherwise(F.col("s_suppkey").cast("string"))
    genes = nation.join(supplier, k == F.col("s_nationkey")).select(own.alias("uniprot"), entrez.alias("entrez"))
    s = F.col("s_suppkey")
    places = supplier.select(
        s.cast("int").alias("entrez"),
        F.when(s % 11 == 5, "HG_1").otherwise(F.col("s_nationkey").cast("string")).alias("chr"),
        (s * 1000 + 17).alias("start"),
    )
    overrides = spark.createDataFrame([("U5", "9", "4242")], "uniprot string, chr string, start string")
    return joins.locate_genes(info, genes, places, overrides)


@query(
    "union_with_source",
    oracle(
        """SELECT 'early' AS platform, phenotype, iid, count(*) AS n FROM fx_trait WHERE batch < 2 GROUP BY ALL
UNION ALL SELECT 'late', phenotype, iid, count(*) FROM fx_trait WHERE batch >= 2 GROUP BY ALL""",
        "fx_trait",
    ),
)
def union_with_source(spark, sf):
    t = view(spark, sf, "fx_trait")
    labelled = joins.union_with_source({"early": t.where("batch < 2"), "late": t.where("batch >= 2")})
    return labelled.groupBy("platform", "phenotype", "iid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "arg_best",
    oracle(
        """SELECT phenotype, iid, event_id, round(value, 6) + 0.0e0 AS value, rank FROM (
  SELECT *, 'max' AS rank, row_number() OVER (PARTITION BY phenotype, iid ORDER BY value DESC, event_id) AS rn FROM fx_trait WHERE value IS NOT NULL
  UNION ALL SELECT *, 'min', row_number() OVER (PARTITION BY phenotype, iid ORDER BY value, event_id) FROM fx_trait WHERE value IS NOT NULL)
WHERE rn = 1""",
        "fx_trait",
    ),
)
def arg_best(spark, sf):
    t = view(spark, sf, "fx_trait")
    parts = [
        A.arg_best(t, ["phenotype", "iid"], "value", how, ["event_id"]).withColumn("rank", F.lit(how)) for how in ("max", "min")
    ]
    return joins.union_all(parts).select("phenotype", "iid", "event_id", r6("value").alias("value"), "rank")


@query(
    "collapse",
    oracle(
        """SELECT phenotype, iid, string_agg(variable, ',' ORDER BY event_id) AS variables,
array_to_string(list_sort(list(DISTINCT variable)), '/') AS distinct_variables FROM fx_trait GROUP BY phenotype, iid""",
        "fx_trait",
    ),
)
def collapse(spark, sf):
    t = view(spark, sf, "fx_trait")
    keys = ["phenotype", "iid"]
    all_of = A.collapse(t, keys, "variable", ",", ["event_id"]).withColumnRenamed("variable", "variables")
    once = A.collapse(t, keys, "variable", "/", distinct=True).withColumnRenamed("variable", "distinct_variables")
    return all_of.join(once, keys)


@query(
    "paired_lists",
    oracle(
        """
sheet AS (SELECT phenotype, string_agg(variable, ',' ORDER BY variable) AS aptamer, string_agg(replace(variable, '_p', '-'), ',' ORDER BY variable) AS seq_id
  FROM (SELECT DISTINCT phenotype, variable FROM fx_trait) GROUP BY phenotype)
SELECT phenotype, unnest(string_split(seq_id, ',')) AS seq_id, unnest(string_split(aptamer, ',')) AS aptamer FROM sheet""",
        "fx_trait",
    ),
)
def paired_lists(spark, sf):
    t = view(spark, sf, "fx_trait").select("phenotype", "variable").distinct()
    sheet = t.groupBy("phenotype").agg(F.array_join(F.sort_array(F.collect_set("variable")), ",").alias("aptamer"))
    sheet = sheet.withColumn("seq_id", F.regexp_replace("aptamer", "_p", "-"))
    return phenotypes.paired_lists(sheet, ["phenotype"], ["seq_id", "aptamer"])


@query(
    "parse_markers",
    oracle(
        r"""
m AS (SELECT row_no, CASE WHEN row_no % 13 = 0 THEN 'X' ELSE CAST(chr AS VARCHAR) END AS c, pos, lower(effect_allele) AS ea FROM fx_gwas)
SELECT row_no, try_cast(c AS INT) AS chr, try_cast(c AS INT) AS marker_chr, CAST(pos AS INT) AS marker_pos, upper(ea) AS effect_allele FROM m""",
        "fx_pvar", "fx_gwas",
    ),
)
def parse_markers(spark, sf):
    c = F.when(F.col("row_no") % 13 == 0, "X").otherwise(F.col("chr").cast("string"))
    gwas = view(spark, sf, "fx_gwas")
    pos = dict(gwas.dtypes)["pos"]
    m = gwas.select(
        "row_no", F.concat(F.lit("chr"), c).alias("chrom"),
        F.concat(F.lit("chr"), c, F.lit(":"), "pos", F.lit(":A:C")).alias("marker"), F.lower("effect_allele").alias("ea"),
    )
    return m.select(
        "row_no", E.normalise_chr("chrom").alias("chr"), E.marker_chr("marker").alias("marker_chr"),
        E.marker_pos("marker", pos).alias("marker_pos"), F.upper("ea").alias("effect_allele"),
    )


@query(
    "drop_missing",
    oracle("SELECT event_id, round(value, 6) + 0.0e0 AS value FROM fx_trait WHERE value IS NOT NULL", "fx_trait"),
)
def drop_missing(spark, sf):
    t = view(spark, sf, "fx_trait").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return qtl.drop_missing(t, "value").select("event_id", r6("value").alias("value"))


@query(
    "clean_names",
    oracle(
        r"""SELECT DISTINCT variable, replace(variable, '_', '.pct') AS percent, regexp_replace(variable, '^p', 'P') AS initial,
  regexp_replace(replace(replace(lower('INF1' || variable || '--A.B'), '.', ''), '--', ''), '^inf1', 'inf') AS panel,
  'SeqId_' || replace(replace(variable, '_', '-'), '-', '_') AS seq FROM fx_trait""",
        "fx_trait",
    ),
)
def clean_names(spark, sf):
    v = view(spark, sf, "fx_trait").select("variable").distinct().select(
        "variable", F.concat(F.lit("INF1"), "variable", F.lit("--A.B")).alias("raw"), F.regexp_replace("variable", "_", "-").alias("dashed")
    )
    return v.select(
        "variable", names.percent_name("variable").alias("percent"), E.clean_name("variable", [("^p", "P")]).alias("initial"),
        names.panel_match_name("raw").alias("panel"), names.aptamer_phenotype("dashed").alias("seq"),
    )


@query(
    "rename_cascade",
    oracle(
        """SELECT event_id, CASE WHEN phenotype = 'click' THEN 'seen' WHEN phenotype = 'view' THEN 'seen'
WHEN phenotype = 'error' THEN variable ELSE phenotype END AS name FROM fx_trait""",
        "fx_trait",
    ),
)
def rename_cascade(spark, sf):
    """Later rules see earlier results: click becomes view, then view becomes seen."""
    rules = [("name", "click", "view"), ("name", "view", "seen"), ("phenotype", "error", lambda: F.col("variable"))]
    t = view(spark, sf, "fx_trait").withColumn("name", F.col("phenotype"))
    return E.rename_by_rules(t, "name", rules).select("event_id", "name")


@query(
    "select_rename",
    oracle("SELECT event_id AS idno, CASE WHEN value > 10 THEN 1 ELSE 0 END AS event, phenotype AS trait FROM fx_trait WHERE phenotype = 'click'", "fx_trait"),
)
def select_rename(spark, sf):
    flag = F.when(F.col("value") > 10, 1).otherwise(0)
    return E.select_rename(view(spark, sf, "fx_trait"), F.col("phenotype") == "click", {"idno": "event_id", "event": flag, "trait": "phenotype"})


@query("trait_list", oracle("SELECT DISTINCT phenotype FROM fx_trait", "fx_trait"))
def trait_list(spark, sf):
    return phenotypes.trait_list(view(spark, sf, "fx_trait"))


@query(
    "pending_traits",
    oracle(
        """SELECT DISTINCT phenotype FROM fx_gwas WHERE phenotype NOT IN (SELECT phenotype FROM fx_gwas WHERE pval < 1e-9)""",
        "fx_pvar", "fx_gwas",
    ),
)
def pending_traits(spark, sf):
    gwas = view(spark, sf, "fx_gwas")
    return writers.pending_keys(gwas.select("phenotype").distinct(), qtl.filter_pvalue(gwas, 1e-9))


@query(
    "score_metrics",
    oracle(
        """
j AS (SELECT phenotype, value AS y, CAST(event_id % 50 AS DOUBLE) AS yhat FROM fx_trait WHERE value IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY phenotype ORDER BY y) + (count(*) OVER (PARTITION BY phenotype, y) - 1) / 2.0e0 AS ry,
  rank() OVER (PARTITION BY phenotype ORDER BY yhat) + (count(*) OVER (PARTITION BY phenotype, yhat) - 1) / 2.0e0 AS rx FROM j)
SELECT phenotype, round(corr(y, yhat), 6) + 0.0e0 AS m_r, round(corr(y, yhat) ** 2, 6) + 0.0e0 AS m_r2, round(1 - avg((y - yhat) ** 2) / var_pop(y), 6) + 0.0e0 AS m_det,
  round(1 - var_pop(y - yhat) / var_pop(y), 6) + 0.0e0 AS m_evs, round(corr(ry, rx), 6) + 0.0e0 AS m_sr FROM ranked GROUP BY phenotype""",
        "fx_trait",
    ),
)
def score_metrics(spark, sf):
    t = view(spark, sf, "fx_trait").where("value IS NOT NULL").select(
        "phenotype", F.col("value").alias("y"), (F.col("event_id") % 50).cast("double").alias("yhat")
    )
    out = scoring.score_metrics(t, ["phenotype"], "y", {"m": "yhat"})
    return out.select("phenotype", *[r6(f"m_{c}").alias(f"m_{c}") for c in ("r", "r2", "det", "evs", "sr")])
