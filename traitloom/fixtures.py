"""Genetics-shaped views derived from the test tables, as SQL that Spark and DuckDB share.

``{part}`` and the like stand for a base table: a Parquet path for Spark, a view name for
DuckDB. Only the genotype and the component views differ in spelling between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from traitloom.session import task_count

BASE = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

# Size of the genotyped panel: every variant of ``part`` has this many samples, so the
# genotype table grows with ``part`` alone. Sample ids are 0 .. PANEL - 1.
PANEL = 100

_U = """({iid} * 31 + CAST(floor({row} / 20) AS BIGINT) * 17 + ({row} % 5) * 7
   + CASE WHEN ({iid} * 7 + {row} * 13) % 11 = 0 THEN 40 ELSE 0 END) % 97"""
_DOSE = """CASE WHEN ({iid} * 3 + {row} * 5) % 101 = 0 THEN CAST({missing} AS {type})
     WHEN {row} % 61 = 0 THEN CAST(0 AS {type})
     ELSE CAST(CASE WHEN {u} < 55 THEN 0 WHEN {u} < 85 THEN 1 ELSE 2 END AS {type}) END"""


def _dose(iid: str, row: str, missing: str, dtype: str) -> str:
    u = _U.format(iid=iid, row=row)
    return _DOSE.format(iid=iid, row=row, u=u, missing=missing, type=dtype)


SHARED = {
    "fx_pvar": """
SELECT CAST(k % 5 + 1 AS INT) AS chr, CAST(1000000 + pb * 7919 + CASE WHEN idx % 50 = 13 THEN 3000 ELSE 0 END AS {pos}) AS pos,
       CASE WHEN idx % 9 = 0 OR idx % 72 = 28 THEN '.'
            WHEN idx % 50 IN (13, 23) THEN 'rs' || CAST(k - 5 AS STRING)
            ELSE 'rs' || CAST(k AS STRING) END AS id,
       CASE WHEN idx % 40 = 7 THEN alt0 ELSE ref0 END AS ref,
       CASE WHEN idx % 40 = 7 THEN ref0 WHEN idx % 33 = 5 THEN alt0 || 'A' ELSE alt0 END AS alt,
       k AS row_id
FROM (SELECT k, idx, pb, substr('ACGT', CAST(ab % 4 + 1 AS INT), 1) AS ref0,
             substr('ACGT', CAST((ab % 4 + 1 + CAST(floor(ab / 4) AS BIGINT) % 3) % 4 + 1 AS INT), 1) AS alt0
      FROM (SELECT k, idx, CASE WHEN idx % 40 = 7 OR idx % 72 = 28 THEN idx - 1 ELSE idx END AS pb,
                   CASE WHEN idx % 40 = 7 OR idx % 50 = 13 THEN idx - 1 ELSE idx END AS ab
            FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 5) AS BIGINT) AS idx FROM {part})))""",
    "fx_snpstats": """
SELECT chr AS chromosome, pos AS position,
       CASE WHEN row_id % 83 = 0 OR CAST(floor(row_id / 5) AS BIGINT) % 280 IN (6, 7) THEN 'N'
            WHEN row_id % 2 = 0 THEN ref ELSE alt END AS A_allele,
       CASE WHEN row_id % 2 = 0 THEN alt ELSE ref END AS B_allele,
       CAST((row_id * 37) % 101 AS DOUBLE) / 100 AS information, row_id
FROM fx_pvar""",
    "fx_gwas": """
SELECT {merge}'SeqId_' || CAST(l_suppkey % 20 AS STRING) AS phenotype, v.chr, v.pos,
       CASE WHEN l_orderkey % 2 = 0 THEN v.alt ELSE v.ref END AS effect_allele,
       CASE WHEN l_orderkey % 2 = 0 THEN v.ref ELSE v.alt END AS other_allele,
       l_discount - 0.05 AS beta, 0.01 + l_tax / 10 AS beta_se, CAST(1000 + l_quantity * 10 AS DOUBLE) AS n_eff,
       (CAST((l_orderkey * 7919 + l_linenumber * 104729) % 100003 AS DOUBLE) + 1) / 100004
         / CASE WHEN l_quantity > 45 THEN 1000000 ELSE 1 END AS pval,
       'panel' || CAST(CAST(floor(l_suppkey / 20) AS BIGINT) % 2 AS STRING) AS measure_id,
       (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey AS row_no
FROM {lineitem} JOIN fx_pvar v ON v.row_id = l_partkey""",
    "fx_trait": """
SELECT event_type AS phenotype, user_id AS iid, event_type || '_p' || CAST(event_id % 2 AS STRING) AS variable,
       CASE WHEN event_id % 97 = 0 THEN CAST(NULL AS DOUBLE) ELSE value END AS value,
       CAST(user_id % 4 AS INT) AS batch, event_id
FROM {events}""",
    "fx_surv": """
SELECT o_orderkey AS eid, o_custkey AS genid,
       CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event,
       CAST(1 + (o_orderkey * 7 + o_custkey) % 60 AS DOUBLE) AS censor_age,
       o_orderpriority AS array_type, o_totalprice AS score
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    # Three diseases from the order status; the last one occurs in one sex only.
    "fx_phecode": """
SELECT phecode, eid, genid, CASE WHEN nation % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
       CASE WHEN status = phecode THEN 1 ELSE 0 END AS event, CAST(1 + (eid * 7 + genid) % 60 AS DOUBLE) AS time
FROM (SELECT {explode}('F', 'O', 'P'{end}) AS phecode, o_orderkey AS eid, o_custkey AS genid, c_nationkey AS nation, o_orderstatus AS status
      FROM {orders} JOIN {customer} ON c_custkey = o_custkey)
WHERE phecode <> 'P' OR nation % 2 = 1""",
    "fx_scores": """
SELECT CASE WHEN trait = 'price' THEN 'Panel' ELSE 'Array' END AS platform, trait, iid,
       CASE WHEN trait = 'price' THEN price ELSE CAST((iid * 13 + cust * 7) % 1009 AS DOUBLE) + price / 1000 END AS score
FROM (SELECT {explode}('price', 'mixed'{end}) AS trait, o_orderkey AS iid, o_custkey AS cust, o_totalprice AS price FROM {orders})""",
    # A protein panel: three panels, several measures a protein, lists of proteins, proteins without an id.
    "fx_panel": """
SELECT k, panel, g, panel || '_a' || CAST(k AS STRING) || '___q' || CAST(g AS STRING) AS variable,
       CASE WHEN g % 9 = 0 OR g = 195 THEN '' WHEN g = 7 THEN 'Q8WWJ7' WHEN g % 5 = 1 THEN 'Q' || CAST(g AS STRING) || ';Q' || CAST(g + 1 AS STRING)
            ELSE 'Q' || CAST(g AS STRING) END AS uniprot,
       'OID' || lpad(CAST(g AS STRING), 5, '0') AS olink_id, 'prot' || CAST(g % 2 + k % 2 AS STRING) AS protein,
       CASE WHEN panel = 'inf' THEN 'INF1' ELSE upper(panel) END || '_A.' || CAST(k AS STRING) || '___Q' || CAST(g AS STRING) AS measure, size
FROM (SELECT p_partkey AS k, p_partkey % 400 AS g, CASE p_partkey % 3 WHEN 0 THEN 'inf' WHEN 1 THEN 'cvd2' ELSE 'neu' END AS panel, p_size AS size FROM {part})""",
    "fx_aptamer": """
SELECT CASE WHEN k % 10 = 0 THEN 'Control' ELSE 'Protein' END AS Type, CAST(floor(k / 2) AS BIGINT) || '-' || k % 3 AS SeqId,
       CASE k % 6 WHEN 0 THEN 'VEGFA' WHEN 1 THEN 'CGA' WHEN 2 THEN 'F2' WHEN 3 THEN 'CKB' WHEN 4 THEN 'POMC' ELSE 'GENE' || CAST(k AS STRING) END || '.' || k AS SOMAMER_ID,
       'v' || k AS variable,
       CASE k % 7 WHEN 0 THEN 'Luteinizing hormone' WHEN 1 THEN 'MPIF-1' WHEN 2 THEN '14-3-3' WHEN 3 THEN 'SEM6C' ELSE 'Target-' || k END AS Target,
       'Full-name-' || k AS TargetFullName, 'U' || k AS UniProt, 'G' || k % 50 AS Gene,
       CAST(k % 22 + 1 AS STRING) AS chr, CAST(k * 100 AS STRING) AS tss, size
FROM (SELECT p_partkey AS k, p_size AS size FROM {part})""",
    "fx_measured": """
SELECT l_partkey AS k, l_suppkey AS iid, CASE WHEN l_linenumber = 7 THEN CAST(NULL AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS value FROM {lineitem}""",
    "fx_loc": """
SELECT 'SeqId_' || CAST(n_nationkey AS STRING) AS phenotype,
       CAST(n_nationkey % 5 + 1 AS STRING) || '|' || CAST((n_nationkey + 2) % 5 + 1 AS STRING) AS chr,
       CAST(1000000 + n_nationkey * 40000 AS STRING) || '|' || CAST(1100000 + n_nationkey * 30000 AS STRING) AS tss
FROM {nation}""",
    "fx_region": """
SELECT CAST(region_chr AS INT) AS region_chr, CAST(region_start AS INT) AS region_start, CAST(region_end AS INT) AS region_end, region_name
FROM (VALUES (1, 100000, 700000, 'r1'), (2, 2200000, 2900000, 'r2'), (3, 1500000, 1600000, 'r3'))
  AS t(region_chr, region_start, region_end, region_name)""",
    "fx_gmap": """
SELECT CAST(n_nationkey % 5 + 1 AS INT) AS chr, CAST(1000000 + floor(n_nationkey / 5) * 900000 AS INT) AS pos,
       CAST(floor(n_nationkey / 5) AS DOUBLE) * 1.25 + (n_nationkey % 5) * 0.5e0 AS cm
FROM {nation}""",
    "fx_chain": """
SELECT label AS trait, CAST(vec_id AS INT) AS chain, embedding AS corr_est
FROM {embeddings}""",
}

# A file of keys is small, so few tasks would read it and make all genotypes: the keys are dealt out first.
_DEALT = "(SELECT /*+ REPARTITION({tasks}) */ p_partkey AS row_id FROM {part})"

SPARK_ONLY = {
    "fx_dosage": f"""
SELECT iid, row_id, {_dose('iid', 'row_id', 'NULL', 'DOUBLE')} AS alt_dosage
FROM (SELECT explode(sequence(0L, {PANEL - 1}L)) AS iid, row_id FROM {_DEALT})""",
    "fx_packed": f"""
SELECT row_id, 0 AS sample_block,
       transform(sequence(0L, {PANEL - 1}L), s -> {_dose('s', 'row_id', "'NaN'", 'FLOAT')}) AS doses
FROM {_DEALT}""",
    "fx_pc": "SELECT vec_id AS iid, "
    + ", ".join(f"CAST(element_at(embedding, {i}) AS DOUBLE) AS PC_{i}" for i in range(1, 11))
    + " FROM {embeddings}",
    "fx_qc": "SELECT c_custkey AS sample_id, c_mktsegment AS array_type, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS in_ancestry_subset, "
    + ", ".join(f"CAST(element_at(embedding, {i}) AS DOUBLE) AS PC{i}" for i in range(1, 11))
    + " FROM {customer} JOIN {embeddings} ON vec_id = c_custkey % {vectors}",
    # Sample-major genotypes: 64 variants per sample, so this one grows with the samples.
    "fx_design": """
SELECT vec_id AS iid, transform(embedding, e -> CAST(CASE WHEN e < -0.05 THEN 0 WHEN e < 0.08 THEN 1 ELSE 2 END AS DOUBLE)) AS x
FROM {embeddings}""",
}

DUCK_ONLY = {
    "fx_dosage": f"""
SELECT iid, row_id, {_dose('iid', 'row_id', 'NULL', 'DOUBLE')} AS alt_dosage
FROM (SELECT CAST(unnest(range({PANEL})) AS BIGINT) AS iid, p_partkey AS row_id FROM {{part}})""",
    "fx_pc": "SELECT vec_id AS iid, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS PC_{i}" for i in range(1, 11))
    + " FROM {embeddings}",
    "fx_qc": "SELECT c_custkey AS sample_id, c_mktsegment AS array_type, CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS in_ancestry_subset, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS PC{i}" for i in range(1, 11))
    + " FROM {customer} JOIN {embeddings} ON vec_id = c_custkey % {vectors}",
    "fx_design": """
SELECT vec_id AS iid, [CAST(CASE WHEN e < -0.05 THEN 0 WHEN e < 0.08 THEN 1 ELSE 2 END AS DOUBLE) FOR e IN embedding] AS x
FROM {embeddings}""",
}

_NEEDS = {"fx_snpstats": ("fx_pvar",), "fx_gwas": ("fx_pvar",)}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in (*_NEEDS.get(name, ()), name):
            if dep not in out:
                out.append(dep)
    return out


def _ctes(names: list[str], texts: dict[str, str], tables: dict[str, str]) -> str:
    return ",\n".join(f"{n} AS ({texts[n].format(**tables)})" for n in names)


# Position type of each session's tables, by the path of ``part``.
_position_types: dict[tuple[str, str], str] = {}


def _position_type(spark: SparkSession, part: str) -> str:
    """INT, as in the SQL, while every position fits; positions grow with the keys, so many variants need BIGINT."""
    key = (spark.sparkContext.applicationId, part)
    if key not in _position_types:
        last = spark.sql(f"SELECT max(pos) FROM ({SHARED['fx_pvar'].format(part=part, pos='BIGINT')})").first()[0]
        _position_types[key] = "INT" if last is None or last < 1 << 31 else "BIGINT"
    return _position_types[key]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame over the Parquet tables in ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in BASE}
    # A part file is small for the variants made of its keys: they are sorted and merged, never broadcast.
    tables |= {"explode": "explode(array", "end": ")", "tasks": str(task_count(spark)), "merge": "/*+ MERGE(v) */ "}
    if name == "fx_qc":
        tables["vectors"] = str(max(1, spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").count()))
    texts, needed = {**SHARED, **SPARK_ONLY}, _closure((name,))
    if "fx_pvar" in needed:
        tables["pos"] = _position_type(spark, tables["part"])
    return spark.sql(f"WITH {_ctes(needed, texts, tables)} SELECT * FROM {name}")


def oracle(body: str, *names: str) -> str:
    """DuckDB statement: the views it needs as CTEs, then ``body`` (CTEs of its own or a SELECT).

    ``body`` starts with SELECT, or with further ``name AS (...)`` items ending in a SELECT.
    """
    tables = {t: t for t in BASE} | {"explode": "unnest(list_value", "end": ")", "vectors": "(SELECT count(*) FROM embeddings)", "merge": "", "pos": "INT"}
    texts = {**SHARED, **DUCK_ONLY}
    body = body.strip()
    ctes = _ctes(_closure(names), texts, tables)
    if body.upper().startswith("SELECT"):
        return f"WITH {ctes}\n{body}" if ctes else body
    return f"WITH {ctes},\n{body}" if ctes else f"WITH {body}"
