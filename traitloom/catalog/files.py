"""File sources and sinks: fixture views written as the files users have, and read back.

Files go to a fresh folder under the session's shared checkpoint folder.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from traitloom.catalog.base import query, r6
from traitloom.catalog.traits import _EFFECTS as EFFECTS_SQL
from traitloom.catalog.traits import chosen_effects
from traitloom.fixtures import oracle, view
from traitloom.operators import joins
from traitloom.sources import readers, writers
from traitloom.session import work_path


def _tsv(df, path, **options):
    writer = df.write.option("header", True).option("sep", "\t").option("quote", "").option("escape", "")
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.csv(path)
    return path


@query("read_variants", oracle("SELECT chr, pos, id, ref, alt FROM fx_pvar", "fx_pvar"))
def read_variants(spark, sf):
    v = view(spark, sf, "fx_pvar").select(
        F.col("chr").alias("#CHROM"), F.col("pos").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT")
    )
    path = _tsv(v.repartition(5, "#CHROM"), work_path(spark, "pvar"))
    return readers.read_variants(spark, path, pos=dict(v.dtypes)["POS"]).drop("row_id")


@query(
    "read_variant_rows",
    oracle("SELECT count(*) AS n, count(*) AS n_distinct, CAST(1 AS BIGINT) AS first, count(*) AS last FROM fx_pvar", "fx_pvar"),
)
def read_variant_rows(spark, sf):
    """Rows in file order are numbered densely from 1."""
    v = view(spark, sf, "fx_pvar").select(
        F.col("chr").alias("#CHROM"), F.col("pos").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT")
    )
    rows = readers.read_variants(spark, _tsv(v.repartition(5, "#CHROM"), work_path(spark, "pvar")), pos=dict(v.dtypes)["POS"])
    per_row = rows.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"))
    return per_row.agg(
        F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("row_id").alias("first"), F.max("row_id").alias("last")
    )


@query(
    "read_variant_stats",
    oracle("SELECT chromosome, position, A_allele, B_allele, information FROM fx_snpstats", "fx_pvar", "fx_snpstats"),
)
def read_variant_stats(spark, sf):
    s = view(spark, sf, "fx_snpstats").drop("row_id")
    return readers.read_variant_stats(spark, _tsv(s, work_path(spark, "snpstats")), pos=dict(s.dtypes)["position"])


def _gwas_files(spark, sf, layout, name):
    """Results as gzip text, one folder per phenotype, with a header that fits nothing."""
    g = view(spark, sf, "fx_gwas")
    width = max(v for v in (layout.chr, layout.pos, layout.marker, layout.effect_allele, layout.other_allele, layout.beta, layout.pval) if v)
    fields = {k: F.lit("x") for k in range(1, width + 1)}
    if layout.marker:
        fields[layout.marker] = F.concat(F.lit("chr"), "chr", F.lit(":"), "pos", F.lit(":"), "row_no")
    else:
        fields[layout.chr], fields[layout.pos] = F.col("chr"), F.col("pos")
    case = F.lower if layout.upper else (lambda c: F.col(c))
    fields[layout.effect_allele], fields[layout.other_allele] = case("effect_allele"), case("other_allele")
    if layout.beta:
        fields[layout.beta] = F.format_string("%.9f", F.col("beta"))
    fields[layout.pval] = F.format_string("%.12f", F.log10("pval")) if layout.log10_p else F.format_string("%.15e", F.col("pval"))
    line = F.concat_ws("\t", *[fields[k].cast("string") for k in sorted(fields)])
    path = work_path(spark, name)
    out = g.select(line.alias("broken header"), F.concat(F.lit("INTERVAL_"), "phenotype").alias("dir")).repartition("dir")
    out.write.option("header", True).option("sep", "\u0001").option("quote", "").option("escape", "").partitionBy("dir").csv(
        path, compression="gzip"
    )
    return path + "/*/*.csv.gz"


_NAME = [("dir=", ""), ("INTERVAL_", "")]


def _read_layout(spark, sf, kind):
    layout = readers.LAYOUTS[kind]
    pos = dict(view(spark, sf, "fx_pvar").dtypes)["pos"]
    rows = readers.read_sumstats(spark, _gwas_files(spark, sf, layout, f"gwas_{kind}"), layout, 0.01, pos)
    named = readers.phenotype_from_path(rows, _NAME, directory=True)
    beta = [r6("beta").alias("beta")] if layout.beta else []
    return named.select("phenotype", "chr", "pos", "effect_allele", "other_allele", *beta, r6("pval", 9).alias("pval"))


def _layout_sql(beta: bool) -> str:
    extra = "round(beta, 6) + 0.0e0 AS beta, " if beta else ""
    return oracle(
        f"SELECT phenotype, chr, pos, effect_allele, other_allele, {extra}round(pval, 9) + 0.0e0 AS pval FROM fx_gwas WHERE pval < 0.01",
        "fx_pvar", "fx_gwas",
    )


@query("read_sumstats_nmr", _layout_sql(True))
def read_sumstats_nmr(spark, sf):
    return _read_layout(spark, sf, "nmr")


@query("read_sumstats_metabolon", _layout_sql(True))
def read_sumstats_metabolon(spark, sf):
    return _read_layout(spark, sf, "metabolon")


@query("read_sumstats_olink", _layout_sql(False))
def read_sumstats_olink(spark, sf):
    return _read_layout(spark, sf, "olink")


@query("read_sumstats_somalogic", _layout_sql(False))
def read_sumstats_somalogic(spark, sf):
    return _read_layout(spark, sf, "somalogic")


@query(
    "read_traits",
    oracle("SELECT variable, iid, round(value, 6) + 0.0e0 AS value FROM fx_trait", "fx_trait"),
)
def read_traits(spark, sf):
    t = view(spark, sf, "fx_trait").select("variable", F.col("iid").alias("IID"), F.coalesce(F.col("value").cast("string"), F.lit("NA")).alias("value"))
    return readers.read_traits(spark, _tsv(t, work_path(spark, "traits"))).withColumn("value", r6("value"))


@query("read_trait_info", oracle("SELECT DISTINCT variable, phenotype AS protein FROM fx_trait", "fx_trait"))
def read_trait_info(spark, sf):
    info = view(spark, sf, "fx_trait").select("variable", F.col("phenotype").alias("protein"), F.lit("-").alias("panel")).distinct()
    path = work_path(spark, "info")
    writers.write_info(info, path)
    return readers.read_trait_info(spark, path, ["variable", "protein"])


@query(
    "read_covariates",
    oracle("SELECT iid, round(PC_1, 6) + 0.0e0 AS pc_1, round(PC_2, 6) + 0.0e0 AS pc_2 FROM fx_pc", "fx_pc"),
)
def read_covariates(spark, sf):
    path = _tsv(view(spark, sf, "fx_pc").withColumnRenamed("iid", "ID"), work_path(spark, "pcs"))
    cols = {"iid": ("ID", "bigint"), "pc_1": ("PC_1", "double"), "pc_2": ("PC_2", "double")}
    out = readers.read_covariates(spark, path, cols)
    return out.select("iid", r6("pc_1").alias("pc_1"), r6("pc_2").alias("pc_2"))


@query(
    "dosage_matrix_files",
    oracle(
        """
d AS (SELECT iid, 'v' || (row_id % 7) AS rsid, max(alt_dosage) AS dosage FROM fx_dosage GROUP BY ALL)
SELECT iid, rsid, dosage FROM d""",
        "fx_dosage",
    ),
)
def dosage_matrix_files(spark, sf):
    """A dosage matrix written as gzip text, one column per variant, and read back long."""
    d = view(spark, sf, "fx_dosage").withColumn("rsid", F.concat(F.lit("v"), F.col("row_id") % 7))
    d = d.groupBy("iid", "rsid").agg(F.max("alt_dosage").alias("dosage"))
    path = work_path(spark, "dosages")
    writers.write_dosage_wide(d, path, [f"v{i}" for i in range(7)])
    return readers.read_dosage_wide(spark, path)


@query(
    "read_with_preamble",
    oracle("SELECT sample_id, array_type, in_ancestry_subset, round(PC1, 6) + 0.0e0 AS PC1, round(PC10, 6) + 0.0e0 AS PC10 FROM fx_qc", "fx_qc"),
)
def read_with_preamble(spark, sf):
    """Sample QC as one file whose header is its 32nd line."""
    qc = view(spark, sf, "fx_qc")
    names = ["#UKB_ID1", "genotyping.array", "in.white.British.ancestry.subset", *[f"PC{i}" for i in range(1, 11)]]
    pcs = [F.col(f"PC{i}").cast("string") for i in range(1, 11)]
    rows = qc.select(
        F.concat_ws(" ", F.col("sample_id").cast("string"), "array_type", F.col("in_ancestry_subset").cast("string"), *pcs).alias("value"),
    )
    preamble = [*[f"note {i}" for i in range(31)], " ".join(names)]

    def headed(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array(preamble, pa.string())})
        for batch in batches:
            yield batch.filter(batch.column(0).is_valid())

    path = work_path(spark, "sample_qc")
    # One file, since the preamble belongs to a file: its task puts the preamble first and streams the samples, one row each,
    # behind it. The line without a value makes sure of a file without samples.
    mark = spark.createDataFrame([(None,)], "value string")
    rows.unionByName(mark).coalesce(1).mapInArrow(headed, "value string").write.text(path)
    out = readers.ancestry_flag(readers.read_with_preamble(spark, path))
    return out.select("sample_id", "array_type", "in_ancestry_subset", r6("PC1").alias("PC1"), r6("PC10").alias("PC10"))


@query("read_phecode", oracle("SELECT phecode, eid, genid, sex, event, time FROM fx_phecode", "fx_phecode"))
def read_phecode(spark, sf):
    path = work_path(spark, "phecodes")
    codes = view(spark, sf, "fx_phecode").select(
        "phecode", "eid", "genid", "sex", F.col("event").alias("PHECODE_AgeAsTimescale"),
        F.col("time").alias("PHECODE_AgeAsTimescale_Years"), F.lit("unused").alias("other"),
    )
    for code in ("F", "O", "P"):
        part = codes.where(F.col("phecode") == code).drop("phecode")
        part.write.option("header", True).csv(f"{path}/Phecode_{code}.csv.gz", compression="gzip")
    return readers.read_phecode(spark, f"{path}/*")


@query(
    "read_scores",
    oracle("SELECT platform, trait, iid, round(score, 6) + 0.0e0 AS score FROM fx_scores", "fx_scores"),
)
def read_scores(spark, sf):
    paths = {}
    for platform, trait in (("Panel", "price"), ("Array", "mixed")):
        part = view(spark, sf, "fx_scores").where(F.col("platform") == platform)
        wide = part.select(F.col("iid").alias("IID"), F.col("score").alias(trait))
        paths[platform] = _tsv(wide, work_path(spark, "scores"), compression="gzip")
    return readers.read_scores(spark, paths).withColumn("score", r6("score"))


@query(
    "genotype_files",
    oracle("SELECT row_id, count(alt_dosage) AS n, round(sum(alt_dosage), 6) + 0.0e0 AS total FROM fx_dosage GROUP BY row_id", "fx_dosage"),
)
def genotype_files(spark, sf):
    path = work_path(spark, "genotypes")
    view(spark, sf, "fx_packed").write.parquet(path)
    cells = readers.read_genotypes(spark, path).select("row_id", F.explode("doses").alias("d"))
    ok = F.when(~F.isnan("d"), F.col("d").cast("double"))
    return cells.groupBy("row_id").agg(F.count(ok).alias("n"), r6(F.sum(ok)).alias("total"))


@query("write_id_list", oracle("SELECT id FROM fx_pvar", "fx_pvar"))
def write_id_list(spark, sf):
    path = work_path(spark, "ids")
    writers.write_id_list(view(spark, sf, "fx_pvar"), path)
    return spark.read.text(path).withColumnRenamed("value", "id")


@query(
    "write_sumstats",
    oracle("SELECT phenotype, row_no, measure_id AS platform, round(pval, 9) + 0.0e0 AS pval FROM fx_gwas WHERE pval < 0.01", "fx_pvar", "fx_gwas"),
)
def write_sumstats(spark, sf):
    path = work_path(spark, "collated")
    hits = view(spark, sf, "fx_gwas").where("pval < 0.01").withColumn("platform", F.col("measure_id"))
    writers.write_sumstats(hits.select("phenotype", "row_no", "pval", "platform"), path)
    return spark.read.parquet(path).select("phenotype", "row_no", "platform", r6("pval", 9).alias("pval"))


@query(
    "write_variant_effects",
    oracle(
        f"""{EFFECTS_SQL} SELECT c.phenotype, rsid, row_id, v.chr, v.pos, round(effect, 6) + 0.0e0 AS effect
FROM chosen c JOIN (SELECT row_id, chr, pos FROM fx_pvar) v USING (row_id)""",
        "fx_pvar", "fx_gwas",
    ),
)
def write_variant_effects(spark, sf):
    """Effects per phenotype folder, written in two runs; the second takes what is pending."""
    path = work_path(spark, "effects")
    effects = chosen_effects(spark, sf).join(view(spark, sf, "fx_pvar").select("row_id", "chr", "pos"), "row_id")
    writers.write_variant_effects(effects.where(F.col("phenotype") < "SeqId_15"), path)
    todo = writers.pending_keys(effects.select("phenotype").distinct(), spark.read.parquet(path))
    writers.write_variant_effects(joins.restrict_to(effects, todo, ["phenotype"]), path)
    return spark.read.parquet(path).select("phenotype", "rsid", "row_id", "chr", "pos", r6("effect").alias("effect"))


@query(
    "write_assoc",
    oracle(
        "SELECT phenotype AS trait, chr, min(pval) < 0.5 AS found, round(min(pval), 9) + 0.0e0 AS pvalue FROM fx_gwas GROUP BY phenotype, chr",
        "fx_pvar", "fx_gwas",
    ),
)
def write_assoc(spark, sf):
    path = work_path(spark, "assoc")
    best = view(spark, sf, "fx_gwas").groupBy(F.col("phenotype").alias("trait"), "chr").agg(F.min("pval").alias("pvalue"))
    writers.write_assoc(best, path)
    cols = {"trait": ("trait", "string"), "chr": ("chr", "int"), "pvalue": ("pvalue", "double")}
    back = readers.read_table(spark, path, cols)
    return back.select("trait", "chr", (F.col("pvalue") < 0.5).alias("found"), r6("pvalue", 9).alias("pvalue"))


@query(
    "write_tables",
    oracle(
        """SELECT 'phenotypes' AS kind, count(*) AS n FROM fx_trait UNION ALL SELECT 'metrics', 2 * count(*) FROM fx_gwas
UNION ALL SELECT 'models', count(*) FROM fx_chain UNION ALL SELECT 'sumstat_qc', count(*) FROM fx_gwas UNION ALL SELECT 'chains', count(*) FROM fx_chain""",
        "fx_pvar", "fx_gwas", "fx_trait", "fx_chain",
    ),
)
def write_tables(spark, sf):
    """Phenotypes, metrics (appended twice), models and score outputs, counted as read back."""
    root = work_path(spark, "tables")
    gwas, chains = view(spark, sf, "fx_gwas"), view(spark, sf, "fx_chain")
    writers.write_phenotypes(view(spark, sf, "fx_trait").select("phenotype", "iid", "value"), f"{root}/phenotypes")
    for _ in range(2):
        writers.write_metrics(gwas.select("phenotype", "pval"), f"{root}/metrics")
    writers.write_models(chains, f"{root}/models")
    writers.write_ldpred_outputs(f"{root}/out", {"sumstat_qc": gwas, "chains": chains})
    back = {
        "phenotypes": spark.read.option("header", True).option("sep", "\t").csv(f"{root}/phenotypes"),
        "metrics": spark.read.parquet(f"{root}/metrics"), "models": spark.read.parquet(f"{root}/models"),
        "sumstat_qc": spark.read.parquet(f"{root}/out/sumstat_qc"), "chains": spark.read.parquet(f"{root}/out/chains"),
    }
    return joins.union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in back.items()])
