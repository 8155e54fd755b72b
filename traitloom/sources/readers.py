"""Readers of the text and Parquet inputs. Schemas are stated, never inferred from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitloom.functions.expressions import clean_name, marker_chr, marker_pos, normalise_chr, pval_from_log10
from traitloom.operators.genotypes import to_long
from traitloom.operators.joins import union_all
from traitloom.operators.ordering import row_index
from traitloom.session import cut

_NO_SEP = "\u0001"


def read_table(spark: SparkSession, path, columns: Mapping[str, tuple[str, str]], sep: str = "\t") -> DataFrame:
    """Chosen columns of delimited files with a header.

    ``columns`` maps an output name to (name in the file, type). Text that does not parse
    is missing; so are ``NA``, ``NaN`` and the empty text of a non-text column.
    """
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    picked = []
    for out, (name, dtype) in columns.items():
        c = F.col(f"`{name}`")
        if dtype != "string":
            c = F.when(~F.upper(c).isin("NA", "NAN"), c).try_cast(dtype)
        picked.append(c.alias(out))
    return raw.select(*picked)


def read_variants(spark: SparkSession, path, with_row: bool = True, pos: str = "int") -> DataFrame:
    """Per-chromosome variant tables as one: chr, pos (of type ``pos``), id, ref, alt and the row in file order."""
    raw = spark.read.option("header", True).option("sep", "\t").schema(
        f"`#CHROM` string, POS {pos}, ID string, REF string, ALT string"
    ).csv(path)
    cols = [normalise_chr("#CHROM").alias("chr"), F.col("POS").alias("pos"), F.col("ID").alias("id"),
            F.col("REF").alias("ref"), F.col("ALT").alias("alt")]
    if not with_row:
        return raw.select(*cols)
    place = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
             F.monotonically_increasing_id().alias("__m")]
    indexed = row_index(raw.select(*cols, *place), ["__f", "__b", "__m"], "row_id")
    return indexed.drop("__f", "__b", "__m")


def read_variant_stats(spark: SparkSession, path, sep: str = "\t", pos: str = "int") -> DataFrame:
    return read_table(
        spark, path,
        {"chromosome": ("chromosome", "int"), "position": ("position", pos), "A_allele": ("A_allele", "string"),
         "B_allele": ("B_allele", "string"), "information": ("information", "double")},
        sep,
    )


@dataclass(frozen=True)
class SumstatLayout:
    """Where a result file keeps its fields, as column numbers from 1."""

    effect_allele: int
    other_allele: int
    pval: int
    chr: int | None = None
    pos: int | None = None
    marker: int | None = None
    beta: int | None = None
    log10_p: bool = False
    upper: bool = False


# Column numbers of the four kinds of result files.
LAYOUTS = {
    "nmr": SumstatLayout(chr=2, pos=3, effect_allele=5, other_allele=6, beta=9, pval=11),
    "metabolon": SumstatLayout(marker=1, effect_allele=2, other_allele=3, beta=7, pval=9),
    "olink": SumstatLayout(chr=3, pos=4, effect_allele=5, other_allele=6, pval=22),
    "somalogic": SumstatLayout(chr=1, pos=2, effect_allele=4, other_allele=5, pval=8, log10_p=True, upper=True),
}

# What to take off a file name to get the phenotype, in order.
NAME_RULES = {
    "nmr": [(r"\.tar\.gz", "")],
    "metabolon": [("INTERVAL_", ""), ("_.*", "")],
    "olink": [("INTERVAL_", ""), (r"_chr_merged\.gz", "")],
    "olink_neu": [("_olink.*", ""), ("^", "neu_")],
}


def file_lines(spark: SparkSession, path) -> DataFrame:
    """Lines after the header line of each file, whatever that header holds: line, path."""
    reader = spark.read.option("header", True).option("sep", _NO_SEP).option("quote", "").option("escape", "")
    return reader.schema("line string").csv(path).select("line", F.col("_metadata.file_path").alias("path"))


def read_sumstats(spark: SparkSession, path, layout: SumstatLayout, max_p: float | None = None, pos: str = "int") -> DataFrame:
    """Summary statistics by column position: fields and the file ``path``. ``max_p`` drops weaker rows at the scan.

    Positions are of type ``pos``; rows whose position does not fit are dropped like those without one.

    Fields are separated by white space and the header is skipped unread. A threshold on a
    log10 p-value is applied on the log scale. A gzip file is one task however large; the
    rows kept are few, and adaptive execution evens them out after the next shuffle.
    """
    field = F.split(F.trim("line"), r"\s+")

    def at(k: int) -> Column:
        return F.get(field, k - 1)

    number = at(layout.pval).try_cast("double")
    rows = file_lines(spark, path).withColumn("__p", F.when(~F.isnan(number), number))
    if max_p is not None:
        rows = rows.where(F.col("__p") < (F.log10(F.lit(float(max_p))) if layout.log10_p else F.lit(float(max_p))))
    if layout.marker is not None:
        where = [marker_chr(at(layout.marker)).alias("chr"), marker_pos(at(layout.marker), pos).alias("pos")]
    else:
        where = [normalise_chr(at(layout.chr)).alias("chr"), at(layout.pos).try_cast(pos).alias("pos")]
    alleles = [at(layout.effect_allele), at(layout.other_allele)]
    if layout.upper:
        alleles = [F.upper(a) for a in alleles]
    beta = [at(layout.beta).try_cast("double").alias("beta")] if layout.beta is not None else []
    pval = pval_from_log10("__p") if layout.log10_p else F.col("__p")
    out = rows.select(
        *where, alleles[0].alias("effect_allele"), alleles[1].alias("other_allele"), *beta, pval.alias("pval"), "path"
    )
    return out.where(F.col("chr").isNotNull() & F.col("pos").isNotNull())


def phenotype_from_path(df: DataFrame, rules: Sequence[tuple[str, str]] = (), directory: bool = False) -> DataFrame:
    """Replace ``path`` by ``phenotype``: the file's (or its directory's) name after ``rules``."""
    depth = r"([^/]+)/[^/]+$" if directory else r"([^/]+)$"
    name = F.url_decode(F.regexp_extract("path", depth, 1))
    return df.withColumn("phenotype", clean_name(name, rules)).drop("path")


def read_traits(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    return read_table(
        spark, path, {"variable": ("variable", "string"), "iid": ("IID", "bigint"), "value": ("value", "double")}, sep
    )


def read_trait_info(spark: SparkSession, path, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    return read_table(spark, path, {c: (c, "string") for c in columns}, sep)


def read_covariates(spark: SparkSession, path, columns: Mapping[str, tuple[str, str]], sep: str = "\t") -> DataFrame:
    return read_table(spark, path, columns, sep)


def read_dosage_wide(spark: SparkSession, path) -> DataFrame:
    """Dosage matrix of one trait (varID and a column per variant) as iid, rsid, dosage."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    named = [c for c in raw.columns if c != "varID"]
    wide = raw.select(F.col("varID").cast("bigint").alias("iid"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in named])
    return to_long(wide, ["iid"], "rsid", "dosage")


def read_dosages(spark: SparkSession, path: str) -> DataFrame:
    """Dosages of all traits, as ``write_dosages`` left them, as phenotype, iid, rsid, dosage."""
    root = path.rstrip("/")
    rows = spark.read.parquet(f"{root}/dosages").join(spark.read.parquet(f"{root}/variants"), "phenotype")
    cells = F.arrays_zip(F.col("rsids").alias("rsid"), F.col("dosages").alias("dosage"))
    return rows.select("phenotype", "iid", F.inline(cells))


def read_with_preamble(spark: SparkSession, path, skip: int = 31, sep: str = " ") -> DataFrame:
    """Delimited files whose header follows ``skip`` other lines in each; all columns are text.

    The first file by name gives the column names; another header in a file is an error. The preamble has to lie in the first block of a file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
        F.monotonically_increasing_id().alias("__m"),
    )
    # Rows of the first block are numbered in line order: its least number places the header.
    heads = cut(lines.where("__b = 0").groupBy("__f").agg((F.min("__m") + skip).alias("__last")))
    at = lines.join(heads, "__f")
    header = at.where("__b = 0 AND __m = __last").select("__f", "value")
    named = header.orderBy("__f").first()
    if named is None:
        raise ValueError("no header line")
    odd = header.where(F.col("value") != named["value"]).first()
    if odd is not None:
        raise ValueError(f"{odd['__f']} has another header than {named['__f']}")
    data = at.where((F.col("__b") > 0) | (F.col("__m") > F.col("__last"))).select(F.split("value", sep.replace("|", r"\|")).alias("f"))
    return data.select(*[F.get("f", i).alias(n) for i, n in enumerate(named["value"].split(sep))])


def read_phecode(spark: SparkSession, path) -> DataFrame:
    """Survival files of phecodes: phecode (from the file name), eid, genid, sex, event, time."""
    raw = spark.read.option("header", True).csv(path)
    code = F.regexp_extract(F.col("_metadata.file_path"), r"Phecode_([^/]+?)(\.csv(\.gz)?)?(/[^/]*)?$", 1)
    return raw.select(
        code.alias("phecode"), F.col("eid").cast("bigint"), F.col("genid").cast("bigint"), "sex",
        F.col("PHECODE_AgeAsTimescale").try_cast("int").alias("event"),
        F.col("PHECODE_AgeAsTimescale_Years").try_cast("double").alias("time"),
    )


def read_scores(spark: SparkSession, paths: Mapping[str, object]) -> DataFrame:
    """Wide score files of many platforms as platform, trait, iid, score."""
    parts = []
    for platform, path in paths.items():
        raw = spark.read.option("header", True).option("sep", "\t").csv(path)
        traits = raw.columns[1:]
        wide = raw.select(F.col("IID").cast("bigint").alias("iid"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in traits])
        parts.append(to_long(wide, ["iid"], "trait", "score").withColumn("platform", F.lit(platform)))
    return union_all(parts).select("platform", "trait", "iid", "score")


def read_genotypes(spark: SparkSession, path) -> DataFrame:
    """Genotype table in long or packed form; both are Parquet."""
    return spark.read.parquet(path)


def ancestry_flag(qc: DataFrame) -> DataFrame:
    """Sample QC under our names, from the column names of the file."""
    return qc.select(
        F.col("`#UKB_ID1`").cast("bigint").alias("sample_id"),
        F.col("`genotyping.array`").alias("array_type"),
        F.col("`in.white.British.ancestry.subset`").try_cast("int").alias("in_ancestry_subset"),
        *[F.col(f"PC{i}").try_cast("double").alias(f"PC{i}") for i in range(1, 11)],
    )
