"""Sinks, and the check of what earlier runs have finished."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.operators.genotypes import to_wide
from traitloom.session import large


def write_id_list(df: DataFrame, path: str, col: str = "id") -> None:
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)


def write_sumstats(df: DataFrame, path: str) -> None:
    """Partitioned by platform; sorted by p inside files so that readers can skip."""
    df.sortWithinPartitions("platform", "pval").write.mode("overwrite").partitionBy("platform").parquet(path)


def write_variant_effects(df: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per phenotype, in genomic order within files.

    Rebalancing brings a phenotype's rows together but splits one that is too large.
    """
    ordered = df.hint("rebalance", "phenotype").sortWithinPartitions("phenotype", "chr", "pos")
    ordered.write.mode(mode).partitionBy("phenotype").parquet(path)


def write_info(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_phenotypes(df: DataFrame, path: str) -> None:
    """Phenotypes, technical-only phenotypes, or ages and sexes: tab-separated with a header."""
    write_info(df, path)


def write_dosage_wide(df: DataFrame, path: str, names: Sequence[str] | None = None) -> None:
    """Dosage matrix of one trait from iid, rsid, dosage, as gzip text."""
    wide = to_wide(df, "iid", "rsid", "dosage", list(names) if names is not None else None)
    wide = wide.withColumnRenamed("iid", "varID")
    wide.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)


def write_dosages(cells: DataFrame, path: str) -> None:
    """Dosages of all traits in one table: phenotype, iid and ``dosages``, an array in the order of the trait's
    variants, beside a table ``variants`` (phenotype, rsids). Cells (phenotype, iid, rsid, dosage)
    that are absent are NULL in the array. A variant has a name and one cell per trait and sample. Rows are as wide as a
    trait has variants."""
    root = path.rstrip("/")
    names = cells.select("phenotype", "rsid").distinct().groupBy("phenotype").agg(F.sort_array(F.collect_list("rsid")).alias("rsids"))
    names.write.mode("overwrite").parquet(f"{root}/variants")
    names = cells.sparkSession.read.parquet(f"{root}/variants")
    # Each cell takes its place in the array along: a look-up by name would search all names of the trait.
    places = names.select("phenotype", F.size("rsids").alias("__n"), F.posexplode("rsids").alias("__k", "rsid"))
    named = cells.withColumn("rsid", F.coalesce("rsid", F.raise_error(F.lit("a cell without a variant")).cast("string")))
    placed = large(named).join(places, ["phenotype", "rsid"])
    e = F.col("e")
    rows = placed.groupBy("phenotype", "iid", "__n").agg(F.sort_array(F.collect_list(F.struct("__k", "dosage"))).alias("e"))
    none = F.lit(None).cast(cells.schema["dosage"].dataType)

    def with_gap(entry: Column, i: Column) -> Column:
        gap = entry["__k"] - F.when(i > 0, e[i - 1]["__k"]).otherwise(-1) - 1
        once = F.when(gap >= 0, gap).otherwise(F.raise_error(F.lit("a variant twice for one sample")).cast("int"))
        return F.concat(F.array_repeat(none, once), F.array(entry["dosage"]))

    tail = F.array_repeat(none, F.col("__n") - F.element_at(e, -1)["__k"] - 1)
    rows = rows.select("phenotype", "iid", F.concat(F.flatten(F.transform(e, with_gap)), tail).alias("dosages"))
    rows.write.mode("overwrite").parquet(f"{root}/dosages")


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_models(df: DataFrame, path: str, mode: str = "append") -> None:
    """Models are rows: keys, coef, intercept, alpha, lambda."""
    df.write.mode(mode).parquet(path)


def write_assoc(df: DataFrame, path: str) -> None:
    """Association results by p-value, missing last."""
    df.orderBy(F.asc_nulls_last("pvalue")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_ldpred_outputs(path: str, tables: Mapping[str, DataFrame]) -> None:
    """QC table, LD-score estimates, score model, sample scores, chain heritability."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def pending_keys(todo: DataFrame, done: DataFrame, on: Sequence[str] = ("phenotype",)) -> DataFrame:
    """Work that no earlier run has finished."""
    return todo.join(done.select(*on).distinct(), list(on), "left_anti")
