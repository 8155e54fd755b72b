"""Column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Complement of each base.
STRAND_FROM = "ACGT"
STRAND_TO = "TGCA"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def finite(col: Column | str) -> Column:
    """NaN becomes NULL, so that comparisons drop it as they drop a missing value."""
    c = _c(col)
    return F.when(~F.isnan(c), c)


def sorted_alleles(ref: Column | str, alt: Column | str, sep: str = ":") -> Column:
    """Allele pair in an order that does not depend on which one is the reference."""
    return F.concat_ws(sep, F.least(_c(ref), _c(alt)), F.greatest(_c(ref), _c(alt)))


def flip_strand(col: Column | str) -> Column:
    """Complement of an allele string (not reversed)."""
    return F.translate(_c(col), STRAND_FROM, STRAND_TO)


def select_rename(df: DataFrame, where: Column, columns: dict[str, Column | str]) -> DataFrame:
    """Rows of one kind, with the given columns under their new names."""
    return df.where(where).select(*[_c(c).alias(name) for name, c in columns.items()])


def normalise_chr(col: Column | str) -> Column:
    """Chromosome as an integer; sex chromosomes, contigs and junk become NULL."""
    return F.regexp_replace(_c(col).cast("string"), "^chr", "").try_cast("int")


def marker_chr(col: Column | str) -> Column:
    return F.regexp_extract(_c(col), "^chr([^:]*):", 1).try_cast("int")


def marker_pos(col: Column | str, dtype: str = "int") -> Column:
    return F.regexp_extract(_c(col), "^chr[^:]*:([^:]*)", 1).try_cast(dtype)


def pval_from_log10(col: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(col))


def genotype_sd(freq: Column | str) -> Column:
    """Standard deviation of a dosage in Hardy-Weinberg proportions."""
    f = _c(freq)
    return F.sqrt(F.lit(2.0) * f * (F.lit(1.0) - f))


def hard_call(dose: Column | str, threshold: float = 0.1) -> Column:
    """Nearest genotype when the dosage is within ``threshold`` of it, else NULL."""
    d = finite(dose)
    return F.when(F.abs(d - F.round(d)) <= threshold, F.round(d))


def clean_name(col: Column | str, rules: Iterable[tuple[str, str]], lower: bool = False) -> Column:
    """Apply ``(pattern, replacement)`` rules in order, after lower-casing if asked."""
    c = F.lower(_c(col)) if lower else _c(col)
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


Rule = tuple[str, str, "str | Callable[[], Column]"]


def rename_by_rules(df: DataFrame, target: str, rules: Iterable[Rule]) -> DataFrame:
    """Ordered cascade: a rule ``(column, equals, value)`` sets ``target`` where it holds.

    A later rule sees what earlier ones wrote. ``value`` is a text or a function
    giving a column expression. A four-part rule names its own target column.
    """
    for rule in rules:
        where, equals, value = rule[:3]
        out = rule[3] if len(rule) > 3 else target
        new = value() if callable(value) else F.lit(value)
        df = df.withColumn(out, F.when(F.col(where) == equals, new).otherwise(F.col(out)))
    return df


def log_spaced(start: float, stop: float, n: int) -> Column:
    """Array of ``n`` numbers, evenly spaced on the log scale, both ends included."""
    if n < 2:
        raise ValueError("need at least two points")
    step = F.lit((1.0 / (n - 1)))
    lo, hi = F.log(F.lit(float(start))), F.log(F.lit(float(stop)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.exp(lo + (hi - lo) * i.cast("double") * step)
    )


def dot(x: Column | str, w: Column | str) -> Column:
    """Inner product of two array columns of equal length."""
    return F.aggregate(F.zip_with(_c(x), _c(w), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
