"""Naming rules of the trait sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitloom.functions.expressions import clean_name, rename_by_rules

# Clean-up of panel variable names in result files, applied in order after
# lower-casing, and two single corrections.
PANEL_NAME_RULES = [(r"\.", ""), ("--", ""), ("^inf1", "inf")]
PANEL_DNER = "inf_dner___q8nft8"
PANEL_EBP1 = ("inf_4ebp1___q13541", "inf_ebp1___q13541")


def percent_name(col: str) -> Column:
    """``_`` marks a percentage and would break file names."""
    return F.regexp_replace(col, "_", ".pct")


def metabolite_name(col: str) -> Column:
    return F.regexp_replace(col, "^m", "M")


def panel_match_name(col: str) -> Column:
    c = clean_name(col, PANEL_NAME_RULES, lower=True)
    c = F.when(c.contains(PANEL_DNER), PANEL_DNER).otherwise(c)
    return F.when(c == PANEL_EBP1[0], PANEL_EBP1[1]).otherwise(c)


def panel_phenotype(uniprot: str, assay: str) -> Column:
    """Protein list with ``.`` between members, or the assay where there is none."""
    name = F.regexp_replace(uniprot, ";", ".")
    return F.when(name == "", F.col(assay)).otherwise(name)


def aptamer_phenotype(seq_id: str) -> Column:
    return F.concat(F.lit("SeqId_"), F.regexp_replace(seq_id, "-", "_"))


def _target() -> Column:
    return F.col("Target")


def _dotted() -> Column:
    return F.regexp_replace("Target", "-", ".")


def _dotted_full() -> Column:
    return F.regexp_replace("TargetFullName", "-", ".")


# Fixed values: (column, equals, new short name), in the order they apply.
SHORT_NAME_RULES = [
    ("name", "VEGFA", _target),
    ("name", "PLG", _target),
    ("name", "C3", _target),
    ("name", "C4A", _target),
    ("Target", "C5b, 6 Complex", "C5b"),
    ("Target", "MPIF-1", "MPIF.1"),
    ("Target", "Ck-b-8-1", "Ck.b.8.1"),
    ("name", "CGA", _target),
    ("name", "Luteinizing hormone", "CGA.LHB"),
    ("name", "Glycoprotein hormones a-chain", "CGA"),
    ("Target", "SCGF-beta", "SCGFb"),
    ("Target", "SCGF-alpha", "SCGFa"),
    ("Target", "Coagulation Factor Xa", "F10a"),
    ("Target", "FN1.3", "FN1.3"),
    ("Target", "Haptoglobin, Mixed Type", "HPm"),
    ("name", "LRP1", _target),
    ("name", "LYN", _target),
    ("Target", "PILRA isoform FDF03-M14", "PILRA.M14"),
    ("Target", "PILRA isoform FDF03-deltaTM", "PILRA.dTM"),
    ("Target", "Ubiquitin+1", "RPS27Aplus1"),
    ("Target", "alpha-1-antichymotrypsin complex", "SERPINA3cmplx"),
    ("Target", "14-3-3 protein beta/alpha", "14.3.3.pba"),
    ("Target", "14-3-3", "14.3.3"),
    ("name", "C5", _target),
    ("name", "F2", _target),
    ("name", "EGFR", _target),
    ("name", "FN1", _target),
    ("name", "NRXN1", _target),
    ("name", "ADCYAP1", _dotted),
    ("name", "CKB", _dotted),
    ("name", "EGFR", _dotted),
    ("name", "FGA", _dotted),
    ("name", "FGF8", _dotted),
    ("name", "PPBP", _dotted),
    ("Target", "CLF-1/CLC Complex", "CLF1.CLC.complex"),
    ("Target", "CK2-A1:B", "CK2.A1.B"),
    ("Target", "Coagulation Factor IX", "CF.IX"),
    ("Target", "Coagulation Factor IXab", "CF.IXab"),
    ("Target", "GDF-11/8", "GDF11.8"),
    ("Target", "IgG2, Kappa", "IgG2"),
    ("Target", "IgG4, Kappa", "IgG4"),
    ("Target", "N-terminal pro-BNP", "NPPB.Nt"),
    ("Target", "Activated Protein C", "PROC.activated"),
    ("Target", "TLR4:MD-2 complex", "TLR4.MD2.complex"),
    ("Target", "Activin A", "INHBA.A"),
    ("Target", "Activin AB", "INHBA.AB"),
    ("Target", "Lymphotoxin a1/b2", "LTA.A1.B2"),
    ("Target", "Lymphotoxin a2/b1", "LTA.A2.B1"),
    ("name", "POMC", _dotted_full),
    ("Target", "SEM6C", "SEMA6C", "Target"),
    ("name", "14.3.3", "P61981|Q04917", "UniProt"),
]


def aptamer_sheet(info: DataFrame) -> DataFrame:
    """Protein aptamers with a unique short name and the phenotype of their sequence.

    ``info``: Type, SeqId, SOMAMER_ID, variable, Target, TargetFullName, UniProt, Gene, chr, tss.
    """
    proteins = info.where(F.col("Type") == "Protein").drop("Type")
    named = proteins.withColumn("name", F.regexp_replace("SOMAMER_ID", r"\..*", ""))
    renamed = rename_by_rules(named, "name", SHORT_NAME_RULES)
    return renamed.withColumnRenamed("name", "unique_short_name").withColumn("phenotype", aptamer_phenotype("SeqId"))
