"""Linkage disequilibrium."""

from __future__ import annotations

from pyspark.sql import functions as F

from traitloom.catalog.base import ORACLES, query, r6
from traitloom.catalog.variants import COUNTS_SQL, SNPS_SQL
from traitloom.fixtures import oracle, view
from traitloom.operators import cis, joins, ld
from traitloom.operators import genotypes as G
from traitloom.operators.ordering import row_index
from traitloom.plans import curation
from traitloom.session import cut, large

WINDOW = 40_000
MAX_R2 = 0.5
# Pruning of the whole panel looks as far as the reference does.
PRUNE_WINDOW = 1_000_000
MAP = {"ne": 11490.672741, "map_n": 183.0, "cutoff": 1e-5}


def _pairs_sql(window: int) -> str:
    return f"""
near AS (
  SELECT a.chr, a.row_id AS i, b.row_id AS j, a.pos AS pos_i, b.pos AS pos_j FROM fx_pvar a JOIN fx_pvar b ON a.chr = b.chr
    AND (b.pos > a.pos OR (b.pos = a.pos AND b.row_id > a.row_id)) AND b.pos - a.pos <= {window})"""


_PAIRS = _pairs_sql(WINDOW)

_R_SQL = """
sums AS (
  SELECT chr, i, j, count(*) AS n, sum(x.alt_dosage) AS sx, sum(y.alt_dosage) AS sy, sum(x.alt_dosage * x.alt_dosage) AS sxx,
    sum(y.alt_dosage * y.alt_dosage) AS syy, sum(x.alt_dosage * y.alt_dosage) AS sxy
  FROM near JOIN fx_dosage x ON x.row_id = i JOIN fx_dosage y ON y.row_id = j AND y.iid = x.iid
  WHERE x.alt_dosage IS NOT NULL AND y.alt_dosage IS NOT NULL GROUP BY chr, i, j),
ld AS (
  SELECT chr, i, j, n, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS r FROM sums
  WHERE n * sxx - sx * sx > 0 AND n * syy - sy * sy > 0)"""

LD_SQL = f"{_PAIRS},{_R_SQL}"

_ROUNDS = 14


def prune_sql(src: str, rounds: int = _ROUNDS) -> str:
    """Greedy pruning unrolled: CTEs ``e0 .. eN`` of open edges and ``g0 .. `` of losers."""
    parts = [
        f"""e0 AS MATERIALIZED (
  SELECT DISTINCT CASE WHEN a.maf > b.maf OR (a.maf = b.maf AND i < j) THEN i ELSE j END AS better,
    CASE WHEN a.maf > b.maf OR (a.maf = b.maf AND i < j) THEN j ELSE i END AS worse
  FROM ld JOIN {src} a ON a.row_id = i JOIN {src} b ON b.row_id = j WHERE r * r > {MAX_R2})"""
    ]
    for k in range(rounds):
        parts.append(f"t{k} AS MATERIALIZED (SELECT DISTINCT better FROM e{k} WHERE better NOT IN (SELECT worse FROM e{k}))")
        parts.append(f"g{k} AS MATERIALIZED (SELECT DISTINCT worse AS row_id FROM e{k} WHERE better IN (SELECT better FROM t{k}))")
        parts.append(
            f"""e{k + 1} AS MATERIALIZED (SELECT * FROM e{k} WHERE better NOT IN (SELECT better FROM t{k})
  AND better NOT IN (SELECT row_id FROM g{k}) AND worse NOT IN (SELECT row_id FROM g{k}))"""
        )
    gone = " UNION ALL ".join(f"SELECT row_id FROM g{k}" for k in range(rounds))
    parts.append(f"gone AS ({gone})")
    return ",\n".join(parts)


def panel_ld(spark, sf, min_r2=0.0, window_bp=WINDOW):
    return ld.ld_pairs(view(spark, sf, "fx_packed"), view(spark, sf, "fx_pvar"), window_bp, min_r2)


def passing(spark, sf):
    return G.filter_maf(G.variant_counts(view(spark, sf, "fx_packed")), 0.01).select("row_id")


@query("variant_pairs", oracle(f"{_PAIRS} SELECT chr, i, j, pos_i, pos_j FROM near", "fx_pvar"))
def variant_pairs(spark, sf):
    return cis.variant_pairs(view(spark, sf, "fx_pvar"), WINDOW)


@query(
    "variant_blocks",
    oracle(
        "SELECT row_id, chr, CAST(floor((row_number() OVER (PARTITION BY chr ORDER BY pos, row_id) - 1) / 50) AS BIGINT) AS block FROM fx_pvar",
        "fx_pvar",
    ),
)
def variant_blocks(spark, sf):
    return ld.variant_blocks(view(spark, sf, "fx_pvar"), 50).select("row_id", "chr", "block")


@query("ld_r2_pairs", oracle(f"{LD_SQL} SELECT chr, i, j, n, round(r, 6) + 0.0e0 AS r, round(r * r, 6) + 0.0e0 AS r2 FROM ld", "fx_pvar", "fx_dosage"))
def ld_r2_pairs(spark, sf):
    return panel_ld(spark, sf).select("chr", "i", "j", "n", r6("r").alias("r"), r6(F.col("r") * F.col("r")).alias("r2"))


BLOCKED = 40


def blocked(spark, sf):
    """The same genotypes packed into three or more blocks of samples."""
    long = view(spark, sf, "fx_dosage")
    manifest = row_index(long.select("iid").distinct(), ["iid"], "k").select("iid", (F.col("k") - 1).alias("sample_idx"))
    return cut(G.pack_genotypes(long, manifest, block=BLOCKED))


@query(
    "ld_r2_pairs_blocked",
    oracle(f"{LD_SQL} SELECT chr, i, j, n, round(r, 6) + 0.0e0 AS r FROM ld WHERE r * r >= 0.2", "fx_pvar", "fx_dosage"),
)
def ld_r2_pairs_blocked(spark, sf):
    """The same correlations from genotypes cut into sample blocks and small variant blocks."""
    out = ld.ld_pairs(blocked(spark, sf), view(spark, sf, "fx_pvar"), WINDOW, 0.2, block_size=32)
    return out.select("chr", "i", "j", "n", r6("r").alias("r"))


def _pruned_oracle(ld_sql: str) -> str:
    return oracle(
        f"""{COUNTS_SQL},
common AS (SELECT v.*, least(freq, 1 - freq) AS maf FROM fx_pvar v JOIN counts USING (row_id)),
{ld_sql},
{prune_sql('common')}
SELECT row_id, chr, pos FROM common WHERE row_id NOT IN (SELECT row_id FROM gone)""",
        "fx_pvar", "fx_dosage",
    )


@query("ld_prune", _pruned_oracle(f"{_pairs_sql(PRUNE_WINDOW)},{_R_SQL}"))
def ld_prune(spark, sf):
    freq = G.variant_counts(view(spark, sf, "fx_packed")).select("row_id", G.maf("freq").alias("maf"))
    variants = large(view(spark, sf, "fx_pvar")).join(freq, "row_id")
    return ld.ld_prune(panel_ld(spark, sf, MAX_R2, PRUNE_WINDOW), variants, MAX_R2).select("row_id", "chr", "pos")


@query("ld_prune_blocked", _pruned_oracle(LD_SQL))
def ld_prune_blocked(spark, sf):
    packed = blocked(spark, sf)
    freq = G.variant_counts(packed).select("row_id", G.maf("freq").alias("maf"))
    pairs = ld.ld_pairs(packed, view(spark, sf, "fx_pvar"), WINDOW, MAX_R2)
    return ld.ld_prune(pairs, large(view(spark, sf, "fx_pvar")).join(freq, "row_id"), MAX_R2).select("row_id", "chr", "pos")


@query("ld_prune_check", "SELECT 'close pairs kept' AS violation, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'dropped without reason', 0")
def ld_prune_check(spark, sf):
    """Violations: kept pairs above the bound; dropped variants without a better kept neighbour."""
    freq = G.variant_counts(view(spark, sf, "fx_packed")).select("row_id", G.maf("freq").alias("maf"))
    # Written once: pruning and both checks read them, and each time would cost the products and their plan anew.
    variants = cut(large(view(spark, sf, "fx_pvar")).join(freq, "row_id"))
    pairs = cut(panel_ld(spark, sf, MAX_R2))
    strong = pairs.where(F.col("r") * F.col("r") > MAX_R2)
    kept = ld.ld_prune(pairs, variants, MAX_R2).select("row_id", "maf")
    ki = kept.select(F.col("row_id").alias("i"))
    kj = kept.select(F.col("row_id").alias("j"))
    close = large(large(strong).join(ki, "i", "left_semi")).join(kj, "j", "left_semi")
    both = strong.select(F.col("i").alias("row_id"), F.col("j").alias("other")).unionByName(
        strong.select(F.col("j").alias("row_id"), F.col("i").alias("other"))
    )
    other = kept.select(F.col("row_id").alias("other"), F.col("maf").alias("other_maf"))
    better = (F.col("other_maf") > F.col("maf")) | ((F.col("other_maf") == F.col("maf")) & (F.col("other") < F.col("row_id")))
    reasons = large(both).join(other, "other").join(large(variants.select("row_id", "maf")), "row_id").where(better).select("row_id").distinct()
    dropped = large(large(variants).join(kept, "row_id", "left_anti")).join(reasons, "row_id", "left_anti")
    return joins.union_all([
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("violation"), "n")
        for label, df in {"close pairs kept": close, "dropped without reason": dropped}.items()
    ])


@query(
    "thin_variants",
    oracle(
        f"""{COUNTS_SQL}, {SNPS_SQL},
common AS (SELECT v.*, least(freq, 1 - freq) AS maf FROM snps v JOIN counts USING (row_id) WHERE least(freq, 1 - freq) >= 0.005),
{LD_SQL},
{prune_sql('common')}
SELECT row_id, chr, pos, id, ref, alt FROM common WHERE row_id NOT IN (SELECT row_id FROM gone)""",
        "fx_pvar", "fx_dosage",
    ),
)
def thin_variants(spark, sf):
    out = curation.thin_variants(view(spark, sf, "fx_pvar"), view(spark, sf, "fx_packed"), window_bp=WINDOW, max_r2=MAX_R2)
    return out.select("row_id", "chr", "pos", "id", "ref", "alt")


@query("thin_variants_blocked", ORACLES["thin_variants"])
def thin_variants_blocked(spark, sf):
    out = curation.thin_variants(view(spark, sf, "fx_pvar"), blocked(spark, sf), window_bp=WINDOW, max_r2=MAX_R2)
    return out.select("row_id", "chr", "pos", "id", "ref", "alt")


_SCORE_SQL = f"""{COUNTS_SQL}, {LD_SQL},
pass AS (SELECT row_id FROM counts WHERE least(freq, 1 - freq) >= 0.01),
inner_ld AS (SELECT * FROM ld WHERE i IN (SELECT row_id FROM pass) AND j IN (SELECT row_id FROM pass)),
scores AS (SELECT row_id, sum(r2) AS ld_score FROM (
  SELECT i AS row_id, r * r AS r2 FROM inner_ld UNION ALL SELECT j, r * r FROM inner_ld UNION ALL SELECT row_id, 1 FROM pass) GROUP BY row_id)"""


@query("ld_score", oracle(f"{_SCORE_SQL} SELECT row_id, round(ld_score, 6) + 0.0e0 AS ld_score FROM scores", "fx_pvar", "fx_dosage"))
def ld_score(spark, sf):
    return ld.ld_score(panel_ld(spark, sf), passing(spark, sf)).select("row_id", r6("ld_score").alias("ld_score"))


@query("ld_score_blocked", ORACLES["ld_score"])
def ld_score_blocked(spark, sf):
    packed = blocked(spark, sf)
    common = G.filter_maf(G.variant_counts(packed), 0.01).select("row_id")
    pairs = ld.ld_pairs(packed, view(spark, sf, "fx_pvar"), WINDOW)
    return ld.ld_score(pairs, common).select("row_id", r6("ld_score").alias("ld_score"))


_CM_SQL = """
spans AS (
  SELECT chr, pos AS p0, cm AS c0, lead(pos) OVER (PARTITION BY chr ORDER BY pos) AS p1, lead(cm) OVER (PARTITION BY chr ORDER BY pos) AS c1 FROM fx_gmap),
ends AS (SELECT chr, min(pos) AS first, max(pos) AS last, arg_max(cm, pos) AS last_cm FROM fx_gmap GROUP BY chr),
cmpos AS (
  SELECT v.*, CASE WHEN v.pos >= e.last THEN e.last_cm ELSE
    (SELECT max(c0 + (c1 - c0) * ((greatest(v.pos, e.first) - p0) / CAST(p1 - p0 AS DOUBLE))) FROM spans s
      WHERE s.chr = v.chr AND greatest(v.pos, e.first) >= p0 AND greatest(v.pos, e.first) < p1) END AS cm
  FROM fx_pvar v JOIN ends e ON e.chr = v.chr)"""

_SHRUNK_SQL = f"""{LD_SQL}, {_CM_SQL},
factors AS (SELECT ld.chr, i, j, r, exp(-4.0e0 * {MAP['ne']} * abs(b.cm - a.cm) / 100.0e0 / (2.0e0 * {MAP['map_n']})) AS f
  FROM ld JOIN cmpos a ON a.row_id = i JOIN cmpos b ON b.row_id = j),
shrunk AS (SELECT chr, i, j, r * f AS r FROM factors WHERE f >= {MAP['cutoff']})"""


@query("genetic_map", oracle(f"{_CM_SQL} SELECT row_id, chr, pos, round(cm, 9) + 0.0e0 AS cm FROM cmpos", "fx_pvar", "fx_gmap"))
def genetic_map(spark, sf):
    out = ld.interpolate_map(view(spark, sf, "fx_pvar"), view(spark, sf, "fx_gmap"))
    return out.select("row_id", "chr", "pos", r6("cm", 9).alias("cm"))


def shrunk_ld(spark, sf):
    cm = ld.interpolate_map(view(spark, sf, "fx_pvar"), view(spark, sf, "fx_gmap")).select("row_id", "cm")
    return ld.shrink_ld(panel_ld(spark, sf), cm, **MAP)


@query("ld_shrink", oracle(f"{_SHRUNK_SQL} SELECT chr, i, j, round(r, 6) + 0.0e0 AS r FROM shrunk", "fx_pvar", "fx_dosage", "fx_gmap"))
def ld_shrink(spark, sf):
    return shrunk_ld(spark, sf).withColumn("r", r6("r"))


@query(
    "ld_sparsify",
    oracle(f"{_SHRUNK_SQL} SELECT chr, i, j, round(r, 6) + 0.0e0 AS r FROM shrunk WHERE 100 * r * r > 3.841459", "fx_pvar", "fx_dosage", "fx_gmap"),
)
def ld_sparsify(spark, sf):
    return ld.sparsify_ld(shrunk_ld(spark, sf), 100, 3.841459).withColumn("r", r6("r"))


@query(
    "ld_merge",
    oracle(
        f"""{LD_SQL}, idx AS (SELECT row_id, row_number() OVER (ORDER BY chr, pos, row_id) AS k FROM fx_pvar)
SELECT ld.chr, i, j, a.k AS i_idx, b.k AS j_idx, round(r, 6) + 0.0e0 AS r FROM ld JOIN idx a ON a.row_id = i JOIN idx b ON b.row_id = j""",
        "fx_pvar", "fx_dosage",
    ),
)
def ld_merge(spark, sf):
    """Pieces within and across blocks of variants, merged into one indexed matrix."""
    variants = view(spark, sf, "fx_pvar")
    blocks = ld.variant_blocks(variants, 50).select("row_id", "block")
    whole = panel_ld(spark, sf)
    placed = whole.join(blocks.select(F.col("row_id").alias("i"), F.col("block").alias("bi")), "i").join(
        blocks.select(F.col("row_id").alias("j"), F.col("block").alias("bj")), "j"
    )
    cols = ["chr", "i", "j", "r"]
    out = ld.merge_ld([placed.where("bi = bj").select(*cols), placed.where("bi <> bj").select(*cols)], variants)
    return out.withColumn("r", r6("r"))
