"""Rows that go wrong easily: missing values, ties, swapped alleles, empty groups, hot keys."""

import glob
import math
import os

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traitloom.fixtures import view
from traitloom.functions import expressions as E
from traitloom.functions import names
from traitloom.operators import aggregates, cis, genotypes, joins, ld, ordering, regression, scoring, survival
from traitloom.plans import curation, phenotypes, phewas, qtl, sheets
from traitloom.session import cut, cut_by, drop_cut, task_count
from traitloom.sources import readers, writers


def test_arg_best_passes_over_missing(spark):
    rows = [("a", None, 1), ("a", float("nan"), 2), ("b", None, 3), ("b", 2.0, 4), ("b", 5.0, 6), ("b", 5.0, 5)]
    df = spark.createDataFrame(rows, "k string, v double, o int")
    best = aggregates.arg_best(df, ["k"], "v", "max", ["o"]).collect()
    assert [(r.k, r.v, r.o) for r in best] == [("b", 5.0, 5)]
    assert aggregates.arg_best(df, ["k"], "v", "min", ["o"]).first().o == 4


def test_update_join_keeps_rows_and_takes_the_last(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    right = spark.createDataFrame([(1, "old", 1), (1, None, 2), (9, "q", 1)], "k int, v string, o int")
    out = joins.update_join(left, right, ["k"], ["v"], ["o"]).collect()
    assert sorted((r.k, r.v or "") for r in out) == [(1, ""), (1, ""), (2, "z")]


def _variants(spark, rows):
    return spark.createDataFrame(rows, "chr int, pos int, id string, ref string, alt string, row_id long")


def test_duplicates_without_any_score_all_go(spark):
    v = _variants(spark, [(1, 5, ".", "A", "C", 1), (1, 5, "rs1", "C", "A", 2), (1, 9, "rs2", "G", "T", 3), (2, 9, "rs2", "G", "T", 4)])
    stats = spark.createDataFrame([(1, 9, "T", "G", 0.5)], "chromosome int, position int, A_allele string, B_allele string, information double")
    out = {r.row_id: r for r in curation.flag_duplicates(v, stats).collect()}
    assert [out[i].remove for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert out[3].info == 0.5 and out[1].id == "1:5:A:C"


def test_swapped_statistic_takes_precedence(spark):
    v = _variants(spark, [(1, 5, "rs1", "A", "C", 1)])
    stats = spark.createDataFrame(
        [(1, 5, "A", "C", 0.9), (1, 5, "C", "A", 0.2)], "chromosome int, position int, A_allele string, B_allele string, information double"
    )
    assert joins.attach_info(v, stats).first().info == 0.2


def test_multiallelic_position_removes_rs_variants_too(spark):
    v = _variants(spark, [(1, 5, "1:5:A:C", "A", "C", 1), (1, 5, "1:5:A:G", "A", "G", 2), (1, 5, "rs7", "A", "T", 3), (1, 6, "rs8", "A", "G", 4), (1, 7, "rs8", "A", "G", 5), (1, 8, "rs9", "A", "G", 6)])
    assert [r.row_id for r in curation.drop_multiallelic(v).collect()] == [6]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet="ACGT", min_size=1, max_size=8))
def test_complement(spark, text):
    pairs = {"A": "T", "C": "G", "G": "C", "T": "A"}
    row = spark.range(1).select(E.flip_strand(F.lit(text)).alias("a"), E.flip_strand(E.flip_strand(F.lit(text))).alias("b")).first()
    assert row.a == "".join(pairs[c] for c in text) and row.b == text


def test_only_bases_have_a_complement(spark):
    assert spark.range(1).select(E.flip_strand(F.lit("ACGTVXYZ"))).first()[0] == "TGCAVXYZ"


def test_casts_give_null_instead_of_errors(spark):
    df = spark.createDataFrame([("chr7", "chr7:12:A:C"), ("X", "chrX:5"), ("GL_1", "junk"), ("chr2", "chr2:1_A")], "c string, m string")
    rows = df.select(E.normalise_chr("c").alias("c"), E.marker_chr("m").alias("mc"), E.marker_pos("m").alias("mp")).collect()
    assert [tuple(r) for r in rows] == [(7, 7, 12), (None, None, 5), (None, None, None), (2, 2, None)]


def test_thresholds():
    qtl.check_thresholds(5e-8, 0.01)
    for bad in ((0.01, 0.1), (-1, 0.1), (1e-4, 1.5), (None, 0.1), (1e-4, None)):
        with pytest.raises(ValueError):
            qtl.check_thresholds(*bad)


def test_nan_p_value_does_not_pass(spark):
    df = spark.createDataFrame([(0.001,), (float("nan"),), (None,)], "pval double")
    assert qtl.filter_pvalue(df, 0.5).count() == 1


def test_window_edges(spark):
    loc = spark.createDataFrame([("t", "1|X|2", "1500|7|90"), ("u", "3", "50")], "phenotype string, chr string, tss string")
    w = cis.make_windows(loc, 1000)
    assert {(r.phenotype, r.chr, r.start, r.end) for r in w.collect()} == {("t", 1, 500, 2500), ("t", 2, 0, 1090), ("u", 3, 0, 1050)}
    regions = spark.createDataFrame([(1, 400, 600, "a"), (2, 1000, 1200, "b")], "region_chr int, region_start int, region_end int, region_name string")
    ref = {(r.chr, r.start, r.end) for r in cis.extend_windows(w, regions).collect()}
    assert ref == {(1, 400, 2500), (2, 1000, 1090), (3, 0, 1050)}
    both = {(r.chr, r.start, r.end) for r in cis.extend_windows(w, regions, "symmetric").collect()}
    assert both == {(1, 400, 2500), (2, 0, 1200), (3, 0, 1050)}
    assert cis.complex_regions(spark).count() == 4
    ss = spark.createDataFrame([("t", 1, 400), ("t", 1, 399), ("u", 1, 450), ("u", 3, 5000)], "phenotype string, chr int, pos int")
    hits = cis.cis_variants(ss, cis.extend_windows(w, regions), bin_bp=100).collect()
    assert [(r.phenotype, r.chr, r.pos) for r in hits] == [("t", 1, 400)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 12)), min_size=1, max_size=60))
def test_ranks_and_quantiles_with_a_hot_key(spark, rows):
    df = spark.createDataFrame([(k, float(v), i) for i, (k, v) in enumerate(rows)], "k string, v double, i int")
    ranks = {r.i: r.rank for r in ordering.average_rank(df, ["k"], "v", "rank").collect()}
    q = {r.k: r.q for r in ordering.exact_quantile(df, ["k"], "v", 0.3, "q").collect()}
    for key in {k for k, _ in rows}:
        vals = np.array([v for k, v in rows if k == key], dtype=float)
        assert math.isclose(q[key], np.quantile(vals, 0.3), abs_tol=1e-12)
        for i, (k, v) in enumerate(rows):
            if k == key:
                assert ranks[i] == (vals < v).sum() + ((vals == v).sum() + 1) / 2


def test_running_sum_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7).cast("double").alias("w"))
    out = ordering.running_sum(df, ["k"], ["id"], "s", "w").toPandas()
    for _, part in out.groupby("k"):
        part = part.sort_values("id")
        assert np.allclose(part.s, part.w.cumsum())
    idx = ordering.row_index(df, [F.desc("id")], "n").toPandas()
    assert (idx.n == 1000 - idx.id).all()


def test_median_without_keys(spark):
    df = spark.createDataFrame([(4.0,), (1.0,), (None,), (3.0,), (2.0,)], "v double")
    assert ordering.median_of(df, [], "v").first().median == 2.5


def test_rank_deficient_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    rows = [("a", float(v), 2 * float(v), 1.0, float(3 * v + rng.normal())) for v in x] + [("b", 1.0, 2.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, x1 double, x2 double, x3 double, y double")
    out = regression.residualise(df, ["k"], "y", ["x1", "x2", "x3"]).toPandas()
    a = out[out.k == "a"]
    assert abs(a.y.sum()) < 1e-9 and abs((a.y * a.x1).sum()) < 1e-9
    assert abs(out[out.k == "b"].y.iloc[0]) < 1e-12


def test_constant_column_z_score(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0)], "k string, v double")
    assert [r.v for r in regression.zscore(df, ["k"], ["v"]).collect()] == [None, None]
    assert [r.v for r in regression.zscore(df, ["k"], ["v"], constant=0.0).collect()] == [0.0, 0.0]


def test_one_hot_drops_first_level(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "s string")
    assert regression.one_hot(df, ["s"]).columns == ["s_b", "s_c"]


def test_monomorphic_variant(spark):
    long = spark.createDataFrame([(i, 1, 0.0) for i in range(5)] + [(i, 2, None) for i in range(5)], "iid long, row_id long, alt_dosage double")
    counts = genotypes.variant_counts(long)
    assert genotypes.filter_mach_r2(counts).count() == 0
    assert genotypes.filter_maf(counts, 0.01).count() == 0
    assert [r.row_id for r in genotypes.filter_call_rate(counts).collect()] == [1]
    assert genotypes.with_hwe(counts.where("row_id = 1")).first().hwe_p == 1.0


def test_packing_with_gaps(spark):
    cells = [(10, 1, 2.0), (30, 1, None), (40, 1, 1.0), (20, 2, 1.0)]
    long = spark.createDataFrame(cells, "iid long, row_id long, alt_dosage double")
    samples = spark.createDataFrame([(10, 0), (20, 1), (30, 2), (40, 3), (50, 4)], "iid long, sample_idx long")
    packed = genotypes.pack_genotypes(long, samples, block=2)
    back = {(r.iid, r.row_id): r.alt_dosage for r in genotypes.unpack_genotypes(packed, samples, block=2).collect()}
    assert back == {(10, 1): 2.0, (20, 1): None, (30, 1): None, (40, 1): 1.0, (10, 2): None, (20, 2): 1.0}


def test_wide_and_long(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "iid long, rsid string, dosage double")
    wide = genotypes.to_wide(long, "iid", "rsid", "dosage")
    assert genotypes.to_long(wide, ["iid"], "rsid", "dosage").where("dosage IS NOT NULL").count() == 3


def test_ld_of_few_samples(spark):
    doses = {1: [0, 1, 2, 1], 2: [0, 1, 2, 1], 3: [2, 1, 0, float("nan")], 4: [1, 1, 1, 1], 5: [0.4, 1, 2, 0]}
    packed = spark.createDataFrame([(i, 0, [float(v) for v in d]) for i, d in doses.items()], "row_id long, sample_block int, doses array<float>")
    variants = _variants(spark, [(1, 100 * i, f"rs{i}", "A", "C", i) for i in doses])
    got = {(r.i, r.j): (r.n, round(r.r, 9)) for r in ld.ld_pairs(packed, variants, 1000, block_size=2).collect()}
    # Variant 4 is constant; the first cell of variant 5 is too far from a genotype.
    assert got == {(1, 2): (4, 1.0), (1, 3): (3, -1.0), (2, 3): (3, -1.0), (1, 5): (3, 0.866025404), (2, 5): (3, 0.866025404), (3, 5): (2, -1.0)}
    assert ld.ld_pairs(packed, variants, 150, block_size=2).count() == 2


def test_prune_follows_priority(spark):
    variants = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.2), (4, 0.2)], "row_id long, maf double")
    pairs = spark.createDataFrame([(1, 1, 2, 0.95), (1, 1, 3, 0.95), (1, 3, 4, -0.95), (1, 2, 4, 0.1)], "chr int, i long, j long, r double")
    assert sorted(r.row_id for r in ld.ld_prune(pairs, variants, 0.8).collect()) == [2, 3]


def test_sparse_and_shrunk(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.5), (1, 1, 3, 0.0)], "chr int, i long, j long, r double")
    assert ld.sparsify_ld(pairs, 100, 0).count() == 1
    cm = spark.createDataFrame([(1, 0.0), (2, 0.01), (3, 50.0)], "row_id long, cm double")
    got = ld.shrink_ld(pairs, cm).collect()
    assert len(got) == 1 and math.isclose(got[0].r, 0.5 * math.exp(-4 * 11490.672741 * 0.01 / 100 / 366), rel_tol=1e-12)


def test_unequal_lists_are_an_error(spark):
    df = spark.createDataFrame([("t", "a,b", "x")], "phenotype string, seq_id string, aptamer string")
    with pytest.raises(Exception, match="differ in length"):
        phenotypes.paired_lists(df, ["phenotype"], ["seq_id", "aptamer"]).collect()


def test_short_names(spark):
    rows = [("Protein", "1-2", "VEGFA.1", "v1", "VEGF121", "f"), ("Protein", "2-3", "CGA.2", "v2", "Luteinizing hormone", "f"),
            ("Control", "3-4", "ZZ.3", "v3", "t", "f"), ("Protein", "4-5", "POMC.7", "v4", "b-Endorphin", "Beta-end-orphin"),
            ("Protein", "5-6", "YWHAG.1", "v5", "14-3-3", "f")]
    df = spark.createDataFrame(rows, "Type string, SeqId string, SOMAMER_ID string, variable string, Target string, TargetFullName string")
    df = df.withColumn("UniProt", F.lit("P")).withColumn("Gene", F.lit("G"))
    got = {r.SeqId: r for r in names.aptamer_sheet(df).collect()}
    assert {k: v.unique_short_name for k, v in got.items()} == {"1-2": "VEGF121", "2-3": "CGA.LHB", "4-5": "Beta.end.orphin", "5-6": "14.3.3"}
    assert got["5-6"].UniProt == "P61981|Q04917" and got["1-2"].phenotype == "SeqId_1_2"


def test_panel_sheet_on_odd_rows(spark):
    rows = [("inf_a___q1", "Q1;Q2", "OID1", "inf", "p"), ("neu_a___q1", "Q1.Q2", "OID2", "neu", "p"), ("cvd_x___", "", "OID00195", "cvd", None),
            ("inf_b___q3", "P16284", "OID3", "inf", "r"), ("inf_c___q4", None, "OID4", "inf", "s")]
    info = spark.createDataFrame(rows, "variable string, uniprot string, olink_id string, panel string, protein string")
    genes = spark.createDataFrame([("Q1", "7"), ("Q2", None)], "uniprot string, entrez string")
    places = spark.createDataFrame([(7, "3", 99)], "entrez int, chr string, start int")
    located = sheets.panel_info(info, genes, places)
    assert located.count() == len(rows)
    results = spark.createDataFrame([("INF1_A___Q1",), ("Cvd.X--___",), ("inf1_b___q3",), ("unknown",), (None,)], "measure string")
    hits = sheets.name_panel_results(results, located)
    assert sorted((r.measure or "", r.phenotype or "") for r in hits.collect()) == [
        ("", ""), ("Cvd.X--___", ""), ("INF1_A___Q1", "Q1.Q2"), ("inf1_b___q3", "P16284"), ("unknown", "")]
    sheet = sorted(tuple(r) for r in sheets.panel_sheet(located, hits).collect())
    assert sheet == [("P16284", "P16284", "r", "17", "62396775", "inf"), ("Q1.Q2", "Q1.Q2", "p", "3", "99", "neu"), ("Q1.Q2", "Q1;Q2", "p", "3", "99", "inf")]
    values = spark.createDataFrame([("inf_a___q1", 1, 2.0), ("neu_a___q1", 1, 4.0), ("inf_a___q1", 2, None), ("inf_c___q4", 1, 9.0)], "variable string, iid long, value double")
    assert [tuple(r) for r in sheets.sheet_values(values, located, hits).collect()] == [("Q1.Q2", 1, 3.0)]
    assert sheets.panel_sheet(located.where("false"), hits).count() == 0 and sheets.panel_sheet(located, hits.where("false")).count() == 0


def test_panel_names(spark):
    df = spark.createDataFrame([("INF1_DNER___Q8NFT8 ", "", "OID1"), ("inf_4EBP1___Q13541", "P1;P2", "OID2"), ("Neu.X--1", "P3", "O")], "v string, u string, o string")
    rows = df.select(names.panel_match_name("v").alias("m"), names.panel_phenotype("u", "o").alias("p")).collect()
    assert [tuple(r) for r in rows] == [("inf_dner___q8nft8", "OID1"), ("inf_ebp1___q13541", "P1.P2"), ("neux1", "P3")]
    assert spark.range(1).select(names.metabolite_name(F.lit("m123"))).first()[0] == "M123"


def test_file_names(spark, tmp_path):
    folder = tmp_path / "run"
    folder.mkdir()
    (folder / "INTERVAL_M100_sorted.gz.txt").write_text("one two\nchr1:5:A:C a c x x x 0.25 x 0.001\nchrX:6 a c x x x 1 x 0.001\nchr1:7:x a c x x x 1 x NA\n")
    rows = readers.read_sumstats(spark, str(folder), readers.LAYOUTS["metabolon"], max_p=0.01)
    got = readers.phenotype_from_path(rows, readers.NAME_RULES["metabolon"]).collect()
    assert [(r.phenotype, r.chr, r.pos, r.beta, r.pval) for r in got] == [("M100", 1, 5, 0.25, 0.001)]
    df = spark.createDataFrame([("/x/abc_olink_neuro.gz",)], "path string")
    assert readers.phenotype_from_path(df, readers.NAME_RULES["olink_neu"]).first().phenotype == "neu_abc"


def test_pending(spark):
    todo = spark.createDataFrame([("a",), ("b",)], "phenotype string")
    assert [r.phenotype for r in writers.pending_keys(todo, todo.limit(1)).collect()] in (["b"], ["a"])


def test_score_test_without_events(spark):
    df = spark.createDataFrame([("k", 1.0, 0, 0.5), ("k", 2.0, 0, 1.5)], "k string, t double, e int, x double")
    assert survival.cox_score_test(df, ["k"], "t", "e", "x").count() == 0


def test_rules_see_earlier_results(spark):
    df = spark.createDataFrame([("a", "t"), ("b", "t")], "name string, other string")
    out = E.rename_by_rules(df, "name", [("name", "a", "b"), ("name", "b", "c"), ("other", "t", "u", "other")]).collect()
    assert [tuple(r) for r in out] == [("c", "u"), ("c", "u")]


def test_exact_hardy_weinberg_against_full_sum(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(int(v) for v in rng.multinomial(n, p)) for n in (1, 2, 7, 50, 3000) for p in ([0.3, 0.4, 0.3], [0.9, 0.1, 0.0], [0.5, 0.0, 0.5], [0.25, 0.5, 0.25]) for _ in range(8)]
    rows += [(0, 0, 0), (5, 0, 0), (0, 9, 0), (40, 0, 40), (3000, 1, 2)]
    got = spark.createDataFrame(rows, "a long, h long, b long").select("*", genotypes.hwe_exact("a", "h", "b").alias("p")).collect()
    for r in got:
        rare = 2 * min(r.a, r.b) + r.h
        n = r.a + r.h + r.b
        logs = {h: h * math.log(2) - math.lgamma(h + 1) - math.lgamma((rare - h) // 2 + 1) - math.lgamma(n - h - (rare - h) // 2 + 1) for h in range(rare % 2, rare + 1, 2)}
        top = max(logs.values())
        want = sum(math.exp(v - top) for v in logs.values() if v <= logs[r.h] + 1e-9) / sum(math.exp(v - top) for v in logs.values())
        assert math.isclose(r.p, min(1.0, want), rel_tol=1e-6, abs_tol=1e-300), r


def test_packed_and_long_genotypes_agree(spark):
    rng = np.random.default_rng(6)
    cells = [(i, v, None if rng.random() < 0.1 else float(np.float32(rng.choice([0, 1, 2, 0.4, 1.95])))) for i in range(37) for v in range(12)]
    cells += [(i, 99, None) for i in range(37)]
    long = spark.createDataFrame(cells, "iid long, row_id long, alt_dosage double")
    manifest = spark.createDataFrame([(i, i) for i in range(37)], "iid long, sample_idx long")
    packed = genotypes.pack_genotypes(long, manifest, block=10)
    a, b = (sorted(genotypes.variant_counts(g).collect()) for g in (long, packed))
    assert [r.row_id for r in a] == [r.row_id for r in b]
    for x, y in zip(a, b):
        assert (x.n, x.n_called, x.n_hom_ref, x.n_het, x.n_hom_alt) == (y.n, y.n_called, y.n_hom_ref, y.n_het, y.n_hom_alt)
        assert (x.freq is None and y.freq is None) or (math.isclose(x.freq, y.freq) and math.isclose(x.dose_var, y.dose_var, abs_tol=1e-9))
    effects = spark.createDataFrame(
        [(t, v, float(rng.normal()), bool(v % 2), None if v % 3 else 0.7) for t in ("s", "t") for v in range(12)] + [("only", 99, 1.0, True, None)],
        "phenotype string, row_id long, effect double, counts_alt boolean, fill double",
    )
    one = {(r.phenotype, r.iid): r.score for r in scoring.score(long, effects).collect()}
    two = {(r.phenotype, r.iid): r.score for r in scoring.score(packed, effects, manifest, 10).collect()}
    assert set(one) == set(two)
    assert all((one[k] is None and two[k] is None) or math.isclose(one[k], two[k], abs_tol=1e-6) for k in one)


def test_effects_of_all_traits_meet_a_variant_once(spark):
    rng = np.random.default_rng(31)
    samples, variants, traits = 30, 12, 25
    cells = [(i, v, None if rng.random() < 0.2 else float(rng.integers(0, 3))) for i in range(samples) for v in range(variants)]
    long = spark.createDataFrame(cells, "iid long, row_id long, alt_dosage double")
    manifest = spark.createDataFrame([(i, i) for i in range(samples)], "iid long, sample_idx long")
    packed = genotypes.pack_genotypes(long, manifest, block=8)
    rows = [(None if t == 0 else f"t{t}", int(v), float(rng.normal()), bool(rng.random() < 0.5), None if t % 3 else float(t % 2) + 0.5)
            for t in range(traits) for v in range(variants) if rng.random() < 0.4]
    # A repeated effect counts twice; an effect without value or allele not at all.
    rows += [rows[3], ("t1", 0, None, True, None), ("t1", 1, 1.0, None, None)]
    effects = spark.createDataFrame(rows, "phenotype string, row_id long, effect double, counts_alt boolean, fill double")
    lists = scoring.gather_effects(effects)
    assert lists.count() == len({r[1] for r in rows}) and scoring.gather_effects(effects, 5).count() > lists.count()
    assert scoring.gather_effects(effects, 5).select(F.sum(F.size("entries"))).first()[0] == len(rows) - 2
    dose = {(i, v): d for i, v, d in cells}
    want = {}
    for t, v, e, alt, fill in rows:
        for i in range(samples):
            d = dose[i, v] if dose[i, v] is not None else fill
            if d is not None and e is not None and alt is not None:
                want[t, i] = want.get((t, i), 0.0) + e * (d if alt else 2 - d)
    got = {(r.phenotype, r.iid): r.score for r in scoring.score(packed, effects, manifest, 8).collect() if r.score is not None}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert scoring.score(packed, effects.where("false"), manifest, 8).count() == 0


def test_tiles_of_traits_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(4)
    doses = np.where(rng.random((9, 20)) < 0.1, np.nan, rng.integers(0, 3, (9, 20)).astype(float))
    n = 300
    row, trait = rng.integers(0, 9, n), rng.integers(0, 70, n)
    entries = {"effect": rng.normal(size=n), "fill": np.where(rng.random(n) < 0.5, np.nan, 1.5), "counts_alt": rng.random(n) < 0.5}
    whole = dict(scoring._block_scores(doses, row, trait, entries))
    monkeypatch.setattr(scoring, "WEIGHT_CELLS", 30)
    tiled = dict(scoring._block_scores(doses, row, trait, entries))
    assert set(whole) == set(tiled) == set(trait.tolist())
    assert all(np.allclose(whole[t], tiled[t]) for t in whole)


def test_sample_blocks_do_not_change_linkage(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 3, size=(60, 20))
    cells = [(i, v, None if rng.random() < 0.05 else float(base[i, v - v % 3])) for i in range(60) for v in range(20)]
    long = spark.createDataFrame(cells, "iid long, row_id long, alt_dosage double")
    manifest = spark.createDataFrame([(i, i) for i in range(60)], "iid long, sample_idx long")
    variants = spark.createDataFrame([(1, 100 * v, v) for v in range(20)], "chr int, pos int, row_id long")
    results = []
    for block, size in ((60, 64), (20, 64), (7, 5)):
        pairs = ld.ld_pairs(genotypes.pack_genotypes(long, manifest, block=block), variants, 600, 0.1, block_size=size)
        results.append(sorted((r.i, r.j, r.n, round(r.r, 9)) for r in pairs.collect()))
    assert results[0] and results[0] == results[1] == results[2]


def test_preamble_of_several_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("note a\nnote b\nid x\n" + "".join(f"{10 * k + j} v{j}\n" for j in range(k + 1)))
    rows = readers.read_with_preamble(spark, str(tmp_path), skip=2).collect()
    assert sorted((int(r["id"]), r["x"]) for r in rows) == sorted((10 * k + j, f"v{j}") for k in range(3) for j in range(k + 1))
    (tmp_path / "part9.txt").write_text("note a\nnote b\nother y\n1 2\n")
    with pytest.raises(ValueError):
        readers.read_with_preamble(spark, str(tmp_path), skip=2)


def test_level_codes_have_no_limit(spark):
    rows = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("level")).unionByName(spark.createDataFrame([(None,)], "level string"))
    got = regression.level_codes(rows, "level")
    assert got.where("level IS NULL AND code IS NULL").count() == 1
    assert got.agg(F.count_distinct("code"), F.max("code")).first()[0:2] == (1500, 1499)


def test_dropped_tables_are_gone(spark):
    table = cut(spark.range(5).toDF("a"))
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    drop_cut(table)
    assert not os.path.isdir(folder)


def test_running_sums_of_either_sign(spark):
    rng = np.random.default_rng(12)
    rows = [("a" if i % 3 else None, i, float(rng.normal()), int(rng.integers(5))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o int, v double, n long").repartition(7)
    got = ordering.running_sums(df, ["k"], ["o"], {"sv": "v", "sn": "n"}).collect()
    assert len(got) == 900
    for key in ("a", None):
        part = sorted((r for r in got if r.k == key), key=lambda r: r.o)
        assert np.allclose([r.sv for r in part], np.cumsum([r.v for r in part]))
        assert np.allclose([r.sn for r in part], np.cumsum([r.n for r in part]))


def _computed_genotypes(spark):
    """Genotypes made by expressions, which Spark takes for a few rows: packed, long, manifest."""
    samples = spark.range(6).select(F.col("id").alias("iid"), F.col("id").alias("sample_idx"))
    packed = spark.range(8).select(
        F.col("id").alias("row_id"), F.lit(0).alias("sample_block"),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda s: ((s * 5 + F.col("id") * 7) % 3).cast("float")).alias("doses"),
    )
    return packed, genotypes.unpack_genotypes(packed, samples), samples


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_check_reads_the_products_once(spark, tmp_path):
    """The checks read written pairs, they do not make the products again."""
    from traitloom.catalog.ld import ld_prune_check

    # The keys of 300 variants; everything else is made from them.
    spark.range(300).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    out = ld_prune_check(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" not in plan
    assert {tuple(r) for r in out.collect()} == {("close pairs kept", 0), ("dropped without reason", 0)}


def test_genotypes_are_never_broadcast(spark):
    packed, long, samples = _computed_genotypes(spark)
    variants = spark.range(8).select(F.lit(1).alias("chr"), (F.col("id") * 10).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("id").alias("row_id"))
    hits = spark.range(4).select(F.lit("t").alias("phenotype"), F.concat(F.lit("rs"), "id").alias("rsid"), F.lit(1).alias("chr"), (F.col("id") * 10).cast("int").alias("pos"), F.lit("C").alias("effect_allele"), F.lit("A").alias("other_allele"), F.lit(0.5).alias("effect"))
    chosen = joins.match_effects(hits, variants)
    one, many = scoring.score(packed, chosen, samples), scoring.score(long, chosen)
    frames = {
        "row_id": [one, many, joins.effect_dosage(long, hits, variants), ld.ld_pairs(packed, variants, 100)],
        "iid": [genotypes.pack_genotypes(long, samples)], "sample_idx": [long],
    }
    for key, made in frames.items():
        for df in made:
            assert f"SortMergeJoin [{key}" in _plan(df)
    want = {i: 0.5 * sum((i * 5 + v * 7) % 3 for v in range(4)) for i in range(6)}
    for df in (one, many):
        assert {r["iid"]: r["score"] for r in df.collect()} == pytest.approx(want)
    back = {r["row_id"]: list(r["doses"]) for r in genotypes.pack_genotypes(long, samples).collect()}
    assert back == {r["row_id"]: list(r["doses"]) for r in packed.collect()}
    assert ld.ld_pairs(packed, variants, 100).count() > 0


def test_genotype_views_are_made_in_many_tasks(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("fx_packed", "fx_dosage"):
        assert view(spark, str(tmp_path), name).rdd.getNumPartitions() == task_count(spark) > 1


def test_written_ldpred_matches_once(spark, monkeypatch):
    from traitloom.catalog import sumstat

    packed, _, _ = _computed_genotypes(spark)
    rows = [("t", f"rs{k}", 1, 10 * k, "A", "C", 0.1 * k, 0.02, 1000.0, k) for k in range(8)]
    stats = spark.createDataFrame(rows, "phenotype string, rsid string, chr int, pos int, a0 string, a1 string, beta double, beta_se double, n_eff double, row_id long")
    calls = []
    monkeypatch.setattr(sumstat, "matched", lambda *_: calls.append(1) or stats)
    monkeypatch.setattr(sumstat, "view", lambda *_: packed)
    out = {r["rsid"]: r["effect"] for r in sumstat.written_ldpred(spark, "unused").collect()}
    assert out == pytest.approx({f"rs{k}": 0.1 * k for k in range(8)})
    assert len(calls) == 1


def test_model_frames_are_joined_once(spark):
    frame = spark.range(40).select(
        F.lit("p").alias("platform"), F.lit("F").alias("phecode"), F.lit("t").alias("trait"), F.lit(1).alias("event"), F.col("id").cast("double").alias("time"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("array_type"), (F.col("id") * 7 % 11).cast("double").alias("score"), (F.col("id") % 5).cast("double").alias("PC1"),
    )
    model = phewas.prepare_assoc(frame, components=["PC1"])
    assert "Range" not in _plan(model)
    row = model.agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.var_pop("score").alias("v"), F.sum(F.col("score") * F.col("PC1")).alias("c")).first()
    assert row["n"] == 40 and [row["m"], row["v"], row["c"]] == pytest.approx([0, 1, 0], abs=1e-9)


def test_variants_are_never_broadcast(spark, tmp_path):
    packed, long, samples = _computed_genotypes(spark)
    variants = spark.range(8).select(F.lit(1).alias("chr"), (F.col("id") * 10).cast("int").alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("id").alias("row_id"), F.lit("rs").alias("id"))
    hits = spark.range(4).select(F.lit("t").alias("phenotype"), F.concat(F.lit("rs"), "id").alias("rsid"), F.lit(1).alias("chr"), (F.col("id") * 10).cast("int").alias("pos"), F.lit("C").alias("effect_allele"), F.lit("A").alias("other_allele"), F.lit(0.5).alias("effect"), F.lit(0.0).alias("pval"), F.lit(0.5).alias("beta"))
    stats = hits.select("phenotype", "chr", "pos", F.col("effect_allele").alias("a1"), F.col("other_allele").alias("a0"), "beta")
    chosen = joins.match_effects(hits, variants)
    pairs = spark.createDataFrame([(1, 0, 1, 0.9), (1, 1, 2, 0.9)], "chr int, i long, j long, r double")
    ranked = variants.withColumn("maf", F.lit(0.2))
    pruned = ld.ld_prune(pairs, ranked, 0.5)
    scores = ld.ld_score(pairs, variants.select("row_id"))
    made = [
        chosen, joins.snp_match(stats, variants), qtl.select_trans_qtls(hits.drop("rsid"), variants, 0.1, ["beta"]), scoring.score_imputed(packed, chosen, "mean", samples),
        pruned, scores, ld.shrink_ld(pairs, variants.select("row_id", F.lit(0.0).alias("cm"))),
    ]
    for df in made:
        joined = _plan(df)
        assert "SortMergeJoin" in joined
        assert "BroadcastHashJoin [row_id" not in joined and "BroadcastHashJoin [chr" not in joined and "BroadcastHashJoin [i" not in joined
    assert sorted(r["row_id"] for r in pruned.collect()) == [0, 2, 3, 4, 5, 6, 7]
    assert {r["row_id"]: r["ld_score"] for r in scores.collect() if r["row_id"] < 3} == pytest.approx({0: 1.81, 1: 2.62, 2: 1.81})
    spark.range(10).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.range(10).select(
        F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.lit(0.1).alias("l_discount"), F.lit(0.1).alias("l_tax"), F.lit(3).alias("l_quantity"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    gwas = view(spark, str(tmp_path), "fx_gwas")
    assert "BroadcastHashJoin" not in _plan(gwas) and gwas.count() == 10


def test_dosages_are_placed_without_a_look_up_by_name(spark, tmp_path, monkeypatch):
    rows = [("t", i, f"v{k:02d}", None if k == 5 else float(i + k)) for i in range(3) for k in range(12) if (i, k) not in ((0, 0), (0, 1), (1, 6), (2, 11))]
    rows += [("u", 0, "v00", 1.0), (None, 0, "v00", 1.0), ("t", None, "v03", 2.0)]
    cells = spark.createDataFrame(rows, "phenotype string, iid long, rsid string, dosage double")

    def searched(*_):
        raise AssertionError("searches the names of a trait")

    monkeypatch.setattr(writers.F, "try_element_at", searched)
    writers.write_dosages(cells, f"{tmp_path}/all")
    got = {(r["phenotype"], r["iid"], r["rsid"]): r["dosage"] for r in readers.read_dosages(spark, f"{tmp_path}/all").collect()}
    want = {("t", i, f"v{k:02d}"): None for i in (0, 1, 2, None) for k in range(12)} | {("u", 0, "v00"): None}
    assert got == want | {(p, i, v): d for p, i, v, d in rows if p is not None}
    for bad in (("t", 0, "v02", 1.0), ("t", 0, None, 1.0)):
        with pytest.raises(Exception, match="a variant twice|without a variant"):
            writers.write_dosages(cells.unionByName(spark.createDataFrame([bad], cells.schema)), f"{tmp_path}/bad")


def test_preamble_file_is_not_sorted(spark, tmp_path, monkeypatch):
    from traitloom.catalog import files

    customers = spark.range(50).select(F.col("id").alias("c_custkey"), F.lit("A B").alias("c_mktsegment"), (F.col("id") - 25).cast("double").alias("c_acctbal"))
    customers.withColumn("c_mktsegment", F.lit("SEG")).repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4).select(F.col("id").alias("vec_id"), F.array(*[F.lit(k / 4) for k in range(10)]).alias("embedding")).write.parquet(f"{tmp_path}/embeddings.parquet")

    def sorted_whole(*_):
        raise AssertionError("sorts the whole file in one task")

    monkeypatch.setattr(type(customers), "sortWithinPartitions", sorted_whole)
    monkeypatch.setattr(files, "work_path", lambda *_: f"{tmp_path}/written")
    got = files.read_with_preamble(spark, str(tmp_path)).collect()
    assert sorted((r["sample_id"], r["array_type"], r["in_ancestry_subset"], r["PC10"]) for r in got) == [(k, "SEG", int(k >= 25), 2.25) for k in range(50)]
    texts = [open(p).read().splitlines() for p in glob.glob(f"{tmp_path}/written/part-*")]
    assert len(texts) == 1 and len(texts[0]) == 82 and texts[0][0] == "note 0" and texts[0][31].startswith("#UKB_ID1 ")


def test_bucketed_table_stays_in_a_join(spark):
    table = cut_by(spark.range(200).select(F.col("id").cast("string").alias("unit"), F.col("id").alias("v")), "unit")
    other = spark.range(100).select(F.col("id").cast("string").alias("unit"), (F.col("id") * 2).alias("w"))
    joined = table.join(other.hint("shuffle_hash"), "unit")
    assert _plan(joined).count("Exchange hashpartitioning") == 1
    assert sorted((r["v"], r["w"]) for r in joined.collect()) == [(k, 2 * k) for k in range(100)]
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    tables = len(spark.catalog.listTables())
    drop_cut(table)
    assert not os.path.isdir(folder) and len(spark.catalog.listTables()) == tables - 1


def test_ld_pairs_broadcasts_no_roles_of_blocks(spark):
    """The roles of variant blocks grow with the variants; they meet these by sort and merge."""
    variants = spark.createDataFrame([(1, 100 * k, k) for k in range(6)], "chr int, pos int, row_id long")
    doses = [[float((s * (k + 1)) % 3) for s in range(12)] for k in range(6)]
    packed = spark.createDataFrame([(k, 0, d) for k, d in enumerate(doses)], "row_id long, sample_block int, doses array<float>")
    pairs = ld.ld_pairs(packed, variants, 200, block_size=2)
    assert "BroadcastHashJoin [chr" not in _plan(pairs)
    want = {(i, j) for i in range(6) for j in range(i + 1, min(i + 3, 6)) if np.std(doses[i]) and np.std(doses[j])}
    assert {(r["i"], r["j"]) for r in pairs.collect()} == want
    assert all(abs(r["r"] - np.corrcoef(doses[r["i"]], doses[r["j"]])[0, 1]) < 1e-9 for r in pairs.collect())


def test_pruned_panel_has_no_correlated_pair_in_a_megabase(spark, tmp_path):
    from traitloom.catalog.ld import ld_prune

    spark.range(800).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    kept = ld_prune(spark, str(tmp_path)).collect()
    doses = {r.row_id: np.rint(np.array(r.doses, float)) for r in view(spark, str(tmp_path), "fx_packed").collect()}
    close = 0
    for a in kept:
        for b in kept:
            if a.chr == b.chr and a.row_id < b.row_id and abs(a.pos - b.pos) <= 1_000_000:
                x, y = doses[a.row_id], doses[b.row_id]
                both = ~np.isnan(x) & ~np.isnan(y)
                x, y = x[both] - x[both].mean(), y[both] - y[both].mean()
                close += (x @ y) ** 2 > (0.5 + 1e-9) * (x @ x) * (y @ y)
    assert close == 0 and len(kept) > 100


@pytest.fixture(scope="module")
def far_tables(spark, tmp_path_factory):
    """Variants whose positions lie beyond 32 bits, with statistics of two traits."""
    path = str(tmp_path_factory.mktemp("far"))
    keys = spark.range(7_000_000, 7_000_300)
    keys.selectExpr("id AS p_partkey").write.parquet(f"{path}/part.parquet")
    keys.selectExpr(
        "id AS l_partkey", "id % 2 AS l_suppkey", "id * 3 AS l_orderkey", "1 AS l_linenumber", "CAST(id % 11 AS DOUBLE) / 100 AS l_discount",
        "CAST(id % 9 AS DOUBLE) / 100 AS l_tax", "CAST(id % 50 AS DOUBLE) AS l_quantity",
    ).write.parquet(f"{path}/lineitem.parquet")
    return path


def test_positions_beyond_32_bits(spark, far_tables, tmp_path):
    from traitloom.catalog import files, sumstat
    from traitloom.catalog import ld as panel

    variants = view(spark, far_tables, "fx_pvar")
    assert dict(variants.dtypes)["pos"] == "bigint" and variants.agg(F.min("pos")).first()[0] > 1_400_000 * 7919
    doses = {r.row_id: np.rint(np.array(r.doses, float)) for r in view(spark, far_tables, "fx_packed").collect()}
    places = {r.row_id: (r.chr, r.pos) for r in variants.collect()}
    pairs = {(r.i, r.j) for r in panel.ld_r2_pairs(spark, far_tables).collect()}
    near = {(i, j) for i in places for j in places if places[i][0] == places[j][0] and (0, 0) < (places[j][1] - places[i][1], j - i) and 0 <= places[j][1] - places[i][1] <= panel.WINDOW}
    constant = {i for i, d in doses.items() if np.ptp(d[~np.isnan(d)]) == 0}
    assert pairs == {(i, j) for i, j in near if i not in constant and j not in constant}
    assert panel.ld_score_blocked(spark, far_tables).count() == 300 - len(constant)
    thinned = panel.thin_variants_blocked(spark, far_tables).collect()
    assert thinned and all((r.chr, r.pos) == places[r.row_id] for r in thinned)
    assert sumstat.ld_score_by_trait(spark, far_tables).count() > 0
    assert {(r.chr, r.pos) for r in files.read_variants(spark, far_tables).collect()} == set(places.values())
    stats = view(spark, far_tables, "fx_gwas").where("pval < 0.01")
    assert files.read_sumstats_metabolon(spark, far_tables).count() == stats.count()
    spark.range(300).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert dict(view(spark, str(tmp_path), "fx_pvar").dtypes)["pos"] == "int"
