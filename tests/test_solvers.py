"""Iterative solvers against short NumPy solutions of the same problem."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitloom.operators import chains, cox_scan, genotypes, regression, scoring, sumstats, survival, training
from traitloom.plans import evaluation, ldpred, phewas


def _design(spark, n=120, p=6, traits=("a", "b"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for t in traits:
        x = rng.integers(0, 3, size=(n, p)).astype(float)
        y = x @ rng.normal(size=p) + rng.normal(size=n)
        rows += [(t, i, float(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "phenotype string, iid long, y double, x array<double>"), rows


def test_folds_are_balanced_and_repeatable(spark):
    design, _ = _design(spark)
    one = training.assign_folds(design, ["phenotype"]).select("phenotype", "iid", "fold").toPandas()
    two = training.assign_folds(design.repartition(7), ["phenotype"]).select("phenotype", "iid", "fold").toPandas()
    sizes = one.groupby(["phenotype", "fold"]).size()
    assert sizes.min() == sizes.max() == 24
    key = ["phenotype", "iid"]
    assert one.sort_values(key).fold.tolist() == two.sort_values(key).fold.tolist()


def test_bayesian_ridge_is_the_posterior_mean(spark):
    design, rows = _design(spark)
    folded = training.assign_folds(design, ["phenotype"])
    folds = {(r.phenotype, r.iid): r.fold for r in folded.select("phenotype", "iid", "fold").collect()}
    models = evaluation.fold_models(folded, chunk_rows=10).collect()
    assert len(models) == 10
    for m in models:
        use = [r for r in rows if r[0] == m.phenotype and folds[r[0], r[1]] != m.fold]
        x, y = np.array([r[3] for r in use]), np.array([r[2] for r in use])
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + m["lambda"] / m.alpha * np.eye(x.shape[1]), xc.T @ yc)
        assert np.allclose(m.coef, want, atol=1e-8)
        assert math.isclose(m.intercept, y.mean() - x.mean(0) @ want, rel_tol=1e-8)
        assert m.n == len(use)
        # The evidence is stationary: both updates leave the precisions where they are.
        s = np.clip(np.linalg.eigvalsh(xc.T @ xc), 0, None)
        gamma = (m.alpha * s / (m["lambda"] + m.alpha * s)).sum()
        assert math.isclose((gamma + 2e-6) / (want @ want + 2e-6), m["lambda"], rel_tol=1e-2)
        assert math.isclose((len(use) - gamma + 2e-6) / (((yc - xc @ want) ** 2).sum() + 2e-6), m.alpha, rel_tol=1e-2)


def test_more_variants_than_samples(spark):
    design, _ = _design(spark, n=10, p=25, traits=("a",))
    models = evaluation.fold_models(training.assign_folds(design, ["phenotype"])).collect()
    assert len(models) == 5 and all(np.isfinite(m.coef).all() for m in models)


def test_prior_search_matches_single_fits(spark):
    design, rows = _design(spark, traits=("a",))
    folds = training.gram(training.assign_folds(design, ["phenotype"]), ["phenotype", "fold"])
    first = F.col("fold") == 1
    train = training.held_out(folds, ["phenotype"]).where(first).drop("fold")
    val = folds.where(first).drop("fold")
    tuned = training.tune_bayesian_ridge(train, val, ["phenotype"], candidates=(10.0, 1e-5)).toPandas()
    assert len(tuned) == 16 and tuned.combo.tolist() == list(range(16))
    best = training.best_priors(
        training.tune_bayesian_ridge(train, val, ["phenotype"], candidates=(10.0, 1e-5)), ["phenotype"]
    ).first()
    assert best.r == tuned.r.max() and best.combo == tuned.index[tuned.r == tuned.r.max()][0]
    one = training.bayesian_ridge(train, ["phenotype"], best.a1, best.a2, best.l1, best.l2).first()
    held = training.assign_folds(design, ["phenotype"]).where("fold = 1").toPandas()
    pred = np.array(held.x.tolist()) @ np.array(one.coef)
    assert math.isclose(np.corrcoef(held.y, pred)[0, 1], best.r, abs_tol=1e-6)


def _partial_likelihood(beta, t, e, x, strata):
    """Efron log likelihood, gradient and information, sample by sample."""
    ll, grad, info = 0.0, np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    for s in np.unique(strata):
        m = strata == s
        w = np.exp(x[m] @ beta)
        for time in np.unique(t[m][e[m] == 1]):
            risk, dead = t[m] >= time, (t[m] == time) & (e[m] == 1)
            d = dead.sum()
            ll += (x[m][dead] @ beta).sum()
            for k in range(d):
                share = w * (risk - dead * k / d)
                mean = share @ x[m] / share.sum()
                ll -= np.log(share.sum())
                grad -= mean
                info += (x[m].T * share) @ x[m] / share.sum() - np.outer(mean, mean)
            grad += x[m][dead].sum(0)
    return ll, grad, info


def test_cox_small_example_with_ties(spark):
    rows = [("k", "s", 5.0, 1, 0.0), ("k", "s", 5.0, 1, 1.0), ("k", "s", 8.0, 0, 1.0), ("k", "s", 3.0, 1, 2.0), ("k", "s", 9.0, 1, 0.5)]
    df = spark.createDataFrame(rows, "k string, s string, t double, e int, x double")
    fit = survival.cox_ph(df, ["k"], "t", "e", ["x"], ["s"]).first()
    t, e, x = (np.array([r[i] for r in rows], dtype=float) for i in (2, 3, 4))
    ll, grad, info = _partial_likelihood(np.array(fit.coef), t, e, x[:, None], np.zeros(5))
    assert fit.converged and abs(grad[0]) < 1e-7
    assert math.isclose(fit.loglik, ll, rel_tol=1e-9)
    assert math.isclose(fit.se[0], 1 / math.sqrt(info[0, 0]), rel_tol=1e-6)


def test_cox_many_keys_and_covariates(spark):
    rng = np.random.default_rng(11)
    frames = []
    for key in ("a", "b"):
        n = 150
        x = rng.normal(size=(n, 3))
        time = np.ceil(rng.exponential(np.exp(-0.5 * x[:, 0])) * 8)
        frames.append(pd.DataFrame({"key": key, "sex": rng.choice(["F", "M"], n) if key == "a" else "F", "t": time,
                                    "e": (rng.random(n) < 0.7).astype(int), "x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2]}))
    data = pd.concat(frames)
    # A constant and a doubled covariate carry no information of their own.
    data["x3"], data["x4"] = 0.0, data["x1"]
    fits = survival.cox_ph(spark.createDataFrame(data), ["key"], "t", "e", ["x0", "x1", "x2", "x3", "x4"], ["sex"]).collect()
    for f in fits:
        d = data[data.key == f.key]
        x = d[["x0", "x1", "x2"]].to_numpy()
        beta = np.array([f.coef[0], f.coef[1] + f.coef[4], f.coef[2]])
        _, grad, info = _partial_likelihood(beta, d.t.to_numpy(), d.e.to_numpy(), x, d.sex.to_numpy())
        assert f.converged and np.abs(grad).max() < 1e-5 and f.coef[3] == 0
        assert math.isclose(f.se[0], math.sqrt(np.linalg.inv(info)[0, 0]), rel_tol=1e-5)
    z = spark.createDataFrame([(1.959963984540054,), (None,)], "z double").select(survival.wald_p("z").alias("p")).collect()
    assert math.isclose(z[0].p, 0.05, rel_tol=1e-9) and z[1].p is None


def test_phewas_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, pcs = 200, [f"PC{i}" for i in range(1, 11)]
    ids = np.arange(n)
    qc = pd.DataFrame({"sample_id": ids + 1000, "array_type": rng.choice(["A", "B"], n)})
    for c in pcs:
        qc[c] = rng.normal(size=n)
    score = rng.normal(size=n) + qc["PC1"].to_numpy()
    frames = []
    for code, sexes in (("p1", ["F", "M"]), ("p2", ["F"])):
        frames.append(pd.DataFrame({"phecode": code, "eid": ids, "genid": ids + 1000, "sex": rng.choice(sexes, n),
                                    "event": (rng.random(n) < 0.5).astype(int), "time": np.ceil(rng.exponential(np.exp(-0.3 * score)) * 10)}))
    surv = pd.concat(frames)
    scores = pd.DataFrame({"platform": "x", "trait": "t", "iid": ids, "score": score})
    out = phewas.phewas(*(spark.createDataFrame(d) for d in (scores, surv, qc))).collect()
    assert {r.phecode for r in out} == {"p1", "p2"}
    pc = qc[pcs].to_numpy()
    pc = (pc - pc.mean(0)) / pc.std(0)
    full = np.column_stack([np.ones(n), pc])
    s = score - full @ np.linalg.lstsq(full, score, rcond=None)[0]
    s = (s - s.mean()) / s.std()
    x = np.column_stack([s, pc, (qc.array_type == "B").astype(float)])
    for r in out:
        d = surv[surv.phecode == r.phecode]
        beta = np.zeros(x.shape[1])
        for _ in range(30):
            _, grad, info = _partial_likelihood(beta, d.time.to_numpy(), d.event.to_numpy(), x, d.sex.to_numpy())
            beta = beta + np.linalg.solve(info, grad)
        se = math.sqrt(np.linalg.inv(info)[0, 0])
        assert math.isclose(r.hr, math.exp(beta[0]), rel_tol=1e-6)
        assert math.isclose(r.hr_low, math.exp(beta[0] - survival.Z975 * se), rel_tol=1e-6)
        assert math.isclose(r.pvalue, math.erfc(abs(beta[0] / se) / math.sqrt(2)), rel_tol=1e-5)


def _scan_case(spark, rng, n=240):
    """Two phenotypes, five scores with gaps, tied and distinct times, missing times, events and strata."""
    ids = np.arange(n)
    x = rng.normal(size=(n, 3))
    rows = []
    for code in ("a", None):
        time = np.ceil(rng.exponential(np.exp(-0.4 * x[:, 0])) * (6 if code == "a" else 1e6))
        for i in ids:
            sex = None if i % 11 == 0 else ("F", "M")[i % 2]
            rows.append((code, int(i), sex, None if i % 37 == 5 else float(time[i]), None if i % 41 == 7 else int(rng.random() < 0.6),
                         None if i % 53 == 9 else float(x[i, 1]), float(x[i, 2])))
    cohort = spark.createDataFrame(rows, "code string, eid long, sex string, time double, event int, c0 double, c1 double")
    scores = [(f"t{k}", int(i), float(x[i, 0] * k + rng.normal() + 100.0)) for k in range(4) for i in ids if (i + k) % 5 or k == 3]
    scores += [("flat", int(i), 7.0) for i in ids] + [("none", int(i), None) for i in ids] + [("t0", None, 1.0)]
    # A sample with two scores of one trait counts twice.
    scores.append(("t1", 3, 99.0))
    return cohort, spark.createDataFrame(scores, "trait string, iid long, score double")


@pytest.mark.parametrize("size,lanes", [(16, 2), (100000, 64)])
def test_scan_of_scores_equals_one_model_each(spark, size, lanes):
    cohort, scores = _scan_case(spark, np.random.default_rng(21))
    blocks, traits = cox_scan.score_blocks(scores, ["trait"], "iid", "score", lanes)
    fits = cox_scan.cox_scan(cohort, blocks, ["code"], "eid", "time", "event", ["c0", "c1"], 0, ["sex"], size=size)
    got = {(r.code, r.trait): r for r in fits.join(traits, ["block", "lane"]).collect()}
    frame = scores.join(cohort, scores["iid"] == cohort["eid"]).dropna(subset=["score", "time", "event", "c0", "c1"])
    frame = regression.zscore(frame, ["code", "trait"], ["score"], constant=0.0)
    want = {(r.code, r.trait): r for r in survival.cox_ph(frame, ["code", "trait"], "time", "event", ["score", "c0", "c1"], ["sex"]).collect()}
    assert set(got) == set(want) and {t for _, t in got} == {"t0", "t1", "t2", "t3", "flat"}
    for key, w in want.items():
        g = got[key]
        assert g.converged and w.converged
        np.testing.assert_allclose(g.coef, w.coef, rtol=1e-6, atol=1e-8)
        np.testing.assert_allclose(g.se, w.se, rtol=1e-6, atol=1e-8)
        assert math.isclose(g.loglik, w.loglik, rel_tol=1e-9)
        assert key[1] != "flat" or g.coef[0] == 0


def test_time_chunks_keep_tied_events_together_and_the_order(spark):
    rng = np.random.default_rng(8)
    # A third of all samples share one time; events of that time stay in one chunk, the others are dealt out.
    time = np.where(rng.random(900) < 0.33, 50.0, rng.integers(1, 100, 900))
    rows = [("k", int(i), float(t), int(rng.random() < (0.05 if t == 50 else 0.5))) for i, t in enumerate(time)]
    df = spark.createDataFrame(rows, "k string, eid long, time double, event int")
    out = cox_scan.time_chunks(df, ["k"], "time", "event", ["eid"], 32).toPandas()
    assert len(out) == 900 and out[out.event == 1].groupby("time").chunk.nunique().max() == 1
    assert out[(out.time == 50) & (out.event == 0)].chunk.nunique() >= 8
    span = out.groupby("chunk").time.agg(["min", "max"]).sort_index()
    assert (span["min"].to_numpy()[:-1] >= span["max"].to_numpy()[1:]).all()
    sizes = out.groupby("chunk").size()
    assert sizes.max() <= 32 + out[out.event == 1].groupby("time").size().max() + 32
    for t, same in out.groupby("time"):
        if same.event.nunique() == 2:
            assert same[same.event == 0].chunk.max() <= same[same.event == 1].chunk.min()


def test_scan_of_empty_tables(spark):
    cohort, scores = _scan_case(spark, np.random.default_rng(21))
    blocks, _ = cox_scan.score_blocks(scores, ["trait"], "iid", "score")
    none, _ = cox_scan.score_blocks(scores.where("false"), ["trait"], "iid", "score")
    args = (["code"], "eid", "time", "event", ["c0", "c1"], 2, ["sex"])
    assert cox_scan.cox_scan(cohort.where("false"), blocks, *args).count() == 0
    assert cox_scan.cox_scan(cohort, none, *args).count() == 0


def test_ldsc_against_numpy(spark):
    rng = np.random.default_rng(2)
    m = 600
    ld = rng.gamma(3, 10, m)
    n = 5000.0
    chisq = rng.chisquare(1, m) * (1 + 0.4 * n * ld / m)
    df = pd.DataFrame({"phenotype": "a", "row_id": np.arange(m), "chisq": chisq, "ld_score": ld, "n_eff": n})
    got = sumstats.ldsc(spark.createDataFrame(df), blocks=20, step1_chisq=500.0).first()
    y, x, w_ld = chisq + 1e-8, ld / m * n, np.maximum(ld, 1)

    def line(x, y, w):
        a = np.column_stack([np.ones(len(x)), x])
        return np.linalg.solve((a.T * w) @ a, (a.T * w) @ y)

    keep = y < 500
    pred = y[keep]
    for _ in range(100):
        a, b = line(x[keep], y[keep], 1 / (pred**2 * w_ld[keep]))
        new = a + b * x[keep]
        done = np.abs(new - pred).max() < 1e-6
        pred = new
        if done:
            break
    # One more fit at the settled weights, as in the jackknife.
    a = line(x[keep], y[keep], 1 / (pred**2 * w_ld[keep]))[0]
    pred = y
    for _ in range(100):
        w = 1 / (pred**2 * w_ld)
        h2 = (w * x * (y - a)).sum() / (w * x * x).sum()
        done = np.abs(a + h2 * x - pred).max() < 1e-6
        pred = a + h2 * x
        if done:
            break
    assert math.isclose(got.intercept, a, rel_tol=1e-4)
    assert math.isclose(got.h2, h2, rel_tol=1e-4)
    assert got.n_variants == m and got.h2_se > 0


def _hwe_by_enumeration(aa, ab, bb):
    n, rare = aa + ab + bb, 2 * min(aa, bb) + ab
    f = math.factorial
    weight = {h: 2**h / (f(h) * f((rare - h) // 2) * f(n - h - (rare - h) // 2)) for h in range(rare % 2, rare + 1, 2)}
    return sum(w for w in weight.values() if w <= weight[ab] * (1 + 1e-9)) / sum(weight.values())


def test_hwe_exact(spark):
    cases = [(10, 20, 10), (30, 2, 8), (40, 0, 0), (0, 9, 1), (5, 30, 5)]
    df = spark.createDataFrame(cases, "n_hom_ref long, n_het long, n_hom_alt long")
    for row in genotypes.with_hwe(df).collect():
        assert math.isclose(row.hwe_p, _hwe_by_enumeration(row.n_hom_ref, row.n_het, row.n_hom_alt), rel_tol=1e-9)


def _summary(spark, hats, n=10_000.0):
    rows = [("t", i, 1, 100 * i, float(b), 1 / math.sqrt(n), n, f"rs{i}", "A", "C") for i, b in enumerate(hats)]
    return spark.createDataFrame(
        rows, "phenotype string, row_id long, chr int, pos int, beta double, beta_se double, n_eff double, rsid string, a0 string, a1 string"
    )


def test_ld_blocks_are_closed(spark):
    ss = _summary(spark, [0.0] * 8)
    pairs = spark.createDataFrame([(1, 0, 2, 0.5), (1, 1, 2, 0.2), (1, 4, 5, 0.3)], "chr int, i long, j long, r double")
    got = {r.row_id: (r.block, r.k) for r in ldpred.ld_blocks(pairs, ss.select("row_id", "chr", "pos")).collect()}
    blocks = {i: b for i, (b, _) in got.items()}
    assert blocks[0] == blocks[1] == blocks[2] != blocks[3]
    assert blocks[4] == blocks[5] and len({blocks[i] for i in (3, 4, 6, 7)}) == 4
    assert [got[i][1] for i in range(8)] == [0, 1, 2, 0, 0, 1, 0, 0]


def test_auto_chains_find_the_signal(spark):
    hats = [0.3] + [0.0] * 9 + [0.15] + [0.0] * 9
    pairs = spark.createDataFrame([(1, 10, 11, 0.9)], "chr int, i long, j long, r double")
    h2 = spark.createDataFrame([("t", 0.1)], "phenotype string, h2 double")
    args = dict(p_init=[0.01, 0.2], burn_in=3, rounds=4, sweeps=25)
    effects, chains = ldpred.ldpred_auto(_summary(spark, hats), pairs, h2, **args)
    beta = effects.toPandas().pivot(index="row_id", columns="chain", values="beta_est")
    assert beta.shape == (20, 2)
    assert np.allclose(beta.loc[0], 0.3, atol=0.03)
    assert (beta.drop(index=[0, 10, 11]).abs() < 0.02).all().all()
    info = chains.orderBy("chain").collect()
    assert [len(r.path_p_est) for r in info] == [4, 4]
    assert all(0 < r.p_est < 1 and 0.05 < r.h2_est < 0.3 for r in info)
    again = ldpred.ldpred_auto(_summary(spark, hats), pairs, h2, **args)[0].toPandas()
    assert np.array_equal(beta.to_numpy(), again.pivot(index="row_id", columns="chain", values="beta_est").to_numpy())
    model = ldpred.auto_model(_summary(spark, hats), effects).toPandas()
    assert list(model.columns) == ["phenotype", "rsid", "chr", "pos", "effect_allele", "other_allele", "effect"]
    assert math.isclose(model.loc[model.rsid == "rs0", "effect"].iloc[0], 0.3, abs_tol=0.05)


def _plain_chains(hats, corr, h2, starts, sweeps, n=10_000.0):
    """One variant after the other, p and h2 moved after each sweep; mean effects of the second half."""
    rng, m = np.random.default_rng(5), len(hats)
    means = np.zeros((len(starts), m))
    for c, p in enumerate(starts):
        beta, h = np.zeros(m), h2
        for s in range(sweeps):
            for j in range(m):
                res = hats[j] - corr[j] @ beta + beta[j]
                c1 = h / (m * p) * n
                c2 = c1 / (1 + c1)
                post = 1 / (1 + (1 - p) / p * np.sqrt(1 + c1) * np.exp(-((c2 * res) ** 2) / (2 * c2 / n)))
                draw = c2 * res + np.sqrt(c2 / n) * rng.standard_normal() if rng.random() < post else 0.0
                beta[j] = 0.0 if draw * beta[j] < 0 else draw
                means[c, j] += c2 * res * post * (s >= sweeps // 2)
            p = max(rng.beta(1 + (beta != 0).sum(), 1 + (beta == 0).sum()), 1e-5)
            h = max(beta @ corr @ beta, 1e-3)
    return means.mean(0) / (sweeps - sweeps // 2)


def test_windows_settle_where_one_by_one_draws_do(spark):
    m = 24
    corr = np.array([[{0: 1.0, 1: 0.5, 2: 0.2}.get(abs(i - j), 0.0) for j in range(m)] for i in range(m)])
    true = np.zeros(m)
    true[[3, 4, 11, 12, 20]] = 0.2, 0.1, 0.15, -0.15, 0.05
    hats = corr @ true + np.linalg.cholesky(corr) @ np.random.default_rng(2).standard_normal(m) / 100
    pairs = spark.createDataFrame([(1, i, j, float(corr[i, j])) for i in range(m) for j in range(i + 1, min(m, i + 3))], "chr int, i long, j long, r double")
    h2 = spark.createDataFrame([("t", 0.1)], "phenotype string, h2 double")
    starts = [0.05, 0.1, 0.2, 0.3] * 4
    want = _plain_chains(hats, corr, 0.1, starts, 300)
    for window in (4, 64):
        effects, chains = ldpred.ldpred_auto(_summary(spark, hats), pairs, h2, p_init=starts, burn_in=4, rounds=4, sweeps=60, window=window)
        got = effects.toPandas().groupby("row_id").beta_est.mean().sort_index().to_numpy()
        assert np.abs(got - want).max() < 0.01, window
        assert all(0.05 < r.h2_est < 0.3 for r in chains.collect())


def test_colours_part_linked_variants():
    rng = np.random.default_rng(0)
    links = {(int(a), int(b)) for a, b in rng.integers(0, 60, (300, 2)) if a != b}
    both = sorted({(a, b) for a, b in links} | {(b, a) for a, b in links} | {(3, -2), (5, 70)})
    to, of = np.array(both).T
    shade = chains.colours(to, of, 60)
    assert all(shade[a] != shade[b] for a, b in links) and len(shade) == 60


def test_auto_job_ends_in_scores_and_heritability(spark):
    hats = [0.3] + [0.0] * 9
    pairs = spark.createDataFrame([(1, 0, 1, 0.5)], "chr int, i long, j long, r double")
    estimates = spark.createDataFrame([("t", float("nan"))], "phenotype string, h2 double")
    doses = spark.createDataFrame([(s, i, None if s == 2 and i == 0 else float((s + i) % 3)) for s in range(6) for i in range(10)], "iid long, row_id long, alt_dosage double")
    alleles = spark.createDataFrame([(i, "C") for i in range(10)], "row_id long, alt string")
    job = ldpred.auto_job(_summary(spark, hats), pairs, estimates, doses, alleles, p_init=[0.05, 0.2], burn_in=2, rounds=2, sweeps=20)
    told = job["heritability"].collect()
    assert len(told) == 2 and any(r.kept for r in told) and not any(r.h2_defined for r in told)
    effect = {r.rsid: r.effect for r in job["model"].collect()}
    # A missing dose of the first variant counts as its mode, the smallest of equally common ones.
    dose = {(s, i): float((s + i) % 3) for s in range(6) for i in range(10)} | {(2, 0): 0.0}
    for r in job["scores"].collect():
        assert math.isclose(r.score, sum(effect[f"rs{i}"] * dose[r.iid, i] for i in range(10)), abs_tol=1e-9)


def test_predict_long_equals_predict(spark):
    models = spark.createDataFrame([("a", ["r1", "r2"], [0.5, -1.0], 2.0)], "phenotype string, rsids array<string>, coef array<double>, intercept double")
    long = spark.createDataFrame([("a", 1, "r1", 2.0), ("a", 1, "r2", 1.0)], "phenotype string, iid long, rsid string, dosage double")
    design = spark.createDataFrame([("a", 1, [2.0, 1.0])], "phenotype string, iid long, x array<double>")
    assert scoring.predict_long(models, long, ["phenotype"]).first().yhat == 2.0
    assert scoring.predict(models, design, ["phenotype"]).first().yhat == 2.0


def test_cross_validation_prefers_the_ridge(spark):
    design, _ = _design(spark)
    w = spark.createDataFrame([("a", [1.0] * 6), ("b", [1.0] * 6)], "phenotype string, w array<double>")
    out = evaluation.cross_validate(design, w).toPandas()
    assert len(out) == 10 and (out.n_vars == 6).all()
    assert out.br_r2.mean() > out.uni_r2.mean() and out.br_r2.mean() > 0.5
    assert out["time"].notna().all()


@pytest.mark.parametrize("how", ["mode", "median", "mean"])
def test_fill_values(spark, how):
    df = spark.createDataFrame([(0, 1, 2, 5 / 6), (3, 3, 0, 0.25), (1, 1, 4, 0.75)], "n_hom_ref int, n_het int, n_hom_alt int, freq double")
    got = [r[0] for r in df.select(scoring.fill_value(how)).collect()]
    want = {"mode": [2.0, 0.0, 2.0], "median": [2.0, 0.5, 2.0], "mean": [5 / 3, 0.5, 1.5]}[how]
    assert np.allclose(got, want)


def test_windows_stay_in_place_between_rounds(spark, monkeypatch):
    """Of the state of the chains only the effects at the borders of windows move."""
    from traitloom.operators import chains as C

    n, width = 40, 8
    variants = spark.createDataFrame([(k, 1, 100 * k) for k in range(n)], "row_id long, chr int, pos int")
    pairs = spark.createDataFrame([(k, k + 1, 0.3) for k in range(n - 1)], "i long, j long, r double")
    stats = spark.createDataFrame([("t", k, 0.05 * (k % 3), 500.0, 1.0) for k in range(n)], "phenotype string, row_id long, hat double, n double, scale double")
    traits = spark.createDataFrame([("t", 0, 0)], "phenotype string, tb long, tl int")
    places, entries, reach = C.place_windows(pairs, variants, width)
    cells = C.window_cells(stats, places, traits, reach, width)
    static = C.kept_in_place(C.with_borders(cells, width), entries)
    hyper = spark.createDataFrame([(0, [0.1, 0.2], [0.3, 0.3], [n])], "tb long, p array<double>, h2 array<double>, m array<long>")
    empty = C.no_effects(cells, 2)
    state = [empty.where("w % 2 = 0"), empty.where("w % 2 = 1")]
    for step in range(2):
        for side in (0, 1):
            state[side] = C.sweep_windows(state[side], state[1 - side], static, hyper, 2, 3, True, False, 2 * step + side, 2.0 * side)
    seen = []
    monkeypatch.setattr(C, "cut_by", lambda df, *keys, **_: seen.append(df._jdf.queryExecution().executedPlan().toString()))
    C.sweep_windows(state[0], state[1], static, hyper, 2, 3, True, False, 4, 0.0)
    # The borders are gathered and go to their windows; neither the state, the cells nor the entries do.
    assert 1 <= seen[0].count("Exchange hashpartitioning") <= 2 and "REPARTITION" not in seen[0] and seen[0].count("Bucketed: true") == 3
    rows = state[0].unionByName(state[1]).collect()
    assert sorted(r["w"] for r in rows) == list(range(n // width))
    assert all(len(r["curr"]) == 4 * 2 * width and len(r["beta_sum"]) == 8 * 2 * width and len(r["causal"]) == 2 for r in rows)


def test_chain_check_counts_each_chain_and_variant(spark, monkeypatch):
    from traitloom.catalog import sumstat

    def job(effects):
        keys = "phenotype string, chain int"
        made = {
            "effects": spark.createDataFrame(effects, f"{keys}, row_id long, beta_est double, corr_est double"),
            "params": spark.createDataFrame([("t", 1, 0.1, 0.2), ("t", 30, 0.1, 0.2)], f"{keys}, p_est double, h2_est double"),
            "paths": spark.createDataFrame([("t", c, k) for c in (1, 30) for k in range(1, 11)], f"{keys}, path_iter int"),
            "heritability": spark.createDataFrame([("t", 1, True), ("t", 30, False)], f"{keys}, kept boolean"),
            "model": spark.createDataFrame([("t",), ("t",)], "phenotype string"), "scores": spark.createDataFrame([("t", 0.5)], "phenotype string, score double"),
        }
        passed = spark.createDataFrame([("t", 1), ("t", 2)], "phenotype string, row_id long")
        monkeypatch.setattr(sumstat, "auto_job", lambda *_: (passed, made))
        return tuple(sumstat.ldpred_auto_check(spark, "unused").first())

    whole = [("t", c, v, 0.1, 0.2) for c in (1, 30) for v in (1, 2)]
    assert job(whole) == ("t", 2, 2, 0, 1)
    assert job(whole[:-1]) == ("t", 2, 2, 1, 1)
    assert job([*whole[:-1], ("t", 30, 2, float("nan"), 0.2)]) == ("t", 2, 2, 1, 1)


def test_chains_and_scores_read_the_same_pairs(spark, monkeypatch):
    """The products of the panel are made once for the regression and the chains."""
    from traitloom.catalog import sumstat

    made, given = [], []
    pairs = spark.createDataFrame([(1, 1, 2, 0.5, 9)], "chr int, i long, j long, r double, n long")
    monkeypatch.setattr(sumstat, "panel_ld", lambda *_: made.append(1) or pairs)
    monkeypatch.setattr(sumstat, "heritability", lambda spark, sf, pairs=None: given.append(pairs) or (None, None))
    monkeypatch.setattr(sumstat, "view", lambda *_: pairs.withColumnRenamed("i", "row_id").withColumn("alt", F.lit("A")))
    monkeypatch.setattr(sumstat, "manifest", lambda *_: None)
    monkeypatch.setattr(sumstat.ldpred, "auto_job", lambda passed, ld, *_: given.append(ld) or {})
    sumstat.auto_job(spark, "unused")
    assert len(made) == 1 and given[0] is given[1] and [tuple(r) for r in given[0].collect()] == [(1, 1, 2, 0.5, 9)]
