"""Models against dense oracles in numpy."""

import numpy as np
import pandas as pd
import pytest

from hedera.functions.errors import CollinearityError, MissingDataError
from hedera.functions.spec import HDFEConfig, fe
from hedera.operators import effects, linear, poisson, resampling, structure
from hedera.operators.grouped import group_ols
from hedera.operators.structure import categorical_rank


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(7)
    n = 400
    d = pd.DataFrame({"firm": rng.integers(0, 20, n), "year": rng.integers(0, 8, n), "z1": rng.standard_normal(n), "z2": rng.standard_normal(n), "x": rng.standard_normal(n), "t": rng.standard_normal(n)})
    d["cl"] = d.firm % 7
    u = rng.standard_normal(n)
    d["e1"] = 0.7 * d.z1 + 0.4 * d.z2 + 0.5 * u + rng.standard_normal(n)
    d["y"] = 1.5 * d.x + 0.5 * d.e1 + 0.1 * d.firm + 0.2 * d.year + u
    d["w"] = rng.integers(1, 4, n)
    d["count"] = rng.poisson(np.exp(0.3 * d.x + 0.05 * d.firm - 0.1 * d.year))
    return d


@pytest.fixture(scope="module")
def df(spark, panel):
    return spark.createDataFrame(panel).repartition(3).cache()


def dummies(*cols):
    out = [(c.to_numpy()[:, None] == np.unique(c)).astype(float) for c in cols]
    d = np.hstack(out)
    q, r = np.linalg.qr(d)
    return d[:, np.abs(np.diag(r)) > 1e-9]


def dense(y, x, d, w=None):
    w = np.ones(len(y)) if w is None else w
    s = np.sqrt(w)[:, None]
    p = lambda a: a - d @ np.linalg.lstsq(d * s, a * s, rcond=None)[0]
    yw, xw = p(y[:, None])[:, 0], p(x)
    bread = np.linalg.inv((xw * w[:, None]).T @ xw)
    b = bread @ xw.T @ (w * yw)
    return b, yw - xw @ b, xw, bread


def test_ols_two_way_cluster(df, panel):
    d = dummies(panel.firm, panel.year)
    b, e, xw, bread = dense(panel.y.to_numpy(), panel[["x", "e1"]].to_numpy(), d)
    r = linear.olshdfe(df, y="y", x=["x", "e1"], absorb=["firm", "year"], cluster=["cl"])
    assert np.allclose(r.coef, b, atol=1e-8)
    sums = pd.DataFrame(xw * e[:, None]).groupby(panel.cl.to_numpy()).sum().to_numpy()
    # firm lies in cl: it takes nothing; year loses one
    k = 2 + 7
    v = bread @ (sums.T @ sums) @ bread * (len(panel) - 1) / (len(panel) - k - 1) * 7 / 6
    assert np.allclose(r.vcov, v, rtol=1e-7) and r.df_resid == 6
    w = resampling.wild_cluster_test(r, param="x", reps=199)
    assert w.full_enumeration and len(w.draws) == 128 and 0 < w.pvalue <= 1
    r.release()
    m = linear.olshdfe(df, y="y", x=["x"], absorb=["firm", "year"], config=HDFEConfig(solver="map", tolerance=1e-6))
    s = linear.olshdfe(df, y="y", x=["x"], absorb=["firm", "year"])
    assert np.allclose(m.coef, s.coef, atol=1e-5)
    s.release()


def test_wild_draws_equal_refits(df, panel):
    """A draw from sums by cluster equals absorbing and regressing the draw's outcomes."""
    r = linear.olshdfe(df, y="y", x=["x", "e1"], absorb=["year"], cluster=["cl"])
    w = resampling.wild_cluster_test(r, param="x", reps=199)
    d = dummies(panel.year)
    x = panel[["x", "e1"]].to_numpy()
    b, e, xw, bread = dense(panel.y.to_numpy(), x, d)
    a = bread[:, [0]]
    b0 = b - (a * (b[0] / bread[0, 0]))[:, 0]
    yw = xw @ b + e
    u = yw - xw @ b0
    scale = (400 - 1) / (400 - r.notes["k"]) * 7 / 6
    stats = []
    for i in (3, 77):
        v = np.array([((i >> g) & 1) * 2.0 - 1 for g in range(7)])
        bs, es, _, _ = dense(xw @ b0 + u * v[panel.cl.to_numpy()], x, d)
        s = pd.Series((xw @ bread)[:, 0] * es).groupby(panel.cl.to_numpy()).sum()
        stats.append(bs[0] / np.sqrt(scale * (s**2).sum()))
    assert np.allclose(w.draws[[3, 77]], stats, rtol=1e-6)
    r.release()


def test_weights_and_slopes(df, panel):
    long = panel.loc[panel.index.repeat(panel.w)]
    one = linear.olshdfe(df, y="y", x=["x"], absorb=["firm"], weights="w", weight_type="fweight", vce="robust")
    b, e, xw, bread = dense(long.y.to_numpy(), long[["x"]].to_numpy(), dummies(long.firm))
    n = len(long)
    assert np.allclose(one.coef, b) and np.allclose(one.vcov, bread @ (xw * e[:, None] ** 2).T @ xw @ bread * n / (n - 21), rtol=1e-8)
    two = linear.olshdfe(df, y="y", x=["x"], absorb=[fe("firm", "t"), "year"])
    d = np.hstack([dummies(panel.firm), dummies(panel.firm) * panel.t.to_numpy()[:, None], dummies(panel.year)[:, 1:]])
    assert np.allclose(two.coef, dense(panel.y.to_numpy(), panel[["x"]].to_numpy(), d)[0], atol=1e-7)
    one.release(), two.release()


def test_iv_and_diagnostics(df, panel):
    r = linear.ivhdfe(df, y="y", exog=["x"], endog=["e1"], instruments=["z1", "z2"], absorb=["firm", "year"], vce="robust")
    d = dummies(panel.firm, panel.year)
    res = lambda a: a - d @ np.linalg.lstsq(d, a, rcond=None)[0]
    y, x, z = res(panel[["y"]].to_numpy()), res(panel[["x", "e1"]].to_numpy()), res(panel[["x", "z1", "z2"]].to_numpy())
    hat = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    b = np.linalg.solve(hat.T @ x, hat.T @ y)[:, 0]
    assert np.allclose(r.coef, b, atol=1e-8)
    e = y[:, 0] - x @ b
    bread = np.linalg.inv(hat.T @ hat)
    k = 2 + d.shape[1]
    assert np.allclose(r.vcov, bread @ (hat * e[:, None] ** 2).T @ hat @ bread * 400 / (400 - k), rtol=1e-7)
    s = (z * e[:, None]).T @ (z * e[:, None])
    g = z.T @ e
    assert r.diagnostics["overidentification"]["stat"] == pytest.approx(g @ np.linalg.solve(s, g), rel=1e-6)
    # With one endogenous regressor the Wald test is that of its first-stage coefficients.
    p = np.linalg.lstsq(z, x[:, 1], rcond=None)[0]
    zt = z[:, 1:] - z[:, :1] @ np.linalg.lstsq(z[:, :1], z[:, 1:], rcond=None)[0]
    v = (x[:, 1] - z @ p)[:, None] * zt
    spread = np.linalg.inv(zt.T @ zt) @ (v.T @ v) @ np.linalg.inv(zt.T @ zt)
    wald = r.diagnostics["underidentification"]["wald"]
    assert wald["statistic"] == pytest.approx(p[1:] @ np.linalg.solve(spread, p[1:]), rel=1e-6) and wald["df"] == 2 and wald["f"] > 10
    liml = linear.ivhdfe(df, y="y", exog=["x"], endog=["e1"], instruments=["z1", "z2"], absorb=["firm"], estimator="liml", diagnostics=False)
    assert liml.notes["kappa"] >= 1
    just = [linear.ivhdfe(df, y="y", exog=["x"], endog=["e1"], instruments=["z1"], absorb=["firm"], estimator=m, diagnostics=False).coef for m in ("2sls", "liml", "gmm2s")]
    assert np.allclose(just[0], just[1], atol=1e-6) and np.allclose(just[0], just[2], atol=1e-6)
    r.release(), liml.release()


def newton(y, x, d):
    a = np.hstack([x, d])
    b = np.zeros(a.shape[1])
    mu = (y + y.mean()) / 2 + 1e-3
    eta = np.log(mu)
    for _ in range(60):
        z = eta + (y - mu) / mu
        b = np.linalg.lstsq(a * np.sqrt(mu)[:, None], z * np.sqrt(mu), rcond=None)[0]
        eta = a @ b
        mu = np.exp(eta)
    return b[: x.shape[1]], mu, a


def test_ppml(df, panel):
    r = poisson.ppmlhdfe(df, y="count", x=["x"], absorb=["firm", "year"])
    b, mu, a = newton(panel["count"].to_numpy(float), panel[["x"]].to_numpy(), dummies(panel.firm, panel.year))
    assert np.allclose(r.coef, b, atol=1e-6)
    bread = np.linalg.inv((a * mu[:, None]).T @ a)
    s = a * (panel["count"].to_numpy() - mu)[:, None]
    v = (bread @ s.T @ s @ bread)[0, 0] * 400 / (400 - a.shape[1])
    assert r.vcov[0, 0] == pytest.approx(v, rel=1e-5)
    iv = poisson.ivppmlhdfe(df, y="count", endog=["x"], instruments=["x"], absorb=["firm", "year"])
    assert np.allclose(iv.coef, r.coef, atol=1e-6)
    r.release(), iv.release()


def test_ivppml_moments(df, panel):
    """With other instruments than the regressor: the instruments' moments vanish, as do those of all effects."""
    d = dummies(panel.firm, panel.year)
    r = poisson.ivppmlhdfe(df, y="count", exog=["x"], endog=["e1"], instruments=["z1"], absorb=["firm", "year"])
    a, z = np.hstack([panel[["x", "e1"]].to_numpy(), d]), np.hstack([panel[["x", "z1"]].to_numpy(), d])
    y, b = panel["count"].to_numpy(float), np.linalg.lstsq(d, np.log(panel["count"] + 0.5), rcond=None)[0]
    b = np.r_[0.0, 0.0, b]
    for _ in range(100):
        mu = np.exp(a @ b)
        b = b + 0.5 * np.linalg.solve(z.T @ (a * mu[:, None]), z.T @ (y - mu))
    assert np.abs(z.T @ (y - np.exp(a @ b))).max() < 1e-6
    assert np.allclose(r.coef, b[:2], atol=1e-5)
    r.release()


def test_separation(spark):
    d = spark.createDataFrame([(0.0, 1, 1), (1.0, 1, 1), (0.0, 2, 1), (0.0, 2, 2), (1.0, 2, 2)], "y double, a int, b int")
    assert poisson.fe_separated(d, ["a", "b"])[1] == 0
    x = np.array([[1.0, 0], [0, 1], [1, 1], [-1, 0]])
    assert poisson.separated_rows(x).tolist() == [False, True, False, False] or poisson.separated_rows(x).sum() >= 1


def test_recovered_effects(df, panel):
    r = linear.olshdfe(df, y="y", x=["x"], absorb=["firm", "year"])
    t = effects.recover(r).toPandas()
    got = {(a, b): c for a, b, c in zip(t.term, t.level, t.coef, strict=True)}
    fit = np.array([got["firm", str(f)] + got["year", str(y)] for f, y in zip(panel.firm, panel.year, strict=True)])
    b, e, _, _ = dense(panel.y.to_numpy(), panel[["x"]].to_numpy(), dummies(panel.firm, panel.year))
    assert np.allclose(fit, panel.y - panel.x * b[0] - e, atol=1e-7)
    assert abs(t[t.term == "year"].coef.mean()) < 1e-9 and t.identified.all()
    r.release()


def test_checks_and_collinearity(spark, df):
    with pytest.raises(MissingDataError):
        linear.olshdfe(spark.createDataFrame([(1.0, None, 1), (2.0, 1.0, 1)], "y double, x double, g int"), y="y", x=["x"], absorb=["g"])
    with pytest.raises(CollinearityError):
        linear.olshdfe(df, y="y", x=["x", "cl"], absorb=["firm"], collinearity="raise")
    r = linear.olshdfe(df, y="y", x=["x", "cl"], absorb=["firm"], collinearity="drop")
    assert r.names == ["x"] and r.omitted["cl"].startswith("absorbed_or_zero")
    r.release()


def test_structure(spark):
    d = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 2), (3, 3, 2)], "a int, b int, c int")
    kept, gone, rounds = structure.drop_singletons(d, ["a", "b"])
    assert gone == 1 and kept.count() == 6 and rounds == 1
    assert structure.n_components(d, "a", "b") == 3 and structure.n_components(d, "a", "b", most_edges=0) == 3
    assert structure.nested_within(d, "b", "c") and not structure.nested_within(d, "c", "b")


@pytest.mark.parametrize("seed", range(6))
def test_exact_rank(seed):
    rng = np.random.default_rng(seed)
    codes = [np.unique(rng.integers(0, k, 25), return_inverse=True)[1] for k in (6, 5, 4)]
    d = np.hstack([(c[:, None] == np.arange(c.max() + 1)).astype(float) for c in codes])
    assert categorical_rank(codes) == np.linalg.matrix_rank(d)
    assert categorical_rank(codes[:2]) == np.linalg.matrix_rank(d[:, : codes[0].max() + codes[1].max() + 2])


def test_groups_with_individuals(spark):
    rng = np.random.default_rng(3)
    rows, a = [], rng.standard_normal(15)
    for g in range(60):
        team = rng.choice(15, 3, replace=False)
        x, year = rng.standard_normal(), g % 4
        y = 2 * x + a[team].mean() + 0.3 * year + 0.1 * rng.standard_normal()
        rows += [(g, int(i), float(y), float(x), year) for i in team]
    r = group_ols(spark.createDataFrame(rows, "g int, i int, y double, x double, year int"), y="y", x="x", absorb=["i", "year"], group="g", individual="i")
    t = pd.DataFrame(rows, columns=["g", "i", "y", "x", "year"])
    one = t.groupby("g").first()
    d = np.zeros((60, 15))
    for g, i in zip(t.g, t.i, strict=True):
        d[g, i] += 1 / 3
    b = np.linalg.lstsq(np.hstack([one[["x"]], d, dummies(one.year)]), one.y, rcond=None)[0]
    assert r.coef[0] == pytest.approx(b[0], abs=1e-7) and r.n == 60


def test_streamed_moments(spark, tmp_path, panel):
    from hedera.streaming.moments import ols_from_moments, running_moments

    spark.createDataFrame(panel).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame(panel).schema).parquet(str(tmp_path / "in"))
    q = running_moments(stream, "firm", "y", ["x"]).writeStream.outputMode("complete").format("memory").queryName("mom").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = ols_from_moments(spark.table("mom"), 1)
    b, e, _, bread = dense(panel.y.to_numpy(), panel[["x"]].to_numpy(), dummies(panel.firm))
    assert np.allclose(got["coef"], b) and np.allclose(got["vcov"], bread * (e @ e) / (400 - 21))


def test_ranks_without_the_cells_on_the_driver(spark, monkeypatch):
    """Cells beyond what the driver takes are contracted on the cluster; only few arrive."""
    rng = np.random.default_rng(3)
    wide = pd.DataFrame({"a": rng.integers(0, 300, 2000), "b": rng.integers(0, 3, 2000), "t": rng.integers(0, 9, 2000)})
    apart = pd.DataFrame({"a": 1000 + np.arange(40) // 4, "b": 10 + np.arange(40) // 8, "t": 20 + np.arange(40) // 20})
    lone = pd.DataFrame({"a": 2000 + np.arange(60), "b": 30 + np.arange(60) % 7, "t": 40 + np.arange(60) % 11})
    p = pd.concat([wide, apart, lone], ignore_index=True)
    p["b"] = "b" + p.b.astype(str)
    brought = []
    collect = structure.collected_codes
    monkeypatch.setattr(structure, "collected_codes", lambda df, keys, *more: brought.append(df.count()) or collect(df, keys, *more))
    full = [np.hstack([(p[c].to_numpy()[:, None] == p[c].unique()).astype(float) for c in ["a", "b", "t"][:i]]) for i in (1, 2, 3)]
    assert structure.prefix_ranks(spark.createDataFrame(p), ["a", "b", "t"], most=150) == [np.linalg.matrix_rank(m) for m in full]
    assert max(brought) <= 150
    d = spark.createDataFrame(p)
    parts = {(x.a, x.component) for x in structure.component_table(d, "a", "b", most_edges=100).collect()}
    same = pd.DataFrame(structure.component_table(d, "a", "b").collect(), columns=["a", "component"])
    assert len(parts) == len(same) == p.a.nunique()
    assert len({c for _, c in parts}) == same.component.nunique()


@pytest.mark.parametrize("intercept", [True, False])
def test_slopes_of_one_term_write_no_rows(spark, monkeypatch, intercept):
    """A term's slopes are solved from its levels' moments: rows are never written, and levels without spread lose nothing."""
    from hedera.operators import absorb as a

    rng = np.random.default_rng(5)
    p = pd.DataFrame({"g": np.repeat(np.arange(12), 50), "z": rng.standard_normal(600) + 1000.0, "u": rng.standard_normal(600), "y": rng.standard_normal(600), "x": rng.standard_normal(600), "w": rng.integers(0, 4, 600).astype(float)})
    p.loc[p.g == 3, "z"] = 0.1
    p.loc[p.g == 4, "u"] = 3 * p.z[p.g == 4]
    sizes = []
    keep = a.written
    monkeypatch.setattr(a, "written", lambda df: sizes.append(df.count()) or keep(df))
    term = a.Term("g", intercept, ("z", "u"))
    got = a.absorb(spark.createDataFrame(p), [term], ["y", "x"], "w").frame.toPandas()
    assert max(sizes) <= 12
    for _, d in got.groupby("g"):
        m = d[["z", "u"]].to_numpy()
        m = np.c_[np.ones(50), m - m.mean(axis=0)] if intercept else m
        s = np.sqrt(d.w.to_numpy())[:, None]
        v = d[["y", "x"]].to_numpy()
        b = np.linalg.lstsq(m * s, v * s, rcond=1e-10)[0]
        assert np.allclose((d[["_r_y", "_r_x"]].to_numpy() - (v - m @ b)) * s, 0, atol=1e-6)
