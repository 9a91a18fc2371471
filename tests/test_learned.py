"""Fits on the cluster against numpy, laws of the fitted forecasters and of the rate selector, and models as tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import artefact, fit, learned


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + rng.normal(0, 0.3 + 0.3 * (x[:, 0] > 0), 3000)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "phi array<double>, y double").repartition(5).cache()
    df.count()
    return x, y, df


@pytest.mark.parametrize("lam", [0.0, 7.0])
def test_ridge_equals_numpy(regression, lam):
    x, y, df = regression
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    want = np.linalg.solve(a.T @ a + lam * np.diag([1.0] * 4 + [0.0]), a.T @ y)
    w, b = fit.ridge(df, 4, lam)
    assert np.abs(np.append(w, b) - want).max() < 1e-8
    gaps = df.unionByName(df.limit(5).withColumn("y", F.lit(None).cast("double")))
    assert np.abs(fit.ridge(gaps, 4, lam)[0] - want[:4]).max() < 1e-8
    assert fit.ridge(df.limit(0), 4, 1.0)[0].tolist() == [0.0] * 4


def test_slopes_are_those_of_the_loss():
    rng, q = np.random.default_rng(5), np.array(learned.LEVELS)
    phi, y, w, b = rng.normal(size=(40, 3)), rng.normal(size=40), rng.normal(size=(9, 3)), rng.normal(size=9)
    _, dw, db = fit.fan_loss(phi, y, w, b, q)
    for i, j in ((0, 1), (4, 2), (8, 0), (2, 2)):
        e = np.zeros_like(w)
        e[i, j] = 1e-6
        assert dw[i, j] == pytest.approx((fit.fan_loss(phi, y, w + e, b, q)[0] - fit.fan_loss(phi, y, w - e, b, q)[0]) / 2e-6, abs=1e-4)
    for i in range(9):
        e = np.eye(9)[i] * 1e-6
        assert db[i] == pytest.approx((fit.fan_loss(phi, y, w, b + e, q)[0] - fit.fan_loss(phi, y, w, b - e, q)[0]) / 2e-6, abs=1e-4)


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0]) + 0.1
    x, values = fit.lbfgs(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.array([5.0, 5.0, 5.0]), 100)
    assert x == pytest.approx(np.linalg.solve(a, np.ones(3)), abs=1e-4) and all(b <= c for b, c in zip(values[1:], values))


def test_refit_lowers_the_loss_and_its_quantiles_cover(regression):
    x, y, df = regression
    w, b, losses = fit.refit(df, 4, learned.LEVELS, 0.0, 25)
    assert losses[-1] < losses[0] and all(p >= q for p, q in zip(losses, losses[1:]))
    q = fit.fan(x @ w.T + b)
    assert (np.diff(q, axis=1) >= 0).all() and ((y[:, None] < q).mean(0) == pytest.approx(learned.LEVELS, abs=0.03))
    again = fit.refit(df, 4, learned.LEVELS, 0.0, 3, w, b)[2]  # from a given layer
    assert again[0] == pytest.approx(losses[-1])
    with pytest.raises(ValueError, match="nothing"):
        fit.refit(df.limit(0), 4, learned.LEVELS)


@pytest.fixture(scope="module")
def cuts(spark):
    rng, rows = np.random.default_rng(8), []
    for s in range(60):
        n = 24 * 8
        x = 10 + s % 7 + (2 + s % 3) * np.sin(2 * np.pi * (np.arange(n) + s) / 24) + rng.normal(0, 0.5, n)
        x[rng.random(n) < 0.03] = np.nan
        values = [None if np.isnan(v) else float(v) for v in x]
        rows.append((s, values[:-24], values[-24:]))
    return spark.createDataFrame(rows, "series long, context array<double>, target array<double>").repartition(4).cache()


def loss_of(rows):
    q, total = np.array(learned.LEVELS), []
    for r in rows:
        y = np.array([np.nan if v is None else v for v in r["target"]])
        e = y[:, None] - np.array(r["quantiles"])
        total.append(np.nanmean(np.maximum(q * e, (q - 1) * e)))
    return np.mean(total)


@pytest.mark.parametrize("patch", [1, 8])
def test_fitted_forecasters(spark, cuts, patch):
    model, losses = learned.fit(cuts.where("series % 2 = 0"), learned.frozen(), patch, lambda d: d.cache(), steps=15)
    held = learned.forecast(cuts.where("series % 2 = 1"), model, 24, patch).collect()
    naive = []
    for r in held:
        x = learned._filled(r["context"])
        naive.append({"target": r["target"], "quantiles": np.tile(np.resize(x[-24:], 24)[:, None], (1, 9))})
    assert losses[-1] <= losses[0] and loss_of(held) < 0.8 * loss_of(naive)
    # A forecast of 3 x + 5 is 3 times that of x, plus 5 (but for the little that keeps a scale above zero).
    wide = learned.forecast(cuts.withColumn("context", F.transform("context", lambda v: 3 * v + 5)), model, 24, patch).orderBy("series").collect()
    for a, b in zip(learned.forecast(cuts, model, 24, patch).orderBy("series").collect(), wide):
        assert 3 * np.array(a["quantiles"]) + 5 == pytest.approx(np.array(b["quantiles"]), abs=1e-3)
    # The blocks' convolutions are recurrences: step by step they read the same.
    x = learned._floats(cuts.first()["context"])
    fast = learned.features(x, 24, model, patch)[0]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(learned.rc, "s4d_fft", lambda u, a, b, c, dt, skip=0.0: learned.rc.s4d_steps(u, a, b, c, dt, skip)[0])
        assert fast == pytest.approx(learned.features(x, 24, model, patch)[0], abs=1e-9)


def test_rows_of_several_patches_in_one_pass(cuts):
    model = learned.frozen()
    for patch in (1, 8):
        model, _ = learned.fit(cuts, model, patch, lambda d: d.cache(), steps=2)
    both = learned.forecast(cuts.withColumn("p", F.when(F.col("series") % 2 == 0, 1).otherwise(8)), model, 24, "p").collect()
    for patch in (1, 8):
        alone = {r["series"]: r["quantiles"] for r in learned.forecast(cuts, model, 24, patch).collect()}
        assert all(r["quantiles"] == alone[r["series"]] for r in both if r["p"] == patch)
    with pytest.raises(Exception, match="no patches of 5"):
        learned.forecast(cuts, model, 24, 5).collect()
    none = cuts.limit(1).withColumn("context", F.lit(None).cast("array<double>"))
    assert learned.forecast(none, model, 24, 1).first()["quantiles"] is None


def season(x, h):
    return np.resize(x[-24:], h)


@pytest.fixture(scope="module")
def paced(spark):
    """Series whose season is 12, 24, 48 or 96 steps."""
    rng, rows = np.random.default_rng(2), []
    for s in range(160):
        p = (12, 24, 48, 96)[s % 4]
        x = 5 + np.sin(2 * np.pi * (np.arange(432) + s) / p) + 0.4 * np.sin(4 * np.pi * (np.arange(432) + s) / p) + rng.normal(0, 0.05, 432)
        rows.append((s, x[:384].tolist(), x[384:].tolist()))
    return spark.createDataFrame(rows, "series long, context array<double>, target array<double>").repartition(4).cache()


def test_rate_one_is_the_bare_forecast(paced):
    got = learned.select_rate(paced, season, 48, np.zeros(3)).collect()
    assert all(r["k"] == 1.0 and r["forecast"] == season(np.array(r["context"]), 48).tolist() for r in got)
    x = np.random.default_rng(1).normal(size=50)
    assert learned.resampled(x, 1.0) is x and learned.at_rate(season, x, 7, 0.0).tolist() == season(x, 7).tolist()
    assert learned.resampled(np.arange(8.0), 2.0).tolist()[-3:] == [2.5, 4.5, 6.5] and learned.resampled(np.arange(4.0), 0.5).tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3]


def test_selector_beats_every_fixed_rate_on_held_out_series(paced):
    curves = learned.loss_curves(paced.where("series % 8 < 4"), season).cache()
    weights, losses = learned.fit_selector(curves)
    held = paced.where("series % 8 >= 4")
    error = lambda rows: np.mean([np.abs(np.array(r["target"]) - np.array(r["forecast"])).mean() for r in rows])
    picked = learned.select_rate(held, season, 48, weights).collect()
    fixed = [error(learned.select_rate(held, season, 48, np.array([0.0, 0.0, np.log(k)]) if k != 1 else np.zeros(3)).collect()) for k in (0.5, 1, 2, 4)]
    assert losses[-1] <= losses[0] and error(picked) < 0.8 * min(fixed)


def test_selector_and_contexts_without_values(spark, paced):
    rows = [(1, [], [1.0]), (2, [None] * 30, [1.0]), (3, None, [1.0]), (4, [2.0] * 30, [2.0])]
    odd = spark.createDataFrame(rows, "series long, context array<double>, target array<double>")
    got = {r["series"]: r["forecast"] for r in learned.select_rate(odd, season, 3, np.array([1.0, 0.0, 0.0])).collect()}
    assert got[1] is None and got[3] is None and got[2] == [0.0] * 3 and got[4] == [2.0] * 3
    assert learned.loss_curves(odd, season).count() == 2


def test_model_round_trip(spark, tmp_path):
    path, m = str(tmp_path / "m"), learned.frozen() | {"odd": np.array([np.nan, -0.0, 1e-300, np.inf]), "none": np.zeros((0, 3)), "one": np.array(2.5)}
    assert artefact.save_model(spark, path, m) == 1 and artefact.save_model(spark, path, {"a": np.arange(3)}) == 2
    got = artefact.load_model(spark, path, {k: v.shape for k, v in m.items()}, version=1)
    assert all(np.array_equal(got[k], v, equal_nan=True) and got[k].shape == v.shape for k, v in m.items()) and np.signbit(got["odd"][1])
    assert artefact.load_model(spark, path)["a"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError, match="missing .'b'.*unexpected .'a'"):
        artefact.load_model(spark, path, {"b"})
    with pytest.raises(ValueError, match="other shapes"):
        artefact.load_model(spark, path, {"a": (4,)})
    with pytest.raises(ValueError, match="no version"):
        artefact.load_model(spark, path, version=7)
    with pytest.raises(ValueError, match="no version"):
        artefact.load_model(spark, str(tmp_path / "nothing"))


def test_damaged_models_are_refused(spark, tmp_path):
    def model(name, change):
        path = str(tmp_path / name)
        artefact.save_model(spark, path, {"a": np.arange(4.0), "b": np.ones((2, 2))})
        arrays = f"{path}/version=1/arrays"
        rows = change(spark.read.parquet(arrays)).collect()
        spark.createDataFrame(rows, artefact._ARRAYS).write.mode("overwrite").parquet(arrays)
        return path

    with pytest.raises(ValueError, match="have changed"):
        artefact.load_model(spark, model("changed", lambda d: d.withColumn("values", F.when(F.col("name") == "a", F.array(*(F.lit(float(x)) for x in (0, 1, 2, 4)))).otherwise(F.col("values")))))
    with pytest.raises(ValueError, match="1 arrays instead of the 2"):
        artefact.load_model(spark, model("missing", lambda d: d.where("name = 'a'")))
    with pytest.raises(ValueError, match="3 arrays instead of the 2"):
        artefact.load_model(spark, model("further", lambda d: d.union(d.where("name = 'a'"))))


def test_half_written_versions_do_not_exist(spark, tmp_path):
    path = str(tmp_path / "m")
    artefact.save_model(spark, path, {"a": np.arange(2.0)})
    (tmp_path / "m/version=2/arrays").mkdir(parents=True)  # a writer that failed
    assert artefact.load_model(spark, path)["a"].tolist() == [0, 1] and artefact.save_model(spark, path, {"a": np.arange(3.0)}) == 2
    twice = spark.createDataFrame([("a", [1], [1.0]), ("a", [1], [2.0])], "name string, shape array<int>, values array<double>")
    short = spark.createDataFrame([("a", [3], [1.0])], "name string, shape array<int>, values array<double>")
    for bad in (twice, short):
        with pytest.raises(ValueError):
            artefact.save_arrays(bad, path)
    assert len(artefact.load_model(spark, path)["a"]) == 3
