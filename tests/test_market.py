"""Behaviour of features, estimators, engine, panel, scores and re-tests."""

import datetime as dt
import inspect
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratabar.functions import calendar, features, numerics
from stratabar.operators import audit, chains, decision, factored, online, panel, recovery, redundancy, report, retest, rules, walkforward
from stratabar.plans import catalogue, cli
from stratabar.sources import bars, config, registry, simulate

FAST = ["ma_cross", "return_sign", "ewma_slope", "always_range", "hmm_gaussian", "cusum", "bocpd", "kalman_trend", "ms_regression"]


@pytest.fixture(scope="module")
def market():
    return simulate.market(1200, seed=3)


@pytest.fixture(scope="module")
def feats(spark, market):
    df = spark.createDataFrame(market.assign(symbol="sim")[["symbol", "date", "open", "high", "low", "close", "volume"]], bars.BARS)
    return features.build(df).orderBy("date").toPandas()


def panel_bars(spark):
    days = pd.bdate_range("2020-01-01", periods=400).date
    rng = np.random.default_rng(0)
    rows = []
    for s in "ABC":
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))
        rows += [(s, d, c, c, c, c, 1e6) for i, (d, c) in enumerate(zip(days, close.tolist(), strict=True)) if s != "C" or i not in (10, 11, 12)]
    return spark.createDataFrame(rows, bars.BARS)


# -- no look-ahead --------------------------------------------------------------
def test_features_match_pandas_and_see_no_future(spark, market, feats):
    close = pd.Series(market["close"])
    ret = np.log(close).diff()
    assert np.allclose(feats["rv20"], ret.rolling(20).std() * np.sqrt(252), equal_nan=True, atol=1e-10)
    assert np.allclose(feats["ma_spread"], close.rolling(50).mean() / close.rolling(200).mean() - 1, equal_nan=True, atol=1e-10)
    cut = features.build(spark.createDataFrame(market.assign(symbol="sim").iloc[:900][["symbol", "date", "open", "high", "low", "close", "volume"]], bars.BARS)).orderBy("date").toPandas()
    for c in features.FEATURES:
        assert np.allclose(cut[c].astype(float), feats[c].iloc[:900].astype(float), atol=1e-10, equal_nan=True), c


@pytest.mark.parametrize("name", FAST)
def test_estimators_see_no_future_and_keep_the_contract(feats, name):
    est = walkforward.estimator(name)
    est.fit(feats.iloc[:700])
    whole, part = est.states(feats), est.states(feats.iloc[:900])
    p = whole[["p_down", "p_range", "p_up"]].to_numpy(dtype=float)
    assert np.allclose(p[:900], part[["p_down", "p_range", "p_up"]].to_numpy(dtype=float), atol=1e-8, equal_nan=True)
    full = np.isfinite(p).all(axis=1)
    assert full.sum() > 600 and np.allclose(p[full].sum(axis=1), 1, atol=1e-6)
    assert set(whole["map_state"].dropna()) <= set(rules.STATES)
    assert np.nanmax(np.abs(whole["score"].to_numpy(dtype=float))) <= 1 + 1e-9


def test_warm_up_rows(feats):
    first = walkforward.estimator("ma_cross").states(feats).iloc[0]
    assert first["map_state"] == "range" and abs(first["p_range"] - 0.477) < 1e-3
    assert walkforward.estimator("kalman_trend").states(feats)["map_state"].iloc[:20].isna().all()
    assert walkforward.estimator("ms_regression").states(feats.iloc[:400])["map_state"].isna().all()


# -- chains, filters, numerics ------------------------------------------------------
def plain_forward(emit, move, start):
    alpha, out, like = start * emit[0], [], 0.0
    for t in range(len(emit)):
        if t:
            alpha = (alpha @ move) * emit[t]
        like += math.log(alpha.sum())
        alpha = alpha / alpha.sum()
        out.append(alpha)
    return np.array(out), like


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_chain_passes_match_the_plain_recursion(n):
    rng = np.random.default_rng(n)
    emit, move = rng.random((2, n, 3)) + 0.01, rng.random((2, 3, 3))
    move /= move.sum(axis=2, keepdims=True)
    start = np.full((2, 3), 1 / 3)
    alpha, beta, like = numerics.chain_passes(emit, move, start)
    for r in range(2):
        a, ll = plain_forward(emit[r], move[r], start[r])
        assert np.allclose(alpha[r], a) and math.isclose(like[r], ll, rel_tol=1e-9)
        b = np.ones(3)
        for t in range(n - 1, -1, -1):
            assert np.allclose(beta[r, t] / beta[r, t].sum(), b / b.sum())
            b = move[r] @ (emit[r, t] * b)


def test_training_raises_likelihood_and_orders_states():
    x = np.concatenate([np.random.default_rng(0).normal(m, s, 400) for m, s in ((-2, 1), (0, 0.3), (2, 1))])[:, None]
    chain = chains.GaussianChain(3).fit(x)
    assert (np.diff(chain.mean[:, 0]) > 0).all() and np.allclose(chain.mean[:, 0], [-2, 0, 2], atol=0.4)
    assert chain.parameters == 12 and factored.parameters(3) == {"factored": 24, "flat": 108}


def test_switching_finds_volatility_regimes():
    rng = np.random.default_rng(1)
    y = np.concatenate([rng.normal(0.001, 0.005, 500), rng.normal(-0.003, 0.03, 500)])
    p = chains.SwitchingAR().fit(y).filtered(y)
    assert np.nanmean(p[600:].argmax(axis=1) == p[800].argmax()) > 0.8


def test_kalman_fit_improves_and_stays_in_bounds(feats):
    y = np.log(feats["close"].to_numpy(dtype=float))
    k = online.KalmanTrend()
    k.fit(y)
    before = online.trend_filter(y, 1e-5, k.q_slope, 1e-4)[2]
    assert online.trend_filter(y, k.q_level, k.q_slope, k.r)[2] >= before
    assert 1e-10 <= k.q_level <= 1e-1 and 1e-10 <= k.r <= 1e-1


def test_cusum_and_change_points():
    z = np.concatenate([np.zeros(50), np.full(50, 2.0), np.full(50, -2.0)])
    declared, evidence = online.cusum_run(z, 0.5, 5.0)
    assert declared[40] == 1 and declared[80] == 2 and declared[-1] == 0 and (evidence <= 1).all()
    y = np.concatenate([np.random.default_rng(0).normal(m, 0.01, 150) for m in (0.0, 0.02)])
    s = online.ChangePoints().states(y)
    assert s["score"][280] > 0.9 and np.isfinite(s["score"]).all()


def test_logistic_optimum_and_folds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    th = numerics.logistic_fit(x, y)
    p = 1 / (1 + np.exp(-(x @ th[:2] + th[2])))
    assert np.allclose(th[:2] + x.T @ (p - y), 0, atol=1e-6) and abs((p - y).sum()) < 1e-6
    assert numerics.split_folds(103, 5, 5) == [(13, 18, 35), (30, 35, 52), (47, 52, 69), (64, 69, 86), (81, 86, 103)]


def test_hac_and_empirical_size():
    rng = np.random.default_rng(0)
    e = rng.normal(size=3000)
    slow = np.convolve(e, np.ones(10), "valid") / 10 + 0.02
    assert abs(numerics.hac_t(slow, 9)) < abs(numerics.hac_t(slow, 0)) / 2
    hits = sum(abs(numerics.hac_t(np.random.default_rng(s).normal(size=500), 5)) > 1.96 for s in range(60))
    assert hits / 60 < 0.20
    assert math.isclose(numerics.two_sided_p(1.96), 0.05, abs_tol=1e-3)


# -- engine -----------------------------------------------------------------------
def test_walk_forward_blocks(spark, feats):
    engine = config.Engine(min_train=300, refit_every=200, embargo=5, warmup=300, max_train=400)
    assert walkforward.folds(650, engine) == [(300, 500, 0, 295, 0), (500, 650, 95, 495, 200)]
    df = spark.createDataFrame(feats[["date", "ret", "rv20", "close"]].assign(symbol="sim"))
    out = walkforward.sweep(spark, df, ["cusum", ("hmm_gaussian", {"starts": 2}), "return_sign"], engine).toPandas()
    assert set(out["method"]) == {"cusum", "hmm_gaussian", "return_sign"} and out["error"].isna().all()
    one = out[out["method"] == "hmm_gaussian"].sort_values("date")
    assert one["map_state"].iloc[:300].isna().all() and one["map_state"].iloc[300:].notna().all()


@pytest.mark.parametrize(("name", "most", "least"), [("hmm_gaussian", 0.02, 0.97), ("bocpd", 0.02, 0.97), ("kalman_trend", 1e-12, 1.0)])
def test_bounded_replay_is_close_to_full(feats, name, most, least):
    short, full = (walkforward.run_one(feats, walkforward.estimator(name), config.Engine(min_train=600, refit_every=150, warmup=w, max_train=600)) for w in (750, 0))
    a, b = (x[["p_down", "p_range", "p_up"]].to_numpy(dtype=float) for x in (short, full))
    ok = np.isfinite(a).all(axis=1) & np.isfinite(b).all(axis=1)
    assert ok.sum() > 100 and np.abs(a[ok] - b[ok]).mean() <= most and (short["map_state"][ok] == full["map_state"][ok]).mean() >= least


def test_failing_pairs_are_reported(spark, feats):
    df = spark.createDataFrame(feats[["date", "ret", "rv20", "close"]].head(100).assign(symbol="short"))
    out = walkforward.sweep(spark, df, ["cusum"]).collect()
    assert len(out) == 1 and "rows" in out[0]["error"] and walkforward.results(walkforward.sweep(spark, df, ["cusum"])).count() == 0
    with pytest.raises(KeyError):
        walkforward.sweep(spark, df, ["nothing"])
    with pytest.raises(KeyError):
        walkforward.register("cusum", lambda: None)


# -- sources --------------------------------------------------------------------------
def test_registry():
    assert registry.lookup("nas100")["ticker"] == "^NDX" and registry.lookup("zzz")["ticker"] == "ZZZ"
    assert registry.chosen("indices") == ["NAS100", "US500", "US30"] and registry.chosen(["a"]) == ["A"] and [registry.lookup(n)["registered"] for n in ("aapl", "b")] == [True, False]
    with pytest.raises(KeyError):
        registry.chosen("none")
    assert registry.lookup("VIX")["asset_class"] == "volatility" and registry.lookup("q")["asset_class"] == "unregistered"


def test_intervals_and_weeks(spark):
    assert calendar.interval(" Weekly ").periods_per_year == 52 and calendar.interval(None).key == "1d"
    with pytest.raises(ValueError):
        calendar.interval("hourly")
    day = dt.date(2024, 1, 3)
    df = spark.createDataFrame([("A", day + dt.timedelta(days=i), 1.0 * i, 2.0, 0.5, 1.0 + i, 10.0) for i in range(7)], bars.BARS)
    got = calendar.weekly(df).orderBy("date").collect()
    assert [r["date"] for r in got] == [dt.date(2024, 1, 5), dt.date(2024, 1, 12)]
    assert (got[0]["open"], got[0]["close"], got[0]["volume"]) == (0.0, 3.0, 30.0) and got[0]["last_bar_partial"]
    with pytest.raises(Exception, match="daily bars only"):
        calendar.require_daily(calendar.at(df, "weekly"), "test").collect()
    assert calendar.require_daily(calendar.at(df, "daily"), "test").count() == 7
    with pytest.raises(Exception, match="daily bars only"):
        decision.targets(features.build(calendar.at(df, "weekly"))).collect()


def test_cache_falls_back_to_csv(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 10.0)], bars.BARS)
    assert bars.cache(df, str(tmp_path), "A").endswith("A.parquet") and spark.read.parquet(f"{tmp_path}/cache/A.parquet").count() == 1
    monkeypatch.setattr(bars, "write", lambda *a: 1 / 0)
    assert bars.cache(df, str(tmp_path), "B").endswith("B.csv") and spark.read.option("header", True).csv(f"{tmp_path}/cache/B.csv").first()["close"] == "1.5"


def test_custom_rules_are_window_expressions(spark, simfeats):
    got = walkforward.sweep(spark, simfeats, [("ma_cross", {"fast": 10, "slow": 40})])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "run(" not in plan  # the grouped function of fitted methods
    f = simfeats.where("symbol = 'sim0'").orderBy("date").toPandas()
    want = walkforward.estimator("ma_cross", fast=10, slow=40).states(f)["score"].to_numpy()
    mine = got.where("symbol = 'sim0'").orderBy("date").toPandas()["score"].to_numpy(dtype=float)
    assert np.allclose(want, mine, equal_nan=True, atol=1e-9)


def test_sources_in_order(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\nbad,1,1,1,1,1\n2024-01-03,1,2,0.5,x,10\n2024-01-04,2,3,1,2.5,20\n")
    got = bars.load(spark, "aaa", str(tmp_path)).orderBy("date").collect()
    assert [r["close"] for r in got] == [1.5, 2.5] and got[0]["source"] == bars.COMMITTED
    bars.write(spark.createDataFrame([("AAA", dt.date(2024, 2, 1), 1.0, 1.0, 1.0, 9.0, 1.0)], bars.BARS), f"{tmp_path}/cache/AAA.parquet")
    assert bars.load(spark, "AAA", str(tmp_path), fresh=True).first()["source"] == bars.CACHED
    with pytest.raises(ValueError):
        bars.load(spark, "AAA", str(tmp_path), start="2030-01-01")
    with pytest.warns(UserWarning):
        assert bars.load_universe(spark, ["AAA", "BBB"], str(tmp_path)).count() == 2
    with pytest.raises(RuntimeError), pytest.warns(UserWarning):
        bars.load_universe(spark, ["BBB"], str(tmp_path))
    with pytest.raises(ValueError):
        bars.tidy(spark.createDataFrame([(1,)], "Date int"), "A")


def vendor_rows(ticker, start=None, end=None):
    yield (ticker, dt.date(2024, 1, 2), 1.0, 1.0, 1.0, 7.0, 1.0)


def test_vendor_download_fills_the_cache(spark, tmp_path):
    got = bars.load(spark, "NAS100", str(tmp_path), download=True, fetch="tests.test_market:vendor_rows").first()
    assert got["source"] == bars.VENDOR and got["close"] == 7.0 and got["symbol"] == "NAS100"
    assert bars.load(spark, "NAS100", str(tmp_path)).first()["source"] == bars.CACHED
    with pytest.raises(ValueError):
        bars.load(spark, "US30", str(tmp_path), download=True)


def test_config(tmp_path):
    path = tmp_path / "e.yaml"
    path.write_text("name: t\nuniverse: indices\nstart: '2010-01-01'\nend: null\nmethods:\n  - ma_cross\n  - {name: cusum, params: {shift: 30}}\nengine: {min_train: 500}\noutput: out\n")
    e = config.read(str(path))
    assert e.methods == ["ma_cross", ("cusum", {"shift": 30})] and e.engine.min_train == 500 and e.engine.embargo == 5 and e.end is None


# -- audit and panel ----------------------------------------------------------------
def test_audit(spark):
    df = panel_bars(spark)
    late = df.where((F.col("symbol") != "B") | (F.col("date") < "2021-01-01"))
    rep = audit.report(spark, late)
    kinds = {(r["symbol"], r["kind"]) for r in audit.warnings_of(spark, rep).collect()}
    assert ("B", "late") in kinds and ("A", "short") in kinds and ("A", "unregistered") in kinds
    assert audit.search_space(7, 1, 8, 3) == {"comparisons": 168, "deflated_bar": pytest.approx(3.2012, abs=1e-3)} and audit.search_space(1, 1, 1, 1)["deflated_bar"] == 0
    assert {r["symbol"] for r in audit.span_mismatch(late).collect()} == {"B"}


def test_panel_alignment_never_pads(spark):
    df = panel_bars(spark)
    assert panel.shared_dates(df).count() == 397 and panel.shared_dates(df, "union").count() == 400
    union = panel.returns(df, "union").where("symbol = 'C'").orderBy("date").toPandas()["ret"]
    assert union.isna().sum() == 5  # the first, three missing, and the one after
    b = panel.breakdown(df).first()
    assert (b["leading"], b["trailing"], b["interior"], b["kept"]) == (0, 0, 3, 397)
    assert {(r[0], r[1]) for r in panel.blame(df).collect()} == {("C", 3)}
    edge = df.where((F.col("symbol") != "B") | ((F.col("date") >= "2020-02-03") & (F.col("date") < "2021-01-01")))
    e = panel.breakdown(edge).first()
    assert e["leading"] > 0 and e["trailing"] > 0
    with pytest.raises(ValueError):
        panel.shared_dates(df, "other")
    assert panel.notes(edge).count() == 1 and panel.load(df).symbols == ["A", "B", "C"]


def test_absorption_of_equal_and_independent_series(spark):
    rng = np.random.default_rng(0)
    days = pd.bdate_range("2020-01-01", periods=300).date
    x = rng.normal(size=(300, 2))
    same = spark.createDataFrame([(s, d, float(v)) for s in "AB" for d, v in zip(days, x[:, 0], strict=True)], "symbol string, date date, ret double")
    apart = spark.createDataFrame([(s, d, float(v)) for i, s in enumerate("AB") for d, v in zip(days, x[:, i], strict=True)], "symbol string, date date, ret double")
    one, half = (panel.absorption_ratio(r).orderBy("date").toPandas()["absorption"].astype(float) for r in (same, apart))
    assert one.isna().sum() == 251 and np.allclose(one.dropna(), 1) and half.dropna().max() < 0.65


def brute_absorption(rets, window=252):
    """Squared singular values of each date's standardised window of complete rows."""
    wide = rets.toPandas().pivot(index="date", columns="symbol", values="ret").sort_index().astype(float)
    out = pd.Series(np.nan, index=wide.index)
    for t in range(len(wide)):
        part = wide.iloc[max(0, t - window + 1) : t + 1].dropna()
        if len(part) >= window and len(wide.columns) > 1:
            v = np.linalg.svd(((part - part.mean()) / part.std()).to_numpy(), compute_uv=False) ** 2
            out.iloc[t] = v[0] / v.sum()
    return out


def test_absorption_of_all_symbols_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rets = panel.returns(catalogue.daily(spark, sf))
    assert rets.select("symbol").distinct().count() == 6
    got = catalogue.QUERIES["absorption_ratio"](spark, sf).toPandas().set_index("date")["absorption"].astype(float).sort_index()
    want = brute_absorption(rets)
    assert list(got.index) == list(want.index) and want.notna().sum() > 1000 and np.allclose(got, want, atol=1e-7, equal_nan=True)


def test_absorption_of_two_symbols_is_closed_form(spark):
    rng = np.random.default_rng(1)
    days = pd.bdate_range("2020-01-01", periods=300).date
    x = rng.normal(size=(300, 2)) @ np.array([[1.0, 0.6], [0.0, 0.8]])
    rets = spark.createDataFrame([(s, d, float(v)) for i, s in enumerate("AB") for d, v in zip(days, x[:, i], strict=True)], "symbol string, date date, ret double")
    got = panel.absorption_ratio(rets).orderBy("date").toPandas()["absorption"].astype(float).to_numpy()
    assert np.allclose(got[251:], [(1 + abs(np.corrcoef(x[t - 251 : t + 1].T)[0, 1])) / 2 for t in range(251, 300)])


# -- decision, recovery, redundancy, retests ------------------------------------------
@pytest.fixture(scope="module")
def sims(spark):
    return simulate.markets(spark, 2, 900).persist()


@pytest.fixture(scope="module")
def simfeats(sims):
    return features.build(sims).persist()


def truth_states(sims):
    s = F.col("true_state")
    p = lambda k: F.when(s == k, 0.9).otherwise(0.05)
    name = F.when(s == 0, "down").when(s == 1, "range").otherwise("up")
    return sims.select("symbol", "date", F.lit("oracle").alias("method"), p(0).alias("p_down"), p(1).alias("p_range"), p(2).alias("p_up"), name.alias("map_state"), (p(2) - p(0)).alias("score"))


def test_perfect_states_are_recovered(spark, sims):
    r = recovery.metrics(spark, truth_states(sims), sims).first()
    assert r["accuracy"] == 1 and r["balanced_accuracy"] == 1 and math.isclose(r["ari"], 1) and r["median_delay"] == 0 and r["detection_rate"] == 1 and r["false_alarms_pa"] == 0
    flat = rules.always_range(sims.select("symbol", "date")).withColumn("method", F.lit("always_range"))
    z = recovery.metrics(spark, flat, sims).first()
    assert abs(z["ari"]) < 1e-9 and z["detection_rate"] == 0


def test_recovery_is_registered_whole(spark, monkeypatch):
    run = inspect.signature(recovery.run)
    monkeypatch.setattr(recovery, "run", lambda *a, **k: (bound := run.bind(*a, **k)).apply_defaults() or bound.arguments)
    got = catalogue.QUERIES["run_recovery"](spark, "")
    assert (got["seeds"], got["n"], got["methods"]) == (8, 2500, walkforward.methods()) and set(FAST) <= set(got["methods"])


def test_targets_and_calibration(spark, sims, simfeats):
    t = decision.targets(simfeats).toPandas()
    assert set(t["direction"].dropna()) == {0.0, 1.0} and t.groupby("symbol")["direction"].apply(lambda s: s.isna().sum()).min() >= 5
    # a forecaster that is right two times in three about direction
    right = (F.col("direction") == 1) == (F.dayofyear("date") % 3 > 0)
    told = decision.targets(simfeats).where("direction is not null").select("symbol", "date", F.lit("seer").alias("method"), F.when(right, 0.1).otherwise(0.8).alias("p_down"), F.lit(0.1).alias("p_range"), F.when(right, 0.8).otherwise(0.1).alias("p_up"))
    rows = decision.scored(told, simfeats)
    grid = decision.deflated(decision.calibration_gain(rows)).toPandas()
    assert set(grid["target"]) <= set(decision.TARGETS) and len(grid) >= 4
    assert grid[grid["target"] == "direction"]["brier_delta"].mean() < -0.01
    assert (grid["t_threshold"] > 0).all() and grid["p_fdr"].between(0, 1).all()


def test_overlay_only_cuts_risk(sims, simfeats):
    grid, risk = decision.decision_value(truth_states(sims), simfeats, common=True)
    r = risk.toPandas().set_index(["symbol", "strategy"])
    for s in {i[0] for i in r.index}:
        assert r.loc[(s, "vol_target_x_state"), "ann_vol"] <= r.loc[(s, "vol_target"), "ann_vol"] and r.loc[(s, "buy_and_hold"), "turnover_pa"] < 1
    assert grid.count() > 0


def signals_of(spark, columns):
    days = pd.bdate_range("2020-01-01", periods=len(columns[0])).date
    return spark.createDataFrame([("S", d, f"m{j}", float(v)) for j, c in enumerate(columns) for d, v in zip(days, c, strict=True)], "symbol string, date date, method string, score double")


def test_effective_number(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 600))
    assert math.isclose(redundancy.effective_number(signals_of(spark, [x[0]] * 4)).first()["effective_n"], 1, rel_tol=1e-6)
    assert redundancy.effective_number(signals_of(spark, x)).first()["effective_n"] > 3.7
    parts = redundancy.decomposed(signals_of(spark, x)).where("consensus is not null").groupBy("date").agg(F.sum("idio").alias("s")).agg(F.max(F.abs("s"))).first()[0]
    assert parts < 1e-9 and redundancy.loadings(redundancy.decomposed(signals_of(spark, x))).count() == 4


def test_gate_and_verdict(spark, sims, simfeats):
    days = sims.select("symbol", "date", "true_state")
    sig = truth_states(sims).select("symbol", "date", "method", "score").unionByName(days.select("symbol", "date", F.lit("noise").alias("method"), F.sin(F.dayofyear("date") * 12.9).alias("score")))
    grid = redundancy.gate(sig, simfeats)
    assert {r[0] for r in grid.select("variant").distinct().collect()} == {"consensus", "idio_oracle", "idio_noise", "idio_all", "consensus_plus_idio"}
    assert redundancy.verdict(grid).count() == 1


def check_move_retest(got, states, feats):
    """Every number of the re-test from the rule as told: drop rows without a rate first, then split."""
    seen = 0
    for symbol, f in feats.groupby("symbol"):
        f = f.sort_values("date").reset_index(drop=True)
        f["y"] = (f["ret"].shift(-1) < retest.MOVE).astype(float).where(f["ret"].shift(-1).notna())
        rates = np.full(len(f), np.nan)
        rv, y = f["rv20"].to_numpy(dtype=float), f["y"].to_numpy(dtype=float)
        for t in range(750, len(f)):
            known = np.isfinite(rv[:t]) & np.isfinite(y[:t])
            if known.sum() >= 100 and np.isfinite(rv[t]):
                past, hit = rv[:t][known], y[:t][known]
                third = np.searchsorted(np.quantile(past, [1 / 3, 2 / 3]), np.append(past, rv[t]), side="left")
                same = hit[third[:-1] == third[-1]]
                rates[t] = same.mean() if len(same) >= 20 else hit.mean()
        f["rate"] = rates
        rows = f.merge(states[states["symbol"] == symbol], on=["symbol", "date"], suffixes=("", "_s")).dropna(subset=["rv20", "rv60", "y", "rate", *decision.PROBS])
        mine = got[got["symbol"] == symbol].set_index("versus")
        if len(rows) < 300 or rows["y"].nunique() < 2:
            assert mine.empty
            continue
        x, y = rows[["rv20", "rv60", *decision.PROBS]].to_numpy(dtype=float), rows["y"].to_numpy()
        p = {"state": numerics.forward_probabilities(x, y, 5, 1), "volatility": numerics.forward_probabilities(x[:, :2], y, 5, 1), "tercile": rows["rate"].to_numpy()}
        ok = np.isfinite(p["state"]) & np.isfinite(p["volatility"])
        if ok.sum() < 200:
            assert mine.empty
            continue
        loss = {k: (np.clip(v[ok], 1e-6, 1 - 1e-6) - y[ok]) ** 2 for k, v in p.items()}
        for versus in ("tercile", "volatility"):
            r, seen = mine.loc[versus], seen + 1
            assert r["n"] == ok.sum() and np.isclose(r["base_rate"], y[ok].mean())
            assert np.allclose([r["brier_state"], r["brier_versus"], r["brier_delta"]], [loss["state"].mean(), loss[versus].mean(), (loss["state"] - loss[versus]).mean()])
            assert np.isclose(r["t_stat"], numerics.hac_t(loss["state"] - loss[versus], 1))
    assert seen


def test_common_dates_hold_for_risk_too(sims, simfeats):
    full = truth_states(sims)
    late = full.where("date >= '2011-06-01'").withColumn("method", F.lit("late"))
    _, risk = decision.decision_value(full.unionByName(late), simfeats, common=True)
    n = risk.where("strategy = 'buy_and_hold'").groupBy("symbol").agg(F.count_distinct("n").alias("k"), F.count("*").alias("m")).toPandas()
    assert len(n) and (n["k"] == 1).all() and (n["m"] == 2).all()


def test_ruin_is_seen(spark):
    rows = spark.createDataFrame([("S", dt.date(2024, 1, 1) + dt.timedelta(days=i), r, 1.0, 0.0) for i, r in enumerate([0.1, -1.5, 0.2])], "symbol string, date date, r double, w double, cost_bps double")
    assert math.isclose(decision.performance(rows, ["symbol"]).first()["max_drawdown"], -1.6, rel_tol=1e-9)


def test_short_series_have_no_state(monkeypatch):
    y = np.random.default_rng(0).normal(0, 0.01, 900)
    assert np.isnan(chains.SwitchingAR().fit(y).filtered(y[:50])).all() and np.isfinite(chains.SwitchingAR().fit(y).filtered(y[:60])[1:]).all()
    fitted = chains.SwitchingAR().fit(y)
    monkeypatch.setattr(chains, "chain_passes", lambda emit, *a, **k: (emit, emit, np.array([np.nan])))
    assert fitted.beta is not None and fitted.fit(y).beta is None  # a failed fit leaves no model


def test_move_retest_values(spark):
    long = simulate.markets(spark, 1, 1700).persist()
    feats = features.build(long).persist()
    check_move_retest(retest.move_retest(truth_states(long), feats).toPandas(), truth_states(long).toPandas(), feats.toPandas())


def test_move_and_limit_retests(sims, simfeats):
    got = retest.limit_retest(simfeats.where("symbol = 'sim0'")).toPandas()
    assert len(got) == 6
    cap = got[(got["limit"] == "leverage_cap") & (got["versus"] == "matched")].iloc[0]
    assert cap["sharpe_p"] > 0.9  # a cap is a constant exposure
    rv, y = np.random.default_rng(0).random(900), np.random.default_rng(1).random(900).round()
    rates = retest.tercile_rates(rv, y)
    t = 860
    q1, q2 = np.quantile(rv[:t], [1 / 3, 2 / 3])
    bucket = lambda v: np.where(v <= q1, 0, np.where(v <= q2, 1, 2))
    assert math.isclose(rates[t], y[:t][bucket(rv[:t]) == bucket(rv[t])].mean())
    w = retest.kill_path(np.array([-0.2, 0.0, 0.4, 0.1]))
    assert w.tolist() == [2.0, 1.0, 1.0, 2.0]


def test_factored_study(feats):
    x = feats[["ret", "rv20"]].to_numpy(dtype=float)
    x[:, 1] = np.log(np.maximum(x[:, 1], 1e-8))
    whole, part = factored.posteriors(x, "factored", 2, 750, 200), factored.posteriors(x[:1000], "factored", 2, 750, 200)
    assert np.allclose(whole[:950], part[:950], equal_nan=True, atol=1e-8)
    cells = factored.joint_labels(whole, "factored", 2)
    assert set(cells[np.isfinite(cells)]) <= {0, 1, 2, 3} and np.isnan(cells[:750]).all()


def test_reports(spark, sims, simfeats):
    states = rules.states(simfeats, ["ma_cross", "return_sign", "always_range"])
    out = report.state_report(states, ["ma_cross", "return_sign", "always_range", "hmm_gaussian"])
    r = out.first()
    assert r["m_hmm_gaussian"] == "n/a" and 0 <= r["uncertainty"] <= 1 and r["agreement"] > 0
    assert rules.invalid(states).count() == 0
    early = report.latest(states, "2011-01-03").agg(F.max("date")).first()[0]
    assert early <= dt.date(2011, 1, 3)


def test_command_line(capsys):
    cli.main(["list"])
    assert "hmm_gaussian" in capsys.readouterr().out
    assert cli.parser().parse_args(["decision", "-c", "x", "--common-window"]).common_window
