"""Factor panels, arms, the risk overlay, denoised covariances and the two-state model, against plain loops."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import benchmarks, factors, leaves, portfolio, quality, regime_model, risk, stats
from marlstone.operators import timeseries as ts

D = dt.date


# factors


def test_monthly_point_in_time(spark):
    rng = random.Random(1)
    facts = sorted({(s, D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 500)), float(rng.randint(0, 99))) for s in "ab" for _ in range(12)}, key=lambda r: r[:2])
    facts = [r for i, r in enumerate(facts) if i == 0 or facts[i - 1][:2] != r[:2]]
    last = spark.createDataFrame([(D(2021, 9, 1),)], "m date")
    for lag in (0, 30, 45):
        got = {(r.s, r.month): r.v for r in factors.monthly_point_in_time(spark.createDataFrame(facts, "s string, d date, v double"), ["s"], "d", last, "month", lag).collect()}
        want = {}
        for k in range(40):
            month = D(2019 + k // 12, k % 12 + 1, 1)
            for s in "ab":
                known = [(d, v) for t, d, v in facts if t == s and d <= month - dt.timedelta(days=lag)]
                if known and month <= D(2021, 9, 1):
                    want[s, month] = max(known)[1]
        assert got == want


def test_first_available_takes_whole_columns(spark):
    rows = [(1, "a", None, 2.0, 9.0), (1, "b", None, None, 9.0), (2, "a", 1.0, 2.0, 9.0), (2, "b", None, 2.0, 9.0), (3, "a", None, None, None)]
    df = spark.createDataFrame(rows, "m int, s string, x double, y double, z double")
    got = df.withColumn("v", factors.first_available([F.col("x"), F.col("y"), F.col("z")], ["m"])).orderBy("m", "s").collect()
    assert [r.v for r in got] == [2.0, None, 1.0, None, None]


def test_factor_panel_scores(spark):
    month = D(2020, 6, 1)
    prices = spark.createDataFrame([("a", month, 10.0, 0.1), ("b", month, 20.0, None)], "symbol string, month date, px double, momentum double")
    ratio = spark.createDataFrame([("a", D(2020, 1, 1), "earnings_to_price", 0.2), ("a", D(2020, 5, 1), "earnings_to_price", 0.9), ("b", D(2020, 1, 1), "debt_to_equity_hist", -0.4)], "symbol string, snapshot_date date, field_name string, field_value double")
    facts = [("a", "book_value_per_share", 5.0), ("b", "book_value_per_share", 4.0), ("b", "diluted_eps", 7.0), ("a", "net_income", 3.0), ("a", "total_revenue", 6.0), ("a", "stockholders_equity", 0.0)]
    statements = spark.createDataFrame([(s, D(2020, 3, 31), f, v) for s, f, v in facts], "symbol string, report_date date, field_name string, field_value double")
    mood = spark.createDataFrame([("a", D(2020, 6, 1), 60.0), ("b", D(2020, 6, 2), 10.0)], "symbol string, day date, score double")
    got = {r.symbol: r for r in factors.factor_panel(prices, ratio, statements, mood, spark.createDataFrame([(month,)], "m date")).collect()}
    assert got["a"].value == pytest.approx((0.5 + 0.2) / 2)  # the snapshot of 1 May is too young, cash flow isn't known
    assert got["b"].value == pytest.approx(0.2)  # its earnings are only in statements, which the ratio of a shuts out
    assert got["a"].quality == pytest.approx(0.5) and got["b"].quality == pytest.approx(1 / 0.5)
    assert got["a"].sentiment == 60.0 and got["b"].sentiment is None


def test_regimes_match_a_loop(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 8, 70):
        values = [rng.choice([None, 1.0, 2.0, 3.0, rng.random() * 4]) for _ in range(n)]
        rows = [("s", i, v) for i, v in enumerate(values)] + [("t", i, float(i)) for i in range(5)]
        got = {(r.s, r.i): r for r in ts.regimes(spark.createDataFrame(rows, "s string, i int, v double"), "v", "i", ["s"], least=4).collect()}
        assert len(got) == n + 5
        for i, v in enumerate(values):
            seen = [x for x in values[: i + 1] if x is not None]
            under, same = (sum(x < v for x in seen), sum(x == v for x in seen)) if v is not None else (0, 0)
            want = (under + (same + 1) / 2) / (i + 1) if i + 1 >= 4 else 0.5
            assert got["s", i].percentile == pytest.approx(want)
            assert got["s", i].regime == ("NORMAL" if i + 1 < 4 else "LOW" if want < 0.3 else "HIGH" if want > 0.8 else "NORMAL")


# arms


def test_arms_are_eight_and_whole():
    assert len(leaves.ARMS) == 8 and all(sum(a) == pytest.approx(1) for a in leaves.ARMS)


def test_bandit_replay_matches_a_plain_loop(spark):
    rng, t, d, k = np.random.default_rng(3), 40, 4, 3
    x, paid = rng.normal(size=(t, d)), rng.normal(size=(t, k))
    paid[:, 2] += x[:, 0]
    rows = [(seed, i, list(map(float, x[i])), list(map(float, paid[i]))) for seed in (7, 8) for i in range(t)]
    got = leaves.bandit_replay(spark.createDataFrame(rows, "seed int, day int, c array<double>, r array<double>"), "c", "r", ["seed"], "day", "seed", warm=5).collect()
    for seed in (7, 8):
        draws = np.random.default_rng(seed)
        seen = {a: [] for a in range(k)}
        for row in sorted((r for r in got if r.seed == seed), key=lambda r: r.day):
            i, means, covs = row.day, [], []
            for a in range(k):
                xs = np.array([x[j] for j in seen[a]]).reshape(-1, d)
                cov = np.linalg.inv(np.eye(d) + xs.T @ xs)
                means.append(cov @ (xs.T @ np.array([paid[j, a] for j in seen[a]])))
                covs.append(cov)
            arm = 0
            if i >= 5:
                z = draws.standard_normal((k, d))
                arm = int(np.argmax([x[i] @ (m + 0.25 * np.linalg.cholesky(c) @ n) for m, c, n in zip(means, covs, z)]))
            assert row.arm == arm and row.reward == pytest.approx(paid[i, arm]) and row.best == pytest.approx(paid[i].max())
            assert np.allclose(row.means, means) and np.allclose(row.stds, [np.sqrt(np.diag(c)) for c in covs])
            seen[arm].append(i)


def test_bandit_learns_which_arm_pays(spark):
    rows = [(1, i, [1.0], [0.0, 0.0, 1.0, 0.0]) for i in range(80)]
    got = leaves.bandit_replay(spark.createDataFrame(rows, "seed int, day int, c array<double>, r array<double>"), "c", "r", ["seed"], "day", "seed").collect()
    assert all(r.arm == 0 for r in got if r.day < 6) and np.mean([r.arm == 2 for r in got if r.day >= 40]) > 0.8


# risk overlay


def test_trailing_book_returns_and_scalars(spark):
    rng = random.Random(4)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(150)]
    daily = {(s, day): rng.gauss(0, 0.02) for s in "abc" for day in days if rng.random() < 0.7}
    book = {("v", D(2020, m, 1), s): rng.choice([-0.5, 0.25, 0.3]) for m in (3, 5) for s in "abd"}
    b = spark.createDataFrame([(*k, w) for k, w in book.items()], "variant string, month date, symbol string, weight double")
    r = spark.createDataFrame([(s, day, None if rng.random() < 0.02 else v) for (s, day), v in daily.items()], "symbol string, day date, ret double")
    known = {(x.symbol, x.day): x.ret for x in r.collect()}
    trail = risk.trailing_book_returns(b, r, ["variant"], "month", days=90)
    got = {(x.month, x.day): x.r for x in trail.collect()}
    want = {}
    for (_, month, s), w in book.items():
        for (t, day), v in known.items():
            if t == s and month - dt.timedelta(days=90) <= day < month:
                want[month, day] = want.get((month, day), 0.0) + w * (v or 0.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for row in risk.risk_scalars(trail, ["variant", "month"]).collect():
        series = [v for k, v in sorted(want.items()) if k[0] == row.month]
        var = -np.quantile(series, 0.01)
        assert row.n == len(series) and row["var"] == pytest.approx(var) and row.es == pytest.approx(-np.mean([v for v in series if v <= -var + 1e-15]))
        assert row.var_scalar == pytest.approx(0.02 / var)
        assert row.vol_scalar == pytest.approx(np.clip(0.1 / (np.std(series[-60:], ddof=1) * 252**0.5), 0.3, 1.5))


def test_trailing_book_returns_in_blocks_of_symbols(spark):
    """Each symbol in a block of its own; a return that isn't finite stays with its own days, and no daily row is repeated for the dates that look back on it."""
    start, rng = D(2020, 1, 1), random.Random(15)
    book = [(v, m, s, rng.uniform(-1, 1)) for v in ("p", None) for m in (D(2020, 2, 1), D(2020, 3, 1)) for s in "abcd" if (v, s) != ("p", "d")]
    daily = [(s, start + dt.timedelta(days=i), float("inf") if (s, i) == ("d", 40) else rng.gauss(0, 1)) for s in "abdx" for i in range(0, 60, 2 if s == "a" else 3)]
    frames = spark.createDataFrame(book, "variant string, month date, symbol string, weight double"), spark.createDataFrame(daily, "symbol string, day date, ret double")
    want = {}
    for v, m, s, w in book:
        for t, day, r in daily:
            if s == t and m - dt.timedelta(days=30) <= day < m:
                want[v, m, day] = want.get((v, m, day), 0.0) + w * r
    for names in (1, 2000):
        trail = risk.trailing_book_returns(*frames, ["variant"], "month", days=30, names=names)
        got = {(r.variant, r.month, r.day): r.r for r in trail.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "Join" not in trail._jdf.queryExecution().executedPlan().toString()


def test_variant_books_shuffle_scores_once(spark):
    """Of the many books only one score a symbol goes to the legs' window: no factor, and no window that counts what is missing."""
    from marlstone.plans import queries as q

    rng = random.Random(16)
    rows = [(s, D(2020, m, 1), rng.random(), None if m == 2 else rng.random(), rng.random(), rng.random(), rng.random()) for m in (1, 2) for s in range(30)]
    scores = spark.createDataFrame(rows, "symbol int, month date, y double, momentum double, value double, quality double, sentiment double")
    weights = spark.createDataFrame([(k, D(2020, m, 1), *w) for k, w in enumerate([(0.3, 0.3, 0.25, 0.15), (1.0, 0.0, 0.0, 0.0)]) for m in (1, 2)], "v int, month date, w_momentum double, w_value double, w_quality double, w_sentiment double")
    book = q._variant_books(scores, weights, ["v"])
    got = {(r.v, r.month.month, r.symbol): r.weight for r in book.collect()}
    for k, w in enumerate([(0.3, 0.3, 0.25, 0.15), (1.0, 0.0, 0.0, 0.0)]):
        for m in (1, 2):
            total = {r[0]: sum(a * (b or 0.0) for a, b in zip(w, r[3:])) for r in rows if r[1].month == m}
            lo, hi = np.quantile(list(total.values()), [0.2, 0.8])
            legs = {s: x for (v, n, s), x in got.items() if (v, n) == (k, m)}
            assert legs.keys() == {s for s in total if total[s] >= hi or total[s] <= lo}
            assert all(x == 0 or (x > 0) == (total[s] >= hi) for s, x in legs.items()) and sum(map(abs, legs.values())) == pytest.approx(1 if lo < hi else 0.5)
    windows = [line for line in book._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("count(momentum" in line or "count(value" in line for line in windows)


def test_overlay_matches_a_loop(spark):
    rng = random.Random(5)
    months = [D(2018 + k // 12, k % 12 + 1, 1) for k in range(40)]
    book, ahead, scalars = {}, {}, {}
    for v in ("p", "q"):
        for k, m in enumerate(months):
            for s in rng.sample("abcdef", 4):
                book[v, m, 100 + k, s] = rng.uniform(-0.6, 0.6)
            if k != 7:
                scalars[v, m] = (rng.uniform(0.2, 2.5), rng.uniform(0.3, 1.5))
    for m in months:
        for s in "abcde":
            ahead[s, m] = rng.gauss(-0.005, 0.06)
    frames = (
        spark.createDataFrame([(v, m, k, s, w) for (v, m, k, s), w in book.items()], "variant string, month date, k int, symbol string, weight double"),
        spark.createDataFrame([(s, m, y) for (s, m), y in ahead.items()], "symbol string, month date, y double"),
        spark.createDataFrame([(v, m, a, b) for (v, m), (a, b) in scalars.items()], "variant string, month date, var_scalar double, vol_scalar double"),
    )
    steps = risk.overlay_steps(*frames, ["variant"], "month", "k")
    got = {(r.variant, r.month): r for r in risk.overlaid(steps, ["variant"], "month", "k").collect()}
    levels = set()
    for v in ("p", "q"):
        navs, before = [1.0], {}
        for k, m in enumerate(months):
            w = {s: x for (u, _, i, s), x in book.items() if u == v and i == 100 + k}
            down = navs[-1] / max(navs[-13:]) - 1
            level = 0.5 if down <= -0.06 else 0.75 if down <= -0.03 else 1.0
            levels.add(level)
            a, b = scalars.get((v, m), (1.0, 1.0))
            scale = min(max(a * b * level, 0.0), 2.0)
            scale = min(scale, 2.0 / sum(map(abs, w.values())))
            now = {s: x * scale for s, x in w.items()}
            turned = sum(abs(now.get(s, 0) - before.get(s, 0)) for s in {*now, *before}) / 2
            net = sum(x * ahead.get((s, m), 0.0) for s, x in now.items()) - turned * 2 * 20 / 1e4
            navs.append(navs[-1] * (1 + net))
            before, row = now, got[v, m]
            assert (row.drawdown, row.scale, row.turnover, row.net, row.nav) == (pytest.approx(down, abs=1e-12), pytest.approx(scale), pytest.approx(turned), pytest.approx(net), pytest.approx(navs[-1]))
    assert len(got) == 80 and levels == {1.0, 0.75, 0.5}


# covariances and legs


def _one_factor(rng, t, n):
    load, own = rng.uniform(0.5, 1.5, n), rng.uniform(0.5, 2.0, n)
    return rng.normal(size=(t, 1)) * load + rng.normal(size=(t, n)) * own, np.outer(load, load) + np.diag(own**2)


def test_denoised_covariance_keeps_the_factor_and_gives_better_weights():
    """Under the true covariance, weights of least variance are better by the denoised estimate than by the sample's."""
    rng, risks = np.random.default_rng(6), []
    for t, n in [(120, 40), (60, 50), (300, 100)] * 4:
        x, true = _one_factor(rng, t, n)
        sample = np.cov(x, rowvar=False)
        found, edge, noise = leaves.denoised_covariance(x)
        largest = np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))[-1]
        assert 1 < edge < largest and 0.75 * n <= noise < n
        assert np.allclose(found, found.T) and np.linalg.eigvalsh(found).min() > 0
        assert np.trace(found) == pytest.approx(np.trace(sample))
        weights = [np.linalg.solve(c, np.ones(n)) for c in (found, sample)]
        risks.append([w @ true @ w / w.sum() ** 2 for w in weights])
    denoised, plain = np.array(risks).T
    assert (denoised < plain).mean() > 0.9 and denoised.mean() < 0.8 * plain.mean()


def test_noise_variance_is_the_best_of_a_dense_grid():
    rng = np.random.default_rng(7)
    x, _ = _one_factor(rng, 100, 50)
    values = np.linalg.eigvalsh(np.corrcoef(x, rowvar=False))

    def slow(v):
        low, high = v * (1 - 0.5**0.5) ** 2, v * (1 + 0.5**0.5) ** 2
        inside = [e for e in values if low <= e <= high]
        if len(inside) < 5:
            return np.inf
        width, far = (high - low) / 50, []
        for b in range(50):
            a = low + b * width
            count = sum(a <= e < a + width or (b == 49 and e == high) for e in inside)
            mid = a + width / 2
            far.append((v * (count / (len(inside) * width) - 2 / (2 * np.pi * v * mid) * np.sqrt((high - mid) * (mid - low)))) ** 2)
        return np.mean(far)

    found = leaves.noise_variance(values, 2.0)
    assert slow(found) <= min(slow(v) for v in np.linspace(1e-3, values.max(), 200)) + 1e-9
    assert leaves.noise_variance(np.array([5.0, 6.0]), 2.0) == 1.0


def test_pure_noise_is_all_noise():
    values = np.linalg.eigvalsh(np.corrcoef(np.random.default_rng(8).normal(size=(400, 80)), rowvar=False))
    assert 0.6 < leaves.noise_variance(values, 5.0) < 1.4


def test_leg_weights_against_direct_solutions(spark):
    rng = np.random.default_rng(9)
    sd = np.array([0.5, 1.0, 2.0, 1.5])
    x = rng.normal(size=(400, 4)) * sd
    rows = [("s", t, str(i), float(x[t, i])) for t in range(400) for i in range(4)]
    df = spark.createDataFrame(rows, "sector string, t int, name string, r double")
    for method, cov in (("minimum_variance", leaves.shrunk_covariance(x)), ("denoised", leaves.denoised_covariance(x)[0])):
        inverse = np.linalg.inv(cov) @ np.ones(4)
        got = {r.name: r.weight for r in leaves.leg_weights(df, ["sector"], "name", "t", "r", method=method, cap=1.0).collect()}
        if (inverse > 0).all():
            assert [got[str(i)] for i in range(4)] == pytest.approx(list(inverse / inverse.sum()), abs=2e-3)
    capped = [r.weight for r in leaves.leg_weights(df, ["sector"], "name", "t", "r", cap=0.3).collect()]
    assert max(capped) <= 0.3 + 1e-9 and sum(capped) == pytest.approx(1)
    parity = {r.name: r.weight for r in leaves.leg_weights(df, ["sector"], "name", "t", "r", method="risk_parity").collect()}
    assert sum(parity.values()) == pytest.approx(1) and min(parity, key=parity.get) == "2" and max(parity, key=parity.get) == "0"
    rows = leaves.leg_covariances(df, ["sector"], "name", "t", "r").collect()
    want = leaves.denoised_covariance(x)[0]
    assert len(rows) == 10 and all(r.covariance == pytest.approx(want[int(r.a), int(r.b)]) for r in rows)


def test_legs_of_one_name_or_none(spark):
    rows = [("one", t, "a", float(t % 3)) for t in range(30)] + [("few", t, "b", 1.0) for t in range(5)]
    df = spark.createDataFrame(rows, "sector string, t int, name string, r double")
    got = leaves.leg_covariances(df, ["sector"], "name", "t", "r").collect()
    assert [(r.sector, r.a, r.b, r.noise) for r in got] == [("one", "a", "a", 0)] and got[0].covariance == pytest.approx(np.var([t % 3 for t in range(30)], ddof=1))
    for method in ("minimum_variance", "denoised", "risk_parity"):
        assert [tuple(r) for r in leaves.leg_weights(df, ["sector"], "name", "t", "r", method=method).collect()] == [("one", "a", 1.0)]


def _plain_risk_parity(x):
    n, cov = x.shape[1], np.cov(x, rowvar=False)
    distance = np.round((1 - np.corrcoef(x, rowvar=False)) / 2, 12)
    clusters = [[i] for i in range(n)]
    while len(clusters) > 1:
        _, i, j = min((distance[np.ix_(a, b)].min(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        clusters[i] = clusters[i] + clusters.pop(j)
    weights, todo = np.ones(n), [clusters[0]]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            halves = part[: len(part) // 2], part[len(part) // 2 :]
            own = [1 / np.diag(cov)[h] / (1 / np.diag(cov)[h]).sum() for h in halves]
            risk = [w @ cov[np.ix_(h, h)] @ w for w, h in zip(own, halves)]
            for h, other in zip(halves, risk[::-1]):
                weights[h] *= other / sum(risk)
            todo += halves
    return weights


def test_legs_in_blocks_match_whole_matrices(spark, monkeypatch):
    """More names than dates, in many blocks, with copies; gaps count as 0."""
    monkeypatch.setattr(leaves, "_BLOCK", 7)
    monkeypatch.setattr(leaves, "_PAIRS", 5)
    rng = np.random.default_rng(12)
    x, _ = _one_factor(rng, 25, 40)
    x[:, 30:33] = x[:, 3:6]
    x[4, 7] = 0.0
    rows = [(g, t, 100 + i, float(x[t, i])) for g, names in (("a", 40), (None, 3)) for t in range(25) for i in range(names) if (t, i) != (4, 7)]
    df = spark.createDataFrame(rows, "sector string, t int, name int, r double")
    for g, names in (("a", 40), (None, 3)):
        own, cov = x[:, :names], leaves.denoised_covariance(x[:, :names])
        for method, want in (("minimum_variance", leaves.minimum_variance(own, 0.5)), ("denoised", leaves.minimum_variance(own, 0.5, covariance=lambda y: leaves.denoised_covariance(y)[0])), ("risk_parity", _plain_risk_parity(own))):
            got = {r.name: r.weight for r in leaves.leg_weights(df, ["sector"], "name", "t", "r", method=method, cap=0.5).collect() if r.sector == g}
            assert [got[100 + i] for i in range(names)] == pytest.approx(list(want), abs=1e-9)
        pairs = {(r.a, r.b): r for r in leaves.leg_covariances(df, ["sector"], "name", "t", "r").collect() if r.sector == g}
        assert pairs.keys() == {(100 + i, 100 + j) for i in range(names) for j in range(i, names)}
        assert all(r.covariance == pytest.approx(cov[0][a - 100, b - 100], abs=1e-9) and r.edge == pytest.approx(cov[1]) and r.noise == cov[2] for (a, b), r in pairs.items())


def test_legs_hold_no_matrix_of_names():
    """Tasks of a leg hold rows of names and sums of dates, so that 20,000 names (a matrix of 3.2 GB) are weighed in a few hundred MB."""
    import tracemalloc

    rng = np.random.default_rng(13)
    x, z = leaves._normalised(rng.normal(size=(20_000, 30)))
    tracemalloc.start()
    found = leaves.moments(x.T @ x, z.T @ z, len(x))
    load = z @ found["basis"]
    own = np.full(len(x), found["floor"])
    assert leaves.largest_eigenvalue(own, load) >= found["floor"]
    w = leaves._descended(len(x), lambda w: own * w + load @ (w @ load), leaves.largest_eigenvalue(own, load), 0.25, rounds=5)
    assert w.sum() == pytest.approx(1) and leaves.bisected(x, np.arange(len(x))).sum() == pytest.approx(1)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_largest_eigenvalue_without_the_matrix():
    rng = np.random.default_rng(14)
    for n, k in ((1, 1), (6, 2), (40, 3), (5, 0)):
        own, load = rng.uniform(0.1, 2, n), rng.normal(size=(n, k))
        assert leaves.largest_eigenvalue(own, load) == pytest.approx(np.linalg.eigvalsh(np.diag(own) + load @ load.T)[-1])


def test_capped_weights_match_a_loop(spark):
    for w in ([0.5, 0.3, 0.2], [0.9, 0.04, 0.03, 0.03], [0.04] * 25):
        df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(w)], "g string, i int, w double")
        got = [r.w for r in portfolio.capped(df, "w", ["g"], 0.35).orderBy("i").collect()]
        assert max(got) <= 0.35 + 1e-9 and sum(got) == pytest.approx(min(1.0, 0.35 * len(w)))
        assert all(a >= b - 1e-9 for (x, a), (y, b) in itertools.combinations(zip(w, got), 2) if x >= y)


def test_content_print_ignores_order_and_sees_changes(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None)]
    make = lambda r: quality.content_print(spark.createDataFrame(r, "k int, v string"), ["k", "v"]).first()
    assert make(rows) == make(rows[::-1]) and make(rows).rows == 4
    assert len({make(r) for r in (rows, rows[:3], [(1, "b"), (2, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "b"), (3, None), (3, None)])}) == 4


# two-state model


def test_forward_matches_all_paths():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(1, 7))
    start, move, mean, var = np.array([[0.3, 0.7]]), np.array([[[0.8, 0.2], [0.4, 0.6]]]), np.array([[0.0, 1.0]]), np.array([[0.5, 2.0]])
    dens = regime_model._densities(x, mean, var)
    alpha, scale = regime_model.forward(dens, np.ones((1, 7), bool), start, move)
    for t in range(7):
        joint = np.zeros(2)
        for path in itertools.product((0, 1), repeat=t + 1):
            p = start[0, path[0]] * dens[0, 0, path[0]]
            for i in range(1, t + 1):
                p *= move[0, path[i - 1], path[i]] * dens[0, i, path[i]]
            joint[path[-1]] += p
        assert alpha[0, t] == pytest.approx(joint / joint.sum())
        assert np.prod(scale[0, : t + 1]) == pytest.approx(joint.sum())


def test_fit_never_lowers_the_likelihood_and_ignores_padding():
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=90), np.concatenate([rng.normal(0, 0.2, 60), rng.normal(1, 1.5, 60)])
    x, live = np.zeros((2, 120)), np.zeros((2, 120), bool)
    x[0, :90], live[0, :90], x[1], live[1] = a, True, b, True
    *both, likelihood = regime_model.fit(x, live, 40)
    assert (np.diff(likelihood, axis=1) > -1e-8).all()
    *alone, _ = regime_model.fit(a[None], np.ones((1, 90), bool), 40)
    assert all(np.allclose(p[0], q[0]) for p, q in zip(both, alone))


def test_two_state_regimes_see_no_future(spark):
    rng = np.random.default_rng(12)
    changes = np.concatenate([rng.normal(0, 0.01, 120), rng.normal(0.08, 0.05, 60), rng.normal(0, 0.01, 60)])
    level = np.exp(np.r_[0, np.cumsum(changes)])
    rows = [("v", i, float(x)) for i, x in enumerate(level)] + [("v", 500, None), ("v", 501, -1.0), ("w", 0, 1.0)]
    df = spark.createDataFrame(rows, "s string, i int, v double")
    dates = spark.createDataFrame([(d,) for d in (-1, 20, 110, 178, 239)], "d int")
    run = lambda data: {(r.s, r.as_of): (r.n, round(r.probability, 9), r.regime) for r in regime_model.two_state_regimes(data, "v", ["s"], "i", dates).collect()}
    whole, cut = run(df), run(df.filter("i <= 178"))
    assert all(whole[k] == cut[k] for k in whole if k[1] <= 178)
    assert whole["v", 20] == (20, 0.5, "NORMAL") and whole["w", 239] == (0, 0.5, "NORMAL")
    assert whole["v", 178][2] == "HIGH" and whole["v", 239][2] == "LOW"


# benchmarks, capacity


def test_latest_rate_and_blend(spark):
    dates = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 5),), (D(2020, 1, 9),)], "m date")
    rates = spark.createDataFrame([(D(2020, 1, 1), 0.01), (D(2020, 1, 5), 0.02), (D(2020, 1, 6), None)], "day date, rate double")
    got = benchmarks.latest_rate(dates, rates, "m", "day", "rate").orderBy("m").withColumn("b", benchmarks.cash_market_blend(F.col("rf"), F.lit(0.1), 6)).collect()
    assert [r.rf for r in got] == [0.0, 0.01, 0.02]
    assert got[2].b == pytest.approx(0.5 * (1.02**0.5 - 1) + 0.05)


def test_capacity(spark):
    book = spark.createDataFrame([("m", "a", 0.5), ("m", "b", -0.5), ("m", "c", 0.0), ("m", "d", 0.2)], "month string, symbol string, weight double")
    liquid = spark.createDataFrame([("a", 1e-9, 5.0), ("b", 4e-9, 5.0), ("c", 1e-3, 5.0), ("d", None, 5.0)], "symbol string, illiquidity double, adv double")
    row = stats.capacity(stats.capacity_frame(book, liquid, "weight", ["symbol"]), "weight", "illiquidity", ["month"]).first()
    assert row.max_aum == pytest.approx(15 / (0.5 * 4e-9 * 1e4)) and row.n_stocks == 2 and row.median_illiquidity == 4e-9


def test_sign_flips_match_a_loop(spark):
    import hashlib

    rng = random.Random(13)
    data = {"x": [rng.gauss(0.3, 1) for _ in range(30)], "y": [rng.gauss(0, 1) for _ in range(20)] + [None]}
    rows = [(s, i, v) for s, vs in data.items() for i, v in enumerate(vs)]
    got = {r.s: r for r in stats.sign_flips(spark.createDataFrame(rows, "s string, i int, v double"), "v", ["s"], "i", rounds=50).collect()}
    for s, values in data.items():
        values, count = [v for v in values if v is not None], 0
        for k in range(1, 51):
            signs = [-1 if int(hashlib.md5(f"{s}-{i}-{k}-42".encode()).hexdigest()[31], 16) % 2 else 1 for i in range(1, len(values) + 1)]
            count += abs(np.mean(np.multiply(signs, values))) >= abs(np.mean(values)) - 1e-12
        assert got[s].p_value == pytest.approx((count + 1) / 51) and got[s]["mean"] == pytest.approx(np.mean(values))
