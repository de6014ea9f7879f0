"""Selection, archives, ledgers and pools against brute force and known values."""

import math

import numpy as np

from tideframe.functions import search


def test_fronts_equal_brute_force():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    fronts = search.fast_non_dominated_sort(x)
    assert sorted(i for f in fronts for i in f) == list(range(60))
    beats = lambda i, j: all(x[i] >= x[j]) and any(x[i] > x[j])
    for k, f in enumerate(fronts):
        rest = [i for g in fronts[k:] for i in g]
        assert set(f) == {i for i in rest if not any(beats(j, i) for j in rest)}
    assert search.pareto_front(x) == fronts[0]
    kept = search.nsga2_survival(x, 25)
    assert len(kept) == len(set(kept)) == 25 and set(fronts[0][:25]) & set(kept)
    d = search.crowding_distance([[0, 4], [1, 2], [4, 0]])
    assert d[0] == d[2] == math.inf and d[1] == 2.0
    assert set(search.age_fitness_pareto_survival([1, 5, 3], [0, 9, 3], 2)) <= {0, 1, 2}


def test_parents():
    rng = np.random.default_rng(1)
    cases = np.array([[1.0, 0, 0], [0, 1, 0], [0.99, 0.99, 0], [np.nan, np.nan, np.nan]])
    got = {search.lexicase(cases, rng) for _ in range(200)}
    assert got == {0, 1}
    assert {search.eps_lexicase(cases, rng, 0.05) for _ in range(200)} == {2}  # the one that is near the best in both
    assert np.mean([search.tournament([0, 1, 2, 3], rng, 4) for _ in range(300)]) > 2.2


def test_archive():
    a = search.Archive([[0.0], [1.0, 2.0]])
    assert a.n_cells == 6 and a.add("x", 1.0, (-1, 0.5)) and not a.add("y", 0.5, (-2, 0.1)) and a.add("z", 2.0, (3, 5)) and not a.add("w", math.nan, (3, 1.5))
    assert (a.best(), sorted(a.elites()), a.qd_score(), a.n_added, a.n_accepted, a.coverage) == ("z", ["x", "z"], 3.0, 4, 2, 2 / 6)
    assert [r["cell"] for r in a.to_records()] == [(0, 0), (1, 2)]


def test_ledger():
    rng = np.random.default_rng(2)
    ledger, base = search.TrialLedger(reservoir=50), rng.normal(size=400)
    for i in range(200):
        s = 0.7 * base + math.sqrt(1 - 0.49) * rng.normal(size=400)
        ledger.record(i, float(s.mean()), s, held_out=float(s.mean()) / 2)
    assert ledger.n_trials == 200 and len(ledger._sample) == 50 and ledger.best_score == ledger.scores.max()
    assert abs(ledger.mean_pairwise_correlation() - 0.49) < 0.05
    n = ledger.implied_independent_trials()
    assert 90 < n < 115 and 1 < ledger.effective_trials_pca() <= 50
    assert abs(search.search_diagnostics(ledger)["shrinkage"] - 0.5) < 1e-9
    assert abs(search.significance_hurdle(1) - 1.95996) < 1e-4 and search.significance_hurdle(100) > 3.4
    assert abs(search.haircut_sharpe_ratio(0.1, 900, 1) - 0.1) < 1e-6 and search.haircut_sharpe_ratio(0.1, 900, 50) < 0.1
    assert 0 < search.minimum_backtest_length(10) < search.minimum_backtest_length(1000)


def test_pool():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 3))
    y = x @ [0.5, 0.3, 0.0] + rng.normal(size=5000)
    z = (x - x.mean(0)) / x.std(0)
    t = (y - y.mean()) / y.std()
    pool = search.AlphaPool(max_size=2)
    for j in range(3):
        mutual = [float(np.mean(z[:, j] * z[:, i])) for i in pool.names]
        gain = pool.marginal_contribution(float(np.mean(z[:, j] * t)), mutual)
        before = pool.score()
        gone = pool.add(float(np.mean(z[:, j] * t)), mutual, name=j)
        assert gone is not None or abs(pool.score() - before - gain) < 1e-9
    assert pool.names == [0, 1]
    w = np.linalg.lstsq(z[:, :2], t, rcond=None)[0]
    assert np.allclose(pool.weights(), w, atol=1e-6) and abs(pool.loss() - np.mean((t - z[:, :2] @ w) ** 2)) < 1e-6
    pool.reset()
    assert pool.score() == 0 and len(pool.single_ic()) == 0
