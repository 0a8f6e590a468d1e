"""Logistic models against Newton's method in numpy."""

import numpy as np

from evidar.operators import models


def newton(x, y, w, l2):
    """The minimum of the weighted mean loss and l2 / 2 times the squared weights; the constant is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.full(x.shape[1], l2), 0.0)
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ b))
        gradient = a.T @ (w * (p - y)) / w.sum() + ridge * b
        hessian = (a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag(ridge)
        b -= np.linalg.solve(hessian + 1e-12 * np.eye(len(b)), gradient)
    return b


def drawn(n, seed):
    r = np.random.RandomState(seed)
    x = r.randn(n, 3)
    y = (x @ [1.5, -1.0, 0.0] + r.randn(n) > 0.4).astype(float)
    return x, y


def test_gate_finds_the_minimum(spark):
    x, y = drawn(150, 1)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, v array<double>, y int")
    model = models.gate(df, "v", "y", c=2.0)
    b = newton(x, y, np.ones(len(y)), 1 / (2.0 * len(y)))
    assert np.allclose([*model.coefficients.toArray(), model.intercept], b, atol=1e-3)
    got = {r["id"]: r["score"] for r in models.gate_scores(model, df, "id", "v").collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-(x @ b[:-1] + b[-1]))), atol=1e-3)


def test_novelty_scores_each_fold_by_the_others(spark):
    x, y = drawn(200, 2)
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    got = {r["id"]: r for r in models.novelty_scores(df, "id", ["a", "b", "c"], "y").collect()}
    assert sorted(got) == list(range(200))
    fold = np.array([got[i]["fold"] for i in range(200)])
    for k in range(5):
        train, test = fold != k, fold == k
        assert 20 <= test.sum() <= 60
        mean, std = x[train].mean(0), x[train].std(0, ddof=1)
        n1, n = y[train].sum(), train.sum()
        w = np.where(y[train] == 1, n / (2 * n1), n / (2 * (n - n1)))
        b = newton((x[train] - mean) / std, y[train], w, 1 / n)
        want = 1 / (1 + np.exp(-((x[test] - mean) / std @ b[:-1] + b[-1])))
        assert np.allclose([got[i]["score"] for i in np.flatnonzero(test)], want, atol=2e-3)
