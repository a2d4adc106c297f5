"""Fitted distributions against known values and against draws from them."""

import math

import numpy as np
import pytest

from weftline.operators import generate, marginals


def test_distribution_functions():
    # of textbooks: gamma of shape 1 is the exponential, beta(1, b) and beta(a, 1) are powers, halves are symmetric
    x = np.linspace(0, 8, 33)
    assert np.allclose(marginals.gamma_cdf(1.0, x), 1 - np.exp(-x), atol=1e-12)
    assert np.allclose(marginals.gamma_cdf(2.0, x), 1 - np.exp(-x) * (1 + x), atol=1e-12)
    assert np.allclose(marginals.gamma_cdf(0.5, x), [math.erf(math.sqrt(v)) for v in x], atol=1e-10)
    u = np.linspace(0, 1, 21)
    assert np.allclose(marginals.beta_cdf(1, 3, u), 1 - (1 - u) ** 3, atol=1e-12)
    assert np.allclose(marginals.beta_cdf(4, 1, u), u**4, atol=1e-12)
    assert np.allclose(marginals.beta_cdf(0.5, 0.5, u), 2 / math.pi * np.arcsin(np.sqrt(u)), atol=1e-9)
    big = marginals.gamma_cdf(200.0, np.array([150.0, 200.0, 250.0]))
    assert big[0] < 1e-3 < 0.4 < big[1] < 0.6 < 0.999 < big[2]


@pytest.mark.parametrize("family", marginals.FAMILIES)
def test_fit_finds_the_family_again(spark, family):
    pick = np.random.default_rng(4)
    n = 4000
    cut = pick.normal(0, 2, 4 * n)
    draws = {"norm": pick.normal(5, 2, n), "uniform": pick.uniform(-1, 3, n), "gamma": 2 + pick.gamma(2.0, 3.0, n), "beta": pick.beta(2, 5, n) * 10, "truncnorm": cut[(cut > -1) & (cut < 3)][:n]}
    df = spark.createDataFrame([(float(v), 1.0, None) for v in draws[family]], "v double, flat double, none double")
    rows = {r["distribution"]: r for r in marginals.fitted(df, ["v", "flat", "none"]).collect()}
    assert {r["column_name"] for r in rows.values()} == {"v"}
    assert rows[family]["ks"] < 0.03
    model = generate.GaussianCopula(default_distribution=family).fit(df)
    assert set(model.fitted) == {"v"} and model.fitted["v"][0] == family
    made = np.array([r["v"] for r in model.generate(spark, 4000).collect()])
    assert abs(made.mean() - draws[family].mean()) < 0.1 * draws[family].std() and abs(made.std() / draws[family].std() - 1) < 0.06
    assert draws[family].min() <= made.min() and made.max() <= draws[family].max()


def test_names(spark):
    assert marginals.family_of(" Gaussian ") == marginals.family_of("normal") == "norm"
    with pytest.raises(ValueError):
        generate.GaussianCopula(default_distribution="cauchy")
    df = spark.createDataFrame([(float(i % 7) ** 2, "a") for i in range(100)], "v double, c string")
    best = generate.GaussianCopula(default_distribution="best").fit(df)
    assert best.fitted["v"][2] == min(r["ks"] for r in marginals.fitted(df, ["v"]).collect())
    free = generate.GaussianCopula(default_distribution="norm", enforce_min_max_values=False).fit(df).generate(spark, 500)
    assert free.filter("v < 0").count() > 0
    assert generate.GaussianCopula(default_distribution="norm").fit(df.limit(1)).generate(spark, 3).count() == 3
