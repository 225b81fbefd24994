"""Column functions against plain Python on the same points, and draws against moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.functions import distributions as D
from sparkbayes.functions import expr as E
from sparkbayes.functions import special as S


def values(spark, column, points):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(points)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_special_functions(spark):
    x = [0.1, 0.5, 1.0, 2.5, 10.0, 80.0]
    assert np.allclose(values(spark, S.lgamma, x), [math.lgamma(v) for v in x], atol=1e-10)
    assert np.allclose(values(spark, S.erf, [-2.0, 0.0, 0.3, 1.5]), [math.erf(v) for v in (-2.0, 0.0, 0.3, 1.5)], atol=1e-10)
    assert np.allclose(S.np_erfinv(np.array([-0.9, 0.0, 0.5])), [-1.1630871536766743, 0, 0.4769362762044699])
    assert np.allclose(values(spark, S.log1mexp, [-1e-5, -0.3, -5.0]), [math.log(-math.expm1(v)) for v in (-1e-5, -0.3, -5.0)])


def integral(spark, logp, lo, hi, n=20001):
    x = np.linspace(lo, hi, n)
    return float(np.trapezoid(np.exp(values(spark, logp, x)), x))


@pytest.mark.parametrize("d,lo,hi", [(D.GenExtreme(0.0, 1.0, 0.2), -4.99, 200), (D.GenExtreme(0.0, 1.0, -0.3), -30, 3.33), (D.GenPareto(1.0, 2.0, 0.2), 1, 400), (D.GenPareto(0.0, 1.0, -0.5), 0, 2), (D.ExtGenPareto(0.0, 1.0, 0.1, 2.5), 1e-9, 150), (D.Chi(3.0), 0, 12), (D.Maxwell(2.0), 0, 30)])
def test_densities_integrate_to_one(spark, d, lo, hi):
    assert abs(integral(spark, d.logp, lo, hi) - 1) < 3e-3


def test_cdf_is_the_integral(spark):
    for d, lo, at in ((D.GenExtreme(0.0, 1.0, 0.2), -4.99, 1.5), (D.ExtGenPareto(0.0, 1.0, 0.3, 2.0), 1e-9, 1.2), (D.Maxwell(1.5), 1e-9, 2.0), (D.Chi(4.0), 1e-9, 1.7)):
        assert abs(integral(spark, d.logp, lo, at) - math.exp(values(spark, d.logcdf, [at])[0])) < 1e-3


def test_quantiles_invert(spark):
    q = [0.01, 0.3, 0.9, 0.999]
    for d in (D.GenExtreme(1.0, 2.0, -0.2), D.GenExtreme(1.0, 2.0), D.GenPareto(1.0, 2.0, 0.3), D.GenPareto(1.0, 2.0), D.ExtGenPareto(1.0, 2.0, -0.2, 0.7)):
        assert np.allclose(values(spark, lambda x: d.cdf(d.icdf(x)), q), q, atol=1e-9)


def test_edges(spark):
    d = D.GenPareto(0.0, 1.0, -0.5)
    assert values(spark, d.logp, [-1.0, 2.5]) == [float("-inf")] * 2
    assert values(spark, d.logcdf, [-1.0, 2.5]) == [float("-inf"), 0.0]
    assert values(spark, d.icdf, [0.0, 1.0]) == [0.0, 2.0] and math.isnan(values(spark, d.icdf, [1.5])[0])
    assert values(spark, D.GenExtreme(0.0, 1.0, -0.5).logcdf, [3.0]) == [0.0]
    assert values(spark, D.Poisson(3.0).logp, [-1.0]) == [float("-inf")]
    for bad in (lambda: D.GenExtreme(0.0, -1.0), lambda: D.GenExtreme(0.0, 1.0, 1.5), lambda: D.GeneralizedPoisson(1.0, -0.5), lambda: D.JointCategorical.of()):
        with pytest.raises(ValueError):
            bad()


def test_counts_sum_to_one(spark):
    x = range(0, 400)
    for d in (D.GeneralizedPoisson(4.0, 0.3), D.BetaNegativeBinomial(6.0, 4.0, 5.0)):
        p = np.exp(values(spark, d.logp, x))
        assert abs(p.sum() - 1) < 2e-3 and np.allclose(np.log(p[:30]), d.np_logp(np.arange(30)))
    p = np.exp(values(spark, D.Skellam(7.0, 4.0).logp, range(-40, 60)))
    assert abs(p.sum() - 1) < 1e-8 and abs((p * np.arange(-40, 60)).sum() - 3) < 1e-6


def test_draws_have_the_moments(spark):
    df = spark.range(20000)
    row = df.select(D.GenPareto(0.0, 1.0, 0.1).draw(F.col("id"), 1).alias("a"), D.GeneralizedPoisson(4.0, 0.2).draw(F.col("id"), 2).alias("b"), D.Skellam(7.0, 4.0).draw(F.col("id"), 3).alias("c"), S.normal(F.col("id"), 4).alias("z")).agg(F.avg("a"), F.avg("b"), F.avg("c"), F.avg("z"), F.stddev("z")).head()
    assert np.allclose(row, [1 / 0.9, 5.0, 3.0, 0.0, 1.0], atol=0.1)


def test_joint_categorical(spark):
    d = D.JointCategorical.of(logit_p=np.log([[0.1, 0.2], [0.3, 0.4]]))
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "a int, b int")
    got = [r[0] for r in df.select(d.logp(F.col("a"), F.col("b"))).collect()]
    assert np.allclose(got[:2], np.log([0.2, 0.4])) and got[2] == float("-inf") and d.support_point() == [1, 1]


def test_expressions_differentiate():
    a, b = E.param("a"), E.param("b")
    e = E.log(1 + E.exp(a * b)) + a**3 / b - E.loggamma(b + 2.0) + E.sigmoid(a) + E.softplus(b) + E.log1p(a * a)
    at, h = {"a": 0.7, "b": 1.3}, 1e-6
    for n in "ab":
        up, down = at | {n: at[n] + h}, at | {n: at[n] - h}
        assert abs((E.evaluate(e, up) - E.evaluate(e, down)) / (2 * h) - E.evaluate(E.derivative(e, n), at)) < 1e-5


def test_expressions_compile_alike(spark):
    e = E.poisson(E.data("x"), E.param("r")) + E.bernoulli_logit(E.data("x"), E.param("r") * E.data("x"))
    x = [0.0, 1.0, 5.0]
    assert np.allclose(values(spark, lambda c: E.column(e, {"r": 0.3}), x), E.evaluate(e, {"r": 0.3}, {"x": np.array(x)}))


def test_incomplete_gamma_takes_as_many_terms_as_it_needs(spark):
    """Against closed forms, also where 300 terms were too few and where x is far above a."""
    from sparkbayes.functions.special import gamma_p

    xs = [1e-6, 0.00125, 0.5, 3.0, 12.5, 80.0, 400.0, 900.0, 1e6]
    df = spark.createDataFrame([(x,) for x in [*xs, 0.0, -1.0, None]], "x double")
    got = {r["x"]: r for r in df.select("x", gamma_p(1.0, F.col("x")).alias("one"), gamma_p(0.5, F.col("x")).alias("half"), gamma_p(900.0, F.col("x")).alias("far")).collect()}
    for x in xs:
        assert math.isclose(got[x]["one"], -math.expm1(-x), rel_tol=1e-10) and math.isclose(got[x]["half"], math.erf(math.sqrt(x)), rel_tol=1e-10)
    assert got[0.0]["one"] == got[-1.0]["one"] == 0.0 and got[None]["one"] is None
    total = sum(math.exp(k * math.log(900.0) - 900.0 - math.lgamma(k + 1)) for k in range(900))
    assert math.isclose(got[900.0]["far"], 1 - total, rel_tol=1e-8) and got[1e6]["far"] == 1.0 and got[3.0]["far"] == 0.0
