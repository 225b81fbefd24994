"""Fitted weights of a re-expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkbayes.operators import vip


def test_slopes_equal_differences():
    rng = np.random.default_rng(0)
    y = rng.normal(size=4)
    like = lambda x: (float(-0.5 * ((y - x) ** 2).sum() / 0.3), (y - x) / 0.3)
    z, w = rng.normal(size=6), rng.uniform(0.1, 0.9, 4)
    f = lambda z, w: vip.log_joint(z, w, like, (0.5, 2.0), (-0.3, 0.7))
    _, dz, dw = f(z, w)
    h = 1e-6
    assert np.allclose(dz, [(f(z + h * e, w)[0] - f(z - h * e, w)[0]) / (2 * h) for e in np.eye(6)], atol=1e-5)
    assert np.allclose(dw, [(f(z, w + h * e)[0] - f(z, w - h * e)[0]) / (2 * h) for e in np.eye(4)], atol=1e-5)


def test_much_data_centre_and_little_do_not(spark):
    rng = np.random.default_rng(1)
    x = 1.0 + 0.8 * rng.normal(size=8)
    df = spark.createDataFrame([(j, float(x[j] + rng.normal() * s), s) for j in range(8) for s in (0.5, 20.0) for _ in range(60 if s == 0.5 else 3)], "g int, y double, s double")
    strong = vip.fit_vip(vip.grouped_normal(df.where("s = 0.5"), "g", "y", 0.5)[1], 8)
    keys, like = vip.grouped_normal(df.where("s = 20"), "g", "y", 20.0)
    weak = vip.fit_vip(like, 8)
    assert keys == [*range(8)] and strong.weights.min() > 0.8 and weak.weights.max() < 0.25
    assert np.mean(strong.bounds[-50:]) > np.mean(strong.bounds[100:150])
    means = np.array([r.m for r in df.where("s = 0.5").groupBy("g").agg(F.avg("y").alias("m")).orderBy("g").collect()])
    assert np.allclose(strong.latents(np.random.default_rng(0), 2000).mean(axis=0), means, atol=0.1)
    half = vip.fit_vip(like, 8, steps=1)
    assert np.allclose(half.weights, 0.5, atol=0.05)
