"""Priors, model rewrites, the facade, loaders, streams and the catalog."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkbayes.operators import numeric
from sparkbayes.plans import model as M
from sparkbayes.plans import priors as P
from sparkbayes.plans.builder import LinearModel, LogisticModel
from sparkbayes.sources import loader
from sparkbayes.streaming import online


def test_priors_round_trip():
    p = P.Prior("Normal", mu=P.Prior("Normal", mu=1.0, sigma=2.0), sigma=P.Prior("HalfNormal", sigma=1.0), dims=("a", "b"), centered=False, transform="exp")
    assert P.Prior.from_dict(json.loads(json.dumps(p.to_dict()))) == p
    for x in (P.Censored(P.Prior("Normal", mu=0.0, sigma=1.0), lower=-1.0), P.Scaled(P.Prior("Exponential", lam=2.0), 3.0)):
        assert P.deserialize(json.loads(json.dumps(x.to_dict()))) == x
    with pytest.raises(P.DeserializableError):
        P.deserialize({"unknown": 1})


@pytest.mark.parametrize(
    "make,error",
    [
        (lambda: P.Prior("Nope"), P.UnsupportedDistributionError),
        (lambda: P.Prior("Normal", rate=1.0), ValueError),
        (lambda: P.Prior("Normal", mu="x"), ValueError),
        (lambda: P.Prior("Gamma", alpha=1.0, beta=1.0, centered=False), ValueError),
        (lambda: P.Prior("Normal", transform="nope"), P.UnknownTransformError),
        (lambda: P.Prior("Normal", mu=P.Prior("Normal", dims="a"), sigma=1.0), P.UnsupportedShapeError),
        (lambda: P.Prior("Exponential", lam=1.0).likelihood(0.0), P.UnsupportedDistributionError),
        (lambda: P.Prior("Normal", mu=1.0, sigma=1.0).likelihood(0.0), ValueError),
    ],
)
def test_bad_priors(make, error):
    with pytest.raises(error):
        make()


def test_prior_draws(spark):
    p = P.Prior("Normal", mu=P.Prior("Normal", mu=1.0, sigma=0.5), sigma=2.0, dims="g", centered=False)
    got = p.sample(spark, {"g": ["a", "b"]}, draws=4000, seed=1)
    assert {*got.columns} == {"draw", "g", "x_mu", "x_offset", "x"} and got.count() == 8000
    mean, sd = got.agg(F.avg("x"), F.stddev("x")).head()
    assert abs(mean - 1) < 0.1 and abs(sd - math.sqrt(4.25)) < 0.1
    for prior, m in ((P.Prior("Gamma", alpha=3.0, beta=2.0), 1.5), (P.Prior("Gamma", alpha=0.5, beta=1.0), 0.5), (P.Prior("Beta", alpha=2.0, beta=6.0), 0.25), (P.Prior("StudentT", nu=8.0, mu=2.0, sigma=1.0), 2.0), (P.Prior("Poisson", mu=3.0), 3.0), (P.Prior("Exponential", lam=4.0), 0.25)):
        assert abs(prior.sample(spark, draws=4000).agg(F.avg("x")).head()[0] - m) < 0.08, prior
    c = P.Censored(P.Prior("Normal", mu=0.0, sigma=1.0), lower=-0.5, upper=1.0).sample(spark, draws=500).agg(F.min("x"), F.max("x")).head()
    assert tuple(c) == (-0.5, 1.0)
    with pytest.raises(KeyError):
        p.sample(spark)
    P.register_transform("plus_one", lambda x: x + 1)
    assert P.Prior("Deterministic", value=1.0, transform="plus_one").sample(spark, draws=1).head()["x"] == 2.0


def test_constrained_priors_hold_the_mass(spark):
    for d in ("Normal", "Uniform"):
        p = P.Prior(d).constrain(1.0, 3.0, 0.9)
        share = p.sample(spark, draws=6000).agg(F.avg(F.col("x").between(1.0, 3.0).cast("int"))).head()[0]
        assert abs(share - 0.9) < 0.02


def test_alignment_needs_labels(spark):
    a = spark.createDataFrame([(1, 2.0)], "g int, a double")
    with pytest.raises(P.UnsupportedShapeError):
        P.align({"a": a}, {"a": ("g",)}, {})


MIX = M.Model((M.rv("z", "Bernoulli", p=0.3), M.rv("y", "Normal", mu=M.Pick("z", (0.0, 2.0)), sigma=1.0, observed="y")))


def test_finite_marginal_and_back(spark):
    got = M.marginalize(MIX, ["z"])
    assert [n.dist for n in got.nodes] == ["Marginal"] and M.equivalent(M.unmarginalize(got), MIX)
    df = spark.createDataFrame([(1, 0.5), (2, 1.7)], "id int, y double")
    f = lambda y, m: math.exp(-0.5 * (y - m) ** 2) / math.sqrt(2 * math.pi)
    assert math.isclose(M.model_logp(got, df), sum(math.log(0.7 * f(y, 0) + 0.3 * f(y, 2)) for y in (0.5, 1.7)))
    draws = spark.range(3000).select(F.col("id").alias("draw"))
    share = M.recover(got, df.limit(1), draws, "z", "id").agg(F.avg("z")).head()[0]
    assert abs(share - 0.3 * f(0.5, 2) / (0.7 * f(0.5, 0) + 0.3 * f(0.5, 2))) < 0.03
    with pytest.raises(TypeError):
        M.conditional(got, got)
    with pytest.raises(ValueError):
        M.unmarginalize(got, ["nope"])
    with pytest.raises(ValueError):
        M.marginalize(MIX, ["y"])


def test_normal_marginal_with_free_parameter(spark):
    model = M.Model((M.rv("m", "Normal", mu=0.0, sigma=5.0), M.rv("x", "Normal", mu=M.Ref("m"), sigma=2.0), M.rv("y", "Normal", mu=M.Ref("x", 3.0, 1.0), sigma=0.5, observed="y")))
    got = M.marginalize(model, ["x"])
    df = spark.createDataFrame([(4.0,)], "y double")
    s = math.sqrt(0.25 + 36)
    want = -0.5 * ((4 - 1 - 3 * 0.7) / s) ** 2 - math.log(s) - 0.5 * math.log(2 * math.pi) - 0.5 * (0.7 / 5) ** 2 - math.log(5) - 0.5 * math.log(2 * math.pi)
    assert math.isclose(M.model_logp(got, df, {"m": 0.7}), want)
    c = M.conditional(got, "x", {"m": 0.7})
    mean, sd = df.select(c["mean"], c["sd"]).head()
    assert math.isclose(sd, 1 / math.sqrt(1 / 4 + 36)) and math.isclose(mean, (0.7 / 4 + 12 * 3) * sd**2)
    with pytest.raises(NotImplementedError):
        M.marginalize(model.add(M.Node("d", "Deterministic", (("of", M.Ref("x")),))), ["x"])
    laplace = M.marginalize(M.Model((M.rv("x", "Normal"), M.rv("y", "Poisson", mu=M.Ref("x"), observed="y"))), ["x"], laplace={"x": np.eye(1)})
    assert laplace.nodes[0].rule == "laplace"
    with pytest.raises(NotImplementedError):
        M.row_logp(laplace)


def test_reparametrization_and_printing(spark):
    model = M.Model((M.rv("x", "Normal", mu=2.0, sigma=3.0, dims=("g",)), M.rv("y", "Normal", mu=M.Ref("x"), sigma=1.0, observed="y")), (("g", (1, 2, 3)),))
    for w in (0.0, 0.4, 1.0):
        new = M.reparametrize(model, "x", w)
        tau, back = new["x_tau"], new["x"].get("of")
        assert math.isclose(back.slope * tau.get("sigma"), 3.0) and math.isclose(back.offset + back.slope * tau.get("mu"), 2.0)
    assert model.n_parameters() == 3 and "total parameters: 3" in M.model_table(model)
    with pytest.raises(NotImplementedError):
        M.reparametrize(model.add(M.rv("p", "Poisson", mu=1.0)), "p", 0.5)

    @M.as_model({"g": [1, 2]})
    def made(scale):
        return [M.rv("x", "Normal", sigma=scale, dims=("g",))]

    assert made(scale=2.0).n_parameters() == made(scale=3.0).n_parameters() == 2


def test_linear_model(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(a), float(1 + 2 * a + 0.5 * e)) for i, (a, e) in enumerate(zip(x, rng.normal(size=300), strict=True))], "id int, input double, output double")
    model = LinearModel(sampler_config={"draws": 50}).fit(df)
    assert np.allclose(model.fitted.mean, [1, 2, math.log(0.5)], atol=0.15)
    assert np.allclose(numeric.ols(df, "output", ["input"]), model.fitted.mean[:2], atol=0.02)
    at = f"file://{tmp_path}/model"
    model.save(at)
    again = LinearModel.load(spark, at)
    assert again.id == model.id and np.allclose(again.fitted.mean, model.fitted.mean) and again.posterior.count() == 50
    assert abs(again.predict(df).agg(F.avg(F.col("prediction") - F.col("output"))).head()[0]) < 0.1
    assert again.predict_posterior(df.limit(2), "id").count() == 100 and model.sample_prior(spark, 10).count() == 10
    with pytest.raises(RuntimeError):
        LinearModel().predict(df)
    with pytest.raises(ValueError):
        loader.load_tables(spark, at, expect_id="other")


def test_logistic_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    p = 1 / (1 + np.exp(-(0.3 + x @ [1.5, -1.0])))
    df = spark.createDataFrame([(i, float(a), float(b), int(u < q)) for i, ((a, b), q, u) in enumerate(zip(x, p, rng.uniform(size=500), strict=True))], "id int, a double, b double, hit int")
    model = LogisticModel({"x": ["a", "b"], "y": "hit"}, {"draws": 200, "seed": 1}).fit(df)
    assert np.allclose(model.fitted.mean, [0.3, 1.5, -1.0], atol=0.4)
    got = {r.id: r.probability for r in model.predict_proba(df).collect()}
    draws = np.array([[r[n] for n in model.parameters()] for r in model.posterior.collect()])
    want = (1 / (1 + np.exp(-(draws[:, :1] + draws[:, 1:] @ x.T)))).mean(axis=0)
    assert np.allclose([got[i] for i in range(500)], want) and abs(want - p).mean() < 0.08
    assert model.predict(df).where((F.col("probability") >= 0.5) != (F.col("prediction") == 1)).isEmpty()
    share = model.predict_posterior(df.limit(3), "id").groupBy("id").agg(F.avg("prediction").alias("p")).collect()
    assert all(abs(r.p - got[r.id]) < 0.15 for r in share)
    model.save(f"file://{tmp_path}/m")
    assert LogisticModel.load(spark, f"file://{tmp_path}/m").predict_proba(df).count() == 500


def test_loader(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") * 2.0).alias("v"), F.col("id").cast("string").alias("s")).repartition(3).write.parquet(f"file://{tmp_path}/t")
    df = loader.parquet_source(spark, f"file://{tmp_path}/t", columns=["id", "v"])
    assert df.count() == 1000
    for bad in (["s"], ["nope"]):
        with pytest.raises(ValueError):
            loader.parquet_source(spark, f"file://{tmp_path}/t", columns=bad)
    with pytest.raises(ValueError):
        loader.parquet_source(spark, f"file://{tmp_path}/nothing")
    one, two = loader.batches(df, 64, seed=1, epoch=1, buckets=2), loader.batches(df, 64, seed=1, epoch=2, buckets=2)
    assert {r["count"] for r in one.groupBy("batch").count().collect()} == {64} and one.select("id").distinct().count() == one.count() >= 1000 - 2 * 63
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, loader.batches(df, 64, seed=1, epoch=1, buckets=2).collect())) != sorted(map(tuple, two.collect()))
    data = loader.DataLoader(df, 100, shuffle=True)
    assert len(data) == 10 and all(b.shape == (100, 2) for b in data) and sum(len(b) for b in loader.DataLoader(df, 100)) == 1000
    with pytest.warns(UserWarning):
        loader.DataLoader(df, 10, total_size=None)
    with pytest.raises(ValueError):
        loader.DataLoader(df.limit(0), 10)


def test_batches_lose_less_than_one_and_mix_equal_rows(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("v"), F.lit(1.0).alias("w")).repartition(5)
    got = {r["batch"]: r for r in loader.batches(df, 64, buckets=20).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")).collect()}
    assert sorted(got) == list(range(10_000 // 64)) and {r["n"] for r in got.values()} == {64}
    assert all(0.4 < r["mean"] < 1.6 for r in got.values())
    data = loader.DataLoader(df, 300, shuffle=True)
    assert [len(list(data)), len(list(data))] == [len(data)] * 2
    assert loader.batches(df.limit(63), 64).count() == 0 and loader.batches(df.limit(64), 64, buckets=9).count() == 64


def test_streams(spark, tmp_path):
    at = f"file://{tmp_path}/in"
    rows = [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 5.0), (1, 2, None), (1, 3, 3.0)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "series long, t long, y double").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema("series long, t long, y double").option("maxFilesPerTrigger", 1).parquet(at)
    out = online.online_level(stream, "series", "t", "y", a0=0.0, P0=10.0, H=1.0, Q=0.5)
    q = out.writeStream.format("memory").queryName("levels").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from sparkbayes.operators import statespace as S

    model = S.StateSpace(T=[[1.0]], Z=[[1.0]], R=[[1.0]], H=[[1.0]], Q=[[0.5]], x0=[0.0], P0=[[10.0]])
    f = S.kalman(model, np.array([1.0, 2.0, np.nan, 3.0]))
    last = spark.table("levels").where("series = 1").orderBy(F.desc("n")).head()
    assert last["n"] == 4 and math.isclose(last["level"], f.next_state[0]) and math.isclose(last["loglike"], f.loglike.sum())
    times = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", float(m)) for m in (1, 5, 31, 59)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = online.windowed(times, "ts", "v", size="30 minutes").orderBy("window").collect()
    assert [r["n"] for r in got] == [2, 2] and got[0]["mean"] == 3.0


def test_catalog_and_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    names = entry.queries()
    assert {*entry.oracle_sql()} <= {*names} and "gev_logp_by_flag" in names


def test_every_query_equals_its_sql(spark, sf_dir):
    import duckdb

    from sparkbayes.plans.catalog import ORACLES, QUERIES

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf_dir)
        columns = sorted(got.columns)
        cursor = c.execute(sql)
        there = [d[0] for d in cursor.description]
        assert sorted(there) == columns, name
        want = [tuple(r[there.index(k)] for k in columns) for r in cursor.fetchall()]
        mine = [tuple(r) for r in got.select(*columns).collect()]
        key = lambda r: tuple(round(v, 3) if isinstance(v, float) else str(v) for v in r)
        assert len(mine) == len(want), name
        for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
            assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-3) for x, y in zip(a, b, strict=True)), (name, a, b)


def test_sources_in_memory_and_blocks_as_they_are(spark, tmp_path):
    x = np.arange(24.0).reshape(12, 2)
    assert loader.memory_source(spark, x).columns == ["x0", "x1"] and loader.memory_source(spark, lambda: iter([x, x]), ["a", "b"]).count() == 24
    once = iter([x, x[:3]])
    assert loader.memory_source(spark, once).count() == 15
    with pytest.raises(RuntimeError):
        loader.memory_source(spark, once)
    with pytest.raises(ValueError):
        loader.memory_source(spark, [x, x[:, :1]])
    df = spark.range(0, 1000, 1, 3).select(F.col("id").alias("a"), F.when(F.col("id") > 3, F.col("id") % 7).alias("b"))
    df.write.parquet(str(tmp_path / "t"))
    blocks = [*loader.source_blocks(loader.parquet_source(spark, str(tmp_path / "t")))]
    whole = np.concatenate(blocks)
    assert sorted(whole[:, 0]) == list(range(1000)) and np.isnan(whole[whole[:, 0] <= 3, 1]).all() and sum(len(b) for b in loader.DataLoader(df, 64)) == 1000
    with pytest.raises(ValueError):
        next(loader.source_blocks(df.select(F.lit("s").alias("s"))))
