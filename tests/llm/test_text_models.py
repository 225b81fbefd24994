"""Language identification and quality rules."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkbayes.llm import langid as L
from sparkbayes.llm import quality as Q


def test_held_out_accuracy(spark, sf_dir, docs):
    got = L.query(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null")
    right = got.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert {r["held_out"] for r in right} == {True, False} and all(r["a"] > 0.97 and 0 <= r["lo"] <= r["hi"] <= 1 for r in right)


def test_language_cases(spark, docs):
    model = L.train(docs, sample=200)
    df = spark.createDataFrame([(0, None, "x"), (1, "", "x"), (2, "123 !!", "x"), (3, "the and of that is", "x"), (4, "the and of that is", "x"), (5, "the " * 60000, "x")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "en" and got[3]["score"] == got[4]["score"]
    assert L.train(docs.limit(0)) is None and L.predict(df, None).where("lang_pred = 'und'").count() == 6
    assert L.predict(df.limit(0), model).count() == 0


def test_penalties_make_weights_sparse(docs):
    few, many = L.train(docs, sample=150, l1=0.5), L.train(docs, sample=150, l1=0.0)
    assert (few.weights != 0).sum() < (many.weights != 0).sum()


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(400, 3))
    truth = np.array([rng.choice(3, p=L.softmax(s / 2.5)) for s in scores * 4])
    t = L.calibrate(scores * 4, truth)
    loss = lambda t: -np.mean(np.log(L.softmax(scores * 4 / t)[np.arange(400), truth]))
    assert all(loss(t) <= loss(x) + 1e-9 for x in np.linspace(0.3, 10, 50)) and 1.8 < t < 3.5


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(len(re.findall(r"[#*$%&|<>]", w)) for w in words), dup, len(covered)


def test_statistics(docs):
    rng = random.Random(3)
    odd = ["", "a b c d e a b c d e", " \x1c x\x85y ", "a\n\na\n a\n", "x " * 50, *(" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(500))]
    for t in [*odd, *(r[0] for r in docs.select("text").collect())]:
        assert Q.statistics(t or "")[:5] == brute(t)


def test_repeats_with_many_words():
    rng = random.Random(4)
    words = [str(rng.randrange(9000)).encode() for _ in range(20000)]
    assert Q.repeated(words + words[:100])[0] == 200


def test_decision_list_finds_the_rules():
    rng = np.random.default_rng(5)
    x = {f: rng.uniform(size=3000) for f in Q.FEATURES}
    bad = ((x["upper_share"] > 0.8) & (x["mean_word"] <= 0.5)) | (x["dup_line_share"] > 0.9)
    rules = Q.learn(dict(x), bad.copy())
    hit = np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= Q.covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97 and Q.learn(dict(x), np.zeros(3000, dtype=bool)) == []


def test_quality_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = Q.query(spark, sf_dir)
    both = {tuple(r)[:2]: r[2] for r in got.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert both.get((0, True), 0) <= 0.1 * sum(n for (q, _), n in both.items() if q == 0)
    assert got.where("not base_failed and not kept").join(labels, "doc_id").where("quality = 1").count() == 0
    assert got.count() == docs.count() and got.where("base_failed and kept").count() == 0


def test_quality_cases(spark, docs):
    df = spark.createDataFrame([(0, None, 7), (1, "", 7), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_words int")
    got = Q.judge(df, []).collect()
    assert len(got) == 4 and all(r["base_failed"] and not r["kept"] for r in got) and [r["n_words"] for r in sorted(got, key=lambda r: (r["doc_id"], r["n_words"]))] == [0, 0, 2, 2]
    assert Q.judge(df.limit(0), []).count() == 0
    assert Q.train(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
