"""The pipeline's stages, each on its predecessor's rows, against plain code."""

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from sparkbayes.llm.common import stored  # noqa: E402

from .test_pairs import brute  # noqa: E402
from .test_text_models import brute as statistics  # noqa: E402


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "language ID", "n-gram Jaccard join", "packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf_dir), "test-stage")
        if name != "packing":
            assert after.columns == docs.columns
            had, has = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, after))
            assert all(had[i] == t for i, t in has.items()) and has
        if name == "quality rules":
            for i, t in had.items():
                n, _, _, _, again = statistics(t)
                if n < 10 or 100 * again > 20 * n:
                    assert i not in has
            clean = [i for i in had if labels.get(i) == 1 and statistics(had[i])[0] >= 10 and 100 * statistics(had[i])[4] <= 20 * statistics(had[i])[0]]
            assert sum(i in has for i in clean) >= 0.98 * len(clean)
        if name == "language ID":
            assert len(has) >= 0.99 * len(had)
        if name == "n-gram Jaccard join":
            assert {*has} == {d for d, _, c in brute([*had.items()]) if d == c}
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {*has}
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()


def test_empty(spark, sf_dir, docs):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none_after = stage(spark, none, sf_dir)
        assert none_after.count() == 0


def test_clashing_names_repeated_ids_and_odd_texts(spark, sf_dir, docs):
    """Columns named like results come through; different texts of one id both stay, equal ones and near copies don't; rows without an id give way."""
    texts = [" ".join(f"word{k}{i}" for i in range(60)) for k in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[0] + " more"), (None, texts[0]), (None, texts[2]), (9, None), (9, ""), (9, "  ")]
    df = spark.createDataFrame([(d, t, "k", 7, i, "r") for i, (d, t) in enumerate(rows)], "doc_id long, text string, kept string, score int, n_words int, _row string")
    got = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert got.columns == df.columns and all((r["kept"], r["score"], r["_row"]) == ("k", 7, "r") for r in got.collect())
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.where("text LIKE 'word%'").collect()) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2])])
    good = corpus_pipeline.good_quality(spark, df, sf_dir)
    assert good.columns == df.columns and good.where("doc_id = 9").count() == 0 and {r["kept"] for r in good.collect()} <= {"k"}
    long = docs.where("lang = 'en'").limit(1).withColumn("text", F.concat_ws(" ", F.array_repeat("text", 300))).withColumn("lang_pred", F.lit("x")).unionByName(docs.limit(150).withColumn("lang_pred", F.lit("x")))
    told = corpus_pipeline.known_language(spark, long, sf_dir)
    assert told.columns == long.columns and {r["lang_pred"] for r in told.select("lang_pred").distinct().collect()} == {"x"} and told.where("length(text) > 30000").count() >= 1
