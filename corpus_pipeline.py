"""From raw documents to packed training sequences.

Four stages, each over all rows its predecessor kept: documents that the quality rules reject go; documents whose
language isn't one of those learned, or isn't told from the others, go; of each group of near duplicates the one with
the smallest id stays; the rest is packed. Between stages the rows are written as Parquet to the shared folder and read again.

Defined cases: a null, empty or white text has fewer than ten words and goes in the first stage; a text of any length
is read whole; rows that repeat an id are documents of their own, told apart by the place they are stored at; of a group's
documents one with an id stays if there is one, of those with the same smallest id the one stored first; columns
named like what a stage computes come through unchanged; an empty table passes every stage and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbayes.llm import jaccard, langid, packing, quality
from sparkbayes.llm.common import discard, ready, stored, table


def apart(docs: DataFrame) -> DataFrame:
    """The text beside one column of all others, so that no name clashes with a computed one."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def together(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*["text" if c == "text" else F.col("_row").getField(c).alias(c) for c in columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    rules = quality.train(docs, table(spark, sf_dir, "labels"))
    return together(quality.judge(apart(docs), rules, keep_text=True).where("kept"), docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return together(langid.predict(apart(docs), model, keep_text=True).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = stored(apart(docs).withColumn("_place", F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard.clusters(rows, doc_id="_place").select(F.col("doc_id").alias("_place"), "component_id")
    named = found.join(rows.select("_place", F.col("_row.doc_id").alias("_id")), "_place")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_place"))
    stay = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first._place").alias("_place"))
    return together(rows.join(stay, "_place", "left_semi"), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES = [("quality rules", good_quality), ("language ID", known_language), ("n-gram Jaccard join", near_duplicates), ("packing", packed)]

#: Learned rules, a learned model and a tokenizer: SQL can't express the stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
