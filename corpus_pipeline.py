"""Corpus pipeline over documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and gives documents' columns again;
the last gives the encoded corpus. run() writes each stage's rows as Parquet in the shared folder and reads them for
the next one; what is between is deleted when the last stage's input is written.

Cases, in every stage: null ids and texts are rows like others, further columns pass through (but for those named like
an operator's results or keys, see there), very long texts are worked on whole, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, spill
from tallyspark.llm.decontaminate import decontaminate
from tallyspark.llm.minhash import near_duplicates
from tallyspark.llm.sentencepiece import round_trip
from tallyspark.llm.suffixarray import PASSAGE, Rule, remove
from tallyspark.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, rejects go. Null and empty texts have no features
    and stay unless most labelled rows are toxic; rows that repeat get equal scores; without labels all stay."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least doc_id; where none has one, the text
    of the least hash. Of rows that repeat one stays; null, empty and word-less texts are linked with nothing."""
    no_id = F.col("doc_id").isNull() & F.col("node").isNotNull()
    groups = [F.col("doc_id"), F.when(no_id, F.col("node")).alias("node"), F.when(~no_id, F.col("th")).alias("own")]
    kept = near_duplicates(docs, keyed=True).filter("kept").groupBy(*groups).agg(F.min("th").alias("th"), F.count(F.lit(1)).alias("_times"))
    kept = spill(kept.select("doc_id", "th", "_times"))
    a, b = docs.alias("a"), kept.alias("b")
    left = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.text") == F.col("b.th"))).select("a.*", "b._times")
    if not kept.filter("_times > 1").isEmpty():  # rows that repeat: one of them
        left = left.filter("_times = 1").unionByName(left.filter("_times > 1").dropDuplicates(["doc_id", "text"]))
    return left.select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that start anywhere else as well, same document included, leave the texts, whatever
    their bytes; n_chars follows. Every occurrence goes. A null text becomes empty, and rows stay, with what is left."""
    left = remove(docs, cut=Rule(PASSAGE, words=True), keep_text=True)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go. Null and empty texts
    hold none; rows that repeat go or stay together; without a benchmark all stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("not contaminated").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: a row per document with its ids, the digests of these and of what decoding gives back, and
    whether that is the text. Null and empty texts have no ids; rows that repeat get equal ids."""
    return round_trip(docs, keep_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-2]:
            docs = scratch.spill(stage(spark, docs, sf_dir))
        docs = spill(STAGES[-2][1](spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
