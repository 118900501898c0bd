"""A training corpus from raw documents, in five stages.  Each takes (spark,
docs, sf_dir) and returns a frame, written as Parquet and read again for the
next; all but the last return the columns of documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moundflow.llm import decontaminate, importance, line_dedup, mixing, simhash
from moundflow.session import ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample takes and that are not toxic; the
    others go.  Null and empty texts weigh 0 and stay or go by their noise; equal
    rows share it."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that stand earlier.  Null,
    empty and shorter texts are unchanged; repeated rows are one document."""
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest id.  Null and empty texts
    are one group; of repeated rows one stays."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.  Null and empty texts have
    none and stay; repeated rows are judged alike."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes.  The mix
    itself, slot by slot, is written to ``mixed_corpus(spark)``.  Null and empty
    texts have no words and none taken; repeated rows take places of their own."""
    plan, parts, taken = mixing.mix_sources(docs)
    mixing.mixed_order(plan, parts).write.mode("overwrite").parquet(mixed_corpus(spark))
    return taken


def mixed_corpus(spark: SparkSession) -> str:
    """The folder of the order in which the session's last run reads its documents."""
    return f"{ensure_checkpoint_dir(spark)}/mixed-{spark.sparkContext.applicationId}"


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near),
          ("benchmark_decontamination", decontaminate_benchmark), ("source_mixing", mix)]

#: The classifier's random sample and the XXH64 fingerprints have no SQL form;
#: tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    import uuid
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
