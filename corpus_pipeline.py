"""From raw documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:

1. quality: documents that the quality rules reject go;
2. near_duplicates: one document of each group of near-duplicates stays, the least by doc_id; texts whose
   sets of five-word shingles overlap by 80 per cent or more are near-duplicates;
3. decontamination: documents that repeat a benchmark item go;
4. pii: personal data in texts is replaced by its kind, and n_chars follows;
5. packing: token pieces in windows.

Between stages the documents are written to the shared folder and read again, so a lost executor costs
no earlier stage. Nulls, empty tables and repeated rows are handled as the operators say; extra columns
pass through up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import common, decontamination, jaccard_join, packing, pii, quality


#: The stage's own rule for near-duplicates; op3_jaccard_join keeps the rule of its contract.
SHINGLE = 5
PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, shingle=SHINGLE, percent=PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = pii.redact(docs)
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("pii", redact_pii), ("packing", pack_tokens)]

#: Neither near-duplicate components nor token windows can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``. A stage's table is deleted once the next one is written."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
