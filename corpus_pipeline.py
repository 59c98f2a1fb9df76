"""Raw documents to token ids: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage works on all rows that its
predecessor kept.

* quality rules: documents that fail the base rule or score too low are dropped;
* near-duplicates: the document with the smallest id of each group stays;
* benchmark decontamination: documents that contain a benchmark item are dropped;
  rows are told apart by id and text, so a null id or one of several texts loses no clean row;
* personal data: spans are replaced by their kind, and ``n_chars`` is counted again;
* byte-pair encoding: number and digest of the ids, digest of the text read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrid.llm import bpe, decontamination, near_duplicates, pii, quality_rules
from daygrid.llm.catalog import table
from daygrid.stage import checkpoint_root, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return quality_rules.quality(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that with the smallest id; of equal rows of one id, one stays.

    Rows are told apart by a 64-bit hash of id and text, so that an id may have several
    texts.  A document without an id is in no group and stays.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    docs = docs.select(*COLUMNS, key.alias("row_key"))
    rows = stage(docs.where("row_key is not null").groupBy("row_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    found = near_duplicates.near_duplicates(docs.select(F.col("row_key").alias("doc_id"), "text"), width=5)
    found = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("row_key")).agg(F.min("component_id").alias("component_id"))
    members = stage(rows.join(found, "row_key"))
    first = members.groupBy("component_id").agg(F.min(F.struct("id", "row_key")).alias("first")).select("first.row_key")
    dropped = stage(members.join(first, "row_key", "left_anti").select("row_key"))
    twice = stage(members.where("n > 1").select("row_key"))
    rest = docs.join(dropped.union(twice), "row_key", "left_anti").select(*COLUMNS)
    if twice.isEmpty():
        return rest
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = (docs.join(twice, "row_key", "left_semi").join(dropped, "row_key", "left_anti")
            .groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("o")).select("doc_id", "text", "o.*"))
    return rest.unionByName(once).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; the verdict is on the row, so null and repeated ids are rows like any other."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    key = F.xxhash64("doc_id", "text", F.col("doc_id").isNull())
    rows = docs.select(*COLUMNS, key.alias("row_key"))
    found = decontamination.contained_items(rows.select(F.col("row_key").alias("doc_id"), "text"), items)
    leaking = stage(found.select(F.col("doc_id").alias("row_key")).distinct())
    return rows.join(leaking, "row_key", "left_anti").select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs.select(*COLUMNS), pii.train(pii.labelled_windows(docs)))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents."""
    return bpe.token_digests(bpe.encode(docs, bpe.send_lexicon(docs, bpe.tokenizer_path())))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("bpe", encoding_stage),
]

#: The trained field and the hashed model have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = f"{checkpoint_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
