"""A training corpus from raw documents: quality rules, near-duplicates, decontamination, secrets, token ids.

Every stage reads all that the stage before has kept, and its decisions take effect: rejected documents go, one document
of each group of near-duplicates stays, documents that leak a benchmark item go, secrets are replaced by a mark, and the
last stage encodes the texts and checks that the ids decode to them. All stages but the last return the columns of their
input.

Defined cases: a null text is an empty one, which the quality rules reject; a null id is like any other and the last one
where the least id stays; of repeated rows, and of documents whose fingerprints link them, one stays; ties go to the
least id; other columns are carried along whatever their names; empty tables give an empty table of the last stage's
columns. Each stage is written to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm import bpe, decontaminate, quality, secrets, simhash
from grantloom.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the fingerprints: three words a shingle, two bits a link."""
    return simhash.deduplicated(docs, size=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = bpe.default_ranks()
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
