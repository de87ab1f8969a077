"""A training-data pipeline over ``documents``: five stages, each by one operator.

1. Language ID: documents without a known language go.
2. Quality: documents that the classifier rejects go.
3. N-gram Jaccard join: one document of each group of near duplicates stays.
4. Decontamination: documents that contain a benchmark item go.
5. BPE: token counts and digests of what stays.

Each stage works on all that the one before kept, and on whole texts of any length.
Null and empty texts: the first stage drops them, for they have no letter.  Repeated
rows, and of near duplicates all but the one with the least id: the third stage drops
them.  An empty table gives no rows.  Columns beyond those of ``documents`` pass
through all stages, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, decontamination, jaccard, language_id, quality
from tallyweave.llm.common import held_out, shared_dir, table, temporary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns as op4 does, from the documents themselves."""
    model = language_id.fit_language(docs, ~held_out("doc_id", 4, 2))
    return language_id.keep_language(docs, model)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns as op2 does, from the labels of what the stage before kept."""
    model, _ = quality.learned(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return quality.keep_quality(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the number of tokens and digests of the ids and of the text decoded from them."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = bpe.bpe_encode_decode(rows, bpe.default_path(), "row", "text", within=True)
    return out.select("row", *bpe.digests()).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("quality", good),
    ("jaccard", distinct),
    ("decontamination", clean),
    ("bpe", encoded),
]

#: The stages before the last learn, hash and align; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        temporary(spark, path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
