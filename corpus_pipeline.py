"""From raw documents to packed sequences: the stages and what each of them keeps.

Every stage reads all that the one before kept, as Parquet in the shared folder, and its decisions
take effect: toxic documents go, of each group of near duplicates (five words, similarity
0.8) the document with the least doc_id stays, documents with benchmark passages go, personal
data is replaced by surrogates, and what is left is packed into sequences of 1024 tokens.

Nulls: a document without text or words is neither toxic nor a duplicate nor a leak; it stays, and is packed as its end
token. A null doc_id is kept; among near duplicates it goes before no other id. Repeated rows: one stays. Ties: of
several rows with the least doc_id of a group the first read stays. Very long texts go through each stage whole.
Columns beside doc_id and text stay, under any names, up to the last stage. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import decontamination, jaccard_join, packing, pii, toxicity
from logsift.llm.tokens import BYTE_BPE
from logsift.session import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.clean_documents(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_personal(docs, key="surrogates-1", count=None)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(BYTE_BPE), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal),
    ("packing", pack),
]
ORACLE_SQL = None  # no stage's method can be written in SQL; tests/llm/test_pipeline.py compares each with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
