"""From raw documents to tokens: toxic documents go, one of each group of near-duplicates stays, documents that hold
benchmark items go, private data gets surrogates, and what is left is encoded and decoded again.

Each stage reads what its predecessor kept, as a table, and returns the columns of documents; the last returns tokens.
Every filter judges rows, each by its own text, whatever their doc_id; rows equal in doc_id and text are one document. Extra columns are carried to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, decontam, minhash, pii, toxicity
from panelspark.llm.common import shared_dir

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon, learnt from the labelled ones, rejects."""
    return toxicity.clean(docs, toxicity.train(toxicity.labelled_documents(docs, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return minhash.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates in place of private data; n_chars follows the text."""
    held = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("entities",) if c in docs.columns})
    out = pii.replace(held).drop("entities").withColumnsRenamed({"__own_entities": "entities"}).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    return bpe.encode_decode(docs, *bpe.rank_file(), outputs=("n_tokens", "ids", "decoded_sha256"), remember=40_000, carry=20_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_private),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
