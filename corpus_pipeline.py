"""A corpus pipeline over ``documents``: each stage works on all that the one before kept.

toxicity -> MinHash near-dedup -> personal data -> mixing to target weights -> BPE.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.bpe_codec import encode_decode
from tallyforge.llm.common import cut, remove, shared_folder, table
from tallyforge.llm.minhash_dedup import near_duplicates
from tallyforge.llm.mixing import mixed_documents
from tallyforge.llm.pii import sanitised_documents
from tallyforge.llm.toxicity import clean_documents, train

WORD_BPE = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go."""
    return clean_documents(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group (runs of five words, similarity 0.8 or more) the smallest id stays; of rows
    that repeat an id and a text, one."""
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    text = F.xxhash64("text")
    repeated = docs.where("doc_id is not null").groupBy("doc_id", text.alias("text_hash")).count().where("count > 1").select("doc_id").distinct()
    repeated = cut(repeated)
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced by their classes."""
    return _same_columns(sanitised_documents(docs), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; the row at a source's budget in part."""
    return _same_columns(mixed_documents(docs), docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, and a digest of what they decode to."""
    return encode_decode(docs, public_tokenizers.path(WORD_BPE), outputs=("ids", "decoded_sha256"))


def _same_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("bpe", bpe),
]
#: The classifier and the hash order of the mix have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again.
    A stage's folder goes when the next one's is written; only the last stays, as the result."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
