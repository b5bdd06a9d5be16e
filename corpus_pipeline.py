"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again for the next.

Quality classifier, SimHash near-dedup, secret scan, mixing of sources, byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm import op1_quality, op2_mix, op6_simhash, op7_secrets, op10_bpe
from siltlog.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, rows without a text by the score of an empty one."""
    return op1_quality.keep_good(docs, op1_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document stays."""
    return op6_simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; no document goes. n_chars follows the text."""
    clean = op7_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes their words, so that each source's words come near its target.

    Documents that the mix takes nothing of go; texts without words stay once. Each row has its own share, also among
    rows without an id or of one id.
    """
    return op2_mix.materialised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of each document, their number, and the number of bytes that decoding them gives back.

    Every row gives one, repeated rows too; a null text has no ids.
    """
    path, pattern = op10_bpe.public_vocabulary()
    encoded = op10_bpe.encode_decode(docs, path, pattern)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.length("decoded").cast("long").alias("n_bytes"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Neither the trained classifier nor XXH64 fingerprints can be stated in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage kept is written in the shared folder and read back, and goes with the session."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
