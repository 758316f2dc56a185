"""A training corpus from documents, in five stages.

Quality rules drop bad documents; repeated line runs are removed; one document
of each group of near copies stays; sources are mixed to target weights; the
mix is packed into sequences.  Each stage takes what the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm import jaccard, lines, mixing, packing, quality
from pitloom.llm.queries import tokenizer_path
from pitloom.llm.session import checkpointed

#: SQL can express neither tokens nor the seeded draws.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.without_repeated_runs(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mixed(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_documents),
    ("line_dedup", distinct_lines),
    ("near_copies", distinct_documents),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
