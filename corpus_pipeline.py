"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet before the next one reads it.

Toxic documents go; repeated lines go but for their first occurrence; of near-duplicates the document with the smallest id
stays; secrets are masked; what is left is packed into sequences of 2048 tokens. The first four return the columns of
``documents`` (``n_chars`` follows the text), the last one row per packed piece. The SQL of the toxicity model and of the
packing can't be written, so tests hold the pipeline against a plain version of its stages.

Defined cases: null texts are empty for every stage and stay null where nothing is cut from them; keys may be null or repeat
(rows are told apart by numbers of their own); of repeated rows the first keeps its lines and stays; ties of key go by the
text's hash; texts are read whole, however long; columns of any name are kept; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, near_dedup, packing, secrets, toxicity
from plumbline.llm.queries import BATCH_ROWS, WORD_BPE, tokenizer_path
from plumbline.llm.storage import materialize

SEQUENCE_TOKENS, END_ID, TOXIC_FROM = 2048, 0, 0.5
#: Documents are linked from this similarity on; op7 has a threshold of its own.
NEAR_PERCENT = 80


def _batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, model, TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return _recounted(line_dedup.dedup_lines(docs, shortest=1))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    return near_dedup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _batches(spark)
    pieces = materialize(packing.token_pieces(docs, tokenizer_path(WORD_BPE), END_ID, SEQUENCE_TOKENS), "pack-pieces")
    return packing.pack(pieces, SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
