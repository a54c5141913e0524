"""A training-data pipeline over `documents`: each stage is one operator of modelloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs; all but the last keep the columns of documents. An empty table passes through. Each stage first hands back what
the driver holds of the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelloom.llm import decontaminate, language_id, mixing, near_copies, simhash, token_output
from modelloom.llm.common import documents, released, saved
from modelloom.llm.sampling import fold


#: Rows that go to a Python worker at once: whole texts, so fewer than Spark's 10,000.
ROWS_AT_ONCE = "1000"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter) go. Learns from lang, where it is given."""
    released(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    model = language_id.learnt(docs, docs.filter(fold(F.col("doc_id"), 4) != 2))
    return language_id.identified(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents link at a similarity of 0.8 or more of their five-word shingles; of each group that links lead through, one stays."""
    released(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return simhash.one_of_each(docs, near_copies.near_groups(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    released(spark)
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a row for each document and pass that takes any word of it, with the words taken."""
    released(spark)
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, written and read back: doc_id, start, n_tokens, ids_crc32."""
    released(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    return token_output.token_output(docs, most_kept=150_000)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Hash majorities, a low-discrepancy schedule and a tokenizer: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
