"""Training-corpus pipeline: five stages, each one of the corpus operators.

A stage takes the documents that the stage before it kept. The first four return
the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard_join, line_dedup, sentencepiece_scan, toxicity
from quern.llm.common import identified, public_id
from quern.llm.queries import TOKENIZER
from quern.session import Tables, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go."""
    return toxicity.without_toxic(docs, Tables(spark, sf_dir).labels)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but the largest document that holds them."""
    return line_dedup.rewrite(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more go."""
    return decontaminate.clean(docs, Tables(spark, sf_dir).benchmark)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every document that is left."""
    done = sentencepiece_scan.encode(identified(docs), TOKENIZER)
    return done.select(public_id().alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("tokens", tokenise),
]

# A trained classifier and a tokenizer's lattice are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = Tables(spark, sf_dir).documents
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
