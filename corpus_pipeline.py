"""Corpus preparation: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of ``documents``.

Rows are told apart by a row id in every stage that filters, so documents with
a null or a repeated doc_id are documents of their own: a null one comes before
all others, and of rows that are copies of each other one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.llm import linededup, mixing, packing, simhash, toxicity
from stratabar.llm.common import Scratch, table, with_rid

#: Share of tokens that the mixing stage keeps.
KEEP = 0.8
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold; the model learns from the training fold of ``labels``."""
    model = toxicity.train(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_below(spark, docs, model, TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat or nearly repeat an earlier one."""
    out = linededup.clean(*linededup.kept_lines(spark, docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies."""
    rows = with_rid(docs, "doc_id", Scratch(spark, "copies"))
    groups = simhash.classes(spark, rows, key="__rid")
    return rows.join(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__rid")), "__rid", "left_semi").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by probabilities raked to source, language and topic targets."""
    rows = with_rid(docs, "doc_id", Scratch(spark, "mix"))
    drawn = mixing.sample(spark, rows, KEEP, keep=["__rid"])
    return rows.join(drawn.where("kept").select("__rid"), "__rid", "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1,024 ids."""
    return packing.pack(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the toxicity model nor XXH64 nor byte-pair ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(name.replace(" ", "_"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
