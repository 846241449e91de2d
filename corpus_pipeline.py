"""A corpus pipeline of five stages: filter, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the
last return the columns of documents.  A stage's result is written as Parquet
in the folder of ``spark.checkpoint.dir`` and read again as the next one's
documents, so a lost executor costs no more than its tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, near_dup, packing, pii, toxicity
from graphloom.llm._io import table
from graphloom.plans.lineage import drop_written, written

#: Documents whose toxicity score is at least this go.
REJECT_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on labelled rows outside fold 0, doesn't take for toxic.

    Null and empty texts score what no word says, as a model without labels scores all.  Repeated rows
    and rows with a null id are judged like others; no documents give none.  Columns may have any names.
    """
    weights = toxicity.fit(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), "toxic", 5, 0))
    scored = toxicity.score_toxicity(docs, weights)
    return scored.filter(F.col(scored.columns[-1]).getField("score") < REJECT_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of one id's rows the first by text.

    Documents without words and rows with a null id stay; no documents give none.
    """
    return near_dup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts, null ids and repeated rows stay; an empty benchmark keeps all.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts, null ids and repeated rows stay."""
    return pii.redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null or empty text is a piece of the end alone; repeated rows are packed repeatedly; no documents give none.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("best_fit_packing", pack),
]

#: Models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's table goes when the next one is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if held is not None:
            drop_written(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
