"""The corpus pipeline: quality rules, language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored and read again as the next one's docs.
All but the last keep the columns of documents, whatever they are called: stages add no column that could clash.

Defined results in every stage: an empty table gives an empty result; the result depends on texts and ids alone, so ties
and repeated rows are treated alike; texts are processed whole, however long. Nulls are stated with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import op2_dartminhash, op5_langid, op6_pii, op8_packing, op9_quality
from tidemill.llm.common import drop, saved, table
from tidemill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy of the rule ledger keeps. A null or empty text has too few words and goes; a repeated row stays or goes with its twin."""
    return op9_quality.accepted(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language, which becomes their lang (a null one too). A text that is null or has no letters has no language and goes."""
    return op5_langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class; all rows of that id stay. A null text, or a row with a null id, is like no other and stays."""
    return op2_dartminhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced, and n_chars brought up to date. A null text stays null."""
    return op6_pii.sanitised(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and where they lie in the sequences. A null text is an empty one: its piece is the closing id alone."""
    return op8_packing.packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: No SQL expresses the trained, hashed and packed stages; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        drop(before)  # what the stage before stored; an input table is left alone
    return STAGES[-1][1](spark, docs, sf_dir)
