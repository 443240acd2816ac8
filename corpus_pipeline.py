"""The corpus pipeline: STAGES over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomscape.llm.common import table, work_path
from loomscape.llm.decontamination import drop_contaminated
from loomscape.llm.line_dedup import dedup_lines
from loomscape.llm.near_duplicates import drop_near_duplicates
from loomscape.llm.packing import pack_documents
from loomscape.llm.quality import keep_good
from loomscape.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and wordless texts among them; repeated rows
    are judged alike; an empty table stays empty."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of lines the first by doc_id and place stays; no document goes. Null
    texts stay null; a document that loses all its lines has an empty text."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays, one row of it;
    documents without words or doc_id stay as they are."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; null texts hold none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents that are left, each with its place in a sequence; a null
    text has its end id."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Robust estimates and the packing's sweeps can't be told in one SQL statement. The tests
#: hold run() against its stages, one after another, and each operator but the estimates of
#: the first stage against a brute-force version of its own; there is none of all five together.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir. All stages but the last return the
    columns of documents, whatever else these hold; each one's rows are written to the shared
    folder, from which the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
