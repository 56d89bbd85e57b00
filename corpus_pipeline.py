"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, then packing.

Each stage takes what the stage before it kept, written as Parquet and read
again, and hands on the columns of ``documents``; the last one returns the pieces
of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.llm.common import table, written
from motifloom.llm.decontaminate import index_benchmark, leaks_of
from motifloom.llm.jaccard import one_of_each
from motifloom.llm.langid import UNDETERMINED, language_of, train_languages
from motifloom.llm.packing import pack_documents
from motifloom.llm.quality import THRESHOLD, quality_of, train_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior below which a document has no language it can be said to be in.
SURE = 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold.

    Null and empty texts are scored as texts without tokens; repeated rows stay or
    go together; rows with a null id teach nothing and are judged; an empty table
    gives no rows; other columns than those of ``documents`` are dropped.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return docs.select(COLUMNS).where(quality_of(spark, model, F.col("text")) >= THRESHOLD)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model is sure of.

    Null and empty texts and texts without a letter have none and go; repeated
    rows stay or go together; an empty table gives no rows; other columns than
    those of ``documents`` are dropped.
    """
    language = language_of(spark, train_languages(docs), F.col("text"))
    told = docs.select(*COLUMNS, language.alias("__language"))
    return told.where((F.col("__language.lang_pred") != UNDETERMINED) & (F.col("__language.score") >= SURE)).select(COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows are judged one by one: rows that share an id stay or go by their own
    texts, null ids come last, of repeats of the row that stays one stays, the
    first in the order of its columns.  Null texts and texts without words copy
    nothing and stay.  An empty table gives no rows; other columns than those of ``documents`` are dropped.
    """
    return one_of_each(docs.select(COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay, as do all rows where the benchmark is
    empty; repeated rows are judged alike; an empty table gives no rows; other
    columns than those of ``documents`` are dropped.
    """
    found = leaks_of(index_benchmark(table(spark, sf_dir, "benchmark")), F.col("text"))
    return docs.select(COLUMNS).where(F.size(found) == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null texts are empty and have the end id alone; repeated rows and ids are
    documents of their own; an empty table gives no rows.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the packing; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
