"""A training corpus from documents: toxic texts go, near duplicates go, benchmark
passages are cut out, secrets are redacted, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as
Parquet below the shared folder and reads it again as the next one's docs. All but the
last return the columns of documents.

Every stage reads the columns of documents only, so that others, of whatever names, don't matter. Null
and empty texts are kept up to packing, where they are one token, the end of a document. Rows that
repeat an id are judged row by row, but a text that goes as a near copy takes all rows of its id with it unless one of
them is kept; rows with a null id are never taken for copies of others. Very long texts are read whole.
Of copies, and of texts with equal scores, rows are treated alike, but for near duplicates, where the
smallest id stays. Empty tables give empty results, and empty labels or benchmarks leave all documents as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recitary.functions.ship import ship
from recitary.llm import op02_packing, op03_secrets, op06_toxicity, op07_minhash, op10_decontaminate
from recitary.llm.common import Workspace, text_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose score reaches their language's threshold. Without labels, or with one
    kind only, all stay whose share of toxic labels is below it."""
    text_batches(spark)
    model, thresholds = op06_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op06_toxicity.score(docs.select(*COLUMNS), model, thresholds).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies, under five-word
    shingles and a similarity of 0.8. Texts without words are copies of nothing."""
    text_batches(spark)
    return op07_minhash.keep_one(docs, size=5).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out benchmark passages; documents that consist of them for the most part go."""
    text_batches(spark)
    return _as_documents(op10_decontaminate.decontaminate(docs, op10_decontaminate.automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts every secret found; n_chars is that of the text as it is then, null for a null text."""
    text_batches(spark)
    return _as_documents(op03_secrets.scan(docs).withColumn("text", F.col("redacted")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of at most 2048. Each row is packed, also one
    that repeats an id; a null text is the end of a document alone."""
    text_batches(spark)
    return op02_packing.pack(docs, op02_packing.vocabulary_path(), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: No stage but the first filter could be put as SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result of the last one."""
    ws = Workspace(ship(spark), "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if k > 1:
            ws.drop(STAGES[k - 1][0])
    return docs
