"""A corpus through five stages of the training-data operators.

Each stage works on all that the one before it kept; between stages the rows are written as Parquet and read again.
All stages but the last return the columns of the documents.  A group of near-duplicates keeps its smallest id; rows
with one id but different texts are different documents.  Null ids pass every stage whose decision needs an id: they
can't be the copy of a named document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.decontaminate import scan_documents
from threadloom.llm.nearcopies import near_copies
from threadloom.llm.queries import table, vocabulary
from threadloom.llm.secrets import redact
from threadloom.llm.sentencepiece_bpe import encode_texts
from threadloom.llm.toxicity import fit, keep_clean
from threadloom.session import checkpointed, ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, SIMILAR = 5, 80  # words of a run, and per cent of runs that near-duplicates share
WINDOW = 10  # words of a benchmark passage
REDACTED = "[secret]"


def documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity model, fitted to the labels, scores 0.5 or more."""
    docs = documents(docs)
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: of those with its smallest id, the one whose text has the
    smallest hash.  Rows of one id whose texts are in different groups are decided apart."""
    docs = documents(docs)
    found = near_copies(docs.where("doc_id is not null"), shingle=SHINGLE, percent=SIMILAR)
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    first = checkpointed(first.join(found.groupBy("doc_id", "th").agg(F.count("*").alias("rows")), ["doc_id", "th"]))
    named = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    single = named.join(first.where("rows = 1"), ["doc_id", "th"], "left_semi")
    # equal rows are brought together on the map side first
    several = named.join(first.where("rows > 1"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return documents(single).unionByName(documents(several)).unionByName(documents(docs.where("doc_id is null")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; documents of which nothing else is left go."""
    docs = documents(docs)
    found = scan_documents(docs, table(spark, sf_dir, "benchmark"), window=WINDOW, carry=("lang", "source", "n_chars"))
    left = found.where((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words")))
    n_chars = F.when(F.col("n_hit") > 0, F.length("text").cast("bigint")).otherwise(F.col("c_n_chars"))
    return left.select("doc_id", "text", F.col("c_lang").alias("lang"), F.col("c_source").alias("source"), n_chars.alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; all documents stay."""
    docs = documents(docs)
    out = redact(docs.withColumn("text_before", F.col("text")), mark=REDACTED)
    changed = ~F.col("text").eqNullSafe(F.col("text_before"))
    return documents(out.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (packed) of each document."""
    return encode_texts(documents(docs), vocabulary()).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("sentencepiece", sentencepiece),
]

#: Fitted scores, fingerprints and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    df, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{shared}/{k}-{name}"
        stage(spark, df, sf_dir).write.parquet(path)
        df = spark.read.parquet(path)
        if last:  # what it held is in the next one
            where = spark._jvm.org.apache.hadoop.fs.Path(last)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        last = path
    return df
