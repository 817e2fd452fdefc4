"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.

1. quality       rejects documents of high perplexity (op 6)
2. line_dedup    removes lines that are on many sites, but for one copy; a document
                 that has no text left after it goes (op 9)
3. simhash_dedup keeps the first document of each near-duplicate group (op 4); rows that
                 share an id and a text are one document
4. secrets       replaces confirmed secrets in the text (op 7)
5. packing       packs what is left into training sequences (op 8)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import lines, packing, quality, secrets, simhash
from fieldtally.llm.common import cut, perhaps_in, small_batches, table
from fieldtally.llm.queries import trusted_ids
from fieldtally.operators.graph import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.judge(docs.select(*COLUMNS), trusted_ids(spark, sf_dir))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cleaned = lines.remove_boilerplate(docs.select(*COLUMNS), out_cols=("__lines", "__removed"))
    emptied = (F.col("__removed") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    return _columns(cleaned.where(~F.coalesce(emptied, F.lit(False))))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = simhash.near_duplicates(docs)
    # An id stays if one of its rows comes first in its group; rows without id stay.
    ids = cut(groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1 AND doc_id IS NOT NULL"))
    # Only texts that are likely to go are shuffled.
    told = perhaps_in(docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")), ids.select(F.col("doc_id").cast("string").alias("key")), "key")
    same = told.where("NOT perhaps OR doc.doc_id IS NULL").select("doc.*")
    some = told.where("perhaps AND doc.doc_id IS NOT NULL").select("doc.*")
    some = some.join(ids.where("NOT first").select("doc_id"), "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return _columns(same.unionByName(some))


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return _columns(secrets.redact_secrets(docs.select(*COLUMNS)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    from public_tokenizers import path

    return packing.pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_near),
    ("secrets", clean_secrets),
    ("packing", pack_sequences),
]
#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)  # nothing reads it any more
        before = f"{folder}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
