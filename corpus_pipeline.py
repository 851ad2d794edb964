"""A corpus from documents to token ids, in five stages.

Every stage is written as Parquet and read again as the documents of the next
one; all but the last return the columns of ``documents``.

* quality: documents that the classifier rejects go.
* near_duplicates: texts whose sets of five-word shingles have a Jaccard
  similarity of 0.8 or more are linked, with candidates from SimHash's Golay
  keys and, since 64 bits don't reach down to 0.8, from MinHash; of each group
  of linked documents one row stays, the one with the smallest doc_id (rows
  without doc_id come last).
* decontamination: rows that hold a passage of the benchmark go, each by its own
  text, whatever its doc_id.
* mixing: documents are taken as often as the mix takes them, up to twice.
* token_ids: the ids are written to a dataset in the shared folder, and its
  digest, read back from there, is the result.

A stage's input must be stored: each stage first deletes the scratch tables
that earlier ones left in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklink.llm import decontaminate, mixing, near_duplicates, quality, rans
from stocklink.llm.common import discard, shared_dir, sweep, table, written
from stocklink.llm.queries import END_ID, WORD_BPE


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own (_row) that stays the same: of a stored table by file and place in it; other rows are written."""
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or {"_metadata", "_file", "_place"} & set(docs.columns):
        return written(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    names = sorted(r[0] for r in placed.select("_file").distinct().collect())
    files = docs.sparkSession.createDataFrame([(name, n << 40) for n, name in enumerate(names)], "_file string, _first long")
    return placed.join(F.broadcast(files), "_file").select(*docs.columns, (F.col("_first") + F.col("_place")).alias("_row"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    rows = numbered(docs)
    kept = near_duplicates.kept_rows(rows.select(F.col("_row").alias("row"), "doc_id", "text"))
    return rows.join(kept, rows._row == kept.row, "left_semi").drop("_row")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    rows = numbered(docs)
    judged = decontaminate.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = judged.where("contaminated").select("doc_id")
    return rows.join(found, rows._row == found.doc_id, "left_anti").drop("_row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sweep(spark)
    out = shared_dir(spark, "token-ids")
    rans.write_ids(docs, WORD_BPE, out, END_ID)
    return rans.digest_ids(spark, out)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("token_ids", token_ids)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = written(stage(spark, docs, sf_dir), f"stage-{name}", scratch=False)
        if hasattr(docs, "_written_to"):
            discard(spark, docs)
        docs = made
    return docs
