"""The pipeline against its stages' plain meaning."""

from __future__ import annotations

import os
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from stocklink.llm import decontaminate, mixing, quality
from stocklink.llm.common import written
from stocklink.llm.queries import WORD_BPE
from test_near_duplicates import plain_kept


def test_stages_and_result(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    one = docs.where(docs.doc_id.isin(sorted(good)))
    heads = set(plain_kept([(r.doc_id, r.text) for r in one.collect()])[0])  # by brute force
    two = docs.where(docs.doc_id.isin(sorted(heads)))
    clean = {r.doc_id for r in decontaminate.contamination(two, bench).where("not contaminated").collect()}
    three = docs.where(docs.doc_id.isin(sorted(clean)))
    copies = {r.doc_id: r._copies for r in mixing.mix(three).collect()}
    texts = {r.doc_id: r.text for r in three.collect()}
    library, start, wanted = Tokenizer.from_file(WORD_BPE), 0, []
    for doc in sorted(texts):
        ids = np.asarray([*library.encode(texts[doc], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(copies[doc]):
            wanted.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(wanted) and 0 < len(got)


def test_filter_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_decontamination_judges_each_row_by_its_own_text(spark, sf_dir):
    passage = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len((r.text or "").split()) >= 10)
    rows = [(None, passage), (None, "a clean text without doc_id"), (1, passage), (1, "a clean text that shares its doc_id"), (2, "clean"), (2, "clean"), (3, None)]
    got = corpus_pipeline.clean(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[k] for k in (1, 3, 4, 5, 6)]))


def test_stored_rows_are_numbered_without_a_copy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    several = written(docs.unionByName(docs).repartition(5), "several")
    rows = corpus_pipeline.numbered(several)
    assert not hasattr(rows, "_written_to") and rows.columns == [*docs.columns, "_row"]
    assert rows.count() == rows.select("_row").distinct().count() == 2 * docs.count()
    # the numbers stay when the files are cut otherwise
    own = sorted(map(str, rows.select("_row", "doc_id").collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    again = sorted(map(str, corpus_pipeline.numbered(several).select("_row", "doc_id").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert own == again
    # rows of a join or with such columns are no rows of files
    assert hasattr(corpus_pipeline.numbered(docs.crossJoin(spark.range(2))), "_written_to")
    assert hasattr(corpus_pipeline.numbered(written(docs.withColumn("_file", docs.doc_id), "clash")), "_written_to")


def test_written_tables_have_one_file_for_each_part(spark):
    made = written(spark.range(100).repartition(4), "parts")
    assert made.count() == 100 and not [f for f in os.listdir(made._written_to.removeprefix("file://")) if f.endswith(".crc")]
