"""The corpus pipeline: documents to token ids in five stages, each written and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
``docs``. Further columns pass through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, linededup, mil, setjoin
from millrace.llm.common import numbered, release, small, table, trim_executors, unpacked, with_row, work_dir, written

#: Bytes of an Arrow batch: whole rows go through Python here, and pass through memory several times.
ROW_BATCH_BYTES = 16 << 20
#: The same for the last stage: a batch is held by the executor and its Python worker, beside the encoder's tables.
ENCODE_BATCH_BYTES = 2 << 20
#: Before near copies are looked for, a line is taken out where an earlier one has it and more than six lines in all do:
#: below that it is a quotation or part of a copied document, and would make near copies unlike. Once one document of
#: each group is left, every repeated line goes.
LEAST_COPIES = 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from labelled rows outside the held-out quarter.

    Null and empty texts are scored as texts without words; repeated rows are judged alike. Rows without an id are
    judged as others.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ROW_BATCH_BYTES)
    labels = table(spark, sf_dir, "labels").where(~mil.held_out("doc_id", 4, 2))
    model = mil.fit_mil(docs, labels)
    rows, (text,) = with_row(docs, "text")
    return unpacked(mil.score_quality(rows, model, "row", text).where("predicted = 1"), docs.columns)


def _without_repeats(rows: DataFrame, id_: str, text: str, least_copies: int) -> DataFrame:
    out = linededup.dedup_lines(rows, id_, text, least_copies=least_copies)
    return out.where(f"n_removed = 0 OR {text} RLIKE '[^ \\\\t-\\\\r]'").select(*rows.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document or line has and LEAST_COPIES lines or more share.

    The other repeated lines are taken out by the next stage, when it has found the near copies. Documents with no
    word left go, if a line was taken; null and empty texts and those without a word lose no line and stay. Repeated
    rows (same id and text) lose the same lines. Null ids come first.
    """
    rows, (id_, text) = numbered(docs, "doc_id", "text")
    return _without_repeats(rows, id_, text, LEAST_COPIES).toDF(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies, once, without any line that an earlier one left has.

    Null and empty texts belong to no group. Rows that repeat an id and a text are one document. Rows without an id
    can't be told apart: all stay as they are, and their lines count for no other row. Documents with no word left go,
    if a line was taken.
    """
    rows, (id_, text) = numbered(docs, "doc_id", "text")
    left = written(_one_of_each_group(spark, rows, id_, text), f"{work_dir(spark)}/left")
    release(spark)
    told = _without_repeats(left.where(F.col(id_).isNotNull()), id_, text, 1)
    return told.unionByName(left.where(F.col(id_).isNull())).toDF(*docs.columns)


def _one_of_each_group(spark: SparkSession, rows: DataFrame, id_: str, text: str) -> DataFrame:
    groups = setjoin.similar_groups(rows, id_, text).where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("odd"))
    odd = groups.agg((F.min("component_id") < F.col("odd")).alias("goes"), F.count("*").alias("n")).where("goes OR n > 1").drop("n")
    odd = small(written(odd, f"{work_dir(spark)}/odd"), 2)
    kept = rows.join(odd, F.col(id_) == F.col("odd"), "left").where("goes IS NULL OR NOT goes")
    again = kept.where("odd IS NOT NULL").withColumn("h", F.xxhash64(text)).dropDuplicates([id_, "h"])
    return kept.where("odd IS NULL").select(*rows.columns).unionByName(again.select(*rows.columns))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; test phrases found in the others are cut out.

    Null and empty texts have no phrase and stay; repeated rows are judged alike, rows without an id as others.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ROW_BATCH_BYTES)
    rows, (text,) = with_row(docs, "text")
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), "row", text)
    return unpacked(found.where("NOT contaminated"), docs.columns, {"text": F.coalesce(F.col("cut_text").cast("string"), F.col(text))})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the decoded text, a row for each row.

    Null and empty texts give no ids; rows without an id are encoded as others. The encoder's tables and the Arrow
    batches are kept small, and what earlier stages have left in the executors' heaps is freed first.
    """
    trim_executors(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ENCODE_BATCH_BYTES)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_digests=True, tables=0.33, with_decoded=False)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", remove_benchmark),
    ("byte-level BPE", encode),
]

#: A trained classifier has no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next one reads it."""
    folder, docs = work_dir(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/stage{k}")
    return docs
