"""Operator 10, exact dedup: 128-bit content hashes, one stable row stays, bytes are compared in groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, durable, numbered, scratch, sized_join, spare_name, text_or_empty

#: Characters that don't count when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_key) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, so all empty,
    blank and null texts form one group. Of a group the row with the most code points stays,
    then the smallest id; a null id comes last. Of repeated rows (same id, same text) exactly
    one stays. An empty table gives an empty result. Other columns are ignored, whatever
    their names. ``hash_of`` gives the hash by which texts meet; any one gives the same result.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row"))
    return _verdicts(narrow, hash_of).drop("_row")


def _keyed(docs: DataFrame, hash_of) -> DataFrame:
    """doc_id, _row, _len, _n (the text without white space), _h, text_sha256."""
    out = docs.select("doc_id", "_row", text_or_empty("text").alias("_t"))
    out = out.select("doc_id", "_row", F.char_length("_t").alias("_len"), F.regexp_replace("_t", SPACES, "").alias("_n"))
    return out.select("*", hash_of(F.col("_n")).alias("_h"), F.sha2("_n", 256).alias("text_sha256"))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """_row, doc_id, keep_id, group_size, kept, text_sha256 of rows whose groups are given by ``keys``."""
    best = F.min(F.struct((-F.col("_len")).alias("_least"), F.col("doc_id").isNull().alias("_null"), "doc_id", "_row"))
    groups = rows.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    kept = F.col("_row") == F.col("_best._row")
    return sized_join(rows, durable(groups), keys, "inner").select("_row", "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def _verdicts(docs: DataFrame, hash_of) -> DataFrame:
    """The verdict on each row of (doc_id, text, _row).

    A hash of one row needs no text. The texts of hashes of two rows or more are put together by
    their bytes, first within each task, so a hot group sends one text a task. Where the bytes
    of a hash are one class, its rows, without their texts, are the group; the rows of a hash with
    several classes, a collision, are grouped by the bytes. Row numbers break ties only within
    one durable table.
    """
    keyed = _keyed(docs, hash_of)
    rows = durable(keyed.drop("_n"))
    often = durable(rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1").select("_h"))
    texts = sized_join(keyed.select("_h", "_n"), often, "_h", "left_semi")
    classes = texts.groupBy("_h", "_n").agg(F.count(F.lit(1)).alias("_size")).groupBy("_h").agg(F.count(F.lit(1)).alias("_classes"))
    classes = durable(classes)
    single = sized_join(rows, often, "_h", "left_anti").select("_row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    same = _grouped(durable(sized_join(rows, durable(classes.where("_classes = 1").select("_h")), "_h", "left_semi")), ["_h"])
    out = single.unionByName(same)
    collided = classes.where("_classes > 1").select("_h")
    if not collided.isEmpty():
        out = out.unionByName(_grouped(durable(keyed.join(collided, "_h", "left_semi")), ["_n"]))
    return out


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with the input's columns; cases as in ``exact_dedup``."""
    row = spare_name(docs, "_row")
    named = numbered(docs, row)
    with scratch(docs.sparkSession):
        verdicts = _verdicts(named.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("_row")), content_key)
        dropped = durable(verdicts.where(~F.col("kept")).select(F.col("_row").alias(row)), outlive=True)
    return sized_join(named, dropped, row, "left_anti").select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM k
"""
