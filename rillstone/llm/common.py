"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.storage import durable, scratch, shared_dir

__all__ = ["SLICE_BYTES", "content_key", "durable", "flat_bytes", "held_out", "numbered", "scratch", "shared_dir", "sized_join", "spare_name", "text_or_empty", "text_slices", "train_fold"]

#: A table is broadcast only if it is counted to have at most so many rows (of some 200 bytes at most).
BROADCAST_ROWS = 200_000
#: Python works on at most this many text bytes at a time (one longer text goes alone).
SLICE_BYTES = 2 << 20


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spare_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores before it until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a column that names each row, the same whenever it is evaluated.

    Rows of a plain Parquet scan are named by file and place in it. Rows of any other plan may come
    in another order next time, so these are numbered in a durable copy.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and "_metadata" not in map(str.lower, docs.columns):
        if plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return docs.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(row))
    return durable(docs.select("*", F.monotonically_increasing_id().alias(row)))  # call it outside of a scratch scope


def sized_join(left: DataFrame, right: DataFrame, on, how: str, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """A join whose right side, a durable table of narrow rows, is counted (or its ``weight`` summed) first:
    up to ``BROADCAST_ROWS`` it is broadcast and the left side stays where it is, beyond both are sorted."""
    size = right.count() if weight is None else right.agg(F.sum(weight)).first()[0] or 0
    return left.join(F.broadcast(right) if size <= (BROADCAST_ROWS if most is None else most) else right.hint("merge"), on, how)


def content_key(text: Column) -> Column:
    """128 bits that name a text: the first half of its SHA-256 (nobody knows two texts that share it)."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def train_fold(doc_id: Column) -> Column:
    """True for rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """Null ids count as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that each holds at most ``limit`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def flat_bytes(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and the offsets of its rows; null is empty."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    joined = b"".join(x.as_buffer() if x.is_valid else b"" for x in values)
    return np.frombuffer(joined, np.uint8), offsets
