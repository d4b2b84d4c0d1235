"""Operator 4, quality rules: document rules, and host verdicts from shrunk failure rates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import RangeHash, by_row, exact_ids, mix, spans
from .common import durable, flat_bytes, text_slices

WINDOW = 5
#: A document with fewer words fails.
MIN_WORDS = 10
#: A document fails with more than this percentage of its words in repeated windows.
MAX_REPEAT_PERCENT = 20
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = np.random.default_rng(7).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_windows(words: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the window of ``WINDOW`` word ids at each place occurs at another place of its row."""
    key = row[at].astype(np.uint64)
    for k in range(WINDOW):
        key = key * _ODD[k] + words[at + k].astype(np.uint64)
    key = mix(key)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    maybe = np.zeros(len(at), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    # those whose hash occurs twice are put in order by the ids themselves
    some = np.flatnonzero(maybe)
    columns = [words[at[some] + k] for k in range(WINDOW)] + [row[at[some]]]
    order = np.lexsort(columns)
    same = np.ones(max(0, len(some) - 1), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[some[order[1:][same]]] = True
    twice[some[order[:-1][same]]] = True
    return twice


def count_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The rule counts of each row of a flat byte array.

    Words and lines get ids that are equal if and only if their bytes are; windows are put
    together by a hash of their words' ids and then compared id by id.
    """
    rows = len(offsets) - 1
    if not len(data):
        return {k: np.zeros(rows, np.int64) for k in COUNTS}
    word = ~_SEPARATOR[data]
    hashed = RangeHash(data)
    start, end = spans(word, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    out = {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": by_row(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": by_row(_SYMBOL[data], offsets),
    }

    # lines with a word that equal an earlier line of their text: such lines less the distinct ones
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.union1d(offsets[:-1], newline + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_end = line_end - ((line_end > line_start) & (data[line_end - 1] == 0x0A))
    worded = np.zeros(len(data) + 1, np.int64)
    np.cumsum(word, out=worded[1:])
    has = worded[line_end] > worded[line_start]
    line_start, line_end = line_start[has], line_end[has]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line, _ = exact_ids(data, line_start, line_end, hashed(line_start, line_end))
    _, first = np.unique(line * rows + line_row, return_index=True)
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(line_row[first], minlength=rows)

    # words in windows that occur twice or more in their text
    repeated = np.zeros(len(start) + 1, np.int64)
    if len(start) >= WINDOW:
        words, _ = exact_ids(data, start, end, hashed(start, end))
        n = len(start) - WINDOW + 1
        whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        twice = repeated_windows(words, row, whole)
        at = whole[twice]
        np.add.at(repeated, at, 1)
        np.add.at(repeated, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(repeated[:-1]) > 0], minlength=rows)
    return out


def _features(batches):
    for batch in text_slices(batches):
        counts = count_features(*flat_bytes(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(counts[k], pa.int64()) for k in COUNTS)], ["doc_id", "host", *COUNTS])


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts, and the rules' outcomes few_words, repetitive and base_failed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_features, f"doc_id long, host string, {', '.join(f'{k} long' for k in COUNTS)}")
    return counted.select(
        "*",
        (F.col("n_words") < MIN_WORDS).alias("few_words"),
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")).alias("repetitive"),
    ).withColumn("base_failed", F.col("few_words") | F.col("repetitive"))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected; one row per host, null being a host of its own.

    The beta prior has the mean and variance of the hosts' raw rates (method of moments); with
    one host, no variance, or more variance than a beta has, the prior is uniform.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"), F.count_if("few_words").alias("few_words"), F.count_if("repetitive").alias("repetitive"))
    raw = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(raw), F.var_samp(raw)).first()
    weight = m * (1 - m) / v - 1 if m is not None and v else 0.0
    a, b = (m * weight, (1 - m) * weight) if weight > 0 else (1.0, 1.0)
    rate = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > max_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row: doc_id, n_words, the four counts, base_failed, kept, host_rate (the host's shrunk failure rate).

    A document is kept if it passes the base rules and its host isn't rejected. Null and empty
    texts have no words and fail. Repeated rows are judged each. A null host is one host. An
    empty table gives an empty result. The counts are written once, so that the host statistics
    over all documents and the final join read small columns.
    """
    rules = durable(document_rules(docs, id_col, text_col, host_col))
    hosts = host_verdicts(rules, max_rate).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), "rejected")
    return rules.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"), "host_rate"
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), g AS (
  SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS gram FROM win
), dup AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) >= 2
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dl AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), f AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id)
), r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM r GROUP BY source
), p AS (
  SELECT avg(failed / n) AS m, var_samp(failed / n) AS v FROM h
), q AS (
  SELECT CASE WHEN v > 0 AND m * (1 - m) / v > 1 THEN m * (m * (1 - m) / v - 1) ELSE 1 END AS a,
         CASE WHEN v > 0 AND m * (1 - m) / v > 1 THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1 END AS b FROM p
), s AS (
  SELECT source, (failed + a) / (n + a + b) > 0.5 AS rejected FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source
"""
