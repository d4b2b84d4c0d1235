"""Operator 2, suffix-array dedup: repeated byte strings across and within texts.

Every window of ``length`` bytes has a minimizer: of the ``GRAM``-byte grams in it the one with
the least hash, the first on ties. Neighbouring windows with the same minimizer form a run, a
string that is kept together. Equal windows have equal minimizers, so all copies of a window
meet under one minimizer's hash, and every window belongs to one run. Runs that are equal as a
whole, by 128 bits of BLAKE2b over their bytes, collapse. Where different runs share a minimizer,
their bytes are fetched and put into suffix order: the previous and next smaller positions in
that order give each window's earlier match, if its longest previous factor reaches ``length``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import RangeHash
from .common import content_key, durable, flat_bytes, text_slices

LENGTH = 400
GRAM = 100
#: Bytes that are put into suffix order at a time.
SUFFIX_BYTES = 1 << 20
#: One task orders the suffixes of at most this many different runs of a minimizer. The windows of a
#: minimizer with more are dealt over all tasks by BLAKE2b of their bytes, with the same result.
TASK_RUNS = 8192
_DIGEST = 16

_RUN = "key binary, ord long, fp long, run binary, lo long, hi long"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=_DIGEST).digest()


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` neighbouring grams the place of the least, the first on ties.

    Whole hashes are compared: running minima to the left and right within blocks of ``width``
    give the least value, and the places where they change give its place.
    """
    n, pad = len(grams), -len(grams) % width
    blocks = np.concatenate([grams, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    place = np.arange(blocks.size).reshape(blocks.shape)
    head = np.minimum.accumulate(blocks, 1)
    new = np.ones(blocks.shape, bool)
    new[:, 1:] = blocks[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(new, place, 0), 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]
    tail_at = np.minimum.accumulate(np.where(blocks == tail, place, blocks.size)[:, ::-1], 1)[:, ::-1].ravel()
    head, tail = head.ravel(), tail.ravel()
    m = n - width + 1
    return np.where(tail[:m] <= head[width - 1 : n], tail_at[:m], head_at[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple:
    """row, minimizer's hash, run's digest, first and last window of all runs of a flat byte array."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), [], none, none
    grams = RangeHash(data).grams(gram)
    n = len(data) - length + 1
    least = least_grams(grams, length - gram + 1)
    # windows that lie in one row
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    whole = np.flatnonzero(np.arange(n) + length <= offsets[row + 1])
    if not len(whole):
        return none, none.astype(np.uint64), [], none, none
    at, of = least[whole], row[whole]
    first = np.ones(len(whole), bool)
    first[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(whole)) - 1
    start, end = whole[lo], whole[hi]
    of = of[lo]
    raw = data.tobytes()
    digests = [_digest(raw[a : b + length]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    return of, grams[at[lo]], digests, start - offsets[of], end - offsets[of]


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``length`` bytes, ties by position, and
    for each in that order whether it shares all of them with the one before.

    Ranks of all suffixes by 8 bytes are doubled until they cover ``length``, the last step by overlap.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    covered = min(8, length)
    word >>= np.uint64(8 * (8 - covered))
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while 2 * covered <= length:
        later = np.zeros(n, np.int64)
        later[: max(0, n - covered)] = rank[covered:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        covered *= 2
    key = rank[starts]
    if covered < length:
        key = key * (n + 1) + rank[starts + length - covered]
    order = np.lexsort((starts, key))
    same = np.zeros(len(starts), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def earlier_matches(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each suffix, the nearest in suffix order at a smaller position, if they share the full length, else -1.

    The longest previous factor of a position is the larger of the prefixes that it shares with
    its previous and with its next smaller position in suffix order. A run of full shares bounds
    the search; in it both are found by links: all suffixes between a suffix and its link have
    larger positions, so a link to a larger position takes over that one's link, and the ways
    double each time.
    """
    n = len(order)
    out = np.full(n, -1)
    run = np.cumsum(~same)
    for step in (-1, 1):
        link = np.arange(n) + step
        active = np.arange(n)
        while len(active):
            to = link[active]
            inside = (to >= 0) & (to < n)
            inside[inside] = run[to[inside]] == run[active[inside]]
            link[active[~inside]] = -1 if step < 0 else n
            active, to = active[inside], to[inside]
            larger = order[to] > order[active]
            active = active[larger]
            link[active] = link[to[larger]]
        found = np.flatnonzero((link >= 0) & (link < n) & (out[order] < 0))
        out[order[found]] = order[link[found]]
    return out


def repeated_windows(strings: list[bytes], windows: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the first ``windows[i]`` windows of each string, all in a row: whether the window
    occurs anywhere else among them, and whether it does earlier. Strings are in text order."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum([0, *map(len, strings)])[:-1]
    counts = np.array(windows)
    starts = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    anywhere, earlier = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    # a window whose hash occurs once needs no order
    hashes = RangeHash(data)(starts, starts + length)
    by_hash = np.argsort(hashes)
    equal = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
    maybe = np.zeros(len(starts), bool)
    maybe[by_hash[1:][equal]] = True
    maybe[by_hash[:-1][equal]] = True
    some = np.flatnonzero(maybe)
    if len(some):
        used = np.zeros(len(data) + 1, np.int64)
        np.add.at(used, starts[some], 1)
        np.add.at(used, starts[some] + length, -1)
        held = np.cumsum(used[:-1]) > 0
        place = np.cumsum(held) - 1
        order, same = suffix_order(data[held], place[starts[some]], length)
        match = earlier_matches(order, same)
        earlier[some[match >= 0]] = True
        anywhere[some[match >= 0]] = True
        anywhere[some[match[match >= 0]]] = True
    return anywhere, earlier


def _find_runs(length, gram):
    def run(batches):
        seen = set()  # texts of one key have the same runs, so a task looks at each key once
        for batch in batches:
            new = [k not in seen and not seen.add(k) for k in batch.column("key").to_pylist()]
            for part in text_slices([batch.filter(pa.array(new, pa.bool_()))]):
                row, fp, digests, lo, hi = runs(*flat_bytes(part), length, gram)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("key").take(take), part.column("ord").take(take), pa.array(fp.view(np.int64)), pa.array(digests, pa.binary()), pa.array(lo), pa.array(hi)], ["key", "ord", "fp", "run", "lo", "hi"])

    return run


def _fetch(length):
    """The bytes of the wanted runs of each text; rows of one key come one after another."""

    def run(batches):
        last = None
        for batch in text_slices(batches):
            out = []
            for key, order, text, want in zip(*(batch.column(k).to_pylist() for k in ("key", "ord", "text", "want")), strict=True):
                if key != last:
                    data, last = text.encode(), key
                    out += [(x["fp"], order, key, x["lo"], data[x["lo"] : x["hi"] + length]) for x in want]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["fp", "ord", "key", "lo", "bytes"])

    return run


def _match(length, keep):
    """Windows with another copy (or an earlier one) among the runs of the same minimizer; rows come sorted."""

    def solve(rows):
        rows = list({(x[2], x[3]): x for x in reversed(rows)}.values())[::-1]  # a text that several tasks fetched counts once
        sizes = [len(x[4]) - length + 1 for x in rows]
        anywhere, earlier = repeated_windows([x[4] for x in rows], sizes, length)
        flag = earlier if keep == "first" else anywhere
        out, at = [], 0
        for x, n in zip(rows, sizes, strict=True):
            own = np.flatnonzero(flag[at : at + n])
            at += n
            if len(own):
                cut = np.flatnonzero(np.diff(own) > 1)
                for a, b in zip(own[np.append(0, cut + 1)], own[np.append(cut, len(own) - 1)], strict=True):
                    out.append((x[2], x[3] + int(a), x[3] + int(b)))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["key", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("fp", "ord", "key", "lo", "bytes")), strict=True):
                if size >= SUFFIX_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return run


def _windows(length):
    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("fp", "ord", "key", "lo", "bytes")), strict=True):
                n = len(row[4]) - length + 1
                at = np.arange(n)
                windows = pa.array([_digest(row[4][i : i + length]) for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row[0]] * n, pa.int64()), windows, pa.array([row[1]] * n, pa.int64()), pa.array([row[2]] * n, pa.binary()), pa.array(at + row[3])], ["fp", "window", "ord", "key", "lo"])

    return run


def _cut(length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes."""

    def run(batches):
        for batch in text_slices(batches):
            out = []
            for text, flagged in zip(batch.column("text").to_pylist(), batch.column("flagged").to_pylist(), strict=True):
                data = text.encode()
                kept, spans, at = [], 0, 0
                end = -1
                for x in sorted(flagged or (), key=lambda x: x["lo"]):
                    if x["lo"] > end:
                        spans += 1
                        kept.append(data[at : x["lo"]])
                    end = max(end, x["hi"] + length)
                    at = end
                kept.append(data[max(at, 0) :])
                left = b"".join(kept)
                out.append((len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("ord"), *columns], ["doc_id", *names])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "none", gram: int | None = None, id_col: str = "doc_id", text_col: str = "text", task_runs: int = TASK_RUNS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Bytes covered by a ``length``-byte string that starts anywhere else are removed
    (``keep="none"``), or only where such a string starts earlier, by id and then place
    (``keep="first"``; null ids come first, and rows that repeat both id and text count as one
    and stay alike). Null texts are empty; texts shorter than ``length`` keep all bytes. An empty
    table gives an empty result. Equal runs and, for minimizers with over ``task_runs`` different
    runs, equal windows are those of equal 128-bit BLAKE2b digests, other windows those of equal
    bytes; the result doesn't depend on ``task_runs``.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    gram = gram or max(1, length // 4)
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.col(id_col).cast("long")
    rows = docs.select(content_key(F.concat(F.coalesce(order.cast("string"), F.lit("")), F.lit("\n"), text) if keep == "first" else text).alias("key"), order.alias("ord"), text.alias("text"))
    # rows of one key have the same text and so the same results
    long = rows.where(F.octet_length("text") >= length)
    every = durable(long.mapInArrow(_find_runs(length, gram), _RUN))
    often = durable(every.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("fp"))
    shared = durable(every.join(often, "fp", "left_semi"))
    first = F.min(F.struct("ord", "key", "lo", "hi"))
    distinct = durable(shared.groupBy("fp", "run").agg(F.count(F.lit(1)).alias("copies"), first.alias("r")).select("fp", "run", "copies", "r.*"))
    # written tables on both sides of a join let Spark split a hot minimizer over tasks
    # equal runs: all windows are copies
    copied = shared.join(distinct.where("copies > 1").select("fp", "run", F.struct("ord", "key", "lo").alias("_first")), ["fp", "run"])
    if keep == "first":
        copied = copied.where(~F.struct("ord", "key", "lo").eqNullSafe(F.col("_first")))
    flags = copied.select("key", "lo", "hi")
    if keep == "none":  # of a text in two rows every window is a copy
        twins = long.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.octet_length("text")).cast("long").alias("_size")).where("_n > 1")
        flags = flags.unionByName(twins.select("key", F.lit(0).cast("long").alias("lo"), (F.col("_size") - length).alias("hi")))
    # different runs under one minimizer: their bytes are compared
    kinds = durable(distinct.groupBy("fp").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1"))
    wanted = distinct.join(kinds, "fp").groupBy("key").agg(F.collect_list(F.struct("fp", "lo", "hi")).alias("want"))
    fetched = long.join(wanted, "key").select("key", "ord", "text", "want").sortWithinPartitions("key")
    hot = durable(kinds.where(F.col("_kinds") > task_runs).select("fp"))
    schema = "fp long, ord long, key binary, lo long, bytes binary"
    pieces = durable(fetched.mapInArrow(_fetch(length), schema))
    cold = pieces.join(hot, "fp", "left_anti").repartition("fp").sortWithinPartitions("fp", "ord", "key", "lo")
    flags = flags.unionByName(cold.mapInArrow(_match(length, keep), "key binary, lo long, hi long"))
    windows = pieces.join(hot, "fp", "left_semi").dropDuplicates(["fp", "key", "lo"]).mapInArrow(_windows(length), "fp long, window binary, ord long, key binary, lo long")
    repeated = windows.groupBy("fp", "window").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ord", "key", "lo")).alias("_first")).where("_n > 1")
    split = windows.join(repeated, ["fp", "window"])
    if keep == "first":
        split = split.where(~F.struct("ord", "key", "lo").eqNullSafe(F.col("_first")))
    flags = flags.unionByName(split.select("key", "lo", F.col("lo").alias("hi")))
    flagged = flags.dropDuplicates().groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("flagged"))
    return rows.join(flagged, "key", "left").select("ord", "text", "flagged").mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
