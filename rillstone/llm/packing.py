"""Operator 3, best-fit packing: documents share bins of a fixed capacity unless they conflict."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, text_or_empty
from .exact_dedup import SPACES

#: Bytes of a bin.
CAPACITY = 8192
#: Documents that are packed with one another: rows are dealt by hash to as many tasks as fill shards of so many.
SHARD_ROWS = 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; longest items first, ties in the order given.

    Bins are ordered by what room is left; each carries a bitmap of its sources and one of its
    duplicate clusters. An item goes to the tightest bin that has the room and shares neither
    its source nor its cluster: the search runs on through the successors until one is
    compatible, and only if none is, a new bin opens. Items of length 0 get no bin (-1).
    """
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << k for k, c in enumerate(dict.fromkeys(clusters))}
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    out = [(-1, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        size = lengths[i]
        if size <= 0:
            continue
        s, c = source_bit[sources[i]], cluster_bit[clusters[i]]
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (held_sources[rooms[at][1]] & s or held_clusters[rooms[at][1]] & c):
            at += 1
        if at < len(rooms):
            room, bin_ = rooms.pop(at)
        else:
            room, bin_ = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[bin_] |= s
        held_clusters[bin_] |= c
        out[i] = (bin_, capacity - room)
        if room > size:
            insort(rooms, (room - size, bin_))
    return out


_OUT = "doc_id long, piece int, start long, length long, bin_id long, bin_offset long"


def _packer(capacity: int, shard_rows: int):
    def shard(rows, first_bin):
        tails = [n % capacity for n in rows["length"]]
        placed = best_fit(tails, rows["source"], rows["cluster"], capacity)
        bins = first_bin + max((b for b, _ in placed), default=-1) + 1
        out = []
        for doc_id, length, tail, (bin_, offset) in zip(rows["doc_id"], rows["length"], tails, placed, strict=True):
            for k in range(length // capacity):
                out.append((doc_id, k, k * capacity, capacity, bins, 0))
                bins += 1
            if tail:
                out.append((doc_id, length // capacity, length - tail, tail, first_bin + bin_, offset))
            elif not length:
                out.append((doc_id, 0, 0, 0, None, None))
        return out, bins

    def run(batches):
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        bins, held = first, {k: [] for k in ("doc_id", "source", "cluster", "length")}
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in _OUT.split(", ")]
        table = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                for k in held:
                    held[k] += part.column(k).to_pylist()
                while len(held["doc_id"]) >= shard_rows:
                    out, bins = shard({k: v[:shard_rows] for k, v in held.items()}, bins)
                    held = {k: v[shard_rows:] for k, v in held.items()}
                    yield table(out)
        if held["doc_id"]:
            yield table(shard(held, bins)[0])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster_col: str | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, bin_id, bin_offset (bytes).

    No text is cut short: one longer than a bin fills whole bins of its own first, and its rest
    is packed with others. Two rests in a bin have different sources (a null source is one
    source) and different duplicate clusters: values of ``cluster_col``, such as the classes of a
    similarity join (null is one cluster), or else texts that are equal without white space.
    Null and empty texts have one piece of length 0 without a bin. Repeated rows are packed each;
    an empty table gives an empty result.

    Rows carry no text. They are dealt by a hash of id and text, so hot sources and clusters
    spread evenly, and are packed in the order of that hash, so bins depend on the rows, their
    number and ``spark.sql.shuffle.partitions`` (an upper bound of the tasks), and not on the
    input's partitions. Bins of different shards aren't merged: a shard ends with its own open bins.
    """
    text = text_or_empty(text_col)
    same_text = content_key(F.regexp_replace(text, SPACES, ""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.col(cluster_col).cast("string") if cluster_col else same_text).alias("cluster"),
        F.octet_length(text).cast("long").alias("length"),
        F.xxhash64(F.col(id_col).cast("long"), same_text).alias("_order"),
    )
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(most, -(-docs.count() // shard_rows)))
    dealt = rows.repartition(tasks, "_order").sortWithinPartitions("_order", "doc_id", "length", "source", "cluster")
    return dealt.drop("_order").mapInArrow(_packer(capacity, shard_rows), _OUT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
