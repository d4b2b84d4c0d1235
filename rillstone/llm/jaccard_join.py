"""Operator 9, n-gram Jaccard join: chosen paths find candidates, exact counts decide.

Texts are sets of word shingles. A run puts each set into the bucket of one sampled token, its
least shingle under one of the run's random orders; sets with similarity s share it with chance
s. Buckets of few sets are compared by brute force on sketches. A larger one whose sets are alike
on average counts as one candidate group; another is split again, each of its sets going on to
the buckets of ``CHILDREN`` more sampled tokens, down to ``DEPTH`` levels, beyond which any bucket
is a candidate group. Runs are repeated until a pair at
the threshold is found with chance ``RECALL``. Candidate groups then get all their shingles and
exact similarities, block against block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.components import connected_components

from .bytehash import RangeHash, mix, spans, word_digests
from .common import content_key, durable, flat_bytes, numbered, scratch, sized_join, spare_name, text_or_empty, text_slices

WORDS = 5
#: Sets are linked with a similarity of at least 4/5; kept as a fraction for exact tests.
THRESHOLD = (4, 5)
RECALL = 0.99999
#: Buckets of at most so many sets are compared by brute force.
SMALL = 128
CHILDREN = 2
DEPTH = 4
#: Tokens of a sketch, and how many standard errors below the threshold still count as candidates.
TOKENS = 48
SLACK = 4.5
#: Sets of a large bucket that are looked at to tell whether its sets are alike. This decides only how candidates are grouped.
SAMPLE = 32
#: Sets and shingles of a block in the exact comparison (on average; one larger set is a block of its own).
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
#: Rows and shingle columns of the matrices that a task holds, and of how many rows it has all counts at a time.
STRIP = 256
WIDTH = 1024
PANEL = 1024

_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ODD = np.random.default_rng(11).integers(1, 1 << 63, 2 * max(TOKENS, 16), dtype=np.uint64) | np.uint64(1)


def run_recall(threshold: float, depth: int = DEPTH, children: int = CHILDREN) -> float:
    """The least chance that one run brings a pair at the threshold into one compared bucket."""
    found = 1.0
    for _ in range(depth - 1):
        found = 1 - (1 - threshold * found) ** children
    return threshold * found


def runs_for(recall: float, threshold: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - run_recall(threshold)))


def least_share(threshold: float) -> float:
    """The share of equal sketch tokens from which a pair is a candidate."""
    return max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / TOKENS))


def pair_recall(recall: float, threshold: float) -> float:
    """The chance that a pair at the threshold becomes a candidate: the runs bring it together, and its
    sketches agree in enough tokens. More similar pairs have a higher one."""
    least = math.ceil(least_share(threshold) * TOKENS)
    agree = sum(math.comb(TOKENS, k) * threshold**k * (1 - threshold) ** (TOKENS - k) for k in range(least, TOKENS + 1))
    return recall * agree


RUNS = runs_for(RECALL, THRESHOLD[0] / THRESHOLD[1])


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each row, by row.

    Words are runs of ASCII letters, digits and bytes of other scripts; ASCII case doesn't
    count. A row with fewer words than a shingle has one shingle of all of them.
    """
    folded = _FOLD[data]
    start, end = spans(folded != 0, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        return row, np.zeros(0, np.uint64)
    word = word_digests(folded, start, end, RangeHash(folded)(start, end))
    count = np.bincount(row, minlength=len(offsets) - 1)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    rows = np.concatenate([row, np.full(size, -1)])
    gram = np.zeros(len(word), np.uint64)
    for k in range(size):
        inside = rows[k : k + len(word)] == row
        gram += np.where(inside, padded[k : k + len(word)], np.uint64(k + 1)) * _ODD[k]
    gram = mix(gram)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    whole = (rows[size - 1 : size - 1 + len(word)] == row) | (first & (count[row] < size))
    row, gram = row[whole], gram[whole]
    _, keep = np.unique(gram ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    keep.sort()
    return row[keep], gram[keep]


_SKETCH = "doc_id long, key binary, set binary, size long, tokens array<long>, sketch binary"


def _sketch(size):
    def run(batches):
        for batch in text_slices(batches):
            n = batch.num_rows
            row, gram = shingles(*flat_bytes(batch), size)
            count = np.bincount(row, minlength=n)
            has = np.flatnonzero(count)
            starts = (np.cumsum(count) - count)[has]
            name = np.zeros((n, 2), np.uint64)
            least = np.zeros((n, TOKENS), np.uint64)
            if len(has):
                for k in (0, 1):
                    name[has, k] = np.add.reduceat(mix(gram + _ODD[k]), starts)
                for k in range(TOKENS):
                    x = (gram ^ _ODD[k]) * _ODD[TOKENS + k]
                    least[has, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
            sets = [x.tobytes() if c else None for x, c in zip(name, count, strict=True)]
            # the low bits of a least value are as good as random, its high bits are all small
            sketch = [x.tobytes() for x in mix(least).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sets, pa.binary()), pa.array(count.astype(np.int64)), pa.array(mix(least[:, :RUNS]).view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "key", "set", "size", "tokens", "sketch"],
            )

    return run


def _forest(near: np.ndarray) -> np.ndarray:
    """The least connected index of each index of a symmetric boolean matrix with a true diagonal, its rows packed to bits."""
    n = len(near)
    label = np.arange(n)
    while True:
        rows = (np.unpackbits(near[at : at + STRIP], axis=1, count=n).view(bool) for at in range(0, n, STRIP))
        new = np.concatenate([np.where(x, label[None, :], n).min(1) for x in rows])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _bucket_edges(share_needed, ratio):
    """Star edges between the sets of a bucket whose sketches and sizes are close enough; rows come sorted by bucket."""

    def solve(sets, sketches, sizes):
        if len(sets) < 2:
            return
        s = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sets), TOKENS)
        size = np.array(sizes, np.float64)
        share = np.zeros((len(sets), len(sets)), np.int32)
        for k in range(TOKENS):
            share += s[:, k, None] == s[None, :, k]
        near = (share >= share_needed * TOKENS) & (np.minimum(size[:, None], size) >= ratio * np.maximum(size[:, None], size))
        label = _forest(np.packbits(near | np.eye(len(sets), dtype=bool), axis=1))
        for i in np.flatnonzero(label != np.arange(len(sets))):
            yield sets[i], sets[label[i]]

    def run(batches):
        path, sets, sketches, sizes = None, [], [], []
        for batch in batches:
            out = []
            for p, name, sketch, size in zip(*(batch.column(k).to_pylist() for k in ("path", "set", "sketch", "size")), strict=True):
                if p != path:
                    out += solve(sets, sketches, sizes)
                    path, sets, sketches, sizes = p, [], [], []
                sets.append(name)
                sketches.append(sketch)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])
        out = list(solve(sets, sketches, sizes))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _alike(share_needed):
    """Whether the sketches of a bucket's sample agree in at least ``share_needed`` of their tokens on average."""

    def run(batches):
        for batch in batches:
            whole = []
            for sketches in batch.column("sample").to_pylist():
                s = np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), TOKENS)
                n = len(s)
                same = sum((np.unique(column, return_counts=True)[1] ** 2).sum() for column in s.T) - n * TOKENS
                whole.append(bool(n > 1 and same >= share_needed * n * (n - 1) * TOKENS))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("hub"), pa.array(whole)], ["path", "hub", "whole"])

    return run


def candidate_edges(sets: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """(a, b): edges that connect, but needn't pair, all sets that the runs bring together."""
    share = least_share(threshold)
    slim = sets.select("set", "size", "sketch")
    nodes = sets.select(F.posexplode("tokens").alias("run", "token"), "set").select(F.xxhash64("run", "token").alias("path"), "set")
    compare, edges = [], []
    for level in range(1, DEPTH + 1):
        nodes = durable(nodes)
        counts = durable(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = durable(nodes.join(counts, "path"))
        compare.append(shared.where(F.col("n") <= small).select("path", "set"))
        big = shared.where(F.col("n") > small).select("path", "set").join(slim.select("set", "sketch"), "set")
        big = durable(big)
        if big.isEmpty():
            break
        # a large bucket of sets that are much alike can't be split: it is one candidate group
        slot = F.pmod(F.xxhash64("set"), F.lit(SAMPLE)).alias("slot")
        some = big.groupBy("path", slot).agg(F.min(F.struct("set", "sketch")).alias("s")).groupBy("path").agg(F.min("s.set").alias("hub"), F.collect_list("s.sketch").alias("sample"))
        groups = durable(some.mapInArrow(_alike(share), "path long, hub binary, whole boolean"))
        big = big.join(groups, "path")
        edges.append(big.where(F.lit(level == DEPTH) | F.col("whole")).select(F.col("set").alias("a"), F.col("hub").alias("b")).where("a <> b"))
        if level == DEPTH:
            break
        child = F.explode(F.array(*map(F.lit, range(CHILDREN)))).alias("child")
        at = F.pmod(F.xxhash64("path", "child"), F.lit(TOKENS)).cast("int")
        split = big.where(~F.col("whole")).select("path", "set", "sketch", child)
        nodes = split.select(F.xxhash64("path", "child", F.substring(F.col("sketch"), 2 * at + 1, F.lit(2))).alias("path"), "set").dropDuplicates()
    together = compare[0]
    for x in compare[1:]:
        together = together.unionByName(x)
    ordered = together.join(slim, "set").repartition("path").sortWithinPartitions("path", "set")
    found = ordered.mapInArrow(_bucket_edges(share, threshold), "a binary, b binary")
    for x in edges:
        found = found.unionByName(x)
    return found.dropDuplicates()


def _shingle_sets(size):
    def run(batches):
        for batch in text_slices(batches):
            row, gram = shingles(*flat_bytes(batch), size)
            count = np.bincount(row, minlength=batch.num_rows)
            ends = np.cumsum(count)
            whole = [np.sort(gram[e - c : e]).tobytes() for e, c in zip(ends, count, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("component", "set", "blocks")), pa.array(whole, pa.binary())], ["component", "set", "blocks", "shingles"])

    return run


def exact_links(names: list[bytes], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold=THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Each set's number of links from ``left`` to ``right`` sets, and its least linked index.

    Intersections are counted by matrix products over the shingles that occur in two sets or
    more, ``WIDTH`` columns and ``STRIP`` rows at a time. The counts (4 bytes a pair) are held of
    ``PANEL`` rows, the links as bits.
    """
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    values = np.concatenate(sets)
    order = np.argsort(values)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    values = values[order]
    first = np.ones(len(values) + 1, bool)
    first[1:-1] = values[1:] != values[:-1]
    del values, order
    shared = ~(first[:-1] & first[1:])
    owner = owner[shared]
    column = np.cumsum(first[:-1][shared], dtype=np.int32) - 1
    del first, shared
    degree = np.zeros(n, np.int64)
    near = np.zeros((n, -(-n // 8)), np.uint8)
    for top in range(0, n, PANEL):
        end = min(n, top + PANEL)
        inter = np.zeros((end - top, n), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
            a, b = np.searchsorted(column, np.array([lo, lo + WIDTH], np.int32))
            used = np.unique(owner[a:b])
            i, j = np.searchsorted(used, [top, end])
            if i == j:
                continue
            dense = np.zeros((len(used), WIDTH), np.float32)
            dense[np.searchsorted(used, owner[a:b]), column[a:b] - lo] = 1
            for at in range(i, j, STRIP):
                some = slice(at, min(at + STRIP, j))
                inter[np.ix_(used[some] - top, used)] += dense[some] @ dense.T
        for at in range(top, end, STRIP):
            some = slice(at, min(at + STRIP, end))
            shares = inter[some.start - top : some.stop - top].astype(np.int64)
            linked = threshold[1] * shares >= threshold[0] * (sizes[some, None] + sizes[None, :] - shares)
            linked &= (left[some, None] & right[None, :]) | (right[some, None] & left[None, :])
            np.fill_diagonal(linked[:, at:], False)
            degree[some] = linked.sum(1)
            np.fill_diagonal(linked[:, at:], True)
            near[some] = np.packbits(linked, axis=1)
    return degree, _forest(near)


def _verify(threshold):
    """(set, links, root) of the sets of a pair of blocks; rows come sorted by the pair."""

    def solve(rows):
        names = [r[3] for r in rows]
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        block = np.array([r[5] for r in rows])
        left, right = block == rows[0][1], block == rows[0][2]
        degree, label = exact_links(names, sets, left, right, threshold)
        for i, name in enumerate(names):
            yield name, int(degree[i]), names[label[i]]

    def run(batches):
        pair, held = None, []
        for batch in text_slices(batches, "shingles"):
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in ("component", "i", "j", "set", "shingles", "block")), strict=True):
                if row[:3] != pair:
                    out += solve(held) if held else ()
                    pair, held = row[:3], []
                held.append(row)
            yield table(out)
        yield table(list(solve(held)) if held else [])

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))], ["set", "links", "root"])

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, small: int = SMALL, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies (and, if a ``row`` column is named, it as _row and the class itself as _class).

    Documents are linked when the Jaccard similarity of their sets of ``words``-word shingles is
    at least the threshold (a fraction); classes are the connected components, named by their
    least doc_id (null if all are null). n_links counts the other, different sets that a
    document is linked to, n_copies the other rows with the same set. Texts of fewer words have
    one shingle; null texts and texts without a word have none, belong to no one's class and
    get their own doc_id. Repeated rows are copies. An empty table gives an empty result.

    All links of a candidate group are counted, in blocks of ``block`` sets and ``BLOCK_SHINGLES``
    shingles, so a group of g sets costs g/block copies of its shingles and no row per pair.
    A pair at the threshold is a candidate with chance ``pair_recall(RECALL, threshold)``.
    """
    share = threshold[0] / threshold[1]
    number = [F.col(row).alias("_row")] if row else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *number)
    keyed = rows.withColumn("key", content_key(F.col("text")))
    sketched = durable(keyed.select("doc_id", "key", "text").mapInArrow(_sketch(words), _SKETCH))
    worded = sketched.where("set IS NOT NULL")
    sets = durable(worded.groupBy("set").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"), F.min(F.struct("key", "size", "tokens", "sketch")).alias("r")).select("set", "rows", "least", "r.*"))
    components = durable(connected_components(candidate_edges(sets, share, small)).select(F.col("node").alias("set"), "component"))

    # all shingles of the candidates, one text for each set
    members = durable(components.join(sets.select("set", "key", "size"), "set"))
    dealt = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    wanted = durable(members.join(members.groupBy("component").agg(dealt.alias("blocks")), "component").select("key", "set", "component", "blocks"))
    texts = sized_join(keyed.select("key", "text"), wanted, "key", "inner").dropDuplicates(["set"])
    full = texts.select("component", "set", "blocks", "text").mapInArrow(_shingle_sets(words), "component binary, set binary, blocks int, shingles binary")
    full = full.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = full.select("*", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "shingles", "block")
    ordered = pairs.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "set")
    linked = durable(ordered.mapInArrow(_verify(threshold), "set binary, links long, root binary"))
    links = linked.groupBy("set").agg(F.sum("links").alias("n_links"))
    joined = connected_components(linked.where("set <> root"), "set", "root")

    named = sets.select("set", "rows", "least").join(joined.select(F.col("node").alias("set"), "component"), "set", "left").join(links, "set", "left")
    named = named.withColumn("component", F.coalesce("component", "set"))
    classes = named.groupBy("component").agg(F.min("least").alias("class_id"))
    named = named.join(classes, "component").select("set", "rows", "n_links", "class_id", F.col("component").alias("_class"))
    if row:
        by_key = worded.select("key", "set").dropDuplicates(["key"])
        worded = keyed.select("_row", "doc_id", "key").join(by_key, "key")
        wordless = keyed.select("_row", "doc_id", "key").join(by_key, "key", "left_anti")
    else:
        wordless = sketched.where("set IS NULL")
    extra, kind = (["_row"], ["_class"]) if row else ([], [])
    # each wordless document is alone
    out = worded.select(*extra, "doc_id", "set").join(named, "set").select(*extra, *kind, "doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("rows") - 1).cast("long").alias("n_copies"))
    alone = wordless.select(*extra, *(F.lit(None).cast("binary").alias(k) for k in kind), "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one of each class: that with the least id, then the first in the input. Wordless rows stay."""
    row = spare_name(docs, "_row")
    named = numbered(docs, row)
    with scratch(docs.sparkSession):
        classes = durable(jaccard_classes(named, id_col, text_col, row=row))
        grouped = classes.where("n_links > 0 OR n_copies > 0")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row"))
        best = grouped.groupBy("_class").agg(first.alias("_best")).select(F.col("_best._row").alias("_row"))
        dropped = durable(grouped.join(best, "_row", "left_anti").select(F.col("_row").alias(row)), outlive=True)
    return sized_join(named, dropped, row, "left_anti").select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
