"""Operator 1, byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding.

Two forms of the fold give the same ids. ``encode_words`` is made of Spark's higher-order
functions over a literal rank map and encodes a table of distinct words. ``encode_documents``
keeps the words of a document in order, which takes a lookup of each word where the document is;
it folds the words that its worker hasn't met and remembers them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_slices

#: Splits a text into words before the merges, unless another pattern is given.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its words beyond this number, and remembers only words of at most so many bytes.
REMEMBERED_WORDS = 200_000
REMEMBERED_BYTES = 256
#: Words of more bytes are merged from a heap of pairs instead of by scanning.
SCAN_BYTES = 64


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each piece in a file of lines: base64 of the bytes, blank, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: it whole if it has a rank; else its bytes, of which the adjacent pair with the
    least rank is merged, leftmost first, until no pair has one."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SCAN_BYTES:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(parts[i] + parts[i + 1]) for i in range(len(parts) - 1)]
    while True:
        found = [r for r in pairs if r is not None]
        if not found:
            return [ranks[p] for p in parts]
        i = pairs.index(min(found))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != e:
            continue
        end[i], end[middle] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if i and (r := ranks.get(word[before[i] : e])) is not None:
            heapq.heappush(heap, (r, before[i], e))
    return [ranks[word[i : end[i]]] for i in range(n) if end[i]]


class Codec:
    """Encodes and decodes texts with a rank map."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.pieces = {i: b for b, i in ranks.items()}
        self.words = regex.compile(pattern)
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def decode(self, ids) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def _word(self, word: str) -> tuple[str, int, bytes]:
        data = word.encode()
        ids = merge_word(data, self.ranks)
        out = (",".join(map(str, ids)), len(ids), self.decode(ids))
        if len(data) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED_WORDS:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> list[tuple[str, int, bytes]]:
        """For each word of the text: its ids joined by commas, their number, and the bytes they decode to."""
        known, fold = self.known, self._word
        return [known.get(w) or fold(w) for w in self.words.findall(text)]


_codecs: dict[tuple, Codec] = {}


def _codec(key, ranks, pattern) -> Codec:
    """One codec for each vocabulary in a worker, so that its words outlive a task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids and decoded, on demand).

    Null texts are empty and have no tokens. Words of any length are merged whole. Repeated rows
    are encoded each; an empty table gives an empty result. The rank map, whose size the
    vocabulary bounds, goes to the workers as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)

    def run(batches):
        codec = _codec(key, shared.value, pattern)
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = codec.encode(text or "")
                ids = ",".join([w[0] for w in words])
                decoded = b"".join([w[2] for w in words])
                row = (sum([w[1] for w in words]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest())
                rows.append((*row, [int(x) for x in ids.split(",")] if ids else [], decoded) if with_ids else row)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary())[: 5 if with_ids else 3]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    more = ", ids array<int>, decoded binary" if with_ids else ""
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def _latin(data: bytes) -> str:
    return data.decode("latin-1")


def _rank_of(piece: Column, buckets: Column, size: int) -> Column:
    return F.element_at(F.element_at(buckets, F.pmod(F.hash(piece), F.lit(size)) + 1), piece)


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The rank map as a foldable array of small maps, found by hash; pieces are Latin-1 strings of their bytes."""
    import json

    size = max(1, len(ranks))
    rows = [(_latin(b), r) for b, r in ranks.items()]
    placed = spark.createDataFrame(rows, "piece string, rank int").select(F.pmod(F.hash("piece"), F.lit(size)).alias("at"), "piece", "rank").collect()
    buckets: list[dict] = [{} for _ in range(size)]
    for r in placed:
        buckets[r["at"]][r["piece"]] = r["rank"]
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>"), size


def encode_words(words: DataFrame, ranks: dict[bytes, int], word_col: str = "word") -> DataFrame:
    """The distinct words of a column with their ids, by higher-order functions alone: word, ids.

    A fold over the byte array of a word carries its pieces and the ranks of adjacent pairs;
    each step merges the leftmost pair of the least rank, and steps after the last do nothing.
    Null words are left out; the empty word has no ids.
    """
    table, size = rank_literal(words.sparkSession, ranks)

    def fold(word: Column, buckets: Column) -> Column:
        n = F.length(word)
        pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _rank_of(F.substring(word, i, F.lit(2)), buckets, size))
        start = F.struct(pieces.alias("p"), F.when(n > 1, pairs).otherwise(F.lit(None).cast("array<int>")).alias("r"))

        def step(acc, _):
            p, r = acc["p"], acc["r"]
            at = F.array_position(r, F.array_min(r)).cast("int")
            merged = F.concat(F.element_at(p, at), F.element_at(p, at + 1))
            left = F.when(at > 1, F.array(_rank_of(F.concat(F.element_at(p, F.greatest(at - 1, F.lit(1))), merged), buckets, size))).otherwise(F.lit(None))
            right = F.when(at + 2 <= F.size(p), F.array(_rank_of(F.concat(merged, F.element_at(p, F.least(at + 2, F.size(p)))), buckets, size))).otherwise(F.lit(None))
            none = F.array().cast("array<int>")
            new = F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(merged), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), F.coalesce(left, none), F.coalesce(right, none), F.slice(r, at + 2, F.size(p))).alias("r"),
            )
            return F.when(F.array_min(r).isNull(), acc).otherwise(new)

        folded = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda acc: acc["p"])
        whole = _rank_of(word, buckets, size)
        return F.when(n == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, lambda x: _rank_of(x, buckets, size)))

    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    data = F.decode(F.encode("word", "UTF-8"), "ISO-8859-1")
    return distinct.select("word", F.element_at(F.transform(F.array(F.struct(data.alias("w"), table.alias("t"))), lambda x: fold(x["w"], x["t"])), 1).alias("ids"))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their binary pieces, one after another. Null gives null."""
    import json

    most = max(ranks.values(), default=-1)
    pieces = [""] * (most + 1)
    for data, rank in ranks.items():
        pieces[rank] = _latin(data)
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    bound = F.transform(F.array(F.struct(ids.alias("i"), table.alias("t"))), lambda x: F.array_join(F.transform(x["i"], lambda k: F.element_at(x["t"], k + 1)), ""))
    return F.encode(F.element_at(bound, 1), "ISO-8859-1")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN)
