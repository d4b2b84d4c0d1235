import hashlib
import random

import pytest
import tiktoken

from rillstone.llm.bpe import PATTERN, Codec, decode_ids, encode_documents, encode_words, merge_word, read_ranks

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    signs = [chr(x) for x in (9, 10, 11, 12, 13, 28, 29, 31, 32, 0x85, 0xA0, 0x2003, 0x200B, 0xFEFF, 48, 0x663, 97, 98, 233, 0x4E2D, 0x1F600, 39, 115, 0x301)]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a" * 3000, " " * 2000 + "x", "é" * 700, "ab" * 900]


def test_same_ids_as_the_library(ranks, reference):
    assert public_tokenizers.PATTERN == PATTERN
    codec = Codec(ranks)
    for text in odd_texts():
        words = codec.encode(text)
        assert [int(i) for w in words for i in w[0].split(",")] == reference.encode_ordinary(text)
        assert b"".join(w[2] for w in words) == text.encode()


def test_documents(make_docs, edge_rows, ranks, reference):
    got = sorted([tuple(r) for r in encode_documents(make_docs(edge_rows), ranks).collect()], key=str)
    want = []
    for i, text, *_ in edge_rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert encode_documents(make_docs([]), ranks).collect() == []


def test_native_fold_and_decoding(spark):
    pieces = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"bc", b"\xc3\xa9", b"cab", b"aa", b"aaa"]
    small = {p: i for i, p in enumerate(pieces)}
    words = ["", "a", "ab", "abcab", "bcbcabc", "é", "xéé", "aaaa", "aaaaa", "cabcab", None, "abc", "abc"]
    rows = encode_words(spark.createDataFrame([(w,) for w in words], "word string"), small).collect()
    assert {r.word: list(r.ids) for r in rows} == {w: merge_word(w.encode(), small) if w else [] for w in words if w is not None}
    ids = spark.createDataFrame([([256, 259], 1), ([], 2), (None, 3), ([0xC3], 4)], "ids array<int>, n int")
    got = {r.n: r.b for r in ids.select("n", decode_ids(ids["ids"], small).alias("b")).collect()}
    assert (bytes(got[1]), bytes(got[2]), got[3], bytes(got[4])) == ("abé".encode(), b"", None, b"\xc3")


def test_native_fold_with_the_whole_vocabulary(spark, ranks, reference):
    """The fold of higher-order functions over the literal map of all ranks gives the library's ids."""
    import regex

    words = sorted({w for t in odd_texts()[:120] for w in regex.findall(PATTERN, t) if len(w) <= 60} | {" unbelievable", "Donaudampfschiff", "éèê", " 12345", "xqzjv" * 3})
    rows = encode_words(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r.word: list(r.ids) for r in rows} == {w: reference.encode_ordinary(w) if len(reference.encode_ordinary(w)) else [] for w in words}
