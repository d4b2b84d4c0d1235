import itertools
import zlib

import numpy as np

from rillstone.llm import language as lang

WORDS = {
    "aa": ["thon", "thing", "wher", "shall", "with", "them", "then", "oush"],
    "bb": ["zuker", "schen", "keit", "ungen", "chau", "berg", "pfer", "zeit"],
    "cc": ["ñola", "ciona", "mente", "asta", "queso", "llora", "ando", "dore"],
}


def sentence(rng, name, n):
    return " ".join(WORDS[name][k] + WORDS[name][j] for k, j in rng.integers(0, 8, (n, 2)))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 0, 3, 7, 2, 5])
    scores, trans, first = rng.normal(0, 2, (lengths.sum(), 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    got, at = lang.marginals(scores, lengths, trans, first, block=2), 0
    for n in lengths[lengths > 0]:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(first[path[0]] + sum(scores[at + i, path[i]] for i in range(n)) + sum(trans[path[i], path[i + 1]] for i in range(n - 1)))
            for i in range(n):
                want[i, path[i]] += weight
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_held_out_accuracy_and_switches(make_docs):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        name = list(WORDS)[i % 3]
        rows.append((i, sentence(rng, name, int(rng.integers(1, 60))), name, None, 1, 1, True, 1, "", "", 0.0, ""))
    rows += [(900, None, "aa", *[None] * 9), (901, "", None, *[None] * 9), (902, "12 34 !", "bb", *[None] * 9), (903, "—…", None, *[None] * 9), (None, "thonthing withthem", None, *[None] * 9), (904, sentence(rng, "bb", 5000), None, *[None] * 9)]
    docs = make_docs(rows)
    crf = lang.train(docs)
    assert crf.languages == ["aa", "bb", "cc"]
    assert all(crf.transition[k, k] > crf.transition[k, j] for k in range(3) for j in range(3) if j != k)
    got = {r.doc_id: r for r in lang.language_id(docs, crf).collect()}
    for i, _, name, *_ in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == name and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and got[None].lang_pred == "aa" and got[904].lang_pred == "bb"
    mixed = (sentence(rng, "aa", 12) + " " + sentence(rng, "cc", 12)).encode()
    row, bucket, word = lang.word_features(np.frombuffer(mixed, np.uint8), np.array([0, len(mixed)]))
    label = lang.marginals(crf.word_scores(len(row), bucket, word), np.array([len(row)]), crf.transition, crf.first).argmax(1)
    assert label.tolist() == [0] * 12 + [2] * 12


def test_many_languages_and_rare_ones(make_docs):
    """Over seventy languages, some with one document, one with most of the rows: all can be predicted."""
    rng = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choice(list(letters), 5)) for _ in range(12)] for k in range(75)}
    fold = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows, at = [], 0
    for k, name in enumerate(words):
        for _ in range(600 if k == 0 else 1 if k > 60 else 6):
            rows.append((fold[at], " ".join(rng.choice(words[name], 30)), name))
            at += 1
    tests = [(10_000 + k, " ".join(rng.choice(words[name], 30)), name) for k, name in enumerate(words)]
    docs = make_docs([(i, t, name, None, 1, 1, True, 1, "", "", 0.0, "") for i, t, name in rows])
    crf = lang.train(docs, sample=300, least=5)
    assert crf.languages == sorted(words)
    got = {r.doc_id: r.lang_pred for r in lang.language_id(make_docs([(i, t, None, None, 1, 1, True, 1, "", "", 0.0, "") for i, t, _ in tests]), crf).collect()}
    assert sum(got[i] == name for i, _, name in tests) >= 72


def test_a_language_of_long_texts_only(make_docs):
    rng = np.random.default_rng(10)
    rows = [(i, sentence(rng, "aa", 30), "aa", *[None] * 9) for i in range(30)] + [(100 + i, sentence(rng, "bb", 6000), "bb", *[None] * 9) for i in range(6)]
    crf = lang.train(make_docs(rows))
    assert crf.languages == ["aa", "bb"]
    got = {r.doc_id: r.lang_pred for r in lang.language_id(make_docs(rows), crf).collect()}
    assert all(got[i] == name for i, _, name, *_ in rows)


def brute_features(text):
    """Per word its features as (kind, bytes)."""
    import re

    out = []
    for w in re.findall(rb"[a-z\x80-\xff]+", text.lower()):
        found = [("word", w)]
        for k in (1, 2, 3):
            if len(w) > k:
                found += [(f"prefix{k}", w[:k]), (f"suffix{k}", w[-k:])]
        found += [(f"gram{k}", w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1)]
        out.append(sorted(found))
    return out


def test_features_against_brute_force():
    texts = ["The thing, señor. a Ab abc ABCD 12x", "", "thing a ab", "É" * 30 + " thon", "q" * 5000]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum(list(map(len, data)))])
    row, bucket, word = lang.word_features(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [f for t in data for f in brute_features(bytes(c + 32 if 65 <= c <= 90 else c for c in t))]
    assert row.tolist() == [i for i, t in enumerate(data) for _ in brute_features(bytes(c + 32 if 65 <= c <= 90 else c for c in t))]
    by_word = [sorted(bucket[word == k].tolist()) for k in range(len(want))]
    assert [len(b) for b in by_word] == [len(f) for f in want]
    names = {}
    for k, found in enumerate(want):  # equal words have equal buckets
        assert names.setdefault(str(found), by_word[k]) == by_word[k]
    alone = {}
    for f in {f for found in want for f in found}:
        holders = [set(by_word[k]) for k, found in enumerate(want) if f in found]
        alone[f] = set.intersection(*holders)
        assert alone[f], f


def test_one_very_long_word(make_docs):
    rows = [(0, "thonthing withthem " * 9, "aa", *[None] * 9), (2, "zeitberg keitchau " * 9, "bb", *[None] * 9), (3, "thon" * 100_000, None, *[None] * 9)]
    crf = lang.train(make_docs(rows))
    got = {r.doc_id: r for r in lang.language_id(make_docs(rows), crf).collect()}
    assert len(got) == 3 and 0 <= got[3].score <= 1 and got[3].lang_pred in ("aa", "bb")


def test_nothing_to_learn(make_docs, edge_rows):
    empty = make_docs([])
    assert lang.train(empty) is None and lang.language_id(empty, None).collect() == []
    got = lang.language_id(make_docs(edge_rows), None).collect()
    assert len(got) == len(edge_rows) and {r.lang_pred for r in got} == {"und"}
