import zlib

import numpy as np

from rillstone.llm import toxicity as t


def corpus(n=900, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioulnrstdm"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["vilegrub", "muckwretch", "slimefool"]
    out = []
    for i in range(n):
        text = [words[k] for k in rng.integers(0, 400, rng.integers(20, 200))]
        toxic = int(i % 6 == 0)
        if toxic:
            for k in rng.integers(0, len(text), 1 + len(text) // 40):
                text[k] = bad[rng.integers(0, 3)]
        out.append((i, " ".join(text), toxic))
    return out


def test_held_out_rows_and_misspellings(spark, make_docs):
    from tests.llm.conftest import rows_of

    rows = corpus()
    docs = make_docs(rows_of([r[1] for r in rows]))
    labels = spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows] + [(None, 1, 1, "x"), (5000, None, None, None)], "doc_id long, quality int, toxic int, text string")
    model = t.train(docs, labels)
    got = {r.doc_id: r for r in t.toxicity(docs, model).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].predicted == (got[i].score >= 0.7) and 0 <= got[i].score <= 1
        if got[i].held_out:
            assert got[i].predicted == y
    clean = rows[1][1]
    score = lambda x: model.scores(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0]
    assert score(clean[:200] + " muckwretsch vilegrrub") > score(clean[:200]) + 0.3


def test_labels_of_held_out_rows_are_not_learned(spark, make_docs):
    from tests.llm.conftest import rows_of

    rows = corpus(300)
    docs = make_docs(rows_of([r[1] for r in rows]))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    plain = t.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    turned = t.train(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(plain.weights, turned.weights)


def test_edges(spark, make_docs, edge_rows):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs(edge_rows)
    model = t.train(docs, labels)
    got = t.toxicity(docs, model).collect()
    assert len(got) == len(edge_rows) and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {0}
    kept = t.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(edge_rows)
    assert t.toxicity(make_docs([]), model).collect() == []


def brute_score(model, text):
    """The mean weight of all n-grams of the words, each with a blank on either side, one by one."""
    fold = "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789@$!*" or c >= 128 else " " for c in text.encode())
    data, mask, total, count = [ord(c) for c in f" {fold} "], (1 << 64) - 1, 0.0, 0
    for n in t.GRAMS:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 0x20 in gram[1:-1]:
                continue
            h = n
            for c in gram:
                h = (h * 0x100000001B3 + c + 1) & mask
            h ^= h >> 30
            h = h * 0xBF58476D1CE4E5B9 & mask
            h ^= h >> 27
            h = h * 0x94D049BB133111EB & mask
            h ^= h >> 31
            total += float(model.weights[h >> 46])
            count += 1
    return 1 / (1 + np.exp(-np.clip(total / max(count, 1) + model.bias, -30, 30)))


def test_scores_against_brute_force_and_edges_of_a_trained_model(spark, make_docs, edge_rows):
    from tests.llm.conftest import rows_of

    rows = corpus(400)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = t.train(make_docs(rows_of([r[1] for r in rows])), labels)
    assert np.count_nonzero(model.weights) > 10
    asked = [*edge_rows, *rows_of(["muckwretch " * 40, "m" * 100_000, "a", "ab", "É!", rows[0][1], rows[6][1]], 70)]
    docs = make_docs(asked)
    got = sorted(((r.doc_id, r.score, r.predicted) for r in t.toxicity(docs, model).collect()), key=str)
    want = sorted(((r[0], brute_score(model, r[1] or "")) for r in asked), key=str)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    assert all(g[2] == (g[1] >= 0.7) for g in got)
    kept = t.reject_toxic(docs, model).collect()
    assert sorted((str(tuple(r)) for r in kept)) == sorted(str(r) for r in asked if brute_score(model, r[1] or "") < 0.7)
    assert t.reject_toxic(make_docs([]), model).collect() == []
