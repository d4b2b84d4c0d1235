import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from rillstone.llm.suffix_dedup import earlier_matches, least_grams, remove_repeats, runs, suffix_order


def brute(rows, length, keep):
    rows = [(i, (t or "").encode()) for i, t in rows]
    first, times = {}, Counter()
    for i, data in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for s in range(len(data) - length + 1):
            times[data[s : s + length]] += 1
            first.setdefault(data[s : s + length], (i, s))
    out = []
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if times[w] > 1 and (keep == "none" or first[w] != (i, s)):
                gone[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(20, 80))) for _ in range(4)]
    rows = []
    for i in range(30):
        parts = [rng.choice(base)[rng.randint(0, 10) : rng.randint(15, 80)] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "".join(parts)))
    return [*rows, (100, None), (101, ""), (102, "a" * 200), (103, "ab" * 70), (104, rows[3][1] + rows[5][1]), (105, rows[3][1] + rows[5][1])]


@pytest.mark.parametrize(("length", "gram", "most", "keep"), [(12, 4, 8192, "none"), (20, 8, 8192, "first"), (12, 4, 2, "none"), (12, 4, 2, "first")])
def test_brute_force(spark, length, gram, most, keep):
    rows = texts(length + most)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r)[:5] for r in remove_repeats(docs, length, keep, gram, task_runs=most).collect()], key=str)
    assert got == brute(rows, length, keep)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("most", [8192, 2])
def test_strings_that_collide_modulo_a_power_of_two(spark, most):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = "".join(chr(97 + k * 7 % 26) for k in range(300))
    rows = [(1, x), (2, "." + y), (3, x[:700] + "!"), (4, tail + x[:512]), (5, y[:512] + tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted([tuple(r)[:5] for r in remove_repeats(docs, task_runs=most).collect()], key=str)
    assert got == brute(rows, 400, "none")


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_minimizer(spark, keep):
    """One passage in all texts, with different bytes around it: its minimizer's runs go over all tasks."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh") for _ in range(24))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) + passage + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(500, passage[:15]), (None, passage), (None, passage), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 20, "none") if keep == "none" else None
    results = [sorted([tuple(r)[:5] for r in remove_repeats(docs, 20, keep, 6, task_runs=k).collect()], key=str) for k in (1, 5, 8192)]
    assert results[0] == results[1] == results[2] and (want is None or results[0] == want)


def test_minimizers_do_not_depend_on_the_batch():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 100, 3000).astype(np.uint8)
    alone = runs(text, np.array([0, len(text)]), 60, 10)
    data = np.concatenate([rng.integers(97, 100, 5000).astype(np.uint8), text, text[:100]])
    among = runs(data, np.array([0, 5000, 8000, 8100]), 60, 10)
    mine = among[0] == 1
    assert [a[mine].tolist() if k != 2 else [d for d, m in zip(a, mine, strict=True) if m] for k, a in enumerate(among)][1:] == [a.tolist() if k != 2 else a for k, a in enumerate(alone)][1:]


def test_least_grams_by_scanning():
    rng = np.random.default_rng(6)
    for n, width in [(50, 7), (49, 7), (7, 7), (30, 1), (64, 16), (33, 32)]:
        grams = rng.integers(0, 5, n).astype(np.uint64)
        assert least_grams(grams, width).tolist() == [i + int(np.argmin(grams[i : i + width])) for i in range(n - width + 1)]


def test_long_tie_runs_are_quick():
    n = 200_000
    start = time.time()
    match = earlier_matches(np.arange(n), np.arange(n) > 0)
    assert match.tolist() == list(range(-1, n - 1)) and time.time() - start < 10
    order = np.random.default_rng(7).permutation(2000)
    match = earlier_matches(order, np.arange(2000) % 500 > 0)
    for k in range(2000):
        block = order[k // 500 * 500 : k // 500 * 500 + 500]
        assert (match[order[k]] >= 0) == (order[k] > block.min()) and match[order[k]] < order[k]


def test_edges(make_docs, edge_rows):
    got = sorted([tuple(r)[:5] for r in remove_repeats(make_docs(edge_rows)).collect()], key=str)
    assert got == brute([r[:2] for r in edge_rows], 400, "none")
    assert remove_repeats(make_docs([])).collect() == []


def test_suffix_order_and_matches():
    data = np.frombuffer(b"banana banana bandana", np.uint8)
    n = 5
    starts = np.arange(len(data) - n + 1)
    order, same = suffix_order(data, starts, n)
    key = [(bytes(data[i : i + n]), i) for i in starts]
    assert [int(i) for i in order] == sorted(starts, key=lambda i: key[i])
    match = earlier_matches(order, same)
    for i in starts:
        earlier = [j for j in range(i) if key[j][0] == key[i][0]]
        assert (match[i] >= 0) == bool(earlier) and (match[i] < 0 or match[i] in earlier)
