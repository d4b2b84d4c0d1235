import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillstone.llm.jaccard_join import RECALL, RUNS, exact_links, jaccard_classes, keep_one, pair_recall, run_recall


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()))
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    kinds = list({s for s in sets if s})
    links = [[b for b, y in enumerate(kinds) if b != a and 5 * len(x & y) >= 4 * len(x | y)] for a, x in enumerate(kinds)]
    label = list(range(len(kinds)))
    for _ in kinds:
        label = [min([label[a], *(label[b] for b in links[a])]) for a in range(len(kinds))]
    place, times, least = {s: a for a, s in enumerate(kinds)}, Counter(sets), {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[label[place[s]]] = min(least.get(label[place[s]], i), i)
    return sorted(((i, least.get(label[place[s]]), len(links[place[s]]), times[s] - 1) if s else (i, i, 0, 0) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_copies(seed, groups=6, each=9, loose=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(each):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(loose)]
    return list(enumerate(texts))


def test_recall_of_runs():
    assert 1 - (1 - run_recall(0.8)) ** RUNS >= RECALL


def test_recall_of_pairs():
    assert 0.99997 < pair_recall(RECALL, 0.8) < RECALL


def test_measured_recall_on_a_table(spark):
    """Every link of a whole table with edited copies around the threshold, by an inverted index over shingles, is found."""
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    for i, text in rows[:600]:
        words = (text or "").split()
        for k in range(2):
            edited = list(words)
            for at in range(0, len(words), rng.randint(44, 60)):  # one word in some 50 is five shingles in 50
                edited[at] = f"x{i}y{k}"
            rows.append((10_000 + 2 * i + k, " ".join(edited)))
    kinds = {}
    for (i, _), s in zip(rows, sets_of([t for _, t in rows]), strict=True):
        if s:
            kinds.setdefault(s, []).append(i)
    holders, links = defaultdict(list), defaultdict(int)
    for k, s in enumerate(kinds):
        for gram in s:
            holders[gram].append(k)
    sets = list(kinds)
    common = Counter((a, b) for ks in holders.values() for n, a in enumerate(ks) for b in ks[n + 1 :])
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
    want = {i: links[k] for k, s in enumerate(sets) for i in kinds[s]}
    got = {r.doc_id: r.n_links for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(links.values()) > 500 and {i: got[i] for i in want} == want


def test_words_that_collide_modulo_a_power_of_two(spark):
    morse = lambda a, b: "".join(b if bin(i).count("1") % 2 else a for i in range(512))
    rows = [(1, morse("c", "x")), (2, morse("x", "c")), (3, morse("c", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_classes(docs).collect()]) == brute(rows) == [(1, 1, 0, 1), (2, 2, 0, 0), (3, 1, 0, 1)]


def test_exact_links_in_strips():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(600)]
    left = rng.random(600) < 0.5
    degree, label = exact_links([b""] * 600, sets, left, ~left, (3, 5))
    plain = [set(s.tolist()) for s in sets]
    near = [[b for b in range(600) if left[a] != left[b] and 5 * len(plain[a] & plain[b]) >= 3 * len(plain[a] | plain[b])] for a in range(600)]
    assert degree.tolist() == [len(x) for x in near]
    assert all(label[a] == label[b] for a in range(600) for b in near[a])


def test_two_blocks_of_counts_are_not_held_whole():
    rng = np.random.default_rng(5)
    n = 4096
    sets = [np.unique(rng.integers(0, 4000, 20)).astype(np.uint64) for _ in range(n)]
    left = np.arange(n) < n // 2
    tracemalloc.start()
    degree, label = exact_links([b""] * n, sets, left, ~left, (1, 9))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * n * n  # a float count for each pair
    plain = [set(x.tolist()) for x in sets]
    for a in range(0, n, 512):
        linked = [b for b in range(n) if left[a] != left[b] and 9 * len(plain[a] & plain[b]) >= len(plain[a] | plain[b])]
        assert degree[a] == len(linked) and {label[b] for b in linked} <= {label[a]}


def test_one_very_long_word(spark):
    rows = [(1, "z" * 300_000), (2, "z" * 300_000 + "y"), (3, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_classes(docs).collect()]) == brute(rows)


def test_empty_table_keeps_nothing(make_docs):
    assert keep_one(make_docs([])).collect() == []


@pytest.mark.parametrize(("small", "block"), [(128, 2048), (3, 4)])
def test_brute_force(spark, small, block):
    rows = near_copies(small)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted([tuple(r) for r in jaccard_classes(docs, small=small, block=block).collect()], key=str) == brute(rows)


def test_edges(make_docs, edge_rows):
    got = sorted([tuple(r) for r in jaccard_classes(make_docs(edge_rows)).collect()], key=str)
    assert got == brute([r[:2] for r in edge_rows])
    assert jaccard_classes(make_docs([])).collect() == []


def test_one_of_each_class_stays(make_docs, edge_rows):
    docs = make_docs(edge_rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    wordless = [r for r in rows if not re.search("[0-9a-z\x80-￿]", (r.text or "").lower())]
    assert len(wordless) == sum(not re.search("[0-9a-z\x80-￿]", (r[1] or "").lower()) for r in edge_rows)
    assert [r.doc_id for r in rows if (r.text or "").lower().startswith("hello")] == [3]
    assert sum((r.text or "").startswith("mail me") for r in rows) == 1
    assert sum(len(r.text or "") > 10_000 for r in rows) == 1
