import random
from collections import defaultdict

from rillstone.llm.packing import best_fit, pack


def brute(lengths, sources, clusters, capacity):
    bins, out = [], [(-1, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if not lengths[i]:
            continue
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= lengths[i] and sources[i] not in b["s"] and clusters[i] not in b["c"]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        out[i] = (k, capacity - bins[k]["room"])
        bins[k]["room"] -= lengths[i]
        bins[k]["s"].add(sources[i])
        bins[k]["c"].add(clusters[i])
    return out


def test_best_fit_against_scanning_all_bins():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randint(0, 120)
        lengths = [rng.choice([0, 1, 5, 10, 33, 50, 99, 100]) for _ in range(n)]
        sources = [rng.choice([None, "hot", "hot", *"abcdef"]) for _ in range(n)]
        clusters = [rng.randint(0, 20) for _ in range(n)]
        assert best_fit(lengths, sources, clusters, 100) == brute(lengths, sources, clusters, 100)


def test_pieces_and_conflicts(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, f"text {i % 7} " + "x" * (i * 13 % 300), None, ["hot", None, "b", "c"][i % 4], 1, 1, True, 1, "", "", 0.0, "") for i in range(200)]
    got = pack(make_docs(rows), capacity=500, shard_rows=50).collect()
    size, bins = defaultdict(int), defaultdict(list)
    for r in got:
        size[r.doc_id] += r.length
        if r.length:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    total = defaultdict(int)
    for r in rows:
        total[r[0]] += len((r[1] or "").encode())
    assert size == total
    about = {r[0]: r for r in rows}
    for rs in bins.values():
        assert sum(r.length for r in rs) <= 500
        spans = sorted((r.bin_offset, r.bin_offset + r.length) for r in rs)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        known = [r for r in rs if r.doc_id is not None]
        assert len({about[r.doc_id][3] for r in known}) == len(known)
        texts = ["".join((about[r.doc_id][1] or "").split()) for r in known]
        assert len(set(texts)) == len(known)
    assert pack(make_docs([])).collect() == []


def test_bins_do_not_depend_on_the_input_partitions(make_docs, edge_rows):
    rows = edge_rows + [(100 + i, f"text {i % 7} " + "x" * (i * 13 % 300), None, ["hot", None, "b", "c"][i % 4], 1, 1, True, 1, "", "", 0.0, "") for i in range(300)]
    results = [sorted([tuple(r) for r in pack(make_docs(order, parts), capacity=500, shard_rows=50).collect()], key=str) for order, parts in ((rows, 1), (rows[::-1], 5))]
    assert results[0] == results[1]


def test_given_clusters_and_full_shards(spark):
    """Clusters of a column, in shards that brute force packs again."""
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(1, 90) + str(i), f"s{rng.randint(0, 30)}", rng.choice([None, "a", "b", *map(str, range(40))])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, class string").repartition(3)
    got = pack(docs, capacity=200, shard_rows=100, cluster_col="class").collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(rows[r.doc_id])
    assert all(len({r[2] for r in b}) == len({r[3] for r in b}) == len(b) for b in bins.values())
    least = len({k for k, _ in brute([len(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows], 200)})
    assert len(bins) <= least * 1.15 and max(len(b) for b in bins.values()) > 1


def test_each_shard_against_scanning_all_bins(spark):
    from rillstone.llm import packing

    rng = random.Random(7)
    rows = [(i, rng.choice("abcde"), f"c{rng.randint(0, 9)}", rng.randint(0, 450)) for i in range(130)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(4)], ["doc_id", "source", "cluster", "length"])
    out = [r for b in packing._packer(100, 50)([batch]) for r in b.to_pylist()]
    for at in range(0, 130, 50):
        part = rows[at : at + 50]
        want = brute([r[3] % 100 for r in part], [r[1] for r in part], [r[2] for r in part], 100)
        tails = {r["doc_id"]: (r["bin_id"], r["bin_offset"]) for r in out if r["length"] and r["length"] < 100}
        same = {}
        for r, (k, offset) in zip(part, want, strict=True):
            if k >= 0:
                assert same.setdefault(k, tails[r[0]][0]) == tails[r[0]][0] and tails[r[0]][1] == offset
        assert len(set(same.values())) == len(same)
