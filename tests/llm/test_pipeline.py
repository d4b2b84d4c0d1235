import re

from rillstone.llm import toxicity
from rillstone.llm.packing import CAPACITY
from rillstone.llm.pii import base_spans
from tests.llm.test_jaccard_join import brute as classes

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = before.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "personal_data", "packing"]

    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    low = {r.doc_id for r in toxicity.toxicity(source, model).where("predicted = 0").collect()}
    assert {r.doc_id for r in seen["toxicity"][1]} == low

    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        key = norm(r.text)
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in best.values())

    before, after = seen["jaccard_join"]
    named = {i: c for i, c, _, _ in classes([(r.doc_id, r.text) for r in before])}
    assert sorted(r.doc_id for r in after) == sorted(set(named.values()))

    before, after = seen["personal_data"]
    new = {r.doc_id: r for r in after}
    assert set(new) == {r.doc_id for r in before}
    for r in before:
        spans = base_spans(r.text)
        assert (new[r.doc_id].text == r.text) or spans
        assert not any(r.text[s:e] in new[r.doc_id].text for s, _, e in spans)

    before, after = seen["packing"]
    sizes = {r.doc_id: len(r.text.encode()) for r in before}
    got = {}
    for r in after:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.length <= CAPACITY
    assert got == sizes


def test_run_applies_all_stages(spark, tmp_path, make_docs, edge_rows):
    """``run`` over a small table with nulls, empty texts, ties, repeated rows and columns with clashing names."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    near = " ".join(words * 6)
    rows = [r for r in edge_rows] + [(200 + i, " ".join(words[(i + k) % 12] + "abcdefgh"[k % 8] for k in range(30 + i)), "en", "s", 1, 7, True, 1, "x", "k", 0.5, "c") for i in range(20)]
    rows += [(300, near, None, None, None, None, None, None, None, None, None, None), (301, near + " nu", None, None, None, None, None, None, None, None, None, None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, None if i % 5 else i % 2) for i in range(200, 220)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_offset"]
    assert 300 in got and 301 not in got and {3, 8, 9} <= got and 4 not in got
    assert out.groupBy("doc_id").agg({"length": "sum"}).where("doc_id = 300").first()[1] == len(near)

    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns and after.schema == docs.schema, name
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.collect() == [] and empty.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_scratch_tables_go(spark):
    from rillstone import storage

    with storage.scratch(spark):
        first = storage.durable(spark.range(3).toDF("i"))
        last = storage.durable(first, outlive=True)
        inner = first.inputFiles()[0]
    assert last.count() == 3
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inner)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
