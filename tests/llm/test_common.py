from pyspark.sql import functions as F

from rillstone.llm import common
from rillstone.storage import durable


def test_sized_join_is_the_same_on_both_ways(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "k long, v string").repartition(3)
    right = durable(spark.createDataFrame([(2, 5), (9, 1), (None, 7)], "k long, n int"))
    results = []
    for most in (200_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        out = {how: common.sized_join(left, right, "k", how) for how in ("inner", "left", "left_semi", "left_anti")}
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in out.values()]
        assert all(("BroadcastHashJoin" in p) == bool(most) and ("SortMergeJoin" in p) == (not most) for p in plans)
        on = [F.col("l.k").eqNullSafe(F.col("r.k"))]
        safe = common.sized_join(left.alias("l"), right.alias("r"), on, "left_semi")
        weighed = common.sized_join(left, right, "k", "inner", F.col("n"), most=12)  # 5 + 1 + 7
        assert "SortMergeJoin" in weighed._jdf.queryExecution().executedPlan().toString()
        results.append([sorted(map(str, x.collect())) for x in (*out.values(), safe, weighed)])
    assert results[0] == results[1]


def test_rows_are_named_alike_each_time(spark, tmp_path):
    """Rows of a plain scan by file and place, others by a durable copy; columns with clashing names stay."""
    frame = spark.createDataFrame([(i % 3, "x", i) for i in range(50)], "doc_id long, text string, _row long").repartition(4)
    frame.write.parquet(str(tmp_path / "t"))
    for docs in (spark.read.parquet(str(tmp_path / "t")), frame, spark.read.parquet(str(tmp_path / "t")).where("doc_id > 0")):
        name = common.spare_name(docs, "_row")
        named = common.numbered(docs, name)
        first = {str(r[name]): r["_row"] for r in named.collect()}
        again = {str(r[name]): r["_row"] for r in named.repartition(7).select(name, "_row").collect()}
        assert name == "__row" and len(first) == docs.count() and first == again
