"""Plans and results that must hold when tables grow."""

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from larkspur import queries as q
from larkspur.engine import Engine


def test_weights_are_scanned_in_batches(spark, sf):
    for name in ("weighted_spread", "weighted_all"):
        plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "InPandas" not in plan  # a call and a frame for each group
        assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_weights_go_on_from_batch_to_batch(spark):
    values = [(k, g, None if k % 7 == 3 else float("nan") if k % 11 == 5 else (k * 37 % 101) / 3) for k in range(60) for g in ("a", "b", None)]
    df = spark.createDataFrame(values, "k long, g string, v double").withColumn("spare", F.lit("x")).repartition(5)
    e = Engine(spark)
    e.set_table("t", df, ["k"])
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.g, r.k): (r.m, r.a, r.b) for r in e.eval("update m: 0.3 emean v, a: 0.3 evar v, b: 0.3 estd v by g from t").df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(values)
    for g in ("a", "b", None):
        w = pd.Series([v for k, h, v in values if h == g], dtype="float64").ewm(alpha=0.3, ignore_na=True)
        for k, want in enumerate(zip(w.mean(), w.var(), w.std(), strict=True)):
            assert got[g, k] == tuple(None if x != x else pytest.approx(x, rel=1e-12) for x in want)
    with pytest.raises(ValueError):
        e.eval("update m: 1.5 emean v by g from t")


def test_whole_aggregates_leave_rows_where_they_are(spark, sf):
    for name in ("infix_fold", "terse_fold", "spread_aggregate_all"):
        plan = q.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Window" not in plan and "partial_m" in plan


def test_whole_aggregates_of_odd_values(spark, tmp_path):
    path, nan = f"{tmp_path}/t.parquet", float("nan")
    pq.write_table(pa.table({"k": [0, 1, 2, 3, 4], "v": pa.array([1.0, nan, 3.0, nan, None])}), path)  # bounds without NaN
    e = Engine(spark)
    e.set_table("t", spark.read.parquet(path), ["k"])
    got = lambda source: [tuple(r) for r in e.eval(source).df.orderBy(*e.eval(source).df.columns[:1]).collect()]
    assert got("select k from t where v = max(v)") == [(1,), (3,)]
    assert got("select k from t where v = min(v)") == [(0,)]
    assert got("select k, n: count(i), f: first(v), d: k - min(k), r: csum(k - max(k)) from t where k < 2") == [(0, 2, 1.0, 0, -1), (1, 2, 1.0, 1, -1)]
    assert got("select k, n: count(i), m: sum(v) from t where k > 9") == []
