"""The language's values, control flow and queries on small frames."""

import datetime as dt

import pytest

from larkspur.engine import Engine
from larkspur.operators.joins import JoinProblem
from larkspur.plans.evaluate import EvalProblem, NameProblem
from larkspur.plans.frame import Frame
from larkspur.sources.partitioned import PartitionProblem


@pytest.fixture
def e(spark):
    return Engine(spark)


@pytest.fixture
def t(spark):
    return Engine(spark, "terse")


def rows(x):
    return [tuple(r.values()) for r in x.collect()]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("1+2*3", 9), ("area: function(w, h, k){ w * h - k}; half: area(6, , 4); half(5)", 26), ("max(4.0 6.0f/2)", 3.0), ("left: 20; while(left>6){left: left-5;}; left", 5),
        ("stock: {pear: 4, plum: 6,}; stock(`fig): 10; price: `pear`fig![2,3]; price(`fig) * stock(`fig) - stock(`plum)", 24), ("eval([-, 30, 4])", 26), ("gap: function(hi, lo){ hi - lo}; eval([`gap, 12, 5])", 7),
        ("later: function(day){ if(day<1999.12.31){return 1999.12.31;} day + 2}; later(2011.05.30)", dt.date(2011, 6, 1)), ("0n ?? 3", 3), ("0b && (nothing_here)", False), ("1b || (nothing_here)", True),
        ("if{0b, 1, 0b, 2, 3}", 3), ("(neg) each [1,2]", [-1, -2]), ("over(function(x,y){x*y}, 1, [2,3,4])", 24), ("scan(function(x,y){x+y}, 0, [1,2,3])", [1, 3, 6]),
        ("2 # [1,2,3]", [1, 2]), ("-2 # [1,2,3]", [2, 3]), ("5 # [1,2]", [1, 2, 1, 2, 1]), ("1 _ [1,2,3]", [2, 3]), ("[10,20] @ -1", 20), ("[10,20] @ 5", None), ("1 2 3 in [2]", [False, True, False]),
        ("7 div -2", -4), ("-7 mod 3", 2), ("1/0", float("inf")), ("quantile(0.4, [1,4,9])", 2.5), ("csum([1,2,3])", [1, 3, 6]), ("3 mmean [1,2,3,4]", [1.0, 1.5, 2.0, 3.0]), ("sqrt(4.0)", 2.0),
        ("2024.01.31 + 1", dt.date(2024, 2, 1)), ("\"a\" + 1", "a1"), ("type(1 2)", "i64s"), ("range(3)", [0, 1, 2]), ("range(2024.01.01 2024.01.03) @ 2", dt.date(2024, 1, 3)), ("null([1, 0n])", [False, True]),
        ("2 2 # [1,2,3,4]", [[1, 2], [3, 4]]), ("[1,2] cross [3]", [[1, 3], [2, 3]]), ("filter([0b,1b,1b])", [1, 2]), ("replace(\"aba\", \"a\", \"x\")", "xbx"), ("pad(4, \"ab\")", "ab  "), ("ss([1,3,5], 3)", 1), ("ssr([1,3,5], 3)", 2),
        ("tz(2024.07.01D12:00:00, \"UTC\", \"Europe/Paris\")", dt.datetime(2024, 7, 1, 14)), ("inv([[2.0, 0.0], [0.0, 4.0]])", [[0.5, 0.0], [0.0, 0.25]]), ("`a`b intersect `b`c", ["b"]), ("2 xbar 5", 4),
    ],
)
def test_values(e, source, want):
    assert e.eval(source) == want


def test_terse(t):
    assert t.eval("area: {[w; h; k] w * h - k}; half: area[6; ; 4]; half 5") == 6
    assert t.eval("gap: {[hi; lo] hi - lo}; gap[8]") is not None
    assert t.eval("later: {[day] if[day<1999.12.31; :1999.12.31;]; day + 2}; later 2011.05.30") == dt.date(2011, 6, 1)
    assert "nowhere" in t.eval("try [y: nowhere + 1;] catch [0;]; err")
    assert t.eval("$[0b; 1; 0b; 2; 3]") == 3
    table = t.eval("([]fruit: `fig`pear`pear; kilos: 2 5 1; price: 4.0 1.5 3.0f)")
    t.set_var("sales", table)
    assert rows(t.eval("select total: sum kilos * price, kilos by fruit from sales")) == [("fig", 8.0, [2]), ("pear", 10.5, [5, 1])]


def test_errors(e):
    with pytest.raises(NameProblem):
        e.eval("nothing_here")
    with pytest.raises(EvalProblem, match="no stock"):
        e.eval('raise "no stock"')
    with pytest.raises(EvalProblem):
        e.eval("f: function(x){x}; f(1, 2)")
    with pytest.raises(EvalProblem, match="deep"):
        e.eval("f: function(x){f(x)}; f(1)")
    with pytest.raises(EvalProblem, match="not both"):
        e.eval("t: ([]a: 1 2); delete `a from t where a = 1")


def test_null_semantics(e):
    e.eval("t: ([]g: `x`x`y, v: [1.0, 0n, 0n])")
    assert rows(e.eval("select s: sum(v), n: count(v), u: uc(v), m: mean(v) by g from t")) == [("x", 1.0, 2, 2, 1.0), ("y", 0.0, 1, 1, None)]
    assert rows(e.eval("select n: count(i) from t where v = 0n")) == [(2,)]
    assert rows(e.eval("select n: count(i) from t where v != 1.0")) == [(0,)]
    assert rows(e.eval("select n: count(i) from t where v in [1.0, 0n]")) == [(3,)]
    assert rows(e.eval("delete from t where v > 5")) == [("x", 1.0)]
    assert rows(e.eval("select r: rank(v), c: csum(v) from t")) == [(1, 1.0), (None, None), (None, None)]


def test_order_is_kept(e):
    e.eval("t: ([]k: `b`a`b`c, v: 1 2 3 4)")
    assert rows(e.eval("select sum(v) by k from t")) == [("b", 4), ("a", 2), ("c", 4)]
    assert rows(e.eval("select by k from t")) == [("b", 3), ("a", 2), ("c", 4)]
    assert rows(e.eval("xasc(`k, t)")) == [("a", 2), ("b", 1), ("b", 3), ("c", 4)]
    assert rows(e.eval("select v from t limit -2")) == [(3,), (4,)]
    assert rows(e.eval("unique(select k from t)")) == [("b",), ("a",), ("c",)]
    assert rows(e.eval("vstack(t, t)"))[4] == ("b", 1)
    assert rows(e.eval("1 _ t")) == [("a", 2), ("b", 3), ("c", 4)]


def test_joins(e):
    e.eval("l: ([]k: `a`b`c, v: 1 2 3); r: ([]k: `b`c`d, v: [20, 0n, 40], w: 5 6 7)")
    assert rows(e.eval("lj(`k, l, r)")) == [("a", 1, None), ("b", 20, 5), ("c", None, 6)]
    assert rows(e.eval("ij(`k, l, r)")) == [("b", 20, 5), ("c", None, 6)]
    assert len(rows(e.eval("fj(`k, l, r)"))) == 4 and rows(e.eval("anti(`k, l, r)")) == [("a", 1)] and len(rows(e.eval("cj(`k, l, r)"))) == 9
    assert rows(e.eval("select v: col(\"v\") + lit(1) from l limit 1")) == [(2,)]
    with pytest.raises(JoinProblem):
        e.eval("lj(`k, l, vstack(r, r))")


def test_asof_and_window_join(e):
    e.eval("q: ([]s: `a`a`b, t: 1 5 2, bid: 10 50 20); d: ([]s: `a`a`b`c, t: 5 4 1 9, z: 1 2 3 4)")
    assert rows(e.eval("aj(`s`t, d, q)")) == [("a", 5, 1, 50), ("a", 4, 2, 10), ("b", 1, 3, None), ("c", 9, 4, None)]
    e.eval("w: update lo: t - 4, hi: t from d")
    got = rows(e.eval("delete lo, hi from wj(`s, `t, `lo, `hi, {n: [count, `bid], m: [max, `bid]}, w, q)"))
    assert got == [("a", 5, 1, 1, 10), ("a", 4, 2, 1, 10), ("b", 1, 3, 0, None), ("c", 9, 4, 0, None)]


def test_reshaping(e):
    e.eval("t: ([]g: `x`x`y, k: `p`q`p, v: 1 2 3)")
    assert rows(e.eval("pivot(t, `g, `k, `v, \"\")")) == [("x", 1, 2), ("y", 3, None)]
    assert sorted(rows(e.eval("unpivot(([]a: 1 2, b: 3 4), `a)"))) == [(1, "b", 3), (2, "b", 4)]
    assert rows(e.eval("explode(select v by g from t, `v)")) == [("x", 1), ("x", 2), ("y", 3)]
    assert e.eval("cols(xreorder(`v, t))") == ["v", "g", "k"] and e.eval("cols(xrename(`a`b, t))") == ["a", "b", "v"]
    assert rows(e.eval("hstack(select g from t, select v from t)")) == [("x", 1), ("x", 2), ("y", 3)]
    assert rows(e.eval("schema(t)"))[2][:2] == ("v", "bigint")


def test_windows(e):
    e.eval("t: ([]v: [1.0, 0n, 3.0, 0n, 7.0])")
    assert [r[0] for r in rows(e.eval("select interp(v) from t"))] == [1.0, 2.0, 3.0, 5.0, 7.0]
    assert [r[0] for r in rows(e.eval("select fill(v) from t"))] == [1.0, 1.0, 3.0, 3.0, 7.0]
    assert [r[0] for r in rows(e.eval("select bfill(v) from t"))] == [1.0, 3.0, 3.0, 7.0, 7.0]
    assert [r[0] for r in rows(e.eval("select 0.5 emean v from ([]v: 1.0 2.0 4.0)"))] == pytest.approx([1.0, 5 / 3, (4 + 1 + 0.25) / 1.75])
    assert sorted(r[0] for r in rows(e.eval("select shuffle(v) from ([]v: 1 2 3)"))) == [1, 2, 3]
    assert [r[0] for r in rows(e.eval("select csum(diff(v)) from ([]v: 1 4 9)"))] == [None, 3, 8]


def test_functional_and_register(e):
    e.eval("t: ([]a: 1 2 3, b: `x`y`x)")
    assert rows(e.eval(".fn.select(`t, 0n, [[>, `a, 1]], 0n, {c: `a}, 1)")) == [(2,)]
    assert rows(e.eval(".fn.update(`t, 0n, 0n, {c: [+, `a, 1]})"))[0] == (1, "x", 2)
    assert rows(e.eval(".fn.delete(`t, [[=, `b, \"y\"]], 0n)")) == [(1, "x"), (3, "x")]
    e.register("twice", lambda x: x * 2)
    assert rows(e.eval("select twice(a) from t limit 1")) == [(2,)] and e.eval("twice(4)") == 8


def test_variables_hooks_and_plan(e):
    seen = []
    e.set_pre_eval_hook(lambda s: s.replace("one", "1"))
    e.set_post_eval_hook(lambda s, v: seen.append(v))
    assert e.eval("one + one") == 2 and seen == [2] and e.get_pre_eval_hook() is not None
    e.clear_pre_eval_hook()
    e.eval("x: 3; t: ([]a: 1 2)")
    assert e.has_var("x") and e.table_names() == ["t"] and [r[0] for r in rows(e.list_vars())] == ["t", "x"]
    assert "Project" in e.query_plan("select a + 1 from t where a > 1")
    e.del_var("x")
    assert not e.has_var("x") and e.is_lazy_mode() and e.stats()["vars"] == 1


def test_partitions(e, tmp_path):
    root = str(tmp_path)
    for d in (5, 2, 3, 4, 8):
        frame = e.eval(f"([]symbol: `a`b, value: {d}.0 {d * 2}.0)")
        assert e.write_partitioned_df(frame, root, "weights", dt.date(2024, 1, d), ["symbol"]) > 0
    assert e.load_partitioned_df(root) == ["weights"]
    n = lambda c: e.eval(f"count(select from weights where {c})")
    assert [n("date=2024.01.03"), n("date=2024.02.01"), n("date within 2024.01.02 2024.01.04"), n("date>=2024.01.05"), n("date>2024.01.05"), n("date=2024.01.03, symbol=`a"), n("date in 2024.01.02 2024.01.08")] == [2, 0, 6, 4, 2, 1, 4]
    with pytest.raises(PartitionProblem):
        e.eval("select from weights")
    with pytest.raises(PartitionProblem):
        e.write_partitioned_df(e.eval("([]other: 1 2)"), root, "weights", dt.date(2024, 1, 9))
    plan = e.query_plan("select value from weights where date=2024.01.03, value>1.0")
    assert "2024-01-03" in plan.split("PartitionFilters")[1].splitlines()[0] and "ReadSchema: struct<value:double>" in plan
    e.write_partitioned_df(e.eval("([]symbol: `z, value: 1.0)"), root, "weights", dt.date(2024, 1, 3), overwrite=True)
    e.write_partitioned_df_custom(e.eval("([]symbol: `y, value: 1.0)"), root, "weights", dt.date(2024, 1, 3), rechunk=True, compression="snappy")
    e.load_partitioned_df(root)
    assert n("date=2024.01.03") == 2


def test_files(e, tmp_path):
    p = str(tmp_path)
    e.eval(f't: ([]a: 1 2, b: `x`y); wcsv("{p}/t.csv", t); wjson("{p}/t.json", t); wparquet("{p}/t.parquet", t); wtxt("{p}/t.txt", "hello"); wbin("{p}/t.bin", t); wbin("{p}/d.bin", [1, {{k: 2024.01.01}}])')
    for source in ("rcsv(\"{p}/t.csv\")", "rjson(\"{p}/t.json\")", "rparquet(\"{p}/t.parquet\")", "rbin(\"{p}/t.bin\")"):
        assert sorted(rows(e.eval(source.replace("{p}", p)))) == [(1, "x"), (2, "y")]
    assert e.eval(f'rtxt("{p}/t.txt")') == "hello\n" and e.eval(f'rbin("{p}/d.bin")') == [1, {"k": dt.date(2024, 1, 1)}]
    assert rows(e.eval(f'rcsv("{p}/t.csv", 1b, ",", 0b, {{b: `str}})')) == [("x",), ("y",)]
    assert e.eval(f'exists("{p}/t.txt")') and e.eval(f'hdel("{p}/t.txt")') and not e.eval(f'exists("{p}/t.txt")')


def test_import(e, tmp_path):
    (tmp_path / "constant.terse").write_text("n: 314;")
    e.eval(f'import("{tmp_path}/constant.terse")')
    assert e.eval("n") == 314


def test_ticks(e, tmp_path):
    trade = e.eval("([]sym: `a`b`a`c, price: 1.0 2.0 3.0 4.0)")
    e.init_tick({"trade": trade}, f"{tmp_path}/log")
    e.subscribe("trade", lambda m: e.upsert("some", m[2]), {"trade": ("sym", ["a"])})
    e.subscribe("trade")
    e.publish("trade", trade)
    e.publish("trade", e.eval("([]sym: `a`d, price: 5.0 6.0)"))
    assert rows(e.get_var("some")) == [("a", 1.0), ("a", 3.0), ("a", 5.0)] and e.get_var("trade").data.count() == 6
    assert e.get_tick_count() == 2 and e.ticks.broker.validate_seq(f"{tmp_path}/log") == 2
    got = []
    for q in e.ticks.follow(f"{tmp_path}/log", lambda t, df: got.append((t, df.count())), once=True):
        q.awaitTermination()
    assert sum(n for _, n in got) == 6
    e.set_var("upd", lambda t, df: got.append((t, df.data.count())))
    assert e.ticks.replay(f"{tmp_path}/log", 1, 2) == 1 and got[-1] == ("trade", 2)
    e.insert("last", "sym", trade)
    assert sorted(rows(e.get_var("last"))) == [("a", 3.0), ("b", 2.0), ("c", 4.0)]
    assert e.drain("last").count() == 3 and e.get_var("last").data.count() == 0
    assert e.tick(5, 3) == 5 and e.set_tick_count(1, 3) == 1


def test_jobs(e):
    ran = []
    e.set_var("work", lambda *a: ran.append(1))
    now = dt.datetime(2024, 1, 1)
    e.jobs.stop()
    e.jobs.add("work", now, now + dt.timedelta(seconds=3), dt.timedelta(seconds=1), "beat")
    later = e.jobs.add_after("work", dt.timedelta(hours=1))
    for s in range(6):
        e.jobs.run_due(now + dt.timedelta(seconds=s))
    assert len(ran) == 4 and e.jobs.held[later].active
    assert e.jobs.deactivate("beat") == 1 and e.jobs.get(later).data.count() == 1 and e.jobs.list().data.count() == 2


def test_frames_from_spark(e, spark):
    e.set_table("ev", spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), ["k"])
    assert rows(e.eval("select v from ev")) == [("a",), ("b",)] and isinstance(e.get_var("ev"), Frame)
    assert spark.table("ev").count() == 2


@pytest.mark.parametrize("coalescing", ["true", "false"])
def test_rows_are_numbered_once(spark, coalescing):
    """Each row its own number, in order, whatever partitions the sort makes."""
    from pyspark.sql import functions as F

    from larkspur.operators import reshape

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalescing)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        data = spark.range(100_000).select((F.col("id") % 5000).alias("k"), F.xxhash64("id").alias("h"))
        got = reshape.indexed(Frame(data, ["k", "h"]))
        out = got.agg(F.count_distinct("__i"), F.min("__i"), F.max("__i")).first()
        assert tuple(out) == (100_000, 0, 99_999)
        steps = got.orderBy("__i").select("k", "h").collect()
        assert steps == sorted(steps)
        pairs = reshape.side_by_side(Frame(data, ["k", "h"]), Frame(data.select(F.col("h").alias("g"), F.col("k").alias("j")), ["j", "g"])).data
        assert pairs.where("h = g and k = j").count() == pairs.count() == 100_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partition_is_replaced_at_once(e, spark, tmp_path):
    """A partition may be rewritten from itself; a write that fails leaves what was there."""
    root, day = str(tmp_path), dt.date(2024, 3, 1)
    e.write_partitioned_df(e.eval("([]k: 3 1 2)"), root, "t", day)
    own = Frame(spark.read.parquet(f"{root}/t/date=2024-03-01"))
    e.write_partitioned_df(own, root, "t", day, ["k"], overwrite=True)
    e.write_partitioned_df(e.eval("([]k: 9 8)"), root, "t", day, ["k"], rechunk=True)
    read = lambda: sorted(r.k for r in spark.read.parquet(f"{root}/t").collect())
    assert read() == [1, 2, 3, 8, 9] and len(list((tmp_path / "t" / "date=2024-03-01").glob("*.parquet"))) == 1
    bad = Frame(spark.range(3).selectExpr("raise_error('no') as x", "id as k").selectExpr("cast(coalesce(x, k) as bigint) as k"))
    with pytest.raises(Exception, match="no"):
        e.write_partitioned_df(bad, root, "t", day, overwrite=True)
    assert read() == [1, 2, 3, 8, 9] and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_windows_of_unlike_lengths(e, spark):
    """A long window among short ones; every window's rows are those of brute force."""
    left = [(i, i % 3, 10 * i, 10 * i - (5000 if i == 7 else 1 + i % 40)) for i in range(300)]
    right = [(j % 3, 3 * j, float(j % 17)) for j in range(1200)]
    e.set_table("l", spark.createDataFrame(left, "i long, k long, t long, lo long"), ["i"])
    e.set_table("r", spark.createDataFrame(right, "k long, t long, v double"))
    got = rows(e.eval("select i, n, m from wj(`k, `t, `lo, `t, {n: [count, `v], m: [max, `v]}, l, r)"))
    for i, n, m in got:
        _, k, t, lo = left[i]
        inside = [v for kk, tt, v in right if kk == k and lo <= tt < t]
        assert (n, m) == (len(inside), max(inside, default=None))
    assert len(got) == 300


def test_growing_frames_are_compacted(e):
    from larkspur.streaming import ticks

    for k in range(2 * ticks.COMPACT + 3):
        e.upsert("many", e.eval(f"([]k: {k}, v: {k * 2})"))
    frame = e.get_var("many")
    assert rows(frame) == [(k, 2 * k) for k in range(2 * ticks.COMPACT + 3)]
    assert frame.data._jdf.queryExecution().toString().count("Union") < 40
    with pytest.raises(KeyError):
        e.drain("none of that name")
    with pytest.raises(ValueError, match="time zone"):
        e.add_at_time("work", dt.datetime(2030, 1, 1))
    assert e.add_at_time("work", dt.datetime(2030, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2)))) and rows(e.jobs.list())[-1][2] == dt.datetime(2030, 1, 1)
    e.jobs.stop()


def test_frames_of_unlike_orders_stack(e, spark):
    e.set_table("a", spark.createDataFrame([(2, "x"), (1, "y")], "k long, v string"), ["k"])
    e.set_table("b", spark.createDataFrame([(8, "q"), (9, "p")], "k long, v string"), ["v"])
    assert [r[0] for r in rows(e.eval("vstack(a, b)"))] == [1, 2, 9, 8] and [r[0] for r in rows(e.eval("a ++ a"))] == [1, 2, 1, 2]
