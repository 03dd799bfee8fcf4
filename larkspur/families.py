"""Queries for the families of functions that no other query names: one for each family, with the SQL each must equal."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.plans.frame import Frame
from larkspur.queries import ORACLE_SQL, QUERIES, engine, scratch, text

# columns

text(
    "comparisons",
    "select l_orderkey, l_linenumber, a: l_quantity <= 25.0, b: l_quantity >= 25.0, c: l_quantity != 25.0, d: l_quantity ~ 25.0, e: (l_quantity < 10.0) & (l_tax > 0.02) from lineitem",
    "select l_orderkey, l_linenumber, l_quantity <= 25 as a, l_quantity >= 25 as b, l_quantity <> 25 as c, l_quantity = 25 as d, l_quantity < 10 and l_tax > 0.02 as e from lineitem",
)
text(
    "trigonometry_rest",
    "select p_partkey, a: acos(p_size / 50) round 6, b: acosh(p_size) round 6, c: asin(p_size / 50) round 6, d: atanh(p_size / 51) round 6, e: cosh(p_size / 50) round 6, f: cot(p_size) round 5, g: sinh(p_size / 50) round 6, h: tan(p_size / 50) round 6, k: neg(p_size) from part",
    "select p_partkey, round(acos(p_size / 50), 6) as a, round(acosh(p_size), 6) as b, round(asin(p_size / 50), 6) as c, round(atanh(p_size / 51), 6) as d, round(cosh(p_size / 50), 6) as e, round(cot(p_size), 5) as f, round(sinh(p_size / 50), 6) as g, round(tan(p_size / 50), 6) as h, -p_size as k from part",
)
text("hashes", "select n: count(i), kinds: uc(h) from (select h: hash(event_type), event_type from events)", "select count(*) as n, count(distinct event_type)::bigint as kinds from events")
text(
    "moving_rest",
    "select event_id, a, b, c, d, e from (update a: (4 mstd1 value) round 4, b: (4 mvar0 value) round 6, c: (4 mvar1 value) round 6, d: cprod(value / 1000.0 + 1.0) round 6, e: (4 mskew value) round 3 + 0.0 by user_id from events)",
    """with t as (select *, list(value) over w as l from events window w as (partition by user_id order by event_id rows between 3 preceding and current row)),
    m as (select *, list_avg(l) as mu from t), s as (select *, list_avg(list_transform(l, lambda x: pow(x - mu, 2))) as m2, list_avg(list_transform(l, lambda x: pow(x - mu, 3))) as m3 from m)
    select event_id, round(case when len(l) > 1 then sqrt(m2 * len(l) / (len(l) - 1)) end, 4) as a, round(m2, 6) as b, round(case when len(l) > 1 then m2 * len(l) / (len(l) - 1) end, 6) as c,
        round(product(1 + value / 1000) over (partition by user_id order by event_id), 6) as d, round(case when m2 > 0 then m3 / pow(m2, 1.5) end, 3) + 0.0 as e from s""",
)
text(
    "weighted_spread",
    "select event_id, a, b from (update a: (0.5 evar value) round 6, b: (0.5 estd value) round 6 by user_id from events)",
    """with recursive t as (select event_id, user_id, value as v, row_number() over (partition by user_id order by event_id) as k from events),
    r as (select event_id, user_id, k, v as s1, v * v as s2, 1.0::double as w1, 1.0::double as w2 from t where k = 1
        union all select t.event_id, t.user_id, t.k, t.v + 0.5 * s1, t.v * t.v + 0.5 * s2, 1 + 0.5 * w1, 1 + 0.25 * w2 from r join t on t.user_id = r.user_id and t.k = r.k + 1),
    x as (select event_id, case when k > 1 then greatest(s2 / w1 - (s1 / w1) * (s1 / w1), 0) * w1 * w1 / (w1 * w1 - w2) end as x from r)
    select event_id, round(x, 6) as a, round(sqrt(x), 6) as b from x""",
)
text(
    "group_lists",
    "select lo: asc(event_id) @ 0, hi: desc(event_id) @ 0, below: value ss 50.0, upto: value ssr 50.0, rest: count each (1 _ event_id) by event_type from events",
    "select event_type, min(event_id) as lo, max(event_id) as hi, count(*) filter (value < 50) as below, count(*) filter (value <= 50) as upto, (count(*) - 1)::int as rest from events group by 1",
)
text("sorted_and_dropped", "select o_orderkey, o_totalprice from (5 _ xasc(`o_totalprice`o_orderkey, orders))", "select o_orderkey, o_totalprice from orders qualify row_number() over (order by o_totalprice, o_orderkey) > 5")
text("stacked_frames", "vstack((select c_custkey, c_name from customer), extend((select c_custkey, c_name from customer), (select c_custkey, c_name from customer)))", "select c_custkey, c_name from customer cross join range(3)")
text("side_by_side_all", "hstack((select o_orderkey, o_custkey from orders), (select o_totalprice from orders))", "select o_orderkey, o_custkey, o_totalprice from orders")
text("rows_at", "orders @ [0, 3, -1]", "select * exclude r exclude n from (select *, row_number() over (order by o_orderkey) as r, count(*) over () as n from orders) where r in (1, 4, n)".replace("exclude r exclude n", "exclude (r, n)"))
text("quoted_columns", "select 'o_orderkey', total: 'o_totalprice' + lit(1.0), k: col(\"o_custkey\") from orders", "select o_orderkey, o_totalprice + 1 as total, o_custkey as k from orders")
text("group_rows", "select user_id, n: count each v from (select v: value by user_id from events)", "select user_id, count(*)::int as n from events group by 1")
text("schema_of", "select column, datatype from schema((select event_id, event_type, value from events))", "select * from (values ('event_id', 'bigint'), ('event_type', 'string'), ('value', 'double')) t(\"column\", datatype)")
text("flattened", "select n: count(i) by w: p from explode((select p: x union y from (select x: p_type split \" \", y: p_name split \" \" from part)), `p)", "select unnest(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))) as w, count(*) as n from part group by 1")
text("when_local", "select n: count(i) by d: `date$local(ts, \"Asia/Tokyo\") from events", "select (ts + interval 9 hours)::date as d, count(*) as n from events group by 1")
text("zone_to_zone", "select event_id, t: tz(ts, \"UTC\", \"Asia/Tokyo\"), u: utc(ts, \"Asia/Tokyo\") from events", "select event_id, ts + interval 9 hours as t, ts - interval 9 hours as u from events")
text("functional_update", ".fn.update((select o_orderkey, o_totalprice from orders), [[>, `o_totalprice, 100000.0]], 0n, {o_totalprice: 0.0})", "select o_orderkey, case when o_totalprice > 100000 then 0 else o_totalprice end as o_totalprice from orders")
text("functional_delete", ".fn.delete((select o_orderkey, o_custkey from orders), [[>, `o_custkey, 50]], 0n)", "select o_orderkey, o_custkey from orders where not o_custkey > 50")


def shown(x: Any) -> str:
    """A driver value as SQL writes it."""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{round(x, 6):.6f}"
    if isinstance(x, dict):
        return ",".join(f"{k}={shown(v)}" for k, v in x.items())
    if isinstance(x, list):
        return ",".join(map(shown, x))
    return "null" if x is None else str(x)


def values(name: str, calls: dict[str, tuple[str, str]], syntax: str = "infix") -> None:
    """A query of driver values: (name, value) for each source, and the SQL expression it must equal."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = []
        for k, (source, _) in calls.items():
            e = engine(spark, sf_dir, syntax, source)
            rows.append((k, shown(e.eval(source))))
        return spark.createDataFrame(rows, "name string, value string")

    QUERIES[name] = run
    ORACLE_SQL[name] = "select * from (values " + ", ".join(f"('{k}', ({sql})::varchar)" for k, (_, sql) in calls.items()) + ") t(name, value)"


values(
    "control_flow",
    {
        "if": ("x: 3; if(x > 2){ x: 10; } x", "10"), "while": ("n: 0; while(n < 7){ n: n + 2; } n", "8"), "return": ("f: function(n){ if(n > 2){ return n * 100; } n }; f(3) + f(1)", "300 + 1"),
        "comment": ("1 + 2 // and more\n/* nothing */", "3"), "and": ("0b && (missing_name)", "false"), "or": ("1b || (missing_name)", "true"), "cond": ("if{0b, 1, 1b, 2, 3}", "2"),
        "call_dict": ("d: {p: 4, q: 5}; d(`q)", "5"), "call_list": ("v: [7, 8, 9]; v(1)", "8"), "index": ("d: {p: 4}; d(`r): 6; d(`p) + d(`r)", "10"), "projected": ("f: function(a, b, c){ a - b - c }; g: f(10, , 3); g(2)", "5"),
        "frame": ("count(([]a: 1 2 3, b: `x`y`z))", "3"), "matrix": ("count([[1, 2], [3, 4]])", "2"), "fail": ("fail(\"missing_name\", \"missing\")", "true"), "equal": ("equal([1, 2], 1 2)", "true"), "assert": ("assert(count(nation) = 25)", "true"),
        "where_and_columns": ("fail(\"delete `n_name from nation where n_nationkey = 1\", \"not both\")", "true"), "arguments": ("fail(\"f: function(x){x}; f(1, 2)\", \"\")", "true"),
    },
)
values("control_flow_terse", {"try": ('try [a: 2 * `q;] catch [err ~ "x";]; count err', "1"), "raise": ('fail["raise 7"; "7"]', "true"), "cond": ("$[0b; 1; 1b; 2; 3]", "2"), "lambda": ("f: {[a; b] a - b}; f[9; 4]", "5"), "return": ("f: {[a] if[a > 1; :a * 2;]; 0}; f 4", "8")}, "terse")
values(
    "list_values",
    {
        "take": ("5 # [4, 6]", "'4,6,4,6,4'"), "drop": ("-1 _ [4, 6, 8]", "'4,6'"), "shape": ("2 3 reshape range(6)", "'0,1,2,3,4,5'"), "cross": ("count([1, 2, 3] cross [4, 5])", "3 * 2"), "filter": ("filter([1b, 0b, 1b])", "'0,2'"),
        "find": ("[5, 7, 9] ? 9", "2"), "deep": ("{a: {b: 6}} . `a`b", "6"), "dict": ("`a`b ! [3, 4]", "'a=3,b=4'"), "key": ("key({a: 1, b: 2})", "'a,b'"), "value": ("value({a: 1, b: 2})", "'1,2'"), "range": ("sum(range(101))", "5050"),
        "days": ("count(range(2024.02.01 2024.03.01))", "date '2024-03-01' - date '2024-02-01' + 1"), "type": ("type(1.5)", "'f64'"), "types": ("type([1, 2])", "'i64s'"), "inv": ("inv([[4.0, 0.0], [0.0, 2.0]])", "'0.250000,0.000000,0.000000,0.500000'"),
        "asc": ("asc([3, 1, 2])", "'1,2,3'"), "desc": ("desc([3, 1, 2])", "'3,2,1'"), "ss": ("ss([1, 3, 5], 3)", "1"), "ssr": ("ssr([1, 3, 5], 3)", "2"), "neg": ("neg([1, -2])", "'-1,2'"), "union": ("`a`b union `b`c", "'a,b,c'"),
        "transpose": ("transpose([[1, 2], [3, 4]])", "'1,3,2,4'"), "flatten": ("flatten([[1, 2], [3]])", "'1,2,3'"), "cols": ("cols(region)", "'r_regionkey,r_name'"), "enlist": ("count(enlist([1, 2, 3]))", "3"),
        "concat": ("[1, 2] ++ [3]", "'1,2,3'"), "at": ("[10, 20, 30] @ -1", "30"), "rotate": ("1 rotate [1, 2, 3]", "'2,3,1'"), "ne": ("[1, 2] != [1, 3]", "'false,true'"), "le": ("[1, 4] <= 3", "'true,false'"), "ge": ("[1, 4] >= 3", "'false,true'"), "match": ("[1, 2] ~ [1, 2]", "true"),
    },
)
values(
    "evaluation",
    {
        "eval": ("eval([+, 4, 5])", "9"), "evalc": ("evalc(\"2 * 21\")", "42"), "evali": ("count(evali(\"nation\", 4))", "4"), "over": ("over(function(a, b){ a + b }, 0, [1, 2, 3, 4])", "10"), "rounds": ("over(function(a){ a * 2 }, 1, 8)", "256"),
        "scan": ("scan(function(a, b){ a + b }, 0, [1, 2, 3])", "'1,3,6'"), "each": ("(function(a){ a * a }) each [1, 2, 3]", "'1,4,9'"), "parallel": ("parallel(function(a){ a + 1 }, [1, 2])", "'2,3'"), "set": ("set(`zz, 5); get(`zz)", "5"),
        "del": ("set(`zz, 5); del(`zz); fail(\"zz\", \"zz\")", "true"), "list": ("set(`zz, 5); count(list(\"zz\"))", "1"), "timeit": ("timeit(\"1 + 1\", 3) >= 0.0", "true"), "now": ("type(now())", "'timestamp'"), "today": ("today() >= 2024.01.01", "true"),
        "seed": (".os.seed(4); a: 3 ? 100; .os.seed(4); a ~ (3 ? 100)", "true"), "shuffle": ("sum(shuffle([1, 2, 3]))", "6"), "distinct_draws": ("count(unique(-5 ? 5))", "5"), "pid": (".os.pid() > 0", "true"), "syntax": (".os.syntax()", "'infix'"),
        "getenv": (".os.setenv(\"LARKSPUR_T\", \"v\"); .os.getenv(\"LARKSPUR_T\")", "'v'"), "sleep": (".os.sleep(1); 1", "1"), "mem": ("count(.os.mem()) > 0", "true"), "version": ("type(.os.version())", "'str'"), "show": ("count(show([1, 2]))", "2"), "system": ("fail(\".os.system(\\\"ls\\\")\", \"\")", "true"),
    },
)

# files and partitions


def file_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders written in each format and read again; how many rows and what total each holds."""
    e, root = engine(spark, sf_dir), scratch(spark)
    e.eval(f'o: select o_orderkey, o_custkey from orders; wcsv("{root}/o.csv", o); wjson("{root}/o.json", o); wparquet("{root}/o.parquet", o); wbin("{root}/r.bin", region); wtxt("{root}/t.txt", ["one", "two"])')
    out = [(k, *e.eval(f'select n: count(i), total: sum(o_custkey) from r{k}("{root}/o.{k}")').df.first()) for k in ("csv", "json", "parquet")]
    out.append(("bin", e.eval(f'count(rbin("{root}/r.bin"))'), 0))
    out.append(("txt", e.eval(f'count(split("w", rtxt("{root}/t.txt")))'), 0))
    there = e.eval(f'exists("{root}/t.txt")')
    e.eval(f'hdel("{root}/t.txt")')
    out.append(("exists", int(there), int(e.eval(f'exists("{root}/t.txt")'))))
    return spark.createDataFrame(out, "source string, n long, total long")


QUERIES["file_round_trips"] = file_round_trips
ORACLE_SQL["file_round_trips"] = """select k as source, count(*) as n, sum(o_custkey)::bigint as total from orders, (values ('csv'), ('json'), ('parquet')) t(k) group by 1
    union all select 'bin', count(*), 0 from region union all select 'txt', 2, 0 union all select 'exists', 1, 0"""


def partition_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events written by day, some days twice and rechunked, some overwritten; counts under conditions on the day."""
    e, root = engine(spark, sf_dir), scratch(spark)
    events = e.get_var("events").data.select("event_id", "user_id", "value", F.to_date("ts").alias("day")).cache()
    days = sorted(r.day for r in events.select("day").distinct().collect())
    for k, day in enumerate(days):
        frame = Frame(events.where(F.col("day") == day).drop("day"))
        e.write_partitioned_df_custom(frame, root, "ev", day, ["user_id"], overwrite=k % 2 == 0)
        if k % 3 == 0:
            e.write_partitioned_df(frame, root, "ev", day, ["user_id"], overwrite=True)
        if k % 3 == 1:
            e.write_partitioned_df(Frame(frame.data.where("user_id < 0")), root, "ev", day, ["user_id"], rechunk=True)
    events.unpersist()
    e.load_partitioned_df(root)
    a, b, c = days[0], days[len(days) // 2], days[-1]
    d = lambda x: x.strftime("%Y.%m.%d")
    conditions = {"one": f"date={d(b)}", "list": f"date in {d(a)} {d(c)}", "within": f"date within {d(a)} {d(b)}", "after": f"date>{d(b)}", "from": f"date>={d(b)}", "before": f"date<{d(b)}", "all": f"date>={d(a)}"}
    rows = [(k, e.eval(f"count(select from ev where {w})")) for k, w in conditions.items()]
    rows.append(("refused", int(e.eval('fail("select from ev", "")'))))
    rows.append(("tables", len([t for t in e.eval('tables("ev")') if t == "ev"])))
    return spark.createDataFrame(rows, "name string, n long")


QUERIES["partition_days"] = partition_days
ORACLE_SQL["partition_days"] = """with e as (select ts::date as d from events), o as (select d, row_number() over (order by d) as r, count(*) over () as n from (select distinct d from e)),
    k as (select min(d) as a, max(d) as c, max(d) filter (r = n // 2 + 1) as b from o)
    select 'one' as name, count(*) filter (d = b) as n from e, k union all select 'list', count(*) filter (d in (a, c)) from e, k union all select 'within', count(*) filter (d between a and b) from e, k
    union all select 'after', count(*) filter (d > b) from e, k union all select 'from', count(*) filter (d >= b) from e, k union all select 'before', count(*) filter (d < b) from e, k
    union all select 'all', count(*) from e union all select 'refused', 1 union all select 'tables', 1"""

# sessions, ticks, handles, jobs


def _rows(spark: SparkSession, found: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame([(k, shown(v)) for k, v in found.items()], "name string, value string")


def expected(name: str, fn, **sql: str) -> None:
    QUERIES[name] = fn
    ORACLE_SQL[name] = "select * from (values " + ", ".join(f"('{k}', ({v})::varchar)" for k, v in sql.items()) + ") t(name, value)"


def tick_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """insert, upsert, drain, tick counters, subscriptions and the end of a day over nation."""
    e, root = engine(spark, sf_dir), scratch(spark)
    nation, seen = e.get_var("nation"), []
    e.insert("last", "n_regionkey", nation)
    e.upsert("kept", nation)
    e.upsert("kept", nation)
    e.init_tick({"na": nation.df.limit(0)}, f"{root}/log")
    h = e.open_handle(lambda m: seen.append(m[0]))
    e.eval(f".broker.subscribe({h}, [`na])")
    sent = e.eval(".broker.publish(`upd, `na, nation)")
    listed = e.eval(".broker.list()").data.count()
    e.eod("done")
    out = {"last": e.get_var("last").data.count(), "kept": e.get_var("kept").data.count(), "drained": e.drain("kept").count(), "after": e.get_var("kept").data.count(), "messages": seen, "sent": sent, "listed": listed}
    e.publish("na", nation)
    e.eval(f".broker.unsubscribe({h}, [`na])")
    out |= {"tick": e.eval("tick(3, 5)"), "tock": e.eval("tock(3, 2)"), "count": e.get_tick_count(3), "valid": e.eval(f'.broker.validateSeq("{root}/log")'), "strict": e.eval(f'.broker.validateSeqStrict("{root}/log")'), "gone": e.eval(".broker.list()").data.count()}
    return _rows(spark, out)


expected("tick_state", tick_state, last="select count(distinct n_regionkey) from nation", kept="select 2 * count(*) from nation", drained="select 2 * count(*) from nation", after="0", messages="'upd,eod,upd'", sent="1", listed="1", tick="5", tock="2", count="2", valid="1", strict="1", gone="0")


def handle_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seen = Engine(spark), []
    e.set_on_conn_open_hook(lambda n: seen.append(("open", n)))
    e.set_on_conn_close_hook(lambda n: seen.append(("close", n)))
    n = e.open_handle(lambda m: m * 2)
    out = {"reply": e.sync(n, 21), "async": e.async_(n, 4), "exists": e.eval(f".handle.exists({n})"), "fsync": e.fsync_handle(n), "connect": e.eval(f".handle.connect({n})"), "listed": e.list_handle().data.count()}
    e.set_var("gone", lambda h: seen.append(("gone", h)))
    e.eval(f".handle.onDisconnected({n}, gone)")
    out |= {"closed": e.eval(f".handle.close({n})"), "left": e.eval(f".handle.exists({n})"), "hooks": [k for k, _ in seen], "hook": e.get_on_conn_open_hook() is not None}
    e.clear_on_conn_open_hook()
    return _rows(spark, out | {"cleared": e.get_on_conn_open_hook() is None})


expected("handle_calls", handle_calls, reply="42", **{"async": "8"}, exists="true", fsync="true", connect="true", listed="1", closed="true", left="false", hooks="'open,gone,close'", hook="true", cleared="true")


def job_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ran, start = Engine(spark), [], dt.datetime(2024, 1, 1)
    e.jobs.stop()
    e.set_var("work", lambda *a: ran.append(1))
    e.set_var("broken", lambda *a: 1 / 0)
    a = e.eval('.job.add(`work, 2024.01.01D00:00:00, 2024.01.01D00:00:03, 0D00:00:01, "beat")')
    b = e.eval('.job.addAfter(`work, 0D01:00:00, "later")')
    c = e.eval('.job.addAtTime(`broken, 2024.01.01D00:00:02, "once")')
    e.set_jobs_deactivate_on_error(True)
    for s in range(6):
        e.jobs.run_due(start + dt.timedelta(seconds=s))
    out = {"ids": [a, b, c], "ran": len(ran), "listed": e.eval(".job.list()").data.count(), "got": e.eval(f".job.get({b})").data.count(), "off": e.eval('.job.deactivate("later")'), "on": e.eval('.job.activate("later")')}
    out |= {"error": "division" in e.jobs.held[c].error, "stops": e.jobs_deactivate_on_error()}
    e.eval(".job.clear()")
    return _rows(spark, out | {"cleared": e.eval(".job.list()").data.count()})


expected("job_calls", job_calls, ids="'1,2,3'", ran="4", listed="3", got="1", off="1", on="1", error="true", stops="true", cleared="0")


def session_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, seen = engine(spark, sf_dir), []
    e.set_var("x", 4)
    e.set_post_eval_hook(lambda s, v: seen.append(v))
    e.eval("x + 1")
    out = {"has": e.has_var("x"), "get": e.get_var("x"), "hook": seen, "post": e.get_post_eval_hook() is not None}
    e.clear_post_eval_hook()
    e.del_var("x")
    e.set_var("f", lambda v: v + 1)
    n = e.set_source("here", "1 + 1")
    e.set_eval_timeout_ms(60_000)
    out |= {"gone": e.has_var("x"), "call": e.fn_call("f", 41), "source": e.get_source(n)[1], "cache": e.parse_cache_len() > 0, "lazy": e.is_lazy_mode(), "infix": e.is_infix_syntax(), "timeout": e.eval_timeout_ms(), "vars": e.stats()["vars"] > 0}
    out |= {"plan": "Scan parquet" in e.query_plan("select n_name from nation"), "shown": e.get_displayed_vars() is not None, "tables": e.table_count(), "ticks": e.set_tick_count(7, 2)}
    return _rows(spark, out)


expected("session_calls", session_calls, has="true", get="4", hook="5", post="true", gone="false", call="42", source="'1 + 1'", cache="true", lazy="true", infix="true", timeout="60000", vars="true", plan="true", shown="true", tables="0", ticks="7")
