"""Queries over the test tables, one or more for each kind of operator, with the SQL each must equal."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.engine import Engine
from larkspur.plans.frame import Frame
from larkspur.session import shared_folder
from larkspur.streaming.ticks import last_by_key, windowed_counts

#: The columns that order each table's rows, where one is unique.
ORDER = {"events": ["event_id"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"]}
TABLES = [*ORDER, "lineitem"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, syntax: str = "infix", source: str | None = None) -> Engine:
    """An engine with the tables that a source names, or all."""
    e = Engine(spark, syntax)
    for t in TABLES if source is None else [t for t in TABLES if re.search(rf"\b{t}\b", source)]:
        e.vars[t] = Frame(spark.read.parquet(f"{sf_dir}/{t}.parquet"), ORDER.get(t))
    return e


def text(name: str, source: str, sql: str | None, syntax: str = "infix") -> None:
    """A query in the language."""
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, syntax, source).eval(source).df
    if sql:
        ORACLE_SQL[name] = sql


def scratch(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


# select, by, where, limit

text(
    "pricing_summary",
    "select n: count(i), qty: sum(l_quantity) round 2, price: sum(l_extendedprice) round 2, disc: mean(l_discount) round 9 by l_returnflag, l_linestatus from lineitem where l_quantity<25",
    "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as price, round(avg(l_discount), 9) as disc from lineitem where l_quantity < 25 group by 1, 2",
)
text("terse_summary", "select n: count i, top_price: max l_extendedprice, net: (sum l_extendedprice * 1 - l_discount) round 2 by l_returnflag from lineitem where l_tax within 0.02 0.06", "select l_returnflag, count(*) as n, max(l_extendedprice) as top_price, round(sum(l_extendedprice * (1 - l_discount)), 2) as net from lineitem where l_tax between 0.02 and 0.06 group by 1", "terse")
text("terse_fold", "select k: l_linenumber - 1 + 2 * 3 from lineitem where l_quantity = max l_quantity", "select l_linenumber - (1 + 2 * 3) as k from lineitem where l_quantity = (select max(l_quantity) from lineitem)", "terse")
text("infix_fold", "select k: l_linenumber - 1 + 2 * 3 from lineitem where l_quantity = max(l_quantity)", "select (l_linenumber - 1 + 2) * 3 as k from lineitem where l_quantity = (select max(l_quantity) from lineitem)")
text("filters", "select o_orderkey, o_totalprice from orders where o_totalprice within 50000.0 100000.0, o_orderstatus in `P`F, o_orderpriority like \"^[12]\", not(o_custkey = 7)", "select o_orderkey, o_totalprice from orders where o_totalprice between 50000 and 100000 and o_orderstatus in ('P', 'F') and regexp_matches(o_orderpriority, '^[12]') and o_custkey <> 7")
text("logic", "select event_id, m: value | 50.0, n: value & 50.0 from events where (value > 90) | (value < 10) & (user_id > 3)", "select event_id, greatest(value, 50.0) as m, least(value, 50.0) as n from events where ((value > 90) or (value < 10)) and user_id > 3")
text("last_of_group", "select by user_id from events", "select user_id, event_id, ts, event_type, value, props from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
text("computed_key", "select n: count(i), total: sum(value) round 2 by day: 1D xbar ts, big: value > 50 from events", "select date_trunc('day', ts) as day, value > 50 as big, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
text("whole_table", "select n: count(i), users: uc(user_id), lo: min(value), hi: max(value), kinds: uc(event_type) from events", "select count(*) as n, count(distinct user_id)::bigint as users, min(value) as lo, max(value) as hi, count(distinct event_type)::bigint as kinds from events")
text("head", "select event_id, value from events limit 17", "select event_id, value from events order by event_id limit 17")
text("tail", "select event_id, value from events limit -17", "select event_id, value from events order by event_id desc limit 17")
text("user_function", "half: function(x){ x * 0.5 }; band: function(x, w){ w xbar half(x) }; select n: count(i) by b: band(value, 10.0) from events", "select floor(value * 0.5 / 10.0) * 10.0 as b, count(*) as n from events group by 1")
text("conditional", "select n: count(i) by size: when(l_quantity > 40, \"large\", when(l_quantity > 20, \"middle\", \"small\")) from lineitem", "select case when l_quantity > 40 then 'large' when l_quantity > 20 then 'middle' else 'small' end as size, count(*) as n from lineitem group by 1")

# update and delete

text("update_columns", "select o_orderkey, tax, net from (update tax: o_totalprice * 0.1, net: o_totalprice * 0.9 from orders where o_orderstatus = `F)", "select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 0.1 end as tax, case when o_orderstatus = 'F' then o_totalprice * 0.9 end as net from orders")
text("update_by", "select event_id, share, run from (update share: (value / sum(value)) round 6, run: csum(value) round 2 by user_id from events)", "select event_id, round(value / sum(value) over (partition by user_id), 6) as share, round(sum(value) over (partition by user_id order by event_id), 2) as run from events")
text("update_where", "select event_id, value from (update value: 0.0 from events where event_type = `error)", "select event_id, case when event_type = 'error' then 0.0 else value end as value from events")
text("delete_any", "delete from (select event_id, value, user_id from events) where value < 50, user_id > 8", "select event_id, value, user_id from events where not value < 50 and not user_id > 8")
text("delete_columns", "delete props, ts from events", "select event_id, user_id, event_type, value from events")
text("delete_all", "delete from (select o_orderkey from orders)", "select o_orderkey from orders where false")

# arithmetic, casts, parts

text("division", "select event_id, a: (user_id - 7) / (user_id - 7) , b: (user_id - 20) div 7, c: (user_id - 20) mod 7, d: (value - 60.0) div 7.0 from events", "select event_id, case when user_id = 7 then 'nan'::double else 1.0 end as a, floor((user_id - 20) / 7.0)::bigint as b, ((user_id - 20) % 7 + 7) % 7 as c, floor((value - 60.0) / 7.0) as d from events")
text("math", "select event_id, a: sqrt(value) round 6, b: ln(value + 1) round 6, c: (value log 2) round 4, d: exp(value / 100) round 6, e: abs(value - 50), f: sign(value - 50), g: ceil(value), h: floor(value), k: (value pow 2) round 4, m: clip(value, 20.0, 80.0) from events where value > 0.5", "select event_id, round(sqrt(value), 6) as a, round(ln(value + 1), 6) as b, round(ln(value) / ln(2), 4) as c, round(exp(value / 100), 6) as d, abs(value - 50) as e, sign(value - 50)::double as f, ceil(value) as g, floor(value) as h, round(value ** 2, 4) as k, greatest(least(value, 80.0), 20.0) as m from events where value > 0.5")
text("trigonometry", "select p_partkey, a: sin(p_size) round 6, b: cos(p_size) round 6, c: atan(p_size) round 6, d: tanh(p_size / 50) round 6, e: cbrt(p_size) round 6, f: log10(p_size) round 6, g: log1p(p_size) round 6, h: asinh(p_size) round 6 from part", "select p_partkey, round(sin(p_size), 6) as a, round(cos(p_size), 6) as b, round(atan(p_size), 6) as c, round(tanh(p_size / 50.0), 6) as d, round(cbrt(p_size), 6) as e, round(log10(p_size), 6) as f, round(ln(1 + p_size::double), 6) as g, round(asinh(p_size), 6) as h from part")
text("casts", "select o_orderkey, a: `i64$o_totalprice, b: `str$o_custkey, c: `date$o_orderdate from orders", "select o_orderkey, trunc(o_totalprice)::bigint as a, o_custkey::varchar as b, o_orderdate::date as c from orders")
text("parts", "select n: count(i) by y: `year$o_orderdate, q: `quarter$o_orderdate, m: `month$o_orderdate, w: `weekday$o_orderdate from orders", "select year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, month(o_orderdate)::int as m, isodow(o_orderdate)::int as w, count(*) as n from orders group by all")
text("month_bounds", "select n: count(i) by a: `month_start$o_orderdate, b: `month_end$o_orderdate from orders", "select date_trunc('month', o_orderdate)::date as a, last_day(o_orderdate) as b, count(*) as n from orders group by all")
text("bars", "select n: count(i), mean_value: mean(value) round 9 by b: 25.0 xbar value, t: 0D06:00:00 xbar ts from events", "select floor(value / 25) * 25.0 as b, time_bucket(interval 6 hours, ts) as t, count(*) as n, round(avg(value), 9) as mean_value from events group by 1, 2")
text("time_zones", "select event_id, ny: local(ts, \"America/New_York\"), back: utc(local(ts, \"America/New_York\"), \"America/New_York\") from events", None)
text("null_fill", "select event_id, v: 0.0 ^ w, missing: null(w) from (update w: value from events where event_type = `view)", "select event_id, case when event_type = 'view' then value else 0.0 end as v, event_type <> 'view' as missing from events")

# strings

text("strings", "select p_partkey, a: lowercase(p_name), b: uppercase(p_brand), c: p_type split \" \" join \"_\", d: p_size pad 3, e: concat(\"/\", p_brand, p_type), f: replace(p_type, \"[AEIOU]\", \"*\"), g: p_type match \"A\" from (update p_size: `str$p_size from part)", "select p_partkey, lower(p_name) as a, upper(p_brand) as b, replace(p_type, ' ', '_') as c, lpad(p_size::varchar, greatest(3, length(p_size::varchar))::int, ' ') as d, p_brand || '/' || p_type as e, regexp_replace(p_type, '[AEIOU]', '*') as f, length(p_type) - length(replace(p_type, 'A', '')) as g from part")
text("trimming", "select p_partkey, a: trim(s), b: trims(s), c: trime(s) from (update s: \"  \" + p_brand + \" \" from part)", "select p_partkey, p_brand as a, p_brand || ' ' as b, '  ' || p_brand as c from part")

# joins

text("left_join", "lj(`n_nationkey, (select n_nationkey: c_nationkey, c_custkey from customer), nation)", "select c_nationkey as n_nationkey, c_custkey, n_name, n_regionkey from customer left join nation on c_nationkey = n_nationkey")
text("inner_join", "ij(`o_custkey, (select o_custkey, o_orderkey, o_totalprice from orders), (select o_custkey: c_custkey, c_name from customer where c_acctbal > 0))", "select o_custkey, o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 0")
text("full_join", "fj(`k, (select k: n_nationkey + 5, a: n_name from nation), (select k: n_nationkey, b: n_name from nation))", "select coalesce(x.k, y.k) as k, a, b from (select n_nationkey + 5 as k, n_name as a from nation) x full join (select n_nationkey as k, n_name as b from nation) y on x.k = y.k")
text("right_wins", "lj(`k, (select k: n_nationkey, v: n_name from nation), (select k: n_nationkey, v: \"seen\" from nation where n_regionkey = 1))", "select n_nationkey as k, case when n_regionkey = 1 then 'seen' else n_name end as v from nation")
text("cross_join", "cj(`x, (select r_name from region), (select r_name, r_regionkey from region))", "select a.r_name, b.r_name as r_name_right, b.r_regionkey from region a, region b")
text("semi_join", "select c_custkey from semi(`c_custkey, customer, (select c_custkey: o_custkey from orders where o_totalprice > 200000))", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
text("anti_join", "select c_custkey from anti(`c_custkey, customer, (select c_custkey: o_custkey from orders))", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
text("asof_join", "aj(`user_id`ts, (select event_id, user_id, ts from events where event_type = `purchase), (select user_id, ts, seen: value from events where event_type = `view))", "select p.event_id, p.user_id, p.ts, v.value as seen from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts")
text("window_join", "w: update s: ts - 0D12:00:00, e: ts from (select event_id, user_id, ts from events where event_type = `purchase); delete s, e from wj(`user_id, `ts, `s, `e, {n: [count, `value], hi: [max, `value]}, w, (select user_id, ts, value from events))", "select p.event_id, p.user_id, p.ts, count(v.value) as n, max(v.value) as hi from events p left join events v on p.user_id = v.user_id and v.ts >= p.ts - interval 12 hours and v.ts < p.ts where p.event_type = 'purchase' group by 1, 2, 3")

# aggregates

text("moments", "select a: std0(value) round 4, b: std1(value) round 4, c: var0(value) round 3, d: var1(value) round 3, e: kurtosis(value) round 4, f: skew(value) round 4 by event_type from events", "select event_type, round(stddev_pop(value), 4) as a, round(stddev_samp(value), 4) as b, round(var_pop(value), 3) as c, round(var_samp(value), 3) as d, round(kurtosis_pop(value), 4) as e, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / stddev_pop(value) ** 3, 4) as f from events group by 1")
text("pairs", "select a: l_quantity corr l_extendedprice round 6, b: l_quantity cov0 l_extendedprice round 2, c: l_quantity cov1 l_extendedprice round 2, d: l_quantity wmean l_discount round 6, e: l_quantity wsum l_discount round 4 by l_returnflag from lineitem", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as a, round(covar_pop(l_quantity, l_extendedprice), 2) as b, round(covar_samp(l_quantity, l_extendedprice), 2) as c, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as d, round(sum(l_quantity * l_discount), 4) as e from lineitem group by 1")
text("order_statistics", "select a: median(value) round 4, b: value quantile 0.9 round 4, c: first(value), d: last(value), e: any(value > 99), f: all(value > 1) by user_id from events", "select user_id, round(median(value), 4) as a, round((list_sort(list(value))[floor((count(*) - 1) * 0.9)::int + 1] + list_sort(list(value))[ceil((count(*) - 1) * 0.9)::int + 1]) / 2, 4) as b, arg_min(value, event_id) as c, arg_max(value, event_id) as d, bool_or(value > 99) as e, bool_and(value > 1) as f from events group by 1")
text("extremes", "select a: sum each (3 top value) round 2, b: sum each (3 bottom value) round 2, c: count each unique(event_type) by user_id from events", "select user_id, round(list_sum(list_sort(list(value), 'desc')[1:3]), 2) as a, round(list_sum(list_sort(list(value))[1:3]), 2) as b, count(distinct event_type)::int as c from events group by 1")
text("mode_prod", "select m: mode(l_linenumber), p: prod(l_discount / 1000 + 1) round 6 by l_returnflag from lineitem where l_linenumber < 3", "select l_returnflag, (select l_linenumber from lineitem y where y.l_returnflag = x.l_returnflag and l_linenumber < 3 group by 1 order by count(*) desc, 1 limit 1) as m, round(product(l_discount / 1000 + 1), 6) as p from lineitem x where l_linenumber < 3 group by 1")
text("filter_by", "select event_id, user_id, value from events where value = max(value) fby user_id", "select event_id, user_id, value from events qualify value = max(value) over (partition by user_id)")

# windows

text("running", "select event_id, a, b, c, d from (update a: csum(value) round 2, b: cmax(value), c: cmin(value), d: ccount(value) by user_id from events)", "select event_id, round(sum(value) over w, 2) as a, max(value) over w as b, min(value) over w as c, count(value) over w as d from events window w as (partition by user_id order by event_id rows unbounded preceding)")
text("moving", "select event_id, a, b, c, d, e, f from (update a: (3 mmean value) round 4, b: (3 msum value) round 4, c: 3 mmax value, d: 3 mmin value, e: (3 mstd0 value) round 4, f: (3 mmedian value) round 4 by user_id from events)", "select event_id, round(avg(value) over w, 4) as a, round(sum(value) over w, 4) as b, max(value) over w as c, min(value) over w as d, round(stddev_pop(value) over w, 4) as e, round(median(value) over w, 4) as f from events window w as (partition by user_id order by event_id rows 2 preceding)")
text("neighbours", "select event_id, a, b, c, d, e from (update a: prev(value), b: next(value), c: diff(value) round 4, d: value shift 2, e: pc(value) round 4 by user_id from (select from events where value > 1))", "select event_id, lag(value) over w as a, lead(value) over w as b, round(value - lag(value) over w, 4) as c, lag(value, 2) over w as d, round((value - lag(value) over w) / lag(value) over w, 4) as e from events where value > 1 window w as (partition by user_id order by event_id)")
text("filling", "select event_id, a, b, c from (update a: fill(w), b: bfill(w), c: interp(w) round 9 by user_id from (update w: value from events where event_type = `view))", "with t as (select *, case when event_type = 'view' then value end as w, row_number() over (partition by user_id order by event_id) as k from events), u as (select *, last_value(w ignore nulls) over b as lo, last_value(case when w is not null then k end ignore nulls) over b as i, first_value(w ignore nulls) over f as hi, first_value(case when w is not null then k end ignore nulls) over f as j from t window b as (partition by user_id order by event_id rows between unbounded preceding and current row), f as (partition by user_id order by event_id rows between current row and unbounded following)) select event_id, lo as a, hi as b, round(coalesce(w, lo + (hi - lo) * (k - i) / nullif(j - i, 0)), 9) as c from u")
text("ranks", "select event_id, r from (update r: rank(value) by event_type from events)", "select event_id, row_number() over (partition by event_type order by value, event_id)::int as r from events")
text("reordered", "select event_id, a, b from (update a: reverse(value), b: 2 rotate value by user_id from events)", "with t as (select *, row_number() over (partition by user_id order by event_id) - 1 as k, count(*) over (partition by user_id) as n from events) select t.event_id, x.value as a, y.value as b from t join t x on x.user_id = t.user_id and x.k = t.n - 1 - t.k join t y on y.user_id = t.user_id and y.k = (t.k + 2) % t.n")
text("moving_quantile", "select event_id, q from (update q: mquantile(0.5, 4, value) round 4 by user_id from events)", "select event_id, round((list_sort(l)[floor((len(l) - 1) * 0.5)::int + 1] + list_sort(l)[ceil((len(l) - 1) * 0.5)::int + 1]) / 2, 4) as q from (select event_id, list(value) over (partition by user_id order by event_id rows 3 preceding) as l from events)")

# reshaping and sets

text("pivoted", "pivot(lineitem, `l_returnflag, `l_linestatus, `l_quantity, \"sum\")", "select l_returnflag, sum(l_quantity) filter (where l_linestatus = 'F') as F, sum(l_quantity) filter (where l_linestatus = 'O') as O from lineitem group by 1")
text("unpivoted", "unpivot((select p_partkey, p_brand, p_type from part), `p_partkey, `p_brand`p_type)", "select p_partkey, 'p_brand' as variable, p_brand as value from part union all select p_partkey, 'p_type', p_type from part")
text("described", "select statistic, value: value round 4 from describe((select value from events))", "select unnest(['count', 'null_count', 'mean', 'std', 'min', '10%', '25%', '50%', '75%', '90%', 'max']) as statistic, round(unnest([count(value)::double, 0.0, avg(value), stddev_samp(value), min(value), quantile_cont(value, 0.1), quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 0.9), max(value)]), 4) as value from events")
text("exploded", "explode((select p_partkey, word: p_type split \" \" from part), `word)", "select p_partkey, unnest(string_split(p_type, ' ')) as word from part")
text("stacked", "(select k: n_nationkey, v: n_name from nation) ++ (select k: r_regionkey, v: r_name from region)", "select n_nationkey as k, n_name as v from nation union all select r_regionkey, r_name from region")
text("uniques", "unique((select event_type, user_id from events))", "select distinct event_type, user_id from events")
text("sorted_top", "select o_orderkey, o_totalprice from xdesc(`o_totalprice`o_orderkey, orders) limit 25", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 25")
text("side_by_side", "hstack((select r_regionkey from region), (select r_name from region))", "select r_regionkey, r_name from region")
text("renamed", "xrename(`id`label, xreorder(`n_name, (select n_regionkey, n_name from nation)))", "select n_name as id, n_regionkey as label from nation")
text("array_sets", "select p_partkey, a: count each (x intersect y), b: count each (x differ y), c: count each (x union y) from (select p_partkey, x: p_type split \" \", y: p_name split \" \" from part)", "select p_partkey, len(list_distinct(list_intersect(x, y)))::int as a, len(list_distinct(list_filter(x, lambda v: not list_contains(y, v))))::int as b, len(list_distinct(list_concat(x, y)))::int as c from (select p_partkey, string_split(p_type, ' ') as x, string_split(p_name, ' ') as y from part)")
text("list_columns", "select p_partkey, a: x @ 0, b: x @ -1, c: max each x, d: x join \"-\" from (select p_partkey, x: p_type split \" \" from part)", "select p_partkey, x[1] as a, x[-1] as b, list_max(x) as c, array_to_string(x, '-') as d from (select p_partkey, string_split(p_type, ' ') as x from part)")
text("functional", ".fn.select(`events, 0n, [[>, `value, 50.0]], {t: `event_type}, {n: [count, `value], hi: [max, `value]}, 0n)", "select event_type as t, count(*) as n, max(value) as hi from events where value > 50 group by 1")

# a group's rows in order, a row's place in the table

text(
    "weighted_all",
    "select event_id, m from (update m: (0.5 emean value) round 4 by user_id from events)",
    """with recursive t as (select event_id, user_id, value, row_number() over (partition by user_id order by event_id) as k from events),
    r as (select event_id, user_id, k, value as num, 1.0::double as den from t where k = 1 union all select t.event_id, t.user_id, t.k, t.value + 0.5 * r.num, 1 + 0.5 * r.den from r join t on t.user_id = r.user_id and t.k = r.k + 1)
    select event_id, round(num / den, 4) as m from r""",
)
text("lists_by_group_all", "select event_type, ids: ids join \",\" from (select ids: event_id by event_type from events)", "select event_type, string_agg(event_id::varchar, ',' order by event_id) as ids from events group by 1")
text("spread_aggregate_all", "select event_id, d: (value - min(value)) round 4 from events", "select event_id, round(value - min(value) over (), 4) as d from events")
text("virtual_index_all", "select event_id, k: i from events", "select event_id, row_number() over (order by event_id)::int - 1 as k from events")


# tables on disk, streams


def partitioned_all_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders written by year, loaded again and read."""
    e, root = engine(spark, sf_dir), scratch(spark)
    orders = e.get_var("orders")
    years = sorted(r.y for r in orders.data.where("o_orderdate is not null").select(F.year("o_orderdate").alias("y")).distinct().collect())
    for y in years:
        e.write_partitioned_df(Frame(orders.data.where(F.year("o_orderdate") == y)), root, "by_year", y, ["o_custkey"])
    e.load_partitioned_df(root)
    return e.eval(f"select n: count(i), total: sum(o_totalprice) round 2 by year from by_year where year within {years[0]} {years[-1]}").df


QUERIES["partitioned_all_years"] = partitioned_all_years
ORACLE_SQL["partitioned_all_years"] = "select year(o_orderdate)::int as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1"


def stream_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream of files into a sink that keeps each user's last row."""
    path, root = f"{sf_dir}/events.parquet", scratch(spark)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path if not path.endswith("events.parquet") else f"{sf_dir}/events.parque[t]")
    query = last_by_key(stream, ["user_id"], "event_id", spark, f"{root}/out", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out/v={query.lastProgress['batchId']}")


QUERIES["stream_last_rows"] = stream_last_rows
ORACLE_SQL["stream_last_rows"] = "select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows under a watermark, run to the end of what there is."""
    root = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", "1 day", "1 hour", ["event_type"])
    sink = counts.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n").writeStream
    query = sink.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{root}/out")).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("day", "event_type").agg(F.max("n").alias("n"))


QUERIES["stream_windows"] = stream_windows
ORACLE_SQL["stream_windows"] = "select date_trunc('day', ts) as day, event_type, count(*) as n from events group by 1, 2"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions: windows that end when no event came for six hours."""
    root = scratch(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_counts(stream, "ts", "6 hours", "1 hour", ["user_id"], session=True)
    sink = counts.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("since"), "n").writeStream
    query = sink.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out")).outputMode("complete").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out")


QUERIES["stream_sessions"] = stream_sessions
ORACLE_SQL["stream_sessions"] = """with g as (select *, ts >= lag(ts) over w + interval 6 hours or lag(ts) over w is null as opens from events window w as (partition by user_id order by ts)),
    k as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as k from g)
    select user_id, min(ts) as since, count(*) as n from k group by user_id, k"""


def tick_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches logged and published; a subscriber that takes two kinds of events; then a replay of the log."""
    e, root = engine(spark, sf_dir), scratch(spark)
    events = e.get_var("events").df.select("event_id", "event_type", "value")
    e.init_tick({"ev": events.limit(0)}, f"{root}/log")
    e.subscribe("ev", lambda m: e.upsert("taken", m[2]), {"ev": ("event_type", ["view", "click"])})
    e.publish("ev", events.where("event_id % 2 = 0"))
    e.publish("ev", events.where("event_id % 2 = 1"))
    replayed = e.ticks.replay(f"{root}/log", 1, None, "ev", False)
    taken = e.get_var("taken").df.withColumn("how", F.lit("live"))
    return taken.union(replayed[0][1].df.withColumn("how", F.lit("replay")))


QUERIES["tick_subscription"] = tick_subscription
ORACLE_SQL["tick_subscription"] = "select event_id, event_type, value, 'live' as how from events where event_type in ('view', 'click') union all select event_id, event_type, value, 'replay' from events where event_id % 2 = 1"


from larkspur import families  # noqa: E402, F401  # registers more queries here
