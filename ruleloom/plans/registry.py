"""Queries over the test tables, one or more for each operator, with the SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates, library
from ..lang.parser import parse_condition, parse_program, parse_rules
from ..operators import correlation, joins, windows
from ..operators.datastream import DataStream, json_flag, json_number, json_text
from ..sources import memory, streams
from ..streaming import state, watermark
from . import backward, catalog, compiler, patterns, tms
from .forward import Forward

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3_600_000, 86_400_000


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return keep


def t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def events(s, d) -> DataStream:
    return DataStream(t(s, d, "events"))


def r(c, n: int = 4):
    return F.round(c, n)


# -- predicates --------------------------------------------------------------------------------------------------------


def predicate(name: str, table: str, text: str, columns: list[str], sql: str) -> None:
    """Rows of a table for which a condition in the rule language holds."""

    def run(s, d):
        df = t(s, d, table)
        return df.filter(compiler.condition(parse_condition(text), compiler.Scope(df.schema))).select(*columns)

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}"


predicate("pred_eq_ne", "orders", 'Order.o_orderstatus == "F" && Order.o_orderpriority != "5-LOW"', ["o_orderkey", "o_orderstatus"], "o_orderstatus IS NOT DISTINCT FROM 'F' AND o_orderpriority IS DISTINCT FROM '5-LOW'")
predicate("pred_ordering", "lineitem", "l_quantity >= 45 && l_discount < 0.03 && l_tax <= 0.05 && l_extendedprice > 1000", ["l_orderkey", "l_linenumber"], "l_quantity >= 45 AND l_discount < 0.03 AND l_tax <= 0.05 AND l_extendedprice > 1000")
predicate("pred_string_ops", "part", 'p_brand startsWith "Brand#1" || p_type endsWith "STEEL" || p_name contains "an"', ["p_partkey", "p_name"], "starts_with(p_brand, 'Brand#1') OR ends_with(p_type, 'STEEL') OR contains(p_name, 'an')")
predicate("pred_not_contains", "part", 'p_name not_contains "blue" && p_name contains "plate"', ["p_partkey", "p_name"], "NOT contains(p_name, 'blue') AND contains(p_name, 'plate')")
predicate("pred_text_arith", "orders", 'o_orderkey % 7 == 3 && o_orderstatus + "-" + o_orderpriority == "F-5-LOW"', ["o_orderkey"], "o_orderkey % 7 = 3 AND o_orderstatus || '-' || o_orderpriority = 'F-5-LOW'")
predicate("pred_in", "customer", 'c_mktsegment in ["BUILDING", "MACHINERY"]', ["c_custkey"], "c_mktsegment IN ('BUILDING', 'MACHINERY')")
predicate("pred_wildcard", "part", 'p_brand matches "Brand#?1*"', ["p_partkey", "p_brand"], "regexp_matches(p_brand, '^Brand#.1.*$')")
predicate("pred_logic", "orders", '!(o_orderstatus == "F") && (o_totalprice > 100000 || o_orderpriority == "1-URGENT") || o_custkey == 7', ["o_orderkey"], "(NOT (o_orderstatus = 'F') AND (o_totalprice > 100000 OR o_orderpriority = '1-URGENT')) OR o_custkey = 7")
predicate("pred_arith", "lineitem", "l_extendedprice * (1 - l_discount) > l_quantity * 1200 + -5 % 3", ["l_orderkey", "l_linenumber"], "l_extendedprice * (1 - l_discount) > l_quantity * 1200 + -5 % 3")
predicate("pred_test_function", "pages", 'test(isUrl(url)) && length(html) > 500 && inRange(page_id, 3, 200) == true', ["page_id"], "(starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'ftp://')) AND strlen(html) > 500 AND page_id BETWEEN 3 AND 200")


@query("""SELECT o_orderkey, v IS NULL AS is_null, v IS DISTINCT FROM 'F' AS not_f FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS v FROM orders)""")
def pred_null_total(s, d):
    df = t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("v"))
    c = lambda text: compiler.condition(parse_condition(text), compiler.Scope(df.schema))
    return df.select("o_orderkey", c("v == null").alias("is_null"), c('v != "F"').alias("not_f"))


predicate("typed_pattern", "orders", '$o : Order(o_totalprice > 200000 && o_orderstatus == "O")', ["o_orderkey"], "o_totalprice > 200000 AND o_orderstatus = 'O'")

# -- streams -----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'purchase'")
def ds_filter(s, d):
    return events(s, d).filter("value > 50").filter(F.col("event_type") == "purchase").select("event_id", "value").df


@query("SELECT event_id, value * 2 AS doubled, upper(event_type) AS kind FROM events")
def ds_map(s, d):
    return events(s, d).map(doubled=F.col("value") * 2, kind=F.upper("event_type")).select("event_id", "doubled", "kind").df


@query("SELECT event_id, unnest([event_type, CAST(user_id AS VARCHAR)]) AS part FROM events")
def ds_flat_map(s, d):
    return events(s, d).flat_map(F.array("event_type", F.col("user_id").cast("string")), "part").select("event_id", "part").df


@query("SELECT event_id FROM events WHERE event_type = 'click' UNION ALL SELECT event_id FROM events WHERE value > 90")
def ds_union(s, d):
    e = events(s, d)
    return e.filter("event_type = 'click'").union(e.filter("value > 90")).select("event_id").df


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 25")
def ds_take(s, d):
    return events(s, d).take(25).select("event_id", "user_id").df


@query("SELECT event_id FROM events ORDER BY event_id OFFSET 100")
def ds_skip(s, d):
    return events(s, d).skip(100).select("event_id").df


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def ds_sort_topk(s, d):
    return events(s, d).sort_by(F.desc("value")).df.limit(10).select("event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 1")
def ds_find(s, d):
    return events(s, d).find("event_type = 'error'").select("event_id", "user_id")


@query("SELECT bool_or(value > 99) AS has_any, bool_and(value >= 0) AS has_all, coalesce(bool_and(value < 0) FILTER (event_type = 'nothing'), true) AS none FROM events")
def ds_any_all(s, d):
    e = events(s, d)
    return e.any("value > 99").select(F.col("value").alias("has_any")).crossJoin(e.all("value >= 0").select(F.col("value").alias("has_all"))).crossJoin(e.filter("event_type = 'nothing'").all("value < 0").select(F.col("value").alias("none")))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 3")
def event_pattern(s, d):
    return events(s, d).matches("view", user_id=3).select("event_id").df


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events")
def json_numeric_field(s, d):
    return t(s, d, "events").select("event_id", json_number(F.col("props"), "k").alias("k"))


# -- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS count FROM events GROUP BY user_id")
def key_by_count(s, d):
    return events(s, d).key_by("user_id").count()


@query("SELECT event_type, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def key_by_aggregate(s, d):
    a, v = aggregates.STREAM, F.col("value")
    return events(s, d).key_by("event_type").aggregate(n=a["count"](v), total=r(a["sum"](v)), mean=r(a["average"](v)), low=a["min"](v), high=a["max"](v))


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY user_id")
def group_first_last(s, d):
    k = events(s, d).key_by("user_id")
    return k.first("event_id").withColumnRenamed("event_id", "first_id").join(k.last("event_id").withColumnRenamed("event_id", "last_id"), "user_id")


@query("SELECT user_id, round(sum(value), 4) AS value FROM events GROUP BY user_id")
def key_reduce(s, d):
    return events(s, d).key_by("user_id").reduce(lambda a, b: a + b, F.lit(0.0), F.col("value"), commutes=True).withColumn("value", r("value"))


@query("SELECT CAST(count(*) AS DOUBLE) AS n, round(sum(value), 3) AS total, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high FROM events")
def agg_global(s, d):
    a, v = aggregates.STREAM, F.col("value")
    return events(s, d).aggregate(n=a["count"](v), total=r(a["sum"](v), 3), mean=r(a["average"](v)), low=a["min"](v), high=a["max"](v))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_count_distinct(s, d):
    return events(s, d).key_by("event_type").aggregate(users=aggregates.WINDOW["count_distinct"](F.col("user_id")))


@query("SELECT user_id, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 4) AS sd FROM events GROUP BY user_id")
def agg_stddev_pop(s, d):
    return events(s, d).key_by("user_id").aggregate(sd=r(aggregates.std_dev(F.col("value"))))


@query("SELECT user_id, list_sort(list(value))[CAST(round(0.9 * (count(value) - 1)) AS INTEGER) + 1] AS p90 FROM events GROUP BY user_id")
def agg_percentile_nearest(s, d):
    return events(s, d).key_by("user_id").percentile("value", 90, "p90")


@query(f"SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, list_sort(list(value))[CAST(round(0.5 * (count(value) - 1)) AS INTEGER) + 1] AS median FROM events GROUP BY 1")
def win_percentile(s, d):
    return events(s, d).tumbling(DAY).aggregate(median=aggregates.percentile(F.col("value"), 50)).drop("window_end")


@query("SELECT user_id, string_agg(event_type[1], '' ORDER BY event_id) AS value FROM events GROUP BY 1")
def key_fold_in_order(s, d):
    return events(s, d).key_by("user_id").reduce(lambda a, b: F.concat(a, b), F.lit(""), F.left("event_type", F.lit(1)))


@query("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def agg_count_by(s, d):
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return events(s, d).key_by("user_id").count_by("event_type").select("user_id", F.array_join(pairs, ",").alias("counts"))


@query("SELECT event_type, arg_min(event_id, event_id) AS first_id, arg_max(event_id, event_id) AS last_id FROM events GROUP BY event_type")
def agg_first_last(s, d):
    a, e = aggregates.WINDOW, F.col("event_id")
    return events(s, d).key_by("event_type").aggregate(first_id=a["first"](e, e), last_id=a["last"](e, e))


# -- rules: shared text ------------------------------------------------------------------------------------------------

BIG = """
rule "BigSpender" salience 10 no-loop {
    when Order.o_totalprice > 300000 && Customer.c_mktsegment == "BUILDING"
    then Order.tier = "gold";
}"""


def customer_orders(s, d) -> DataFrame:
    o, c = t(s, d, "orders"), t(s, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


@query("""SELECT CASE WHEN o_totalprice > 300000 AND c_mktsegment = 'BUILDING' THEN 'gold' END AS tier, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def fwd_big_spender(s, d):
    out = Forward(parse_rules(BIG), roots=("Order", "Customer")).run(customer_orders(s, d))
    return out.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


def accumulated(function: str, sql: str) -> None:
    text = f"""rule "A" no-loop {{ when accumulate(LineItem($v: l_extendedprice, l_quantity > 20), {function}($v)) then Order.result = LineItem_{function}; }}"""

    def run(s, d):
        li = t(s, d, "lineitem")
        out = Forward(parse_rules(text), roots=("Order",), facts={"LineItem": (li, {"l_orderkey": "o_orderkey"})}).run(t(s, d, "orders"))
        return out.select("o_orderkey", F.floor(F.col("result") * 10 + 0.5 + 1e-4).alias("result"))

    QUERIES[f"accumulate_{function}"] = run
    SQL[f"accumulate_{function}"] = f"SELECT o_orderkey, CAST(floor(coalesce({sql}, 0) * 10 + 0.5 + 1e-4) AS BIGINT) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 20 GROUP BY o_orderkey"


for _f, _q in (("sum", "sum(l_extendedprice)"), ("average", "avg(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("count", "count(l_extendedprice)")):
    accumulated(_f, _q)


@query("SELECT n_nationkey, 0.0 AS result FROM nation")
def accumulate_empty_zero(s, d):
    text = 'rule "A" no-loop { when accumulate(LineItem($v: l_tax, l_quantity > 1000), avg($v)) then Nation.result = LineItem_avg; }'
    return Forward(parse_rules(text), roots=("Nation",), facts={"LineItem": t(s, d, "lineitem")}).run(t(s, d, "nation")).select("n_nationkey", "result")


# -- windows -----------------------------------------------------------------------------------------------------------

V = "round(sum(value), 4) AS total, count(*) AS n"


def _agg(w):
    return w.aggregate(total=r(F.sum("value")), n=F.count(F.lit(1))).drop("window_end")


@query(f"SELECT ((epoch_us(ts) // 1000) // {HOUR}) * {HOUR} AS window_start, {V} FROM events GROUP BY 1")
def win_tumbling(s, d):
    return _agg(events(s, d).tumbling(HOUR))


ANCHORED = """WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms, min((epoch_us(ts) // 1000)) OVER ({by}) AS a FROM events),
x AS (SELECT *, unnest([(ms - a) // {slide} - 1, (ms - a) // {slide}]) AS k FROM e)
SELECT {keys} a + k * {slide} AS window_start, round(sum(value), 4) AS total, count(*) AS n FROM x WHERE k >= 0 GROUP BY ALL"""


@query(ANCHORED.format(by="", slide=3 * HOUR, keys=""))
def win_sliding_anchored(s, d):
    return _agg(events(s, d).sliding(6 * HOUR))


@query(ANCHORED.format(by="PARTITION BY user_id", slide=12 * HOUR, keys="user_id,"))
def win_sliding_keyed(s, d):
    return _agg(events(s, d).sliding(24 * HOUR, "user_id"))


@query(f"""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
g AS (SELECT user_id, ms, sum(CASE WHEN p IS NULL OR ms - p > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS g FROM e)
SELECT user_id, min(ms) AS session_start, max(ms) + {6 * HOUR} AS session_end, count(*) AS count FROM g GROUP BY user_id, g""")
def win_session(s, d):
    return events(s, d).session(6 * HOUR, "user_id")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS trailing FROM events")
def win_trailing_count(s, d):
    return windows.trailing_count(t(s, d, "events"), "ts", DAY, ["user_id"]).select("event_id", "trailing")


@query(f"SELECT event_type, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} + {DAY} AS window_end, count(*) AS count FROM events GROUP BY ALL")
def win_counts(s, d):
    return events(s, d).tumbling(DAY, "event_type").counts()


@query(f"SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, max(value) AS value FROM events GROUP BY 1")
def win_reduce(s, d):
    return events(s, d).tumbling(DAY).reduce(lambda a, b: F.greatest(a, b), F.lit(-1e300), F.col("value"), commutes=True)


@query(f"""SELECT window_start, sum(event_id)::BIGINT AS ids, count(*) AS n FROM (SELECT event_id, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start,
row_number() OVER (PARTITION BY (epoch_us(ts) // 1000) // {DAY} ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1""")
def win_max_events(s, d):
    return events(s, d).tumbling(DAY).with_max_events(5).aggregate(ids=F.sum("event_id"), n=F.count(F.lit(1))).drop("window_end")


@query(f"SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) BETWEEN (epoch_us(TIMESTAMP '2024-01-20') // 1000) - {DAY} AND (epoch_us(TIMESTAMP '2024-01-20') // 1000)")
def win_recent(s, d):
    return windows.recent(t(s, d, "events"), "ts", DAY, F.lit("2024-01-20").cast("timestamp")).select("event_id")


#: Events of a user come in order of time, so a window opens at the first event that the last one does not reach.
FIRST_FIT = f"""WITH RECURSIVE e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms FROM events),
w AS (SELECT user_id, min(ms) AS window_start FROM e GROUP BY 1 UNION ALL
SELECT user_id, nxt FROM (SELECT w.user_id, (SELECT min(ms) FROM e WHERE e.user_id = w.user_id AND ms >= w.window_start + {DAY}) AS nxt FROM w) WHERE nxt IS NOT NULL),
f AS (SELECT w.user_id, window_start, window_start + {DAY} AS window_end, count(*) AS count FROM w JOIN e ON e.user_id = w.user_id AND ms >= window_start AND ms < window_start + {DAY} GROUP BY ALL) """


@query(FIRST_FIT + "SELECT * FROM f")
def win_first_fit(s, d):
    return windows.first_fit(t(s, d, "events"), "ts", DAY, "user_id", "event_id")


@query(f"""WITH w AS (SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, sum(value) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT window_start, round(sum(s) OVER x / sum(n) OVER x, 4) AS moving_average FROM w WINDOW x AS (ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def ana_moving_average(s, d):
    return windows.moving_average(events(s, d).tumbling(DAY).df, "value", 3).withColumn("moving_average", r("moving_average"))


@query(f"""WITH e AS (SELECT *, (epoch_us(ts) // 1000) // {DAY} AS w, max((epoch_us(ts) // 1000) // {DAY}) OVER () AS last FROM events),
b AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM e WHERE w < last)
SELECT event_id, round((value - m) / sd, 4) AS z FROM e, b WHERE w = last AND abs(value - m) / sd > 1.2""")
def ana_anomalies(s, d):
    return windows.anomalies(events(s, d).tumbling(DAY).df, "value", 1.2).select("event_id", r("z").alias("z"))


@query(f"""WITH w AS (SELECT (epoch_us(ts) // 1000) // {DAY} AS k, avg(value) AS a FROM events GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM w),
h AS (SELECT avg(a) FILTER (i <= n // 2) AS x, avg(a) FILTER (i > n // 2) AS y FROM n)
SELECT CASE WHEN (y - x) / x > 0.05 THEN 'Increasing' WHEN (y - x) / x < -0.05 THEN 'Decreasing' ELSE 'Stable' END AS trend FROM h""")
def ana_trend(s, d):
    return windows.trend(events(s, d).tumbling(DAY).df, "value")


@query(f"""SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS "WindowStartTime", ((epoch_us(ts) // 1000) // {DAY}) * {DAY} + {DAY} AS "WindowEndTime", {DAY}::BIGINT AS "WindowDurationMs", count(*) AS "WindowEventCount",
round(sum(value), 4) AS "valueSum", round(avg(value), 4) AS "valueAverage", min(value) AS "valueMin", max(value) AS "valueMax" FROM events GROUP BY ALL""")
def ana_window_facts(s, d):
    out = events(s, d).tumbling(DAY).facts("value")
    return out.withColumns({"valueSum": r("valueSum"), "valueAverage": r("valueAverage"), "WindowDurationMs": F.col("WindowDurationMs").cast("long")})


# -- joins -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS okey, c_custkey AS ckey, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey
WHERE o_totalprice > 250000""")
def join_multi_pattern(s, d):
    P = joins.Pattern
    return joins.match_all(
        P(t(s, d, "customer")).bind(ckey="c_custkey", nk="c_nationkey"), P(t(s, d, "nation")).bind(nk="n_nationkey", nation="n_name"), P(t(s, d, "orders")).where_field("o_totalprice > 250000").bind(ckey="o_custkey", okey="o_orderkey"),
    ).select("okey", "ckey", "nation")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_nationkey = a.s_nationkey AND b.s_acctbal > a.s_acctbal")
def join_theta(s, d):
    P, x = joins.Pattern, t(s, d, "supplier")
    return joins.match_all(P(x).bind(a="s_suppkey", nk="s_nationkey", bal="s_acctbal"), P(x).bind(b="s_suppkey", nk="s_nationkey").where_var("s_acctbal", ">", "bal")).select("a", "b")


@query("SELECT n_nationkey AS n, r_regionkey AS r FROM nation CROSS JOIN region")
def join_cross_beta(s, d):
    return joins.match_all(joins.Pattern(t(s, d, "nation")).bind(n="n_nationkey"), joins.Pattern(t(s, d, "region")).bind(r="r_regionkey"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_exists(s, d):
    c, o = t(s, d, "customer"), t(s, d, "orders").filter("o_totalprice > 250000")
    return joins.exists(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_not_exists(s, d):
    c, o = t(s, d, "customer"), t(s, d, "orders")
    return joins.not_exists(c, o, c.c_custkey == o.o_custkey).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10))")
def join_forall(s, d):
    o, li = t(s, d, "orders"), t(s, d, "lineitem")
    return joins.forall(o, li, o.o_orderkey == li.l_orderkey, li.l_quantity > 10).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN bool_or(l_returnflag = 'R') AND bool_and(l_quantity > 5) THEN 'check' END AS flag
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def fwd_quantifiers(s, d):
    text = 'rule "Q" no-loop { when exists(LineItem.l_returnflag == "R") && forall(LineItem.l_quantity > 5) then Order.flag = "check"; }'
    return Forward(parse_rules(text), roots=("Order",), facts={"LineItem": (t(s, d, "lineitem"), {"l_orderkey": "o_orderkey"})}).run(t(s, d, "orders")).select("o_orderkey", "flag")


def _sides(s, d):
    e = t(s, d, "events").select("event_id", "ts", "user_id", "event_type")
    return e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")


def interval(name: str, how: str, sql: str, order: str = "within") -> None:
    def run(s, d):
        a, b = _sides(s, d)
        return joins.interval_join(a, b, ["user_id"], "ts", 6 * HOUR, how, order=order).select("l_event_id", "r_event_id")

    QUERIES[name] = run
    on = {"within": f"abs((epoch_us(l.ts) // 1000) - (epoch_us(r.ts) // 1000)) <= {6 * HOUR}", "before": f"r.ts > l.ts AND (epoch_us(r.ts) // 1000) - (epoch_us(l.ts) // 1000) <= {6 * HOUR}"}[order]
    SQL[name] = f"""WITH l AS (SELECT * FROM events WHERE event_type = 'view'), r AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM l {sql} JOIN r ON l.user_id = r.user_id AND {on}"""


interval("sjoin_interval_inner", "inner", "")
interval("sjoin_left", "left_outer", "LEFT")
interval("sjoin_right", "right_outer", "RIGHT")
interval("sjoin_full", "full_outer", "FULL")
interval("sjoin_before", "inner", "", "before")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events)
SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM x l JOIN x r USING (user_id) WHERE l.event_type = 'view' AND r.event_type = 'purchase' AND l.k <= 3 AND r.k <= 3""")
def sjoin_count_window(s, d):
    a, b = _sides(s, d)
    return joins.count_window_join(a, b, ["user_id"], 3, "event_id").select("l_event_id", "r_event_id")


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id, c.event_id AS c_id FROM events a JOIN events b USING (user_id) JOIN events c USING (user_id)
WHERE a.event_type = 'view' AND b.event_type = 'click' AND c.event_type = 'purchase' AND abs((epoch_us(a.ts) // 1000) - (epoch_us(b.ts) // 1000)) <= {12 * HOUR} AND abs((epoch_us(a.ts) // 1000) - (epoch_us(c.ts) // 1000)) <= {12 * HOUR}""")
def sjoin_three_way(s, d):
    e = t(s, d, "events")
    of = lambda k: e.filter(F.col("event_type") == k)
    out = joins.chain({"a": of("view"), "b": of("click"), "c": of("purchase")}, ["user_id"], "ts", 12 * HOUR)
    return out.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), F.col("c_event_id").alias("c_id"))


# -- watermarks --------------------------------------------------------------------------------------------------------

#: Arrival order is scrambled a little, or nothing would be late.
ARRIVAL = "CAST(event_id // 50 * 50 + (event_id * 17) % 50 AS BIGINT)"
LATE = f"""WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms, {ARRIVAL} AS arrival FROM events),
w AS (SELECT *, max(ms) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR} AS wm FROM e),
f AS (SELECT *, coalesce(ms < wm, false) AS is_late FROM w) """


def _late(s, d):
    e = t(s, d, "events").withColumn("arrival", F.expr("event_id div 50 * 50 + (event_id * 17) % 50"))
    return watermark.flagged(e, "ts", HOUR, "arrival", bucket=1000)


@query(LATE + "SELECT event_id, wm AS watermark_ms, is_late FROM f")
def wm_late_flags(s, d):
    return _late(s, d).select("event_id", "watermark_ms", "is_late")


@query(LATE + "SELECT event_id FROM f WHERE NOT is_late")
def wm_drop(s, d):
    return watermark.on_time(_late(s, d)).select("event_id")


@query(LATE + f"SELECT event_id FROM f WHERE NOT is_late OR wm - ms <= {2 * HOUR}")
def wm_allowed_lateness(s, d):
    return watermark.allowed(_late(s, d), "ts", 2 * HOUR).select("event_id")


@query(LATE + "SELECT event_id FROM f WHERE is_late")
def wm_side_output(s, d):
    return watermark.side_output(_late(s, d))[1].select("event_id")


@query(LATE + f"SELECT count(*) FILTER (is_late) AS total_late, count(*) FILTER (is_late AND wm - ms > {2 * HOUR}) AS dropped, count(*) FILTER (is_late AND wm - ms <= {2 * HOUR}) AS allowed FROM f")
def wm_late_stats(s, d):
    return watermark.late_stats(_late(s, d), "ts", 2 * HOUR)


# -- forward chaining --------------------------------------------------------------------------------------------------

CHAIN = """
rule "Base" salience 30 no-loop { when o_totalprice > 0 then score = 1; }
rule "Large" salience 20 no-loop { when o_totalprice > 150000 && score == 1 then score = score + 2; class = "large"; }
rule "Urgent" salience 10 no-loop { when o_orderpriority == "1-URGENT" && class == "large" then score = score * 10; $Order.setrush(true); }
"""


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 150000 AND o_orderpriority = '1-URGENT' THEN 30 WHEN o_totalprice > 150000 THEN 3 ELSE 1 END AS score,
CASE WHEN o_totalprice > 150000 AND o_orderpriority = '1-URGENT' THEN true END AS rush FROM orders""")
def fwd_salience_chain(s, d):
    return Forward(parse_rules(CHAIN), roots=("Order",)).run(t(s, d, "orders").withColumn("score", F.lit(0))).select("o_orderkey", "score", "rush")


@query("""WITH RECURSIVE x AS (SELECT c_custkey, 0 AS level, c_acctbal AS left_ FROM customer UNION ALL SELECT c_custkey, level + 1, left_ - 1000 FROM x WHERE left_ > 1000 AND level < 6)
SELECT c_custkey, max(level) AS level FROM x GROUP BY 1""")
def fwd_cycles_fixpoint(s, d):
    text = 'rule "Step" { when rest > 1000 && level < 6 then rest = rest - 1000; level = level + 1; }'
    df = t(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("rest"), F.lit(0).alias("level"))
    return Forward(parse_rules(text)).run(df).select("c_custkey", "level")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS n FROM customer")
def fwd_no_loop(s, d):
    text = 'rule "Once" no-loop { when c_acctbal > 0 then n = n + 1; }'
    return Forward(parse_rules(text)).run(t(s, d, "customer").withColumn("n", F.lit(0))).select("c_custkey", "n")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'A' WHEN o_totalprice > 100000 THEN 'B' ELSE 'C' END AS grade FROM orders")
def fwd_activation_group(s, d):
    text = """rule "A" salience 3 no-loop activation-group "g" { when o_totalprice > 200000 then grade = "A"; }
    rule "B" salience 2 no-loop activation-group "g" { when o_totalprice > 100000 then grade = "B"; }
    rule "C" salience 1 no-loop activation-group "g" { when o_totalprice > 0 then grade = "C"; }"""
    return Forward(parse_rules(text)).run(t(s, d, "orders"), max_cycles=1).select("o_orderkey", "grade")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'checked' END AS state, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'audited' END AS audit FROM orders")
def fwd_agenda_groups(s, d):
    text = """rule "Open" no-loop { when o_orderstatus == "O" then state = "checked"; ActivateAgendaGroup("audit"); }
    rule "Audit" no-loop agenda-group "audit" { when o_totalprice > 100000 then audit = "audited"; }"""
    return Forward(parse_rules(text)).run(t(s, d, "orders").withColumn("audit", F.lit(None).cast("string"))).select("o_orderkey", "state", "audit")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'now' END AS sale FROM orders")
def fwd_date_window(s, d):
    text = """rule "Now" no-loop date-effective "2024-01-01" date-expires "2024-02-01" { when o_totalprice > 1000 then sale = "now"; }
    rule "Past" no-loop date-expires "2023-01-01" { when o_totalprice > 0 then sale = "past"; }"""
    return Forward(parse_rules(text)).run(t(s, d, "orders"), as_of=dt.datetime(2024, 1, 15)).select("o_orderkey", "sale")


@query("SELECT o_orderkey, o_orderstatus = 'F' AS gone, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 0 THEN 'kept' END AS mark FROM orders")
def fwd_retract(s, d):
    text = """rule "Drop" salience 5 no-loop { when Order.o_orderstatus == "F" then retract($Order); }
    rule "Keep" no-loop { when Order.o_totalprice > 0 then Order.mark = "kept"; }"""
    out = Forward(parse_rules(text), roots=("Order",)).run(t(s, d, "orders"), audit=True)
    return out.select("o_orderkey", F.col("retracted_Order").alias("gone"), "mark")


@query("SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice > 100000 THEN 'big' END, CASE WHEN o_orderstatus = 'O' THEN 'open' END) AS tags FROM orders")
def fwd_append(s, d):
    text = 'rule "B" salience 2 no-loop { when o_totalprice > 100000 then tags += "big"; } rule "O" no-loop { when o_orderstatus == "O" then tags += "open"; }'
    df = t(s, d, "orders").withColumn("tags", F.array().cast("array<string>"))
    return Forward(parse_rules(text)).run(df).select("o_orderkey", F.array_join("tags", ",").alias("tags"))


@query("""SELECT 'Base' AS rule, count(*) AS fires, count(*) AS records FROM orders UNION ALL SELECT 'Large', count(*), count(*) FROM orders WHERE o_totalprice > 150000
UNION ALL SELECT 'Urgent', count(*), count(*) FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT'""")
def fwd_audit_counts(s, d):
    return catalog.rule_metrics(Forward(parse_rules(CHAIN), roots=("Order",)).run(t(s, d, "orders").withColumn("score", F.lit(0)), audit=True))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' END AS band FROM orders")
def fwd_template_rules(s, d):
    tpl = catalog.RuleTemplate('rule "T{{n}}" salience {{n}} no-loop { when o_totalprice > {{limit}} then band = "{{band}}"; }')
    rules = tpl.bulk([{"n": 2, "limit": 50000, "band": "mid"}, {"n": 1, "limit": 200000, "band": "high"}])
    return Forward(rules).run(t(s, d, "orders")).select("o_orderkey", "band")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'ok' END AS valid, CASE WHEN o_totalprice > 1000 AND o_orderstatus = 'O' THEN 'ship' END AS step FROM orders")
def fwd_workflow_steps(s, d):
    text = """rule "V" no-loop agenda-group "validate" { when o_totalprice > 1000 then valid = "ok"; }
    rule "S" no-loop agenda-group "ship" { when valid == "ok" && o_orderstatus == "O" then step = "ship"; }"""
    return catalog.run_workflow(Forward(parse_rules(text)), t(s, d, "orders"), ["validate", "ship", "none"])[0].select("o_orderkey", "valid", "step")


@query("SELECT o_orderkey, lower(o_orderpriority) AS p, o_totalprice * 2 AS twice, o_orderstatus = 'F' AS done FROM orders WHERE true")
def fwd_actions(s, d):
    text = """rule "X" no-loop { when o_orderkey >= 0 then ToLowerCase(o_orderpriority, p); Multiply(o_totalprice, 2, twice); set(done, false); }
    rule "Y" salience -1 no-loop { when o_orderstatus == "F" then Mark(done, true); }"""

    def mark(df, fired, args, paths):
        return df.withColumn(paths[0], F.when(F.col(fired), args[1]).otherwise(F.col(paths[0])))

    return Forward(parse_rules(text), handlers={"Mark": mark}).run(t(s, d, "orders")).select("o_orderkey", "p", "twice", "done")


_MANY = "\n".join(f'rule "R{i}" salience {100 - i} no-loop {{ when o_totalprice > {i * 3000} && o_custkey % {i % 7 + 2} == 0 then f{i} = {i}; }}' for i in range(100))


@query("SELECT " + " + ".join(f"CASE WHEN o_totalprice > {i * 3000} AND o_custkey % {i % 7 + 2} = 0 THEN {i} ELSE 0 END" for i in range(100)) + " AS total, count(*) AS n FROM orders GROUP BY 1")
def fwd_100_rules(s, d):
    out = Forward(parse_rules(_MANY)).run(t(s, d, "orders"))
    total = F.lit(0)
    for i in range(100):
        total = total + F.coalesce(F.col(f"f{i}"), F.lit(0))
    return out.select(total.alias("total")).groupBy("total").agg(F.count(F.lit(1)).alias("n"))


# -- multifields -------------------------------------------------------------------------------------------------------


def _lists(s, d):
    return t(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))


@query("""WITH l AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT o_custkey, CAST(len(k) AS INTEGER) AS n, k[1] AS first, k[-1] AS last, k[2] AS second, list_contains(k, 7) AS has7, array_to_string(k[2:3], ',') AS part, len(k) = 0 AS empty FROM l""")
def mf_values(s, d):
    k, c = F.col("keys"), compiler
    e = c.condition(parse_condition("keys empty"), c.Scope(_lists(s, d).schema))
    return _lists(s, d).select("o_custkey", c.mf_count(k).alias("n"), c.mf_first(k).alias("first"), c.mf_last(k).alias("last"), c.mf_index(k, 1).alias("second"), c.mf_contains(k, 7).alias("has7"), F.array_join(c.mf_slice(k, 1, 3), ",").alias("part"), e.alias("empty"))


@query("SELECT o_custkey FROM (SELECT o_custkey, list(o_orderkey) AS k FROM orders GROUP BY 1) WHERE len(k) = 12 OR list_contains(k, 33)")
def mf_conditions(s, d):
    df = _lists(s, d)
    return df.filter(compiler.condition(parse_condition("C.keys count == 12 || keys contains 33 && keys not_empty && keys $?all"), compiler.Scope(df.schema))).select("o_custkey")


# -- functions ---------------------------------------------------------------------------------------------------------

FN = library.FUNCTIONS


@query("""SELECT c_custkey, c_name || '/' || c_custkey AS a, repeat('ab', 3) AS b, substring(c_name, 3, 4) AS c, upper(c_mktsegment) AS d, lower(c_mktsegment) AS e, CAST(strlen(c_name) AS INTEGER) AS f,
contains(c_name, '1') AS g, trim('  x ') AS h, replace(c_name, '0', 'o') AS i, reverse(c_name) AS j, left(c_name, 1) AS k FROM customer""")
def fn_string(s, d):
    n, L, A = F.col("c_name"), F.lit, library.ACTIONS
    return t(s, d, "customer").select(
        "c_custkey", FN["concat"](n, L("/"), F.col("c_custkey")).alias("a"), FN["repeat"](L("ab"), L(3)).alias("b"), FN["substring"](n, L(2), L(4)).alias("c"), A["ToUpperCase"]("c_mktsegment").alias("d"), A["ToLowerCase"]("c_mktsegment").alias("e"),
        A["StringLength"](n).alias("f"), A["StringContains"](n, L("1")).alias("g"), A["StringTrim"](L("  x ")).alias("h"), A["StringReplace"](n, L("0"), L("o")).alias("i"), FN["reverse"](n).alias("j"), FN["first"](n).alias("k"),
    )


@query("""SELECT c_custkey, least(c_acctbal, 100.0) AS a, greatest(c_acctbal, 100.0) AS b, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS c, round(c_acctbal + c_custkey, 4) AS d, round((c_acctbal + c_custkey) / 2, 4) AS e,
abs(c_acctbal) AS f, round(c_acctbal) AS g, round(c_acctbal / nullif(c_custkey - 5, 0), 6) AS h, CAST(floor(c_acctbal) AS BIGINT) AS i, CAST(ceil(c_acctbal) AS BIGINT) AS j FROM customer""")
def fn_math(s, d):
    x, k, A = F.col("c_acctbal"), F.col("c_custkey"), library.ACTIONS
    return t(s, d, "customer").select(
        "c_custkey", FN["min"](x, F.lit(100)).alias("a"), FN["max"](x, F.lit(100)).alias("b"), r(FN["sqrt"](x), 6).alias("c"), r(FN["sum"](x, k)).alias("d"), r(FN["avg"](x, k)).alias("e"), A["Abs"](x).alias("f"), A["Round"](x).alias("g"),
        r(A["Divide"](x, k - 5), 6).alias("h"), FN["floor"](x).alias("i"), FN["ceil"](x).alias("j"),
    )


@query("""SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS dow, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd,
strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later, isodow(o_orderdate) >= 6 AS weekend, strftime(o_orderdate, '%d.%m.%Y') AS f FROM orders""")
def fn_date(s, d):
    o, A = F.date_format("o_orderdate", "yyyy-MM-dd"), library.ACTIONS
    return t(s, d, "orders").select("o_orderkey", FN["dayOfWeek"](o).alias("dow"), FN["year"](o).alias("y"), FN["month"](o).alias("m"), FN["day"](o).alias("dd"), A["AddDays"](o, F.lit(10)).alias("later"), A["IsWeekend"](o).alias("weekend"), library.format_date(o, "%d.%m.%Y").alias("f"))


@query("""WITH l AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT o_custkey, CAST(len(k) AS INTEGER) AS n, array_to_string(list_append(k, 0), ',') AS pushed, array_to_string(k[1:len(k)-1], ',') AS popped, array_to_string(list_reverse_sort(k), ',') AS down, array_to_string(k[2:], ',') AS sliced,
array_to_string(list_filter(k, lambda x: x = 7), ',') AS found, k[1] AS first FROM l""")
def fn_collection(s, d):
    k, A, j = F.col("keys"), library.ACTIONS, lambda c: F.array_join(c, ",")
    return _lists(s, d).select("o_custkey", A["ArrayLength"](k).alias("n"), j(A["ArrayPush"](k, F.lit(0))).alias("pushed"), j(A["ArrayPop"](k)).alias("popped"), j(A["ArraySort"](k, False)).alias("down"), j(FN["slice"](k, F.lit(1))).alias("sliced"), j(library.array_filter(k, "_value", F.lit(7))).alias("found"), F.try_element_at(k, F.lit(1)).alias("first"))


@query(r"""SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'ftp://') AS u, regexp_full_match('a' || page_id || '@x.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS e,
length(regexp_replace(url, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 AS p, page_id BETWEEN 3 AND 9 AS r, regexp_full_match(right(url, 2), '[0-9]+') AS n, trim(url) = '' AS empty FROM pages""")
def fn_validation(s, d):
    k, u = F.col("page_id"), F.col("url")
    return t(s, d, "pages").select("page_id", FN["isUrl"](u).alias("u"), FN["isEmail"](F.concat(F.lit("a"), k, F.lit("@x.org"))).alias("e"), FN["isPhone"](u).alias("p"), FN["inRange"](k, F.lit(3), F.lit(9)).alias("r"), FN["isNumeric"](F.right(u, F.lit(2))).alias("n"), FN["isEmpty"](u).alias("empty"))


# -- goals -------------------------------------------------------------------------------------------------------------

GOALS = """
rule "Vip" { when Customer.c_acctbal > 5000 then Customer.vip = true; }
rule "Offer" { when Customer.vip == true && Customer.c_mktsegment == "BUILDING" then Customer.offer = "yes"; }
rule "Other" { when Customer.c_acctbal < 0 then Customer.blocked = true; }
"""


def _goals(s, d):
    rules = parse_rules(GOALS)
    for x in rules:
        x.no_loop = True
    df = t(s, d, "customer").withColumns({"vip": F.lit(None).cast("boolean"), "blocked": F.lit(None).cast("boolean"), "offer": F.lit(None).cast("string")})
    return backward.Backward(rules, df, roots=("Customer",))


@query("SELECT c_custkey, 'Vip,Offer' AS proof FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def bwd_goal_chain(s, d):
    return _goals(s, d).solutions('Customer.offer == "yes"').select("c_custkey", F.array_join("proof", ",").alias("proof"))


@query("SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0")
def bwd_negation(s, d):
    return _goals(s, d).solutions("NOT Customer.blocked == true").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR c_acctbal < 0")
def bwd_disjunction(s, d):
    return _goals(s, d).any_of(["Customer.vip == true", "Customer.blocked == true"], ["c_custkey"])


@query("SELECT c_custkey AS c, o_orderkey AS o, n_name AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F'")
def bwd_conjunction_join(s, d):
    c = t(s, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("k"))
    o = t(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))
    return backward.conjunction(c, o, t(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).drop("k")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def bwd_nested(s, d):
    vip = _goals(s, d).solutions("Customer.vip == true").select(F.col("c_custkey").alias("o_custkey"))
    refuted = t(s, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return backward.without(backward.conjunction(t(s, d, "orders"), vip), refuted).select("o_orderkey")


def goal_aggregate(function: str, sql: str) -> None:
    def run(s, d):
        out = _goals(s, d).aggregate(f"{function}(?x) WHERE Customer.c_acctbal == ?x AND Customer.vip == true")
        return out.select(r(F.col("value").cast("double"), 3).alias("value"))

    QUERIES[f"bwd_aggregate_{function}"] = run
    SQL[f"bwd_aggregate_{function}"] = f"SELECT round(CAST({sql} AS DOUBLE), 3) AS value FROM customer WHERE c_acctbal > 5000"


for _f, _q in (("count", "count(*)"), ("sum", "sum(c_acctbal)"), ("avg", "avg(c_acctbal)"), ("min", "min(c_acctbal)"), ("max", "max(c_acctbal)")):
    goal_aggregate(_f, _q)

EDGES = "SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey - 1) FROM region WHERE r_regionkey > 0"


@query(f"WITH RECURSIVE e AS ({EDGES}), x AS (SELECT source, target, 1 AS depth FROM e UNION ALL SELECT x.source, e.target, depth + 1 FROM x JOIN e ON x.target = e.source) SELECT source, target, min(depth) AS depth FROM x GROUP BY ALL")
def bwd_recursive_reach(s, d):
    n, g = t(s, d, "nation"), t(s, d, "region").filter("r_regionkey > 0")
    edges = n.selectExpr("'n' || n_nationkey AS source", "'r' || n_regionkey AS target").unionByName(g.selectExpr("'r' || r_regionkey AS source", "'r' || (r_regionkey - 1) AS target"))
    return backward.reachable(edges, "source", "target")


@query("""SELECT c_custkey, (c_acctbal > 5000) AND c_mktsegment = 'BUILDING' AS provable, CASE WHEN (c_acctbal > 5000) AND c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS n_missing FROM customer""")
def bwd_missing(s, d):
    return _goals(s, d).query('Customer.offer == "yes"').select("c_custkey", "provable", F.size("missing").alias("n_missing"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'won' ELSE 'lost' END AS outcome FROM customer")
def bwd_query_block(s, d):
    q = parse_program('query "q" { goal: Customer.vip == true max-depth: 5 on-success: { outcome = "won"; } on-failure: { outcome = "lost"; } }').queries[0]
    return _goals(s, d).execute(q).select("c_custkey", "outcome")


# -- truth maintenance -------------------------------------------------------------------------------------------------


def _premises(s, d):
    """Orders justify customers' standing, customers justify nations' standing."""
    o, c = t(s, d, "orders"), t(s, d, "customer")
    facts = o.selectExpr("'o' || o_orderkey AS fact_id", "true AS explicit").unionByName(c.selectExpr("'c' || c_custkey AS fact_id", "false AS explicit")).unionByName(t(s, d, "nation").selectExpr("'n' || n_nationkey AS fact_id", "false AS explicit"))
    just = o.selectExpr("'jo' || o_orderkey AS just_id", "'c' || o_custkey AS fact_id", "'o' || o_orderkey AS premise_id")
    just = just.unionByName(c.selectExpr("'jc' || c_custkey AS just_id", "'n' || c_nationkey AS fact_id", "'c' || c_custkey AS premise_id"))
    return facts, just, o.filter("o_totalprice > 60000").selectExpr("'o' || o_orderkey AS fact_id")


@query("""WITH o AS (SELECT o_custkey AS c, bool_and(o_totalprice > 60000) AS gone FROM orders GROUP BY 1), n AS (SELECT c_nationkey AS n, bool_and(coalesce(gone, false)) AS gone FROM customer LEFT JOIN o ON c = c_custkey GROUP BY 1)
SELECT 'o' || o_orderkey AS fact_id, 0 AS round FROM orders WHERE o_totalprice > 60000 UNION ALL SELECT 'c' || c, 1 FROM o JOIN customer ON c = c_custkey WHERE gone UNION ALL SELECT 'n' || n, 2 FROM n JOIN nation ON n = n_nationkey WHERE gone""")
def tms_cascade(s, d):
    return tms.cascade(*_premises(s, d)).select("fact_id", "round")


@query("""WITH o AS (SELECT o_custkey AS c, bool_and(o_totalprice > 60000) AS gone, count(*) AS n FROM orders GROUP BY 1)
SELECT 'c' || c AS fact_id FROM o JOIN customer ON c = c_custkey WHERE NOT gone AND n > 1""")
def tms_multi_justification(s, d):
    facts, just, gone = _premises(s, d)
    many = just.groupBy("fact_id").agg(F.count_distinct("just_id").alias("n")).filter("n > 1")
    return tms.standing(facts, just, gone).filter("fact_id like 'c%'").join(many, "fact_id", "left_semi").select("fact_id")


# -- working memory ----------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS bal, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS update_count FROM supplier WHERE s_suppkey % 4 <> 0""")
def wm_lifecycle(s, d):
    wm, x = memory.WorkingMemory(s), t(s, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))
    wm.insert("Supplier", x, key=F.col("s_suppkey"))
    wm.update("Supplier", x.filter("s_suppkey % 3 = 0").select("s_suppkey", (F.col("bal") + 1).alias("bal"), F.col("s_suppkey").alias("fact_id")))
    wm.retract("Supplier", x.filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("fact_id")))
    return wm.get("Supplier").select("s_suppkey", "bal", "update_count")


@query("SELECT s_suppkey, 'rank is missing' AS reasons FROM supplier WHERE s_suppkey % 2 = 0")
def template_violations(s, d):
    tpl = memory.Template("Supplier", {"s_suppkey": ("Integer", True, None), "rank": ("String", True, None)})
    df = t(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, "a").alias("rank"))
    return tpl.violations(df).select("s_suppkey", F.array_join("reasons", ";").alias("reasons"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) ELSE n_name END AS n_name FROM nation")
def facts_merge(s, d):
    n = t(s, d, "nation").select("n_nationkey", "n_name")
    return memory.merged(n, n.filter("n_nationkey < 5").withColumn("n_name", F.upper("n_name")), "n_nationkey")


# -- rules over windows, state -----------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS k, count(*) AS n, avg(value) AS a FROM events GROUP BY 1)
SELECT k AS "WindowStartTime", CASE WHEN n > 30 AND a > 50 THEN 'alert' END AS state FROM w""")
def stream_rules_per_window(s, d):
    text = 'rule "Load" no-loop { when WindowEventCount > 30 && valueAverage > 50 then state = "alert"; }'
    return Forward(parse_rules(text)).run(events(s, d).tumbling(DAY).facts("value")).select("WindowStartTime", "state")


@query(f"""SELECT user_id, ((epoch_us(ts) // 1000) // {600_000}) * {600_000} AS window_start, count(*) AS n FROM events WHERE event_type = 'click' AND value > 20 GROUP BY ALL""")
def stream_pattern(s, d):
    """A pattern's source, type and test, and its window as the group of what it matches."""
    text = 'e: click from stream("events") over window(10 min, tumbling) && e.value > 20'
    pattern = parse_condition(text).parts[0]
    matched = correlation.correlate(text, {"events": t(s, d, "events")})
    return windows.tumbling(matched, "e_ts", pattern.window_ms).groupBy(F.col("e_user_id").alias("user_id"), "window_start").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT l.event_id AS view_id, r.event_id AS buy_id FROM events l JOIN events r ON l.user_id = r.user_id AND abs((epoch_us(l.ts) // 1000) - (epoch_us(r.ts) // 1000)) <= {HOUR * 3}
WHERE l.event_type = 'view' AND r.event_type = 'purchase' AND l.value > 20 AND r.value > l.value""")
def stream_correlation(s, d):
    text = 'v: view from stream("events") over window(3 hours, sliding) && b: purchase from stream("events") over window(3 hours, sliding) && v.user_id == b.user_id && v.value > 20 && b.value > v.value'
    return correlation.correlate(text, {"events": t(s, d, "events")}).select(F.col("v_event_id").alias("view_id"), F.col("b_event_id").alias("buy_id"))


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id, round(a.value + b.value, 4) AS total, CASE WHEN true THEN 'pair' END AS kind FROM events a JOIN events b
ON a.user_id = b.user_id AND (epoch_us(a.ts) // 1000) // {HOUR * 2} = (epoch_us(b.ts) // 1000) // {HOUR * 2} WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_rules(s, d):
    text = """rule "Pair" { when a: click from stream("events") over window(2 hours, tumbling) && b: purchase from stream("events") over window(2 hours, tumbling) && a.user_id == b.user_id
    then Match.total = a.value + b.value; Match.kind = "pair"; }"""
    out = correlation.run_rules(parse_rules(text), {"events": t(s, d, "events")})["Pair"]
    return out.select(F.col("a_event_id").alias("a_id"), F.col("b_event_id").alias("b_id"), r("total").alias("total"), "kind")


# -- streams that run --------------------------------------------------------------------------------------------------


@query("SELECT event_id, upper(event_type) AS kind FROM events WHERE value > 30")
def stream_source_and_sink(s, d):
    """Events read as a running stream, handed to a function batch by batch."""
    source = streams.read_events(s, f"{d}/events.parquet*")
    return streams.drained(source.filter("value > 30"), each=lambda b: b.select("event_id", F.upper("event_type").alias("kind")))


@query(f"SELECT event_type, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_count(s, d):
    source = streams.read_events(s, f"{d}/events.parquet*")
    out = source.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return streams.drained(out, mode="complete").select("event_type", windows.millis(F.col("w.start")).alias("window_start"), "n")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS running, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def state_running_total(s, d):
    """A stateful operator over a running stream: typed state for each user, whole batches at a time.

    Null values add nothing, and a total of nothing else is null; pandas does not tell them from NaN, so they are counted.
    """

    def step(held, rows):
        total, given, n = held or (0.0, 0, 0)
        running = total + rows["value"].where(rows["given"], 0.0).to_numpy().cumsum()
        rows = rows.assign(running=running, given=given + rows["given"].cumsum(), n=n + np.arange(1, len(rows) + 1))
        return (float(running[-1]), int(rows["given"].iloc[-1]), n + len(rows)), rows[["event_id", "running", "given", "n"]]

    source = streams.read_events(s, f"{d}/events.parquet*").select("user_id", "event_id", "value", F.col("value").isNotNull().alias("given"))
    out = streams.drained(state.stateful_batches(source, "user_id", step, "event_id long, running double, given long, n long", "total double, given long, n long", order=["event_id"]))
    return out.select("event_id", F.when(F.col("given") > 0, r(F.coalesce("running", F.lit(float("nan"))), 3)).alias("running"), "n")


def _store(s, d):
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"), F.col("n_regionkey").alias("region"))
    store = state.StateTable.empty(s).put(n.filter("region < 3"), now=1000, ttl_ms=500).put(n.filter("region >= 3"), now=1000)
    return store, n


def _kept_as(form: str) -> None:
    def run(s, d):
        from ..storage import shared_path

        store, _ = _store(s, d)
        path = shared_path(s, f"state-{form}")
        store.checkpoint(path, form)
        return state.StateTable.restore(s, path, form).live(2000).select("key", "value")

    QUERIES[f"state_kept_as_{form}"] = run
    SQL[f"state_kept_as_{form}"] = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_regionkey >= 3"


for _f in ("parquet", "orc", "json"):
    _kept_as(_f)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_regionkey = 4 THEN lower(n_name) WHEN n_regionkey = 0 THEN 'again' ELSE n_name END AS value
FROM nation WHERE n_regionkey IN (0, 3, 4)""")
def state_put_update_ttl(s, d):
    """What was put with a time to live is over at 1500; an update does not prolong it, a new put does."""
    store, n = _store(s, d)
    store = store.update(n.filter("region = 4").withColumn("value", F.lower("value")), now=1400)
    store = store.update(n.filter("region = 1"), now=1400).put(n.filter("region = 0").withColumn("value", F.lit("again")), now=1400, ttl_ms=500)
    return store.get(n, now=1500)


@query("SELECT count(*) FILTER (n_regionkey <> 2 AND n_regionkey <> 4) AS entries, count(*) FILTER (n_regionkey < 2) AS expired FROM nation")
def state_delete_and_statistics(s, d):
    store, n = _store(s, d)
    return store.delete(n.filter("region in (2, 4)").select("key")).statistics(now=1600)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation WHERE n_regionkey >= 3")
def state_snapshot_restore(s, d):
    from ..storage import shared_path

    store, n = _store(s, d)
    root = shared_path(s, "snapshots")
    for number in range(3):
        (store if number < 2 else store.cleanup(now=2000)).snapshot(root, number, keep=2)
    kept = state.snapshots(s, root)
    return state.StateTable.restore(s, kept[-1]).live(2000).select("key", "value").filter(F.lit(len(kept) == 2))


# -- more of streams and windows ---------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(x, '$.name') AS name, CAST(json_extract(x, '$.ok') AS BOOLEAN) AS ok FROM (SELECT event_id, '{\"name\": \"' || event_type || '\", \"ok\": ' || (value > 50) || '}' AS x FROM events)")
def json_text_and_flag(s, d):
    x = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "ok": '), (F.col("value") > 50).cast("string"), F.lit("}"))
    return t(s, d, "events").select("event_id", json_text(x, "name").alias("name"), json_flag(x, "ok").alias("ok"))


@query("SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 40")
def recent_events(s, d):
    return events(s, d).recent(40).select("event_id", "value").df


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def ds_for_each(s, d):
    seen = []
    events(s, d).filter("event_type = 'purchase'").for_each(lambda df: seen.append(df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))))
    return seen[0]


@query(f"SELECT event_type, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, min(value) AS value FROM events GROUP BY ALL")
def win_reduce_keyed(s, d):
    return events(s, d).tumbling(DAY, "event_type").reduce(lambda a, b: F.least(a, b), F.lit(1e300), F.col("value"))


@query(f"""SELECT ((epoch_us(ts) // 1000) // {DAY}) * {DAY} AS window_start, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} + {DAY} AS window_end, count(*) AS count, max(epoch_us(ts) // 1000) AS latest,
((epoch_us(ts) // 1000) // {DAY}) * {DAY} + {DAY} <= epoch_us(TIMESTAMP '2024-01-10') // 1000 AS is_expired FROM events GROUP BY ALL""")
def win_described(s, d):
    return windows.described(events(s, d).tumbling(DAY).df, "ts", int(dt.datetime(2024, 1, 10, tzinfo=dt.timezone.utc).timestamp() * 1000))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def win_in_range(s, d):
    at = lambda day: int(dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc).timestamp() * 1000)
    return windows.in_range(t(s, d, "events"), "ts", at(5), at(6)).select("event_id")


@query(f"WITH w AS (SELECT ((epoch_us(ts) // 1000) // {DAY}) AS k, count(*) AS n, sum(value) AS s FROM events GROUP BY 1) SELECT count(*) AS windows, CAST(sum(n) AS BIGINT) AS events, round(sum(s), 3) AS total, round(min(s), 3) AS least, round(max(s), 3) AS largest FROM w")
def win_across(s, d):
    return windows.across(events(s, d).tumbling(DAY).df, "value").select("windows", "events", *[r(c, 3).alias(c) for c in ("total", "least", "largest")])


@query(f"SELECT DISTINCT ((epoch_us(ts) // 1000) // {HOUR}) * {HOUR} AS window_start FROM events WHERE event_type = 'error'")
def win_with_event_type(s, d):
    return windows.with_event_type(events(s, d).tumbling(HOUR).df, "error")


def _opened(s, d):
    return windows.first_fit(t(s, d, "events"), "ts", DAY, "user_id", "event_id")


@query(FIRST_FIT + "SELECT user_id, window_start FROM f WHERE window_end > epoch_us(TIMESTAMP '2024-01-29') // 1000")
def win_active(s, d):
    return windows.active(_opened(s, d), int(dt.datetime(2024, 1, 29, tzinfo=dt.timezone.utc).timestamp() * 1000)).select("user_id", "window_start")


@query(FIRST_FIT + "SELECT user_id, max(window_start) AS window_start, arg_max(count, window_start) AS count FROM f GROUP BY 1")
def win_latest(s, d):
    return windows.latest(_opened(s, d), "user_id").select("user_id", "window_start", "count")


@query("SELECT count(*) AS events FROM events")
def win_total_events(s, d):
    return windows.total_events(_opened(s, d))


@query("SELECT event_type, round(max(value) - min(value), 4) AS spread FROM events GROUP BY 1")
def agg_custom_stream(s, d):
    aggregates.register_stream("spread", lambda c: F.max(c.cast("double")) - F.min(c.cast("double")))
    return events(s, d).key_by("event_type").aggregate(spread=r(aggregates.STREAM["spread"](F.col("value"))))


@query("SELECT o_orderkey, coalesce(max(l_quantity) - min(l_quantity), 0) AS result FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def accumulate_custom(s, d):
    aggregates.register_accumulate("spread", lambda c: F.coalesce(F.max(c.cast("double")) - F.min(c.cast("double")), F.lit(0.0)))
    text = 'rule "A" no-loop { when accumulate(LineItem($v: l_quantity), spread($v)) then Order.result = LineItem_spread; }'
    return Forward(parse_rules(text), roots=("Order",), facts={"LineItem": (t(s, d, "lineitem"), {"l_orderkey": "o_orderkey"})}).run(t(s, d, "orders")).select("o_orderkey", "result")


@query("SELECT n_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS keys FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def agg_collect(s, d):
    keys = F.array_join(F.transform(F.array_sort(aggregates.ACCUMULATE["collect"](F.col("s_suppkey"))), lambda x: x.cast("string")), ",")
    return t(s, d, "nation").join(t(s, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(keys.alias("keys"))


@query(f"""SELECT l.event_id AS l_event_id, r.event_id AS r_event_id, greatest(epoch_us(l.ts), epoch_us(r.ts)) // 1000 AS at FROM events l JOIN events r ON l.user_id = r.user_id
AND l.ts > r.ts AND (epoch_us(l.ts) // 1000) - (epoch_us(r.ts) // 1000) <= {6 * HOUR} WHERE l.event_type = 'view' AND r.event_type = 'purchase'""")
def sjoin_after_time(s, d):
    a, b = _sides(s, d)
    return joins.interval_join(a, b, ["user_id"], "ts", 6 * HOUR, order="after").select("l_event_id", "r_event_id", windows.millis(F.col("join_ts")).alias("at"))


@query(f"""WITH p AS (SELECT l.event_id AS a, r.event_id AS b FROM events l JOIN events r ON l.user_id = r.user_id AND abs((epoch_us(l.ts) // 1000) - (epoch_us(r.ts) // 1000)) <= {HOUR} WHERE l.event_type = 'view' AND r.event_type = 'purchase')
SELECT 'views to purchases' AS join, count(*) AS pairs, count(DISTINCT a) AS left_events, count(DISTINCT b) AS right_events FROM p""")
def sjoin_manager(s, d):
    m, (a, b) = joins.JoinManager(), _sides(s, d)
    m.register("views to purchases", "views", "purchases", keys=["user_id"], time="ts", ms=HOUR)
    m.register("dropped", "views", "views", keys=["user_id"], time="ts", ms=HOUR)
    m.unregister("dropped")
    return m.statistics({"views": a, "purchases": b}).filter(F.lit(m.of_stream("views") == ["views to purchases"]))


def _arrivals(s, d):
    return t(s, d, "events").withColumn("arrival", F.expr("event_id div 50 * 50 + (event_id * 17) % 50"))


@query(LATE.replace(f" - {HOUR} AS wm", " AS wm") + "SELECT event_id, wm AS watermark_ms, is_late FROM f")
def wm_ascending(s, d):
    return watermark.flagged_by(_arrivals(s, d), "ts", "ascending", "arrival", bucket=1000).select("event_id", "watermark_ms", "is_late")


@query(f"""WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms, {ARRIVAL} // 20 AS turn FROM events), m AS (SELECT turn, max(ms) AS m FROM e GROUP BY 1),
w AS (SELECT turn, max(m) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM m) SELECT event_id, wm AS watermark_ms, coalesce(ms < wm, false) AS is_late FROM e JOIN w USING (turn)""")
def wm_periodic(s, d):
    return watermark.flagged_by(_arrivals(s, d), "ts", "periodic", "arrival", interval=20, bucket=100).select("event_id", "watermark_ms", "is_late")


@query("SELECT event_id, CAST(NULL AS BIGINT) AS watermark_ms, false AS is_late FROM events")
def wm_custom(s, d):
    return watermark.flagged_by(_arrivals(s, d), "ts", "custom", "arrival").select("event_id", "watermark_ms", "is_late")


@query(LATE + f"SELECT ms // {HOUR} * {HOUR} AS window_start, count(*) FILTER (NOT is_late) AS first, count(*) FILTER (is_late) AS revisions, round(sum(value), 4) AS total FROM f GROUP BY 1")
def wm_recompute_windows(s, d):
    return watermark.recomputed(_late(s, d), "ts", HOUR, total=r(F.sum("value")))


# -- more of rules -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'order ' || o_orderkey ELSE '' END AS log FROM orders")
def fwd_log(s, d):
    text = 'rule "L" no-loop { when o_totalprice > 100000 then Log("order " + o_orderkey); }'
    return Forward(parse_rules(text)).run(t(s, d, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string")), audit=True).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.array_join("log", ",").alias("log"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'soon' END AS now_, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 150000 THEN 'checked' END AS later, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END AS waiting FROM orders")
def fwd_schedule(s, d):
    """A rule put off by 5 s and one by an hour; after 10 s only the first has run."""
    text = """rule "Now" no-loop { when o_orderstatus == "O" && o_totalprice > 100000 then now_ = "soon"; ScheduleRule(5000, "Later"); ScheduleRule(3600000, "Last"); }
    rule "Later" no-loop agenda-group "timer" { when o_totalprice > 150000 then later = "checked"; }
    rule "Last" no-loop agenda-group "timer" { when o_totalprice > 0 then later = "too late"; }"""
    engine = Forward(parse_rules(text))
    out = engine.due(engine.run(t(s, d, "orders").withColumn("later", F.lit(None).cast("string")), audit=True), 10_000)
    return out.select("o_orderkey", "now_", "later", F.size("timers").alias("waiting"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'ship=ready,step.complete=true' ELSE '' END AS workflow FROM orders")
def fwd_workflow_data(s, d):
    text = 'rule "W" no-loop { when o_totalprice > 150000 then SetWorkflowData("ship", "ready"); CompleteWorkflow("step"); }'
    out = Forward(parse_rules(text)).run(t(s, d, "orders"), audit=True)
    pairs = F.transform(F.array_sort(F.map_entries("workflow")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("o_orderkey", F.array_join(pairs, ",").alias("workflow"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS n FROM orders")
def fwd_lock_on_active(s, d):
    """The rule stays true, but fires once for each time that its group comes into focus."""
    text = """rule "Go" no-loop { when o_orderstatus == "O" then ActivateAgendaGroup("count"); }
    rule "Count" lock-on-active agenda-group "count" { when n < 5 then n = n + 1; }"""
    return Forward(parse_rules(text)).run(t(s, d, "orders").withColumn("n", F.lit(0))).select("o_orderkey", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'a,b,a2,main' ELSE 'main' END AS trail FROM orders")
def fwd_focus_stack(s, d):
    """Group b comes into focus out of group a; when nothing of b is left to fire, a is in focus again, then MAIN."""
    text = """rule "Start" salience 10 no-loop { when o_orderstatus == "O" then ActivateAgendaGroup("a"); }
    rule "A" salience 5 no-loop agenda-group "a" { when o_totalprice > 0 then trail += "a"; ActivateAgendaGroup("b"); }
    rule "B" no-loop agenda-group "b" { when o_totalprice > 0 then trail += "b"; step = 1; }
    rule "A2" no-loop agenda-group "a" { when step == 1 then trail += "a2"; step = 2; }
    rule "Main" no-loop { when step == 2 || o_orderstatus != "O" then trail += "main"; }"""
    df = t(s, d, "orders").withColumns({"trail": F.array().cast("array<string>"), "step": F.lit(0)})
    return Forward(parse_rules(text)).run(df).select("o_orderkey", F.array_join("trail", ",").alias("trail"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'on' END AS a, CAST(NULL AS VARCHAR) AS b FROM orders")
def fwd_enabled(s, d):
    kb = catalog.KnowledgeBase("kb")
    kb.add_text('rule "On" no-loop { when o_totalprice > 1000 then a = "on"; } rule "Off" no-loop { when o_totalprice > 1000 then b = "off"; }')
    kb.enable("Off", False)
    return Forward(kb.by_salience()).run(t(s, d, "orders").withColumn("b", F.lit(None).cast("string"))).select("o_orderkey", "a", "b")


@query("""WITH o AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT 'Customer:' || o_custkey AS fact_id, CAST(max(o_orderpriority) AS VARCHAR) AS value, false AS explicit, count(*) AS reasons FROM o GROUP BY o_custkey""")
def fwd_insert_logical(s, d):
    text = 'rule "Big" no-loop { when o_totalprice > 200000 then InsertLogical("Customer", o_custkey, o_orderpriority); }'
    facts, why = tms.inserted(Forward(parse_rules(text)).run(t(s, d, "orders"), audit=True), "o_orderkey")
    return facts.join(why.groupBy("fact_id").agg(F.count(F.lit(1)).alias("reasons")), "fact_id")


@query("""SELECT DISTINCT 'Customer:' || o_custkey AS fact_id FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'""")
def tms_of_inserted_facts(s, d):
    """Facts that rules inserted fall with the orders that they were inserted for."""
    text = 'rule "Big" no-loop { when o_totalprice > 200000 then InsertLogical("Customer", o_custkey); }'
    facts, why = tms.inserted(Forward(parse_rules(text)).run(t(s, d, "orders"), audit=True), "o_orderkey")
    gone = t(s, d, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("record:"), F.col("o_orderkey").cast("string")).alias("fact_id"))
    return tms.standing(facts, why, gone).select("fact_id")


@query("SELECT count(*) AS explicit, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS logical, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS justifications, (SELECT count(DISTINCT o_custkey) FROM orders) + (SELECT count(DISTINCT c_nationkey) FROM customer) AS justified FROM orders")
def tms_statistics(s, d):
    facts, just, _ = _premises(s, d)
    return tms.statistics(facts, just)


@query("SELECT 'j' || o_orderkey AS just_id, 'c' || o_custkey AS fact_id, 's' || n_nationkey AS premise_id FROM orders JOIN nation ON n_name = CASE WHEN o_orderstatus = 'F' THEN 'NATION_3' ELSE 'NATION_7' END WHERE o_totalprice > 250000")
def tms_premises(s, d):
    """Premises given as `field = value` meet the facts that are so."""
    o = t(s, d, "orders").selectExpr("'j' || o_orderkey AS just_id", "'c' || o_custkey AS fact_id", "'n_name' AS field", "CASE WHEN o_orderstatus = 'F' THEN 'NATION_3' ELSE 'NATION_7' END AS value", "o_totalprice")
    facts = t(s, d, "nation").selectExpr("'s' || n_nationkey AS premise_id", "'n_name' AS field", "n_name AS value")
    return tms.premises(o.filter("o_totalprice > 250000").select("just_id"), facts, o.drop("o_totalprice"))


@query("SELECT rule, n AS fires FROM (SELECT 'Base' AS rule, count(*) AS n FROM orders UNION ALL SELECT 'Large', count(*) FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'Urgent', count(*) FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT') ORDER BY fires DESC LIMIT 2")
def fwd_most_fired(s, d):
    return catalog.most_fired(Forward(parse_rules(CHAIN), roots=("Order",)).run(t(s, d, "orders").withColumn("score", F.lit(0)), audit=True), 2).select("rule", "fires")


@query("SELECT 'Big' AS rule, count(*) AS records FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'Late', count(*) FROM orders WHERE o_orderpriority = '5-LOW'")
def fwd_profile(s, d):
    rules = parse_rules('rule "Big" { when o_totalprice > 200000 then a = 1; } rule "Late" { when o_orderpriority == "5-LOW" then b = 1; }')
    return catalog.slowest(catalog.profile(Forward(rules), t(s, d, "orders")), 5).select("rule", "records")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'seen' END AS x, CASE WHEN o_totalprice > 250000 THEN 'yes' END AS y FROM orders")
def fwd_modules(s, d):
    """Rules of a module and those that it imports; what the other does not export is not run."""
    text = """defmodule BASE { export: pub* }
    defmodule APP { export: all import: BASE (rules *) }
    ;; MODULE: BASE
    rule "pubSeen" no-loop { when o_totalprice > 200000 then x = "seen"; }
    rule "hidden" no-loop { when o_totalprice > 0 then x = "hidden"; }
    ;; MODULE: APP
    rule "own" no-loop { when o_totalprice > 250000 then y = "yes"; }"""
    program, modules = parse_program(text), catalog.Modules()
    for m in program.modules:
        modules.define(m)
    for x in program.rules:
        modules.add_rule(x.module, x.name)
    seen = modules.visible("APP")
    return Forward([x for x in program.rules if x.name in seen]).run(t(s, d, "orders")).select("o_orderkey", "x", "y")


@query("SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross, CASE WHEN o_totalprice * 1.19 > 200000 THEN 'tax' END AS flag FROM orders")
def fwd_plugin_functions(s, d):
    """Functions that a plugin brings, in conditions and in effects; built-in columns and Arrow batches alike."""
    from pyspark.sql.functions import pandas_udf

    doubled = pandas_udf(lambda x: x * 2, "double")
    plugins = catalog.Plugins()
    plugins.load(catalog.Plugin("tax", functions={"gross": lambda x: x * 1.19, "twice": lambda x: doubled(x.cast("double"))}))
    text = 'rule "T" no-loop { when gross(o_totalprice) > 200000 && twice(o_totalprice) > 0 then flag = "tax"; } rule "G" no-loop { when o_orderkey >= 0 then gross = gross(o_totalprice); }'
    return Forward(parse_rules(text), **plugins.parts()).run(t(s, d, "orders")).select("o_orderkey", r("gross").alias("gross"), "flag")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day_, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS found, 1 + (o_orderstatus = 'F')::INT AS n FROM orders")
def fwd_more_actions(s, d):
    text = """rule "X" no-loop { when o_orderkey >= 0 then FormatDate(at, "%d.%m.%Y", day_); ArrayFilter(marks, "_value", "F", only); ArrayLength(only, n); }
    rule "Y" salience -1 no-loop { when o_orderkey % 2 == 0 then ArrayFind(marks, "_value", "F", found); }"""
    df = t(s, d, "orders").withColumns({"at": F.date_format("o_orderdate", "yyyy-MM-dd"), "marks": F.array(F.lit("F"), F.col("o_orderstatus")), "only": F.array().cast("array<string>")})
    return Forward(parse_rules(text)).run(df).select("o_orderkey", "day_", "found", "n")


@query("SELECT o_orderkey, o_totalprice > 100000 AS base, CASE WHEN o_totalprice > 100000 THEN 100 END AS rate FROM orders")
def fwd_globals(s, d):
    g = memory.Globals()
    g.define("limit", 90_000)
    g.increment("limit", 10_000)
    g.define("rate", 100, read_only=True)
    df = t(s, d, "orders").withColumns({"limit": g.column("limit"), "fixed": g.column("rate")})
    return Forward(parse_rules('rule "G" no-loop { when o_totalprice > limit then rate = fixed; base = true; }')).run(df.withColumn("base", F.lit(False))).select("o_orderkey", "base", "rate")


def _ordered_by(strategy: str, want: str) -> None:
    """The order of activation shows in which rule of equal salience writes last."""

    def run(s, d):
        rules = parse_rules("""rule "Wide" no-loop { when o_totalprice > 0 && o_orderkey >= 0 && o_custkey >= 0 then last = "Wide"; }
        rule "Small" no-loop { when o_totalprice > 0 then last = "Small"; }
        rule "First" salience 5 no-loop { when o_totalprice > 0 then last = "First"; }""")
        return Forward(catalog.ordered(rules, strategy)).run(t(s, d, "orders"), max_cycles=1).select("o_orderkey", "last")

    QUERIES[f"fwd_order_{strategy}"] = run
    SQL[f"fwd_order_{strategy}"] = f"SELECT o_orderkey, '{want}' AS last FROM orders"


for _s, _w in (("salience", "Small"), ("breadth", "Small"), ("depth", "Wide"), ("simplicity", "Wide"), ("complexity", "Small")):
    _ordered_by(_s, _w)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'in' END AS a, CAST(NULL AS VARCHAR) AS b FROM orders")
def fwd_ruleflow_group(s, d):
    text = """rule "In" no-loop ruleflow-group "intake" { when o_totalprice > 100000 then a = "in"; }
    rule "Out" no-loop ruleflow-group "billing" { when o_totalprice > 0 then b = "out"; }"""
    return Forward(parse_rules(text), ruleflow=("intake",)).run(t(s, d, "orders").withColumn("b", F.lit(None).cast("string"))).select("o_orderkey", "a", "b")


# -- more of functions -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS a, CAST(month(o_orderdate) AS INTEGER) AS b, CAST(day(o_orderdate) AS INTEGER) AS c, CAST(day(o_orderdate) AS INTEGER) AS e,
CASE WHEN day(o_orderdate) > 12 THEN CAST(day(o_orderdate) AS INTEGER) ELSE CAST(month(o_orderdate) AS INTEGER) END AS f FROM orders""")
def fn_date_formats(s, d):
    f = lambda p: F.date_format("o_orderdate", p)
    return t(s, d, "orders").select("o_orderkey", FN["year"](f("yyyy-MM-dd HH:mm:ss")).alias("a"), FN["month"](f("yyyy/MM/dd")).alias("b"), FN["day"](f("dd/MM/yyyy")).alias("c"), FN["day"](f("yyyy-MM-dd")).alias("e"), FN["day"](f("MM/dd/yyyy")).alias("f"))


@query("""WITH l AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(k, '+') AS joined, array_to_string(list_reverse(k), '+') AS back, k[-1] AS last, 'k,n' AS names, len(k) || ',' || o_custkey AS vals, 'a=1,b=3,c=4' AS merged FROM l""")
def fn_objects(s, d):
    k, A, text = F.col("keys"), library.ACTIONS, lambda c: F.transform(c, lambda x: x.cast("string"))
    m = F.create_map(F.lit("n"), F.col("o_custkey").cast("string"), F.lit("k"), F.size(k).cast("string"))
    one, two = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"), F.lit("c"), F.lit("4"))
    merged = A["ObjectMerge"](one, two)
    pairs = F.zip_with(A["ObjectKeys"](merged), A["ObjectValues"](merged), lambda a, b: F.concat_ws("=", a, b))
    return _lists(s, d).select(
        "o_custkey", FN["join"](text(k), F.lit("+")).alias("joined"), FN["join"](text(FN["reverse"](k)), F.lit("+")).alias("back"), library.ARRAY_FUNCTIONS["last"](k).alias("last"),
        F.array_join(FN["keys"](m), ",").alias("names"), F.array_join(FN["values"](m), ",").alias("vals"), F.array_join(pairs, ",").alias("merged"),
    )


@query(r"""SELECT c_custkey, c_acctbal + 1 AS added, c_acctbal - 1 AS less, c_name LIKE '%7' AS re, c_acctbal BETWEEN 0 AND 100 AS rng, strlen(c_name) BETWEEN 5 AND 18 AS len, c_mktsegment <> '' AS some,
regexp_full_match(c_mktsegment || '@x.org', '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS mail, right(c_name, 1) AS last FROM customer""")
def fn_validate_actions(s, d):
    A, n, b = library.ACTIONS, F.col("c_name"), F.col("c_acctbal")
    return t(s, d, "customer").select(
        "c_custkey", A["Add"](b, F.lit(1)).alias("added"), A["Subtract"](b, F.lit(1)).alias("less"), A["ValidateRegex"](n, F.lit("7$")).alias("re"), A["ValidateRange"](b, F.lit(0), F.lit(100)).alias("rng"),
        A["ValidateLength"](n, F.lit(5), F.lit(18)).alias("len"), A["ValidateNotEmpty"](F.col("c_mktsegment")).alias("some"), A["ValidateEmail"](F.concat("c_mktsegment", F.lit("@x.org"))).alias("mail"), FN["last"](n).alias("last"),
    )


@query("SELECT n_nationkey, true AS today, true AS now_, true AS date_, true AS time_ FROM nation")
def fn_clock(s, d):
    """The clock's functions give what the session's own clock gives, in their formats."""
    A, day = library.ACTIONS, F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    return t(s, d, "nation").select("n_nationkey", (FN["today"]() == day).alias("today"), FN["now"]().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d").alias("now_"), (A["CurrentDate"]() == day).alias("date_"), A["CurrentTime"]().rlike(r"^\d\d:\d\d:\d\d$").alias("time_"))


# -- more of goals -----------------------------------------------------------------------------------------------------


def _facts(s, d):
    c, o, n, g = (t(s, d, x) for x in ("customer", "orders", "nation", "region"))
    return patterns.Facts({
        "customer": c.select("c_custkey", "c_nationkey", "c_mktsegment"), "order": o.select("o_orderkey", "o_custkey", "o_totalprice"), "nation": n.select("n_nationkey", "n_regionkey", "n_name"),
        "region": g.select("r_regionkey", "r_name"), "blocked": c.filter("c_acctbal < 0").select("c_custkey"),
    })


@query("SELECT DISTINCT c_custkey AS c, n_name AS name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 250000 AND c_acctbal >= 0")
def bwd_text_conjunction(s, d):
    return _facts(s, d).find("served(?c, ?name) WHERE order(?o, ?c, ?price) AND customer(?c, ?n) AND nation(?n, _, ?name) AND ?price > 250000 AND NOT blocked(?c)")


@query("SELECT DISTINCT c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE (r_name = 'ASIA' OR c_mktsegment = 'BUILDING') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def bwd_text_nested(s, d):
    return _facts(s, d).find("""quiet(?c) WHERE (customer(?c, ?n, "BUILDING") OR (inAsia(?c, ?n) WHERE customer(?c, ?n) AND nation(?n, ?r) AND region(?r, "ASIA")))
    AND NOT (big(?c) WHERE order(?o, ?c, ?p) AND ?p > 450000)""")


@query("SELECT count(*) AS value FROM (SELECT DISTINCT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY')")
def bwd_text_aggregate(s, d):
    return _facts(s, d).find('count(?o) WHERE order(?o, ?c) AND customer(?c, ?n, "MACHINERY")')


for _f, _q in (("first", "min(c_acctbal)"), ("last", "max(c_acctbal)")):
    goal_aggregate(_f, _q)


@query("SELECT count(*) AS n, bool_and(c_acctbal > 5000) AS sound FROM (SELECT * FROM customer WHERE c_acctbal > 5000 LIMIT 5)")
def bwd_max_solutions(s, d):
    return _goals(s, d).solutions("Customer.vip == true", max_solutions=5).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("c_acctbal") > 5000).alias("sound"))


@query("SELECT c_custkey, 2 AS depth FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def bwd_deepened(s, d):
    return _goals(s, d).deepened('Customer.offer == "yes"', ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 OR (c_acctbal < 0 AND c_mktsegment = 'BUILDING')")
def bwd_compound_goal(s, d):
    return _goals(s, d).solutions('Customer.vip == true || (Customer.blocked == true && Customer.c_mktsegment == "BUILDING")').select("c_custkey")


@query("""SELECT 'vip' AS query, count(*) AS value FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'n', count(*) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'blocked', count(*) FROM customer WHERE c_acctbal < 0""")
def bwd_many_queries(s, d):
    """Three blocks, one with an aggregate goal, one that keeps its rows for the next who asks."""
    out = _goals(s, d).execute_all("""query "vip" { goal: Customer.vip == true strategy: breadth-first enable-memoization: true }
    query "n" { goal: count(?x) WHERE Customer.c_acctbal == ?x AND Customer.vip == true }
    query "blocked" { goal: Customer.blocked == true strategy: iterative max-depth: 3 enable-optimization: false }""")
    n = lambda name: out[name].filter("provable").agg(F.count(F.lit(1)).alias("value"))
    parts = {"vip": n("vip"), "n": out["n"], "blocked": n("blocked")}
    rows = [df.select(F.lit(k).alias("query"), F.col("value").cast("long").alias("value")) for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'Customer.vip == true holds, by Vip' ELSE 'Customer.vip == true fails: Customer.vip == true' END AS why FROM customer")
def bwd_explained(s, d):
    """The proof in words, row by row in the plan."""
    return _goals(s, d).query("Customer.vip == true").select("c_custkey", backward.explained("Customer.vip == true").alias("why"))


@query("SELECT 1 AS layer, 'Offer' AS rule, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 2, 'Vip', count(*) FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def bwd_static_search(s, d):
    """The rules that a goal depends on, found without running any, beside how often the goal then holds."""
    goal = 'Customer.offer == "yes"'
    found = s.createDataFrame(backward.static_search(goal, parse_rules(GOALS)), "layer int, rule string")
    n = _goals(s, d).solutions(goal).agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(n))  # a single row


predicate("pred_backward_functions", "customer", "len(c_name) > 10 && isEmpty(c_mktsegment) == false && notExists(c_acctbal) == false", ["c_custkey"], "strlen(c_name) > 10 AND trim(c_mktsegment) <> '' AND c_acctbal IS NOT NULL")


# -- more of working memory --------------------------------------------------------------------------------------------


@query("SELECT 'Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'Region', count(*) FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 'click', count(*) FROM events WHERE event_type = 'click'")
def wm_all_types(s, d):
    """Facts of every type in one scan; those from a stream name it."""
    wm = memory.WorkingMemory(s)
    wm.insert("Nation", t(s, d, "nation"), key=F.col("n_nationkey"))
    wm.insert("Region", t(s, d, "region"), key=F.col("r_regionkey"))
    wm.retract("Region", s.createDataFrame([(2,)], "fact_id long"))
    wm.insert_stream("click", t(s, d, "events"), "events", "click", key=F.col("event_id"))
    return wm.get_all().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Region.' || r_regionkey || '.r_name' AS path, r_name AS value FROM region UNION ALL SELECT 'Region.' || r_regionkey || '.r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region")
def wm_flattened(s, d):
    wm = memory.WorkingMemory(s)
    wm.insert("Region", t(s, d, "region").select("r_regionkey", "r_name"), key=F.col("r_regionkey"))
    return wm.flattened()


@query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0")
def wm_deffacts(s, d):
    """Initial facts; those that lack what their template requires are left out."""
    wm = memory.WorkingMemory(s)
    wm.define(memory.Template("N", {"k": ("Integer", True, None), "name": ("String", True, None)}))
    n = t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    wm.register_deffacts("start", [("N", n)])
    wm.load_deffacts("start", skip_invalid=True)
    return wm.get("N").select("k", "name")


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS bal, true AS fresh FROM supplier")
def facts_json(s, d):
    """Facts out to JSON documents and back, then a field set on all and one cleared."""
    x = t(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("bal"), F.lit("x").alias("tmp"))
    back = memory.facts_from_json(s, memory.facts_to_json(x), "id long, name string, bal double, tmp string")
    return memory.without_fields(memory.with_fields(back, fresh=True), "tmp")


@query("SELECT 'u1' AS id, count(*) AS spent FROM orders WHERE o_totalprice > 300000")
def facts_built(s, d):
    """Facts from builders and plain dictionaries, joined to a table's."""
    users = memory.build(s, "User", Name="u1", Age=40, IsVIP=True)
    back = memory.from_context(s, memory.to_context(users), memory.SHAPES["User"])
    n = t(s, d, "orders").filter("o_totalprice > 300000").agg(F.count(F.lit(1)).alias("spent"))
    return back.filter("IsVIP").select(F.col("Name").alias("id")).crossJoin(F.broadcast(n))  # one row each


@query("SELECT count(*) FILTER (typeof(k) = 'BIGINT') > 0 AS ok, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)")
def facts_inferred(s, d):
    """Text that is numbers throughout becomes numbers."""
    x = memory.inferred(t(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"))
    return x.agg(F.lit(dict(x.dtypes)["k"] == "bigint").alias("ok"), F.sum("k").alias("total"))
