"""Scheduled rules, focus, inserted facts, goals as text, stream correlation, joins split by time, folds, facts as documents."""

import itertools

import pytest
from pyspark.sql import functions as F

from ruleloom import storage
from ruleloom.errors import BindError, GoalError
from ruleloom.functions import library
from ruleloom.lang.parser import parse_program, parse_rules
from ruleloom.operators import correlation, joins, windows
from ruleloom.operators.datastream import DataStream, json_flag, json_text
from ruleloom.plans import backward, catalog, patterns, tms
from ruleloom.plans.forward import Forward
from ruleloom.sources import memory
from ruleloom.streaming import watermark


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, "u" if i % 3 else None, (i * 7919) % 500, ["view", "buy"][i % 2], float(i % 11)) for i in range(120)]
    return spark.createDataFrame(rows, "event_id long, user string, ms long, event_type string, value double").withColumn("ts", F.timestamp_millis("ms"))


@pytest.mark.parametrize(("how", "order"), list(itertools.product(["inner", "left_outer", "right_outer", "full_outer"], ["within", "before", "after"])))
def test_interval_join_splits_keys_without_loss(events, how, order):
    a, b = events.filter("event_type = 'view'"), events.filter("event_type = 'buy'")
    for ms in (1, 40, 1000):
        got = sorted((r.l_event_id, r.r_event_id) for r in joins.interval_join(a, b, ["user"], "ts", ms, "inner", order=order).collect())
        fit = {"within": lambda x, y: abs(x - y) <= ms, "before": lambda x, y: x < y <= x + ms, "after": lambda x, y: y < x <= y + ms}[order]
        left, right = a.collect(), b.collect()
        want = sorted((x.event_id, y.event_id) for x in left for y in right if x.user is not None and x.user == y.user and fit(x.ms, y.ms))
        assert got == want
        if how != "inner":
            pairs = {(r.l_event_id, r.r_event_id) for r in joins.interval_join(a, b, ["user"], "ts", ms, how, order=order).collect()}
            alone = {(x.event_id, None) for x in left if x.event_id not in {p for p, _ in want}} if how != "right_outer" else set()
            alone |= {(None, y.event_id) for y in right if y.event_id not in {p for _, p in want}} if how != "left_outer" else set()
            assert pairs == set(want) | alone


def test_folds_and_percentiles(events):
    s = DataStream(events)
    one = {r.event_type: r.value for r in s.key_by("event_type").reduce(lambda a, b: a + b, F.lit(0.0), F.col("value")).collect()}
    two = {r.event_type: r.value for r in s.key_by("event_type").reduce(lambda a, b: a + b, F.lit(0.0), F.col("value"), commutes=True).collect()}
    assert one == two and len(one) == 2
    for p in (0, 10, 50, 77, 100):
        got = {r.event_type: r.value for r in s.key_by("event_type").percentile("value", p).collect()}
        for kind in one:
            x = sorted(r.value for r in events.collect() if r.event_type == kind)
            assert got[kind] == x[int(p / 100 * (len(x) - 1) + 0.5)]
    counts = {r.user: r.counts for r in s.key_by("user").count_by("event_type").collect()}
    assert counts[None] == {"view": 20, "buy": 20} and sum(counts["u"].values()) == 80
    assert s.recent(2).df.count() == 2 and sum(s.count_by("event_type").first().counts.values()) == 120


def test_skip_and_take(events):
    s = DataStream(events)
    for n in (0, 1, 7, 120, 500):
        assert sorted(r.event_id for r in s.skip(n).df.collect()) == list(range(min(n, 120), 120))
        assert sorted(r.event_id for r in s.take(n).df.collect()) == list(range(min(n, 120)))


def test_trailing_counts_split_keys(events):
    rows = events.collect()
    for ms in (0, 1, 30, 10_000):
        got = {r.event_id: r.trailing for r in windows.trailing_count(events, "ts", ms, ["user"]).collect()}
        assert got == {r.event_id: sum(x.user == r.user and r.ms - ms <= x.ms <= r.ms for x in rows) for r in rows}


def test_first_fit_in_and_out_of_order():
    for times in ([0, 3, 9, 10, 25, 26, 40], [5, 5, 5], [7]):
        assert sorted(map(tuple, windows.as_they_come(times, 10))) == sorted(map(tuple, windows.in_turn(__import__("numpy").array(times), 10)))


def test_watermarks_by_kind(events):
    by = lambda kind, **how: {r.event_id: (r.watermark_ms, r.is_late) for r in watermark.flagged_by(events, "ts", kind, "event_id", **how).collect()}
    ms = {r.event_id: r.ms for r in events.collect()}
    ascending, periodic = by("ascending", bucket=7), by("periodic", interval=10, bucket=2)
    for i in ms:
        before = [ms[j] for j in range(i)]
        assert ascending[i][0] == (max(before) if before else None)
        turn = [ms[j] for j in range(i // 10 * 10)]
        assert periodic[i] == (max(turn) if turn else None, bool(turn) and ms[i] < max(turn))
    assert set(by("custom").values()) == {(None, False)} and by("bounded", delay_ms=10_000)[119][1] is False
    out = watermark.recomputed(watermark.flagged_by(events, "ts", "ascending", "event_id"), "ts", 100, n=F.count(F.lit(1)))
    assert all(r.first + r.revisions == r.n for r in out.collect()) and out.agg(F.sum("n")).first()[0] == 120
    with pytest.raises(ValueError):
        by("other")


def test_correlation(events):
    text = 'a: view from stream("s") over window(50 ms, sliding) && b: buy from stream("s") && a.user == b.user && a.value > 3 && b.value < a.value'
    got = {(r.a_event_id, r.b_event_id) for r in correlation.correlate(text, {"s": events}).collect()}
    rows = events.collect()
    want = {(x.event_id, y.event_id) for x in rows for y in rows if x.event_type == "view" and y.event_type == "buy" and x.user and x.user == y.user and x.value > 3 and y.value < x.value and abs(x.ms - y.ms) <= 50}
    assert got == want and want
    assert correlation.correlate('a: view from stream("s") && a.value > 9', {"s": events}).count() == sum(r.event_type == "view" and r.value > 9 for r in rows)
    rule = parse_rules('rule "p" { when a: view from stream("s") over window(1 sec, tumbling) && b: buy from stream("s") over window(1 sec, tumbling) && a.user == b.user then Match.sum = a.value + b.value; }')
    assert all(r["sum"] == r.a_value + r.b_value for r in correlation.run_rules(rule, {"s": events})["p"].collect())
    with pytest.raises(BindError):
        correlation.correlate('a: view from stream("none")', {"s": events})
    with pytest.raises(BindError):
        Forward(rule).run(events)


def test_scheduled_rules_and_focus(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "id int, x int")
    rules = parse_rules("""rule "a" no-loop { when x > 10 then ScheduleRule(100, "b"); ScheduleRule(1000, "c"); }
    rule "b" no-loop agenda-group "t" { when x > 0 then y = 1; } rule "c" no-loop agenda-group "t" { when x > 0 then z = 1; }""")
    engine = Forward(rules)
    audited = engine.run(df, audit=True)
    early, late = engine.due(audited, 50), engine.due(audited, 100)
    assert {r.id: len(r.timers) for r in early.collect()} == {1: 0, 2: 2}
    assert {r.id: (r.y, len(r.timers)) for r in late.collect()} == {1: (None, 0), 2: (1, 1)}
    assert {r.id: (r.z, len(r.timers)) for r in engine.due(audited, 5000).collect()} == {1: (None, 0), 2: (1, 0)}


def test_rows_leave_the_cycle_when_nothing_fires(spark):
    """Each row's own number of cycles, fused or not, and as many as allowed at most."""
    df = spark.createDataFrame([(i, i % 13, 0) for i in range(60)] + [(99, None, 0)], "id int, x int, n int")
    rules = parse_rules('rule "down" { when x > 0 then x = x - 1; n = n + 1; } rule "end" salience -1 no-loop { when x == 0 then done = true; }')
    for fuse in (True, False):
        out = {r.id: (r.x, r.n, r.done) for r in Forward(rules, fuse=fuse).run(df).collect()}
        assert out == {i: (0, i % 13, True) for i in range(60)} | {99: (None, 0, None)}
    short = {r.id: r.n for r in Forward(rules).run(df, max_cycles=3).collect()}
    assert short == {i: min(i % 13, 3) for i in range(60)} | {99: 0}


def test_plain_rules_leave_nothing_behind(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, x int")
    rules = parse_rules('rule "a" no-loop { when x > 1 then y = x * 2; y = y + 1; } rule "b" no-loop { when y > 1 then z = "set"; }')
    fast, slow = Forward(rules).run(df), Forward(rules, handlers={"unused": lambda df, *a: df}).run(df)
    assert fast.columns == slow.columns == ["id", "x", "y", "z"] and sorted(fast.collect(), key=str) == sorted(slow.collect(), key=str)


def test_inserted_facts(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, 60)], "id int, x int")
    rules = parse_rules('rule "r" no-loop { when x > 10 then InsertLogical("T", "big", x); Insert("U", id); }')
    facts, why = tms.inserted(Forward(rules).run(df, audit=True), "id")
    assert {(r.fact_id, r.explicit) for r in facts.collect()} == {("T:big", False), ("U:2", True), ("U:3", True)} and why.count() == 2
    gone = lambda *ids: spark.createDataFrame([(f"record:{i}",) for i in ids], "fact_id string")
    assert "T:big" in {r.fact_id for r in tms.standing(facts, why, gone(2)).collect()}
    assert "T:big" not in {r.fact_id for r in tms.standing(facts, why, gone(2, 3)).collect()}


def test_goals_as_text(spark):
    parent = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "e")], "x string, y string")
    age = spark.createDataFrame([("c", 5), ("d", 20), ("e", 1)], "x string, n int")
    f = patterns.Facts({"parent": parent, "age": age})
    rows = lambda text: sorted(tuple(r) for r in f.find(text).collect())
    assert rows("g(?x, ?z) WHERE parent(?x, ?y) AND parent(?y, ?z)") == [("a", "c"), ("a", "d"), ("b", "e")]
    assert rows("g(?z) WHERE parent(?y, ?z) AND age(?z, ?n) AND ?n < 10") == [("c",), ("e",)]
    assert rows('g(?z) WHERE parent("b", ?z) AND NOT age(?z, 5)') == [("d",)]
    assert rows("g(?x) WHERE (parent(?x, _) OR age(?x, _)) AND ?x != \"a\"") == [("b",), ("c",), ("d",), ("e",)]
    assert rows("g(?z) WHERE (up(?z) WHERE parent(?y, ?z) AND parent(?z, ?w))") == [("b",), ("c",)]
    assert rows("count(?z) WHERE parent(?y, ?z)") == [(4,)] and rows("max(?n) WHERE age(?x, ?n)") == [(20,)]
    assert rows("g(?x) WHERE parent(?x, ?x)") == []
    for bad in ("g(?x)", "g(?q) WHERE parent(?x, ?y)", "g(?x) WHERE NOT parent(?x, ?y)", "g(?x) WHERE none(?x)", "g(?x) WHERE parent(?x, ?y) AND age(?u, ?n)", "g(?x) WHERE parent(?x, ?y) AND ?q > 1", "g(?x) WHERE age(?x, 1, 2)", "g(?x WHERE", "g(?x) WHERE parent(?x, ?y) !"):
        with pytest.raises(GoalError):
            f.find(bad)
    assert patterns.Facts({"parent": parent, "age": age}, cross=True).find("g(?x, ?u) WHERE parent(?x, ?y) AND age(?u, ?n)").count() == 9


def test_query_blocks_and_options(spark):
    df = spark.createDataFrame([(1, 20.0, None, None), (2, 70.0, None, None), (3, None, True, None)], "id int, age double, senior boolean, discount int")
    rules = parse_rules('rule "S" no-loop { when P.age > 60 then P.senior = true; } rule "D" no-loop { when P.senior == true then P.discount = 1; }')
    b = backward.Backward(rules, df, roots=("P",))
    assert {r.id: r.depth for r in b.deepened("P.discount == 1", ["id"]).collect()} == {2: 2, 3: 1}
    out = b.execute_all('query "a" { goal: P.senior == true enable-memoization: true } query "n" { goal: count(?x) WHERE P.age == ?x }')
    assert out["n"].first().value == 2 and out["a"].filter("provable").count() == 2 and b.statistics()["kept"] == 1
    b.execute_all('query "a" { goal: P.senior == true enable-memoization: true }')
    assert b.statistics()["hits"] == 1
    b.replace(df.limit(0))
    assert b.statistics() == {"kept": 0, "hits": 0, "misses": 0}
    for bad in ('query "q" { goal: P.age > 1 strategy: "sideways" }', 'query "q" { goal: P.age > 1 colour: 3 }'):
        with pytest.raises(GoalError):
            b.execute(parse_program(bad).queries[0])
    assert {r.why for r in b.query("P.senior == true").select(backward.explained("g").alias("why")).collect()} == set()


def test_facts_as_documents(spark):
    docs = ['{"a": 1, "b": "x"}', '{"a": "no", "b": "y"}', "{}", "not json"]
    rows = memory.facts_from_json(spark, docs, "a int, b string").collect()
    assert [(r.a, r.b) for r in rows][:1] == [(1, "x")] and rows[2].a is None and rows[3].b is None
    back = memory.facts_to_json(spark.createDataFrame([(1, None)], "a int, b string")).first().json
    assert back == '{"a":1}'
    x = memory.from_context(spark, [{"a": 1}, {"a": 2, "c": 9}], "a int, b string")
    assert memory.to_context(x) == [{"a": 1, "b": None}, {"a": 2, "b": None}]
    assert memory.with_fields(x, b="s", a=None).distinct().collect()[0].asDict() == {"a": None, "b": "s"} and memory.without_fields(x, "b").columns == ["a"]
    with pytest.raises(BindError):
        memory.build(spark, "User", colour="red")
    text = spark.createDataFrame([('{"s": "t", "f": true, "n": 1}',), ('{"s": 1, "f": "true"}',), (None,)], "p string")
    assert [tuple(r) for r in text.select(json_text(F.col("p"), "s"), json_flag(F.col("p"), "f")).collect()] == [("t", True), (None, None), (None, None)]


def test_functions_of_objects_and_numbers(spark):
    df = spark.createDataFrame([({"b": 1, "a": 2}, ["x", None, "y"], "-")], "m map<string,int>, a array<string>, s string")
    r = df.select(library.sorted_keys(F.col("m")).alias("k"), library.sorted_values(F.col("m")).alias("v"), library.joined(F.col("a"), F.col("s")).alias("j")).first()
    assert (r.k, r.v, r.j) == (["a", "b"], [2, 1], "x-y")
    good, bad = ["1", "-1.5", "+2e3", ".5", "5.", "inf", "NaN"], ["1d", "0x1", "1 2", "", " 1", "e5", "abc", None]
    n = spark.createDataFrame([(x,) for x in good + bad], "s string").select(library.is_numeric(F.col("s")).alias("n")).collect()
    assert [r.n for r in n] == [True] * len(good) + [False] * len(bad)


def test_profile_and_memory(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "x int")
    rules = parse_rules('rule "a" { when x > 9 then y = 1; } rule "b" { when x == 3 then y = 2; }')
    assert {(r.rule, r.records) for r in catalog.profile(Forward(rules), df).collect()} == {("a", 10), ("b", 1)}
    wm = memory.WorkingMemory(spark)
    assert wm.get_all().count() == 0
    wm.define(memory.Template("T", {"x": ("Integer", True, None)}))
    wm.register_deffacts("d", [("T", spark.createDataFrame([(1,), (None,)], "x long"))])
    with pytest.raises(BindError):
        wm.load_deffacts()
    wm.load_deffacts(skip_invalid=True)
    assert [(r.type, r.fact) for r in wm.get_all().collect()] == [("T", '{"x":1}')]


def test_tables_in_the_shared_folder(spark):
    df = spark.createDataFrame([(1, [1, 2])], "a int, b array<int>").withColumns({"n": F.lit(None), "c.d": F.lit("x")})
    out = storage.table(df, "t")
    assert out.columns == df.columns and out.dtypes == df.dtypes and [tuple(r) for r in out.collect()] == [(1, [1, 2], None, "x")]
    assert storage.table(df.limit(0), "t").count() == 0
