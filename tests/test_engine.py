"""The rule language, its compiler, and the engines, on small frames with nulls, empties and odd values."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from ruleloom.errors import BindError, CatalogError, GoalError, ParseError
from ruleloom.functions import aggregates, library
from ruleloom.lang import ir, printer
from ruleloom.lang.parser import parse_condition, parse_program, parse_rules
from ruleloom.operators import joins, windows
from ruleloom.operators.datastream import DataStream, json_number
from ruleloom.plans import backward, catalog, compiler, registry, tms
from ruleloom.plans.forward import Forward, fused, settles_at_once
from ruleloom.sources import memory, streams
from ruleloom.streaming import state, watermark

TEXT = '''
defmodule M { export: all import: MAIN (rules *) }
rule "A" salience -5 no-loop agenda-group "g" { when (Order.a > 3 && !(b.c == "x;}&&")) || exists(T.f in ["a", 2]) then Order.t = (a + b) * 2 - -1; $X.setY(3); retract($Z); Log("hi"); foo(a, "b"); Order.l += 3; }
// a comment
rule B { when accumulate(Order($v: amt, st == "x"), sum($v)) && x.items count >= 3 && a * 0.9 > b.y && test(isEmail(u.mail)) && e: Click from stream("s") over window(10 min, session) then X.y = 1; }
query "q" { goal: a.b == true && NOT c.d == 1 max-depth: 5 on-success: { x.y = 1; } }
'''


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "abc", 5.0, 7, True, ["x", None]), (2, None, None, None, None, None), (3, "null", 0.0, 0, False, []), (4, "12", 12.0, 12, True, ["y"]), (5, "", -1.5, -2, False, ["x", "y", "z"])]
    return spark.createDataFrame(rows, "id int, s string, n double, i long, b boolean, a array<string>")


def holds(df, text, missing="native"):
    return {r.id for r in df.filter(compiler.condition(parse_condition(text), compiler.Scope(df.schema, missing))).collect()}


def test_parse_and_print_round_trip():
    p = parse_program(TEXT)
    assert [parse_rules(printer.rule(r))[0] for r in p.rules] == p.rules
    assert p.rules[0].salience == -5 and p.modules[0].imports == [("MAIN", [("rules", "*")])] and p.queries[0].options == {"max-depth": 5}
    for bad in ("rule {", 'rule "x" { when a == then b = 1; }', "nonsense", 'rule "x" { when e: T from stream("s") over window(5 years, sliding) then a = 1; }'):
        with pytest.raises(ParseError):
            parse_program(bad)


@pytest.mark.parametrize(
    "text, want",
    [
        ("s == null", {2, 3}), ('s != "abc"', {2, 3, 4, 5}), ("n > 4", {1, 4}), ('s > 10', {4}), ("n <= 0", {3, 5}), ('s contains "b"', {1}), ('s not_contains "b"', {3, 4, 5}), ('s startsWith "a"', {1}), ('s endsWith "2"', {4}),
        ('s matches "a?c"', {1}), ('s matches "*l*"', {3}), ("i in [7, 12]", {1, 4}), ("i in []", set()), ("!(b == true)", {2, 3, 5}), ("n / i > 0.9", {4}), ("(i + 1) * 2 == 16", {1}), ("i == -2", {5}), ("i - -2 == 0", {5}),
        ("a count == 3", {5}), ("a empty", {3}), ("a not_empty", {1, 4, 5}), ('a contains "x"', {1, 5}), ("a $?all", {1, 3, 4, 5}), ("i == 12 && s == i", {4}), ("n == i", {2, 3, 4}), ("b == s", {2}), ("nothing.here == null", {1, 2, 3, 4, 5}),
        ("length(a) == 3", {5}), ('first(a) == "y"', {4}), ('last(a) == "z"', {5}), ("test(isEmpty(a))", {2, 3}), ('uppercase(s) == "ABC"', {1}), ("trim(s) == 12", {4}), ('uppercase(s) != "ABC"', {2, 3, 4, 5}), ('test(contains(a, "x"))', {1, 5}), ("nothing.here > 1", set()), ("test(isNumeric(s))", {4}), ('length(s) == 3', {1}), ("$v : T(n > 4 && b == true)", {1, 4}),
    ],
)
def test_conditions(odd, text, want):
    assert holds(odd, text) == want


def test_missing_semantics(odd):
    assert holds(odd, "n != 5", "backward") == {2, 3, 4, 5} and holds(odd, "n != 5", "rete") == {3, 4, 5} and holds(odd, "n == 5", "rete") == {1}
    with pytest.raises(BindError):
        holds(odd, "test(noSuch(s))")


def test_functions(odd, spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    A, L = library.ACTIONS, F.lit
    assert one(A["Divide"](L(1), L(0))) is None and one(A["Round"](L(-2.5))) == -3 and one(library.FUNCTIONS["repeat"](L("a"), L(2000))) is None
    assert one(library.FUNCTIONS["dayOfWeek"](L("2024-01-07"))) == 7 and one(library.FUNCTIONS["year"](L("31/12/2023"))) == 2023 and one(library.format_date(L("2024-02-03"), "%d/%m")) == "03/02"
    assert one(library.is_email(L("a@b.co"))) and not one(library.is_phone(L("123"))) and one(library.is_numeric(L("1e3"))) and not one(library.is_numeric(L(" 1")))
    assert one(library.format_text(L("{0}-{1}"), L(1), L("x"))) == "1-x" and one(library.number_text(L(12.0))) == "12" and one(library.trim(L(" x "))) == "x"
    m = library.object_merge(F.create_map(L("a"), L(1), L("b"), L(2)), F.create_map(L("b"), L(3)))
    assert one(m) == {"a": 1, "b": 3} and one(json_number(L('{"k": "5", "j": 5}'), "j")) == 5.0 and one(json_number(L('{"k": "5"}'), "k")) is None


def test_aggregates_of_nothing(odd):
    e = odd.filter("false")
    row = lambda fam, f: e.agg(fam[f](F.col("n")).alias("v")).first().v
    assert [row(aggregates.STREAM, f) for f in ("count", "sum", "average", "min")] == [0.0, 0.0, None, None]
    assert [row(aggregates.ACCUMULATE, f) for f in ("sum", "average", "min", "max", "count")] == [0.0, 0.0, 0.0, 0.0, 0]
    assert [row(aggregates.GOAL, f) for f in ("count", "sum", "avg", "min")] == [0, 0.0, 0.0, None]
    assert odd.filter("id = 1").agg(aggregates.std_dev(F.col("n")).alias("v")).first().v is None


def test_forward_sees_writes_cycles_and_groups(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, 50), (3, 0, None)], "id int, x int, y int")
    rules = parse_rules("""rule "second" salience 1 no-loop { when x == 1 then x = x + 10; z = "s"; }
        rule "first" salience 2 no-loop { when y > 10 then x = 1; }""")
    assert {r.id: (r.x, r.z) for r in Forward(rules).run(df).collect()} == {1: (0, None), 2: (11, "s"), 3: (0, None)}
    loop = parse_rules('rule "up" { when x < 3 then x = x + 1; }')
    assert [r.x for r in Forward(loop).run(df).orderBy("id").collect()] == [3, 3, 3]
    forever = parse_rules('rule "up" { when y > 0 then x = x + 1; }')
    assert [r.x for r in Forward(forever).run(df, max_cycles=4).orderBy("id").collect()] == [4, 4, 0]
    xor = parse_rules('rule "a" salience 2 no-loop activation-group "g" { when y > 1 then z = "a"; } rule "b" no-loop activation-group "g" { when y > 1 then z = "b"; }')
    assert [r.z for r in Forward(xor).run(df, max_cycles=1).orderBy("id").collect()] == ["a", "a", None]
    dated = parse_rules('rule "d" no-loop date-effective "2024-01-01" date-expires "2024-02-01" { when x == 0 then z = 1; }')
    assert Forward(dated).run(df, as_of=dt.datetime(2024, 2, 1)).columns == df.columns
    with pytest.raises(BindError):
        Forward(parse_rules('rule "x" { when x == 0 then NoSuch(x); }')).run(df)


def test_forward_fused_or_not_is_the_same(spark):
    text = "\n".join(f'rule "r{i}" salience {i % 3} no-loop {{ when y > {i} && x{i % 2} == 0 then x{(i + 1) % 3} = {i}; w{i} = x0 + 1; }}' for i in range(12))
    df = spark.createDataFrame([(i, 0, 0, 0, i) for i in range(15)], "id int, x0 int, x1 int, x2 int, y int")
    one, two = (Forward(parse_rules(text), fuse=f).run(df).orderBy("id").collect() for f in (True, False))
    assert one == two
    assert len(fused(parse_rules('rule a { when x == 1 then p = 1; } rule b { when x == 1 then q = 1; } rule c { when p == 1 then r = 1; }'))) == 2
    assert settles_at_once(parse_rules("rule a no-loop { when x == 1 then p = 1; }")) and not settles_at_once(parse_rules("rule a no-loop { when p == 1 then p = 2; }"))


def test_forward_structs_quantifiers_effects(spark):
    df = spark.createDataFrame([(1, ("gold", 5.0), ("open",))], "id int, Customer1 struct<tier:string,spent:double>, Order1 struct<status:string>")
    rules = parse_rules("""rule "q" no-loop salience 3 { when exists(Customer.tier == "gold") && forall(Order.status == "open") && !exists(Order.status == "x") && forall(Nothing.a == 1) then Customer1.spent = Customer1.spent * 2; System.found = true; }
        rule "m" no-loop { when System.found == true then $Customer1.settier("vip"); Log("done"); tags += "t"; retract($Order1); SetWorkflowData(k = "v"); ScheduleRule(5, "later"); CompleteWorkflow("w"); }
        rule "r" no-loop salience -1 { when Order1.status == "open" then tags += "no"; }""")
    r = Forward(rules).run(df, audit=True).first()
    assert (r.Customer1.tier, r.Customer1.spent, r.System.found, r.tags, r.log, r.retracted_Order1, r.workflow, r.scheduled) == ("vip", 10.0, True, ["t"], ["done"], True, {"k": "v", "w.complete": "true"}, ["later"])
    assert r["fires_r"] == 0
    e = spark.createDataFrame([], "k int, v double")
    acc = parse_rules('rule "a" no-loop { when accumulate(T($v: v), avg($v)) then out = T_avg; }')
    assert Forward(acc, facts={"T": e}).run(df).first().out == 0.0


def test_backward(spark):
    df = spark.createDataFrame([(1, 20.0, None), (2, 70.0, None), (3, None, True)], "id int, age double, senior boolean")
    rules = parse_rules('rule "S" no-loop { when P.age > 60 then P.senior = true; } rule "D" no-loop { when P.senior == true then P.discount = 1; }')
    b = backward.Backward(rules, df, roots=("P",))
    q = {r.id: r for r in b.query("P.discount == 1").collect()}
    assert [q[i].provable for i in (1, 2, 3)] == [False, True, True] and q[2].proof == ["S", "D"] and q[3].proof == ["D"] and q[1].missing == ["P.discount == 1"]
    assert {r.id for r in b.solutions("NOT P.senior == true").collect()} == {1} and "fails" in backward.explain(q[1], "g")
    assert b.aggregate("count(?x) WHERE P.age == ?x AND P.age > 10").first().value == 2 and b.aggregate("min(?x) WHERE P.age == ?x AND P.age > 100").first().value is None
    assert b.query("P.senior == true").count() == 3 and len(backward.candidates(parse_condition("P.senior == true"), rules)) == 1
    assert backward.proof_edges(b.query("P.discount == 1"), "id", rules).filter("id = 2").count() == 2
    reach = backward.reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int"), "a", "b")
    assert reach.count() == 9


def test_truth_maintenance(spark):
    facts = spark.createDataFrame([("a", True), ("b", False), ("c", False), ("d", False), ("p", True)], "fact_id string, explicit boolean")
    just = spark.createDataFrame([("1", "b", "a"), ("2", "c", "a"), ("3", "d", "b"), ("4", "d", "c"), ("5", "c", "p")], "just_id string, fact_id string, premise_id string")
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "fact_id string")
    assert {(r.fact_id, r.round) for r in tms.cascade(facts, just, of("a")).collect()} == {("a", 0), ("b", 1)}
    assert {r.fact_id for r in tms.standing(facts, just, of("a", "p")).collect()} == set()
    assert tms.statistics(facts, just).first().justifications == 5


def test_windows_and_watermarks(spark):
    rows = [(1, 0), (2, 500), (3, 10_000), (4, 4_000), (5, 30_000), (6, 19_999)]
    e = spark.createDataFrame(rows, "event_id long, ms long").withColumns({"ts": F.timestamp_millis("ms"), "k": F.lit("a"), "value": F.col("ms").cast("double")})
    want = {}
    for start in range(0, 30_001, 5_000):
        n = sum(start <= ms < start + 10_000 for _, ms in rows)
        want |= {start: n} if n else {}
    got = {r.window_start: r["count"] for r in DataStream(e).sliding(10_000).counts().collect()}
    assert got == want
    assert sorted(r["count"] for r in windows.sessions(e, "ts", 6_000, ["k"]).collect()) == [1, 1, 4]
    late = {r.event_id: r.is_late for r in watermark.flagged(e, "ts", 5_000, "event_id", bucket=2).collect()}
    assert late == {1: False, 2: False, 3: False, 4: True, 5: False, 6: True}
    stats = watermark.late_stats(watermark.flagged(e, "ts", 5_000, "event_id"), "ts", 2_000).first()
    assert tuple(stats) == (2, 1, 1)
    assert windows.trend(DataStream(e).tumbling(10_000).df, "value").first().trend == "Increasing"
    assert {(r.window_start, r["count"]) for r in windows.first_fit(e, "ts", 10_000, "k", "event_id").collect()} == {(0, 2), (10_000, 1), (4_000, 1), (30_000, 1), (19_999, 1)}
    assert DataStream(e.filter("false")).all("value > 0").first().value is True and DataStream(e.filter("false")).any("value > 0").first().value is False


def test_joins(spark):
    e = spark.createDataFrame([(1, "u", 1000), (2, "u", 1005), (3, None, 1000), (4, "v", 9000)], "id long, k string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    ids = lambda df: {(r.l_id, r.r_id) for r in df.collect()}
    assert ids(joins.interval_join(e, e, ["k"], "ts", 10, order="before")) == {(1, 2)}
    assert (3, None) in ids(joins.interval_join(e.filter("id <> 4"), e.filter("id = 2"), ["k"], "ts", 10, "left_outer"))
    P = joins.Pattern
    assert joins.match_all(P(e).bind(a="id"), P(e).bind(b="id").where_var("id", ">", "zz")).count() == 0
    m = joins.JoinManager()
    m.register("j", "e", "e", keys=["k"], time="ts", ms=10)
    assert m.run({"e": e})["j"].count() == 5 and m.of_stream("e") == ["j"]


def test_streaming_queries(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i, "u" + str(i % 2), 1_000_000 + i * 1000, float(i)) for i in range(20)]
    spark.createDataFrame(rows, "event_id long, user string, ms long, value double").withColumn("ts", F.timestamp_millis("ms")).drop("ms").write.parquet(src)
    stream = spark.readStream.schema("event_id long, user string, value double, ts timestamp").parquet(src)

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    w = windows.tumbling(watermark.strategy(stream, "ts", "bounded", 1000), "ts", 5000).groupBy("window_start").agg(F.count(F.lit(1)).alias("n"))
    assert {r.window_start: r.n for r in drain(w, "w", "complete")} == {1_000_000: 5, 1_005_000: 5, 1_010_000: 5, 1_015_000: 5}

    def total(held, event):
        held["sum"] = held.get("sum", 0.0) + event["value"]
        return {"event_id": event["event_id"], "total": held["sum"]}

    out = drain(state.stateful(stream, "user", total, "event_id long, total double"), "totals")
    assert len(out) == 20 and max(r.total for r in out) == sum(range(1, 20, 2))
    one, two = watermark.strategy(stream, "ts", "bounded", 1000), watermark.strategy(stream, "ts", "bounded", 1000)
    assert len(drain(joins.interval_join(one.filter("event_id < 3"), two.filter("event_id < 4"), ["user"], "ts", 2000), "j")) == 6


def test_running_total_over_parts_in_any_order(spark, tmp_path):
    """A user's events lie in several files and come in several parts, the later ones first."""
    rows = [(i, i % 3, None if i % 3 == 0 and i < 30 or i % 10 == 9 else float(i * 7919 % 500) / 4) for i in range(240)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    for k in range(4):
        df.filter(F.col("event_id") % 4 == 3 - k).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    keep = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(keep)
    spark.conf.set(keep, 7)
    try:
        got = {r.event_id: (r.running, r.n) for r in registry.QUERIES["state_running_total"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(keep, held)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {i: (total, n) for i, total, n in con.execute(registry.SQL["state_running_total"]).fetchall()} and got[0] == (None, 1)


def test_state_meets_batches_and_ordered_parts(spark, tmp_path):
    """State goes on from batch to batch; within one, a key's events come in order."""
    src, ddl = str(tmp_path / "in"), "k long, at long, v long"
    for batch in (range(50, 90), range(40)):
        spark.createDataFrame([(0, -i, i) for i in batch], ddl).repartition(3).write.mode("append").parquet(src + f"/{batch.start == 0:d}")

    def step(held, rows):
        assert rows["at"].is_monotonic_increasing
        n = (held or (0,))[0] + 1
        return (n,), rows.assign(n=n)[["v", "n"]]

    stream = streams.read_events(spark, f"{src}/*", spark.read.schema(ddl).parquet(f"{src}/*").schema, files_per_batch=2)
    out = streams.drained(state.stateful_batches(stream, "k", step, "v long, n long", "n long", order=["at"])).collect()
    assert sorted(r.v for r in out) == [*range(40), *range(50, 90)] and {r.n for r in out} == {1, 2, 3}


def test_state_table(spark, tmp_path):
    of = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    s = state.StateTable.empty(spark).put(of(("a", "1"), ("b", "2")), 0, 100).update(of(("a", "3")), 50)
    assert {(r.key, r.value) for r in s.live(99).collect()} == {("a", "3"), ("b", "2")} and s.live(100).count() == 0
    with pytest.raises(CatalogError):
        s.update(of(("a", "4")), 200)
    s = s.put(of(("a", "5")), 90, 100).cleanup(120)
    s.checkpoint(str(tmp_path / "s"))
    assert [r.value for r in state.StateTable.restore(spark, str(tmp_path / "s")).df.collect()] == ["5"] and s.statistics(500).first().expired == 1


def test_working_memory_and_catalog(spark):
    wm = memory.WorkingMemory(spark)
    wm.define(memory.Template("P", {"name": ("String", True, None), "n": ("Integer", False, 7)}))
    p = spark.createDataFrame([("a",), ("b",)], "name string")
    wm.register_deffacts("d", [("P", p)])
    wm.load_deffacts()
    assert {r.n for r in wm.get("P").collect()} == {7}
    gone = wm.get("P").filter("name = 'a'").select("fact_id")
    wm.retract("P", gone)
    assert wm.get("P").count() == 1
    with pytest.raises(CatalogError):
        wm.retract("P", gone)
    with pytest.raises(BindError):
        wm.insert("P", spark.createDataFrame([(None,)], "name string"))
    assert memory.template_from_json(memory.template_to_json(wm.templates["P"])) == wm.templates["P"]
    assert [f.dataType.simpleString() for f in memory.inferred(spark.createDataFrame([("1", "1.5", "true", "x"), (None, "2", "false", "1")], "a string, b string, c string, d string")).schema] == ["bigint", "double", "boolean", "string"]
    g = memory.Globals()
    g.define("x", 1, read_only=True)
    with pytest.raises(CatalogError):
        g.increment("x")
    kb = catalog.KnowledgeBase("k")
    assert kb.add_text(TEXT) == 2 and parse_rules(kb.export()) and kb.statistics()["version"] == 2
    with pytest.raises(CatalogError):
        kb.add_text('rule "A" { when x == 1 then y = 1; }')
    m = catalog.Modules()
    m.define(ir.ModuleDef("A", "a*"))
    m.define(ir.ModuleDef("B", "none", [("A", [("rules", "*")])]))
    m.add_rule("A", "ab"), m.add_rule("A", "x")
    assert m.visible("B") == ["ab"] and m.validate() == []
    with pytest.raises(CatalogError):
        m.define(ir.ModuleDef("C", "all", [("C", [])]))
    with pytest.raises(CatalogError):
        catalog.RuleTemplate("rule {{x}}").build()
    r = parse_rules('rule a { when x > 5 && y == "q" then z = 1; } rule b { when z == 1 then x = 2; }')
    assert catalog.coverage_facts(r[0])[:3] == [{"x": 5}, {"x": 4}, {"x": 6}] and catalog.dependency_report(r) == [("a", "b", ["x", "z"])] and [x.name for x in catalog.ordered(r, "depth")] == ["b", "a"]


def test_plugins_reports_and_caches(spark, odd):
    p = catalog.Plugins(limit=2)
    p.load(catalog.Plugin("base", functions={"twice": lambda c: c * 2}))
    p.load(catalog.Plugin("more", needs=("base",)))
    for bad in (lambda: p.load(catalog.Plugin("base")), lambda: p.load(catalog.Plugin("third")), lambda: p.unload("base"), lambda: p.unload("none"), lambda: p.reload(catalog.Plugin("none"))):
        with pytest.raises(CatalogError):
            bad()
    rules = parse_rules("rule hit { when twice(i) == 24 then n = 1; } rule never no-loop { when i > 1000 then n = 2; } rule every no-loop { when id > 0 then b = true; }")
    out = Forward([rules[0]], **p.parts()).run(odd)
    assert {r.id: r.n for r in out.collect()}[4] == 1
    p.unload("more"), p.unload("base")
    with pytest.raises(BindError):
        Forward([rules[0]], **p.parts()).run(odd)
    audited = Forward(rules[1:]).run(odd, audit=True)
    assert {(r.rule, r.advice) for r in catalog.recommendations(catalog.rule_metrics(audited), 5).collect()} == {("never", "never fires"), ("every", "fires on every record")}
    now, built = [0.0], []
    cache = catalog.CachedAggregates(10, lambda: now[0])
    count = lambda: built.append(1) or odd.agg(F.count("*").alias("n"))
    assert cache.get("n", count).n == cache.get("n", count).n == 5 and len(built) == 1
    now[0] = 10.0
    assert cache.get("n", count).n == 5 and len(built) == 2
    t = catalog.RuleTemplate("rule {{x}} { when a > {{n}} then b = 1; }", {"n": 3})
    again = catalog.RuleTemplate.from_json(t.to_json())
    assert again.build(x="q") == t.build(x="q")
    assert sorted(r.name for r in catalog.ordered(rules, "random", 1)) == ["every", "hit", "never"] and catalog.ordered(rules, "random", 1) == catalog.ordered(rules, "random", 1)


def test_proof_documents_and_limits(odd):
    b = backward.Backward(parse_rules('rule up { when i > 5 then tier = "hi"; }'), odd.withColumn("tier", F.lit(None).cast("string")))
    goal = 'tier == "hi"'
    assert b.query(goal, max_solutions=1).count() == 1 and b.query(goal).count() == 5
    rows = {r.id: r for r in b.query(goal).collect()}
    assert '"rules": ["up"]' in backward.export_proof(rows[1], goal) and "1. up" in backward.export_proof(rows[1], goal, "markdown")
    assert backward.export_proof(rows[2], "a < b", "html").startswith("<h2>a &lt; b</h2><p>Not proven")


def test_snapshots_and_windows_across(spark, tmp_path):
    s = state.StateTable.empty(spark).put(spark.createDataFrame([("a", "1")], "key string, value string"), 0, 10)
    root = f"file://{tmp_path}/s"
    for i in range(4):
        s.snapshot(root, i, keep=2)
    found = state.snapshots(spark, root)
    assert [x[-1] for x in found] == ["2", "3"] and state.StateTable.restore(spark, found[-1]).df.count() == 1
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [tuple(r) for r in s.get(keys, 5).collect()] == [("a", "1")] and s.get(keys, 10).isEmpty()
    df = spark.createDataFrame([(0, "x", 1.0), (0, "y", 2.0), (5, "x", None)], "window_start long, event_type string, v double")
    assert tuple(windows.across(df, "v").first()) == (2, 3, 3.0, 3.0, 3.0) and tuple(windows.across(df.limit(0), "v").first()) == (0, 0, None, None, None)
    assert {r.window_start for r in windows.with_event_type(df, "y").collect()} == {0}


def test_reachable_is_whole_or_says_so(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(5, 4)], "a long, b long").coalesce(1)
    got = {(r.source, r.target): r.depth for r in backward.reachable(chain, "a", "b").collect()}
    assert got == {(i, j): j - i for i in range(6) for j in range(i + 1, 6)} | {(5, 4): 1, (4, 4): 2, (5, 5): 2}
    assert backward.reachable(chain, "a", "b", max_depth=5).count() == len(got)
    with pytest.raises(GoalError):
        backward.reachable(chain, "a", "b", max_depth=4)
