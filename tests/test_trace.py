import json

from pyspark.sql import functions as F

from crawlspark.operators import evidence as E
from crawlspark.operators import keyed as K
from crawlspark.operators import trace as TR
from crawlspark.plans.record_plan import validate_lines
from crawlspark.sources import readers, sinks
from crawlspark.streaming import trace_stream as TS


def line(value, **event):
    return value(TR.console_line(F.lit(json.dumps(event, ensure_ascii=False))))


def test_console_lines(value):
    assert line(value, type="node_enter", node="discover") == ">>> discover"
    assert line(value, type="node_exit", node="discover") is None
    assert line(value, type="something_new", node="x") is None
    assert line(value, type="decision", node="n", action="a", rationale="found 4 links") == "    [n] DECISION a: found 4 links"
    assert line(value, type="tool_result", tool="fetch", error="boom") == "    [-] <- fetch ERROR: boom"
    assert line(value, type="tool_result", node="n", tool="t", domain="d", timestamp=1.0, status=200, ok=True, none=None) == (
        "    [n] <- t: status=200, ok=True")
    assert line(value, type="tool_call", node="n", tool="t") == "    [n] -> t()"
    long = line(value, type="tool_call", node="n", tool="t", input="x" * 200)
    assert long == "    [n] -> t(" + "x" * 159 + "…)"
    assert line(value, type="evidence", node="n", source_type="rest_api", pagination_status="confirmed", sufficient=True, confidence=0.9) == (
        "    [n] EVIDENCE source_type=rest_api pagination_confirmed=confirmed sufficient=True confidence=0.9")
    assert line(value, type="code_generated", node="n", revision=2, mode="patch", path="p") == "    [n] CODE revision=2 mode=patch -> p"
    assert line(value, type="execution", node="n", exit_code=0, duration=1.5, timed_out=False) == (
        "    [n] EXEC exit_code=0 duration=1.5s timed_out=False")
    assert line(value, type="validation", node="n", passed=False, row_count=3, failure_category="timeout") == (
        "    [n] VALIDATE passed=False rows=3 category=timeout")
    assert line(value, type="repair_decision", node="n", action="patch", repair_attempt=1) == (
        "    [n] REPAIR action=patch category=None attempt=1")
    assert value(TR.console_line(F.lit("no json"))) is None


def test_costs(spark):
    events = spark.createDataFrame(
        [
            ("d", "r", "tool_result", None, None, 10, 5, 100, 90), ("d", "r", "tool_result", None, None, 7, None, 50, 60),
            ("d", "r", "tool_result", None, None, None, None, None, 60), ("d", "r", "evidence", False, None, None, None, None, None),
            ("d", "r", "repair_decision", None, None, None, None, None, None), ("d", "r", "validation", None, True, None, None, None, None),
            ("d", "q", "evidence", True, None, None, None, None, None),
        ],
        "domain string, run_id string, type string, sufficient boolean, passed boolean, tokens_prompt int, "
        "tokens_completion int, credits_before int, credits_after int",
    )
    got = {r.run_id: r for r in TR.cost_report(events).collect()}
    r = got["r"]
    assert (r.status, r.repair_attempts, r.total_attempts_used, r.tokens_prompt, r.tokens_completion, r.credits_used) == (
        "success", 1, 2, 17, 5, 10)
    assert (got["q"].status, got["q"].total_attempts_used) == ("failed", 0)


def test_artifact_numbers_grow_past_three_digits(spark):
    df = spark.range(1200).select(F.lit("d").alias("domain"), F.col("id").alias("seq"), F.lit("page.html").alias("name"))
    out = TR.artifact_index(df, "domain", [F.col("seq")], K.span(F.col("seq"), 100))
    names = {r.seq: r.artifact_name for r in out.collect()}
    assert (names[0], names[999], names[1199]) == ("001_page.html", "1000_page.html", "1200_page.html")


def test_trace_sink_and_stream(spark, tmp_path):
    events = spark.createDataFrame(
        [("d1", "r1", "tool_result", 5, None), ("d1", "r1", "decision", None, "why"), ("d2", "r2", "tool_result", 7, None)],
        "domain string, run_id string, type string, tokens_prompt int, rationale string",
    )
    path = str(tmp_path / "trace")
    sinks.append_trace(events, path)
    sinks.append_trace(events, path)
    folders = {p.parent.relative_to(tmp_path).as_posix() for p in (tmp_path / "trace").rglob("*.json")}
    assert folders == {"trace/by_domain=d1/by_run_id=r1", "trace/by_domain=d2/by_run_id=r2"}
    text = "".join(p.read_text() for p in (tmp_path / "trace").rglob("*.json"))
    assert "null" not in text and text.count("\n") == 6

    totals = TS.running_cost(TS.trace_stream(spark, path, files_per_trigger=1))
    q = TS.append_batches(totals, str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    q.awaitTermination()
    schema = "domain string, run_id string, tokens_prompt long, tokens_completion long, batch_id long"
    got = {r.run_id: r.tokens_prompt for r in TS.latest(spark, str(tmp_path / "out"), schema, ["domain", "run_id"]).collect()}
    assert got == {"r1": 10, "r2": 14}


def test_trace_keeps_extra_members_and_drops_what_is_no_event(spark):
    lines = spark.createDataFrame(
        [('{"timestamp":1.5,"domain":"d","type":"decision","action":"x","n":{"a":1}}',), ('{"domain":"d"}',), ("broken",)], "value string"
    )
    (r,) = readers.trace(lines).select("timestamp", "type", F.try_variant_get("extras", "$.n.a", "int").alias("a")).collect()
    assert tuple(r) == (1.5, "decision", 1)


def test_live_attempts_match_batch_when_events_arrive_out_of_order(spark, tmp_path):
    bad = ("u", "spa_no_api", "unknown", None, "f", None)
    good = ("u", "rest_api", "confirmed", "p", "f", None)
    plan = {"r": [bad, bad, good, good, bad, bad, bad], "q": [bad, good]}
    rows = [(run, i, *facts) for run, seq in plan.items() for i, facts in enumerate(seq, 1)]
    schema = (
        "run_id string, attempt long, careers_url string, source_type string, pagination_status string, "
        "pagination_mechanism string, india_filter_mechanism string, reported_total_count long"
    )
    df = spark.createDataFrame(rows, schema)
    # Later attempts first, over three files and so three batches.
    for n, part in enumerate([df.where("attempt > 4"), df.where("attempt in (2, 4)"), df.where("attempt in (1, 3)")]):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    live = TS.live_attempts(stream.json(str(tmp_path / "in")), 3)
    TS.append_batches(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.schema("run_id string, attempt long, stagnant boolean, attempts_left long, exhausted boolean")
    got = out.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))

    batch = E.stagnation(df, ["run_id"]).withColumn("kind", F.lit("evidence"))
    want = E.attempt_budget(batch, ["run_id"], [F.col("attempt")], F.lit(0), 3)
    columns = ["run_id", "attempt", "stagnant", "attempts_left", "exhausted"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_record_sets_over_several_batches_equal_the_batch_report(spark, tmp_path):
    good = '{"title":"a","job_id":"1"}'
    rows = [(1, 1, good), (1, 2, good), (2, 1, good), (2, 2, "broken"), (None, 1, good), (1, 3, '{"title":"b"}'), (2, 3, good), (None, 2, "[")]
    lines = spark.createDataFrame(rows, "set_id long, line_no long, line string")
    for n in (1, 2, 3):
        lines.where(F.col("line_no") == n).coalesce(1).write.json(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    TS.check_record_sets(stream.json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["set_id"], ("title",)).awaitTermination()
    schema = "set_id long, passed boolean, row_count long, failure_category string, details string, batch_id long"
    got = TS.latest(spark, str(tmp_path / "out" / "reports"), schema, ["set_id"])
    want = validate_lines(lines, ["set_id"], required=("title",))
    columns = ["set_id", "passed", "row_count", "failure_category", "details"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert spark.read.parquet(str(tmp_path / "out" / "reports")).select("batch_id").distinct().count() == 3
    assert not {"line", "title"} & set(spark.read.parquet(str(tmp_path / "out" / "facts")).columns)
