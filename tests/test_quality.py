import json
import random

import pytest
from pyspark.sql import functions as F

from crawlspark.operators import quality as Q
from crawlspark.plans.record_plan import validate_lines
from crawlspark.schema import RECORD_FIELDS
from crawlspark.sources import readers, sinks


def good(i, **more):
    return {"title": "Engineer", "job_id": str(i), "url": f"https://e.com/{i}", "country_code": "IN", **more}


SETS = {
    "pass": [good(1), good(2, title="Café Coordinator")],
    "all_null_codes": [good(1, country_code=None)],
    "foreign": [good(1), good(2, country_code="US")],
    "half_title": [good(1), good(2, title=None)],
    "few_titles": [good(1), good(2, title=None), good(3, title=None)],
    "no_url": [good(1, url=None)],
    "damaged": [good(1, job_description="Indiaâ€™s growth")],
    "replacement": [good(1, city="Engineer�")],
    "number": [good(1), good(2), {**good(3), "job_id": 5}],
    "array": [[1]],
    "extra": [{**good(1), "anything": {"n": 1}}],
    "exact": [good(i) for i in range(8)],
    "short": [good(i) for i in range(7)],
    "dirty_script": [good(1)],
}
EXPECTED = {
    "pass": None, "all_null_codes": None, "foreign": "zero_results_filter_mismatch", "half_title": None,
    "few_titles": "schema_drift", "no_url": "schema_drift", "damaged": "mojibake_encoding",
    "replacement": "mojibake_encoding", "number": "schema_drift", "array": "schema_drift", "extra": None,
    "exact": None, "short": "pagination_undercount", "dirty_script": "contains_regex", "broken": "schema_drift",
    "empty": "zero_results_parsing_bug", "missing": "runtime_error",
}


@pytest.fixture(scope="module")
def report(spark):
    lines = []
    for name, records in SETS.items():
        lines += [(name, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
    lines += [("broken", 0, "  "), ("broken", 1, json.dumps(good(1))), ("broken", 2, ""), ("broken", 3, "{bad"), ("broken", 4, "{worse")]
    lines += [("empty", 0, "   ")]
    df = spark.createDataFrame(lines, "set_id string, line_no int, line string").repartition(4)
    totals = {"exact": 10, "short": 10}
    sets = spark.createDataFrame(
        [(n, totals.get(n), n != "dirty_script", n != "missing") for n in EXPECTED],
        "set_id string, reported_total long, script_clean boolean, output_found boolean",
    )
    return {r.set_id: r for r in validate_lines(df, ["set_id"], sets).collect()}


def test_categories(report):
    assert {n: r.failure_category for n, r in report.items()} == EXPECTED
    assert all(r.passed == (r.failure_category is None) for r in report.values())


def test_details(report):
    assert report["number"].details == "Line 2 does not parse as a record."
    assert report["broken"].details == "Line 1 does not parse as a record."
    assert report["array"].details == "Line 0 does not parse as a record."
    assert report["short"].details == "Got 7 rows of 10."
    assert report["foreign"].details.endswith("US")
    assert report["few_titles"].details.startswith("Required field 'title'")
    assert report["pass"].details == "All checks passed."


def test_facts_show_only_as_far_as_the_checks_got(report):
    assert report["number"].row_count == 0 and report["number"].non_null_field_rates is None
    assert report["short"].row_count == 7 and report["short"].non_null_field_rates is None
    assert report["foreign"].all_country_code_allowed is False
    assert report["half_title"].non_null_field_rates["title"] == 0.5
    assert report["half_title"].all_country_code_allowed is True
    assert report["few_titles"].all_country_code_allowed is None


def records(spark, rows):
    data = [(s, i, *[r.get(f) for f in RECORD_FIELDS]) for s, i, r in rows]
    fields = ", ".join(f"{f} string" for f in RECORD_FIELDS)
    return spark.createDataFrame(data, f"set_id string, pos int, {fields}")


def test_field_confidence(spark):
    df = records(spark, [
        ("s", 0, {"job_id": "1", "title": "old", "city": "x"}), ("s", 1, {"job_id": "1", "title": "new"}),
        ("s", 2, {"job_id": "", "title": "t"}), ("s", 3, {"title": None}),
    ])
    got = {(r.record_key, r.field): r.confidence for r in Q.field_confidence(df, ["set_id"], "pos").collect()}
    assert {k for k, _ in got} == {"1", "_row_2", "_row_3"} and len(got) == 3 * len(RECORD_FIELDS)
    assert got["1", "title"] == 0.75 and got["1", "city"] == 0.0 and got["_row_3", "title"] == 0.0
    assert got["_row_2", "job_id"] == 0.75


def test_spot_check(spark):
    df = records(spark, [
        *[("ok", i, {"url": u}) for i, u in enumerate(["a", None, "b", "dead"])],
        ("get", 0, {"url": "refuses_head"}), ("bad", 0, {"url": "dead"}), ("unknown", 0, {"url": "zzz"}), ("none", 0, {"url": ""}),
    ])
    status = spark.createDataFrame(
        [("a", 200, None), ("b", 301, None), ("dead", 404, 404), ("refuses_head", 405, 200)],
        "url string, head_status int, get_status int",
    )
    got = {r.set_id: r.spot_check_ok for r in Q.spot_check(df, ["set_id"], "pos", status).collect()}
    assert got == {"ok": True, "get": True, "bad": False, "unknown": False, "none": True}


def test_record_lines_roundtrip(spark, tmp_path):
    df = records(spark, [("s", 0, {"title": "é\"x", "job_id": "1"}), ("s", 1, {})])
    sinks.write_record_lines(df, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert all(list(x) == list(RECORD_FIELDS) for x in lines)
    assert {x["title"] for x in lines} == {"é\"x", None}
    raw = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    assert "é" in raw


def test_exchanges(spark):
    raw = spark.createDataFrame(
        [
            (1, "https://x/GraphQL?a=1&a=2&b=", "post", '{"q":1}', "[1]"),
            (2, "https://x/api", None, '{"query":"q","variables":{}}', "<html>"),
            (3, "https://x/api", "Get", "a=1", None),
            (4, "https://x/api", "put", "", "{}"),
            (5, "https://x/api", "put", "[1]", "{}"),
        ],
        "i int, url string, method string, request_body string, body string",
    )
    got = {r.i: r for r in readers.exchanges(raw).collect()}
    assert got[1].query_params == {"a": ["1", "2"]}
    assert [got[i].method for i in range(1, 6)] == ["POST", "GET", "GET", "PUT", "PUT"]
    assert [got[i].body_type for i in range(1, 6)] == ["graphql", "graphql", "form", None, "json"]
    assert got[1].response_json == "[1]" and got[2].response_json is None and got[3].json_body is None


def test_pages_keep_failures(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 200, "<p>")], "url string, status int, html string")
    assert [tuple(r) for r in readers.pages(df).orderBy("url").collect()] == [("a", 0, ""), ("b", 200, "<p>")]


@pytest.mark.parametrize("width", [1, 3, 8192])
def test_line_facts_equal_plain_counts(spark, width):
    """First bad line, lines ahead of it, rates and codes, for chunks of any width; null keys and numbers, ties."""
    rng = random.Random(5)
    rows = []
    for s in ("a", "b", "c", None):
        for n in rng.sample(range(40), 25) + [7, 7, None]:
            rows.append((s, n, rng.random() < (0 if s == "c" else 0.1), rng.choice(["IN", "FR", "US", None]), rng.choice(["x", None])))
    typed = spark.createDataFrame(rows, "s string, line_no long, is_bad boolean, country_code string, title string")
    typed = typed.unionByName(typed.limit(0))
    got = {r.s: r for r in Q.line_facts(typed, ["s"], ["IN"], ["country_code", "title"], width=width).collect()}
    assert set(got) == {"a", "b", "c", None}
    for s, r in got.items():
        mine = [x for x in rows if x[0] == s]
        bad = min((x[1] for x in mine if x[2] and x[1] is not None), default=None)
        ahead = None if bad is None else sum(x[1] is not None and x[1] < bad for x in mine)
        assert (r.row_count, r.bad_at, r.lines_ahead) == (len(mine), bad, ahead)
        assert r._rate_title == sum(x[4] is not None for x in mine) / len(mine)
        assert r.offending_codes == sorted({x[3] for x in mine} - {"IN", None})
    assert Q.line_facts(typed.limit(0), ["s"], ["IN"], ["country_code", "title"]).count() == 0


def test_lines_are_read_once(spark, tmp_path):
    spark.createDataFrame([("s", 1, "{}")], "set_id string, line_no long, line string").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    plan = validate_lines(lines, ["set_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
