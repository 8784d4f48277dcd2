import json

from pyspark.sql import functions as F

from crawlspark.functions import payload as J
from crawlspark.functions import replies as R
from crawlspark.functions.jsontext import is_json

L = F.lit


def found(value, payload):
    items = value(J.record_list(L(payload if isinstance(payload, str) else json.dumps(payload))))
    return None if items is None else [json.loads(i) for i in items]


def test_flat_and_relay(value):
    flat = [{"id": 1, "title": "Engineer"}, {"id": 2, "title": "Manager"}]
    assert found(value, {"jobs": flat}) == flat
    edges = [{"node": {"id": "1", "title": "E"}}, {"x": 1}, {"node": None}, {"node": {"id": "2", "title": "M"}}]
    page = {"data": {"p": {"edges": edges, "pageInfo": {"endCursor": "abc"}}}}
    assert found(value, page) == [{"id": "1", "title": "E"}, {"id": "2", "title": "M"}]


def test_shapes_that_are_not_lists(value):
    assert found(value, {"facets": {"t": [{"name": "x", "count": 1}]}}) is None
    assert found(value, {"jobs": []}) is None
    assert found(value, [1, {"id": 1}]) is None
    assert found(value, '{"a": "[{\\"id\\":1}]"}') is None
    assert found(value, "not json") is None
    assert found(value, '[{"id":1}] tail') is None


def test_depth_limit(value):
    at4 = {"a": {"b": {"c": {"d": [{"id": 1}]}}}}
    assert found(value, at4) == [{"id": 1}]
    assert found(value, {"z": at4}) is None


def test_unlimited_depth_and_the_flag_of_a_cut_search(value):
    def search(payload, depth):
        row = value(J.record_list_search(L(payload if isinstance(payload, str) else json.dumps(payload)), depth))
        return row["items"] and [json.loads(i) for i in row["items"]], row["cut"]

    at5 = {"z": {"a": {"b": {"c": {"d": [{"id": 1}]}}}}}
    assert search(at5, 4) == (None, True)
    assert search(at5, 5) == ([{"id": 1}], False)
    assert search(at5, None) == ([{"id": 1}], False)
    deep = {"id": 1}
    deep = [deep]
    for _ in range(60):
        deep = {"]}": deep}
    assert search(deep, None) == ([{"id": 1}], False)
    # What is left comes after the list found, or holds no object and no array.
    assert search({"a": [{"id": 1}], "z": {"b": {"c": {"d": {"e": {}}}}}}, 4) == ([{"id": 1}], False)
    assert search({"z": {"b": {"c": {"d": {"e": {}}}}}, "zz": [{"id": 1}]}, 4) == ([{"id": 1}], True)
    assert search({"a": 1, "b": "x", "c": None}, 0) == (None, False)
    assert search("not json", 4) == (None, False)


def test_repeated_and_escaped_keys_and_long_strings(value):
    assert found(value, '{"a":1,"a":[{"id":1}],"a":[{"id":2}]}') == [{"id": 1}]
    assert found(value, '{"a\\"b" : [{"\\u0069d" : 1, "t": "x\\": {[\\u00e9"}]}') == [{"id": 1, "t": 'x": {[\u00e9'}]
    long = "y" * 300_000 + '\\"' * 1000
    assert found(value, '{"s":"' + long + '","jobs":[{"title":"' + long + '"}]}') == [{"title": long.replace('\\"', '"')}]
    assert found(value, '{"jobs":[{"id":"\U0001f600","n":12345678901234567890,"f":1.5}]}') == [
        {"id": "\U0001f600", "n": 12345678901234567890, "f": 1.5}
    ]
    assert found(value, "") is None and found(value, "{}") is None and found(value, "[]") is None


def test_search_against_a_plain_walk(value):
    """Random documents: the walk over parsed text and the expression find the same."""
    import random

    rng = random.Random(7)
    titles = {"title", "id"}

    def document(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.25:
            return rng.choice([1, "x", None, True, "[1]", {}, []])
        if kind < 0.6:
            return {rng.choice(["z", "a", "title", "node", "m", "nextCursor"]): document(depth - 1) for _ in range(rng.randint(0, 3))}
        return [document(depth - 1) for _ in range(rng.randint(0, 3))]

    def names(node):
        return isinstance(node, dict) and any(k.lower() in titles for k in node)

    def plain_list(node, depth):
        if isinstance(node, list) and node and isinstance(node[0], dict):
            if names(node[0]):
                return node
            if names(node[0].get("node")):
                return [i["node"] for i in node if isinstance(i, dict) and isinstance(i.get("node"), dict)]
        if depth == 0:
            return None
        below = node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
        return next((hit for hit in (plain_list(b, depth - 1) for b in below) if hit is not None), None)

    def plain_value(node, depth):
        if isinstance(node, dict) and "nextCursor" in node:
            return node["nextCursor"]
        if depth == 0:
            return None
        below = node.values() if isinstance(node, dict) else node if isinstance(node, list) else []
        return next((hit for hit in (plain_value(b, depth - 1) for b in below) if hit is not None), None)

    documents = [document(7) for _ in range(400)]
    rows = value(F.transform(
        F.from_json(L(json.dumps([json.dumps(d) for d in documents])), "array<string>"),
        lambda t: F.struct(
            J.record_list(t, 3).alias("l3"), J.record_list(t, None).alias("all"),
            J.first_value(t, ["nextcursor"], 3).alias("v3"), J.first_value(t, ["nextcursor"], None).alias("v"),
        ),
    ))
    listed = lambda items: None if items is None else [json.loads(i) for i in items]
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    hits = 0
    for d, row in zip(documents, rows):
        assert listed(row["l3"]) == plain_list(d, 3), d
        assert listed(row["all"]) == plain_list(d, 99), d
        for got, want in ((row["v3"], plain_value(d, 3)), (row["v"], plain_value(d, 99))):
            assert got == text(want) or json.loads(got) == want, d
        hits += (row["all"] is not None) + (row["v"] is not None)
    assert hits > 40


def test_reading_order_wins_over_key_order_and_depth(value):
    assert found(value, '{"z": {"deep": [{"id": "deep"}]}, "a": [{"id": "flat"}]}') == [{"id": "deep"}]
    assert found(value, '{"z": [{"id": "z"}], "a": [{"id": "a"}]}') == [{"id": "z"}]
    assert found(value, [[{"k": 1}], [{"Title": "t"}, 5]]) == [{"Title": "t"}, 5]


def test_root_locator(value):
    run = lambda t: value(J.record_list_at_root(L(t)))
    assert run('[{"a":1}]') == ['{"a":1}']
    assert run('{"x":[1],"jobs":[{"a":2}]}') == ['{"a":2}']
    assert run('{"n":1,"x":[{"a":3}],"y":[4]}') == ['{"a":3}']
    assert run('{"n":1}') is None


def test_first_value_prunes_below_a_null_match(value):
    keys = ["endcursor"]
    run = lambda t: value(J.first_value(L(t), keys))
    assert run('{"data":{"jobs":{"pageInfo":{"endCursor":"xyz"}}}}') == "xyz"
    assert run('{"a":{"endCursor":null,"below":{"endCursor":"no"}},"b":{"endCursor":"yes"}}') == "yes"
    assert run('{"a":{"b":1}}') is None
    assert run('{"a":{"b":{"c":{"d":{"e":{"f":{"endCursor":"6"}}}}}}}') == "6"
    assert run('{"z":{"a":{"b":{"c":{"d":{"e":{"f":{"endCursor":"7"}}}}}}}}') is None


def body(value, column):
    row = value(column)
    return None if row is None else (json.loads(row["body"]), row["mechanism"])


def test_next_page_body(value):
    run = lambda t: body(value, J.next_page_body(L(t)))
    assert run('{"offset": 0, "limit": 20}') == ({"offset": 20, "limit": 20}, "offset/limit")
    assert run('{"page": 1, "pageSize": 10}') == ({"page": 2, "pageSize": 10}, "page number")
    assert run('{"start": 5, "take": 0}') == ({"start": 25, "take": 0}, "offset/limit")
    assert run('{"SKIP": 5}') == ({"SKIP": 25}, "offset/limit")
    assert run('{"offset": true, "page": 3}') == ({"offset": True, "page": 4}, "page number")
    assert run('{"offset": "0"}') is None
    assert run('{"query": "engineer"}') is None
    assert run("form=1") is None


def test_next_page_variables(value):
    run = lambda v, r: body(value, J.next_page_variables(L(v), L(r)))
    answer = '{"data":{"jobs":{"pageInfo":{"endCursor":"cursor123"}}}}'
    assert run('{"first":20,"after":null}', answer) == ({"first": 20, "after": "cursor123"}, "cursor")
    assert run('{"after":null}', '{"nextCursor":"20"}') == ({"after": "20"}, "cursor")
    assert run('{"after":null}', '{"nextCursor":20}') == ({"after": 20}, "cursor")
    assert run('{"after":null,"page":1}', '{"data":{"jobs":[]}}') is None
    assert run('{"after":null}', '{"cursor":""}') is None
    assert run('{"offset":0,"limit":20}', "{}") == ({"offset": 20, "limit": 20}, "offset/limit")


def test_with_member(value):
    assert json.loads(value(J.with_member(L('{"a":1}'), L("country"), L('I"N')))) == {"a": 1, "country": 'I"N'}
    assert json.loads(value(J.with_member(L('{"country":1,"b":2}'), L("country"), L("IN")))) == {"country": "IN", "b": 2}


def test_with_variable(value):
    run = lambda body: json.loads(value(J.with_variable(L(body), L("country"), L("IN"))))
    assert run('{"query":"q","variables":{"page":1}}') == {"query": "q", "variables": {"page": 1, "country": "IN"}}
    assert run('{"query":"q","variables":{"country":"x"}}') == {"query": "q", "variables": {"country": "IN"}}
    for empty in ('{"query":"q"}', '{"query":"q","variables":null}', '{"query":"q","variables":[]}'):
        assert run(empty) == {"query": "q", "variables": {"country": "IN"}}


def test_probes_from_one_parse_equal_single_members(value):
    probes = [("country", "IN"), ("a", 'x"y')]
    for body in ('{"a":1,"b":[2]}', "{}", "no json", "[1]"):
        one = value(J.member_probes(L(body), probes))
        assert (one and [r["request"] for r in one] or [None] * 2) == [value(J.with_member(L(body), L(k), L(v))) for k, v in probes]
    for body in ('{"query":"q","variables":{"a":{"b":1}}}', '{"query":"q","variables":"{\\"c\\":1}"}', '{"query":"q"}', "[1]"):
        one = value(J.variable_probes(L(body), probes))
        assert (one and [r["request"] for r in one] or [None] * 2) == [value(J.with_variable(L(body), L(k), L(v))) for k, v in probes]


def test_whole_text_json(value):
    good = ["{}", " [1] ", '"x"', "1", "null"]
    bad = ["", "{} x", "[1] [2]", "1,2", "{", '{"a":1}}', "[1]]"]
    assert [value(is_json(L(t))) for t in good] == [True] * len(good)
    assert [value(is_json(L(t))) for t in bad] == [False] * len(bad)


def test_replies(value):
    j = lambda t: value(R.json_text(L(t)))
    assert json.loads(j('so\n```json\n{"a": 1}\n```\nend')) == {"a": 1}
    assert json.loads(j('```\n{"a": 2}\n```')) == {"a": 2}
    assert json.loads(j('well {"a": {"b": 3}} done')) == {"a": {"b": 3}}
    assert j("nothing here") is None
    assert j("{broken} {") is None
    assert value(R.code_text(L("x\n```python\nprint(1)\n```\ny"))) == "print(1)\n"
    assert value(R.code_text(L("  plain  "))) == "plain\n"
