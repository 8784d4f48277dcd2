"""Record lists and pagination keys inside JSON text.

A payload is parsed once, into a VARIANT, and walked level by level inside its own row, so
the walk needs no shuffle and no payload ever meets another one. A VARIANT sorts the members
of an object by key while their order in the text decides which list is "first": every key
gets its place in the text in front before the parse, so both orders are the same. Repeated
keys stay apart that way too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from crawlspark import markers as M
from crawlspark.functions.binding import let
from crawlspark.functions.jsontext import is_json, parsed

# Unquoting would turn the JSON *string* "[1]" into a list. A noncharacter put in front of
# such strings keeps them apart; it is removed again from whatever is returned. The same
# noncharacter, followed by ten digits, marks the place of a key.
_MASK = "\ufdd0"
_PLACE = f"{_MASK}[0-9]{{10}}"
_PLACE_LENGTH = 11


def _mask(text: Column) -> Column:
    return F.regexp_replace(text, r'(?<!\\)"(?=[\[{0-9-])', f'"{_MASK}')


def _unmask(text: Column) -> Column:
    return F.replace(text, F.lit(_MASK), F.lit(""))


def _is_object(node: Column) -> Column:
    return F.startswith(node, F.lit("{"))


def _is_array(node: Column) -> Column:
    return F.startswith(node, F.lit("["))


def _members(node: Column) -> Column:
    """array<struct<key, value>> of an object node, values as raw JSON."""
    return F.transform(
        F.map_entries(F.from_json(node, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )


def _trim(json: Column) -> Column:
    return F.btrim(json, F.lit(" \t\r\n"))


_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# A key with its colon, the text up to the next key, and a quote that opens nothing.
_PIECE = rf'(?s){_STRING}\s*+:|(?:[^"]++|{_STRING}(?!\s*+:))++|"'


def _placed(json: Column) -> Column:
    """The text with the place of every key in front of it, as VARIANT; NULL unless JSON."""
    pieces = F.regexp_extract_all(json, F.lit(_PIECE), F.lit(0))

    def numbered(piece: Column, i: Column) -> Column:
        place = F.concat(F.lit(f'"{_MASK}'), F.lpad(i.cast("string"), 10, "0"), F.substring(piece, 2, 2147483647))
        is_key = F.startswith(piece, F.lit('"')) & F.endswith(piece, F.lit(":"))
        return F.when(is_key, place).otherwise(piece)

    return parsed(F.array_join(F.transform(pieces, numbered), ""))


def _own_keys(text: Column) -> Column:
    """JSON text of a placed value with its own keys again."""
    return F.regexp_replace(text, f'"{_PLACE}', '"')


_NODE = "struct<path:array<int>,object:map<string,variant>,items:array<variant>>"


def _node(path: Column, value: Column) -> Column:
    return F.struct(
        path.alias("path"),
        F.try_variant_get(value, "$", "map<string,variant>").alias("object"),
        F.try_variant_get(value, "$", "array<variant>").alias("items"),
    )


def _containers(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["object"].isNotNull() | n["items"].isNotNull())


def _children(level: Column) -> Column:
    """Objects and arrays below the nodes of a level, in reading order."""

    def below(node: Column) -> Column:
        values = F.coalesce(node["items"], F.map_values(node["object"]))
        return F.transform(values, lambda v, i: _node(F.concat(node["path"], F.array(i)), v))

    return _containers(F.flatten(F.transform(level, below)))


def _deepest(json: Column) -> Column:
    """How deep the brackets outside strings nest."""
    brackets = F.regexp_replace(json, rf"(?s){_STRING}|[^\[\]{{}}]", "")
    return F.aggregate(
        F.filter(F.split(brackets, ""), lambda c: c != ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda at, c: let(
            at["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1),
            lambda now: F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most")),
        ),
        lambda at: at["most"],
    )


def _names_key(json: Column, names: Sequence[str]) -> Column:
    """The text can hold a key of these names: one stands in it, or a key may be escaped."""
    return json.rlike('(?iu)"(?:' + "|".join(names) + r')"\s*:|\\u')


def _search(
    json: Column,
    names: Sequence[str],
    mark: Callable[[Column], Column],
    hit: Callable[[Column], Column],
    goes_on: Callable[[Column], Column],
    kind: str,
    max_depth: int | None,
) -> Column:
    """struct<found: struct<path, hit>, open>: the first hit in reading order.

    ``mark`` is computed once per node; ``hit`` makes a value of type ``kind`` of it, NULL when the
    node is none, and nothing below a node whose mark does not go on is looked at. Text without
    any key of the given names is not parsed and gives NULL.
    Levels 0..max_depth are searched, all of them when it is None. A path of positions sorts like
    reading order, so what lies after the best hit so far needs no further look. ``open`` holds
    the nodes below the last level that could still come first.
    """
    found = f"struct<path:array<int>,hit:{kind}>"

    def looked_at(level: Column, best: Column) -> Column:
        marked = F.transform(level, lambda n: F.struct(n.alias("node"), mark(n).alias("mark")))

        def state(looked: Column, b: Column) -> Column:
            ahead = F.filter(
                looked, lambda n: goes_on(n["mark"]) & (b.isNull() | (n["node"]["path"] < b["path"]))
            )
            below = _children(F.transform(ahead, lambda n: n["node"]))
            return F.struct(b.alias("found"), below.alias("open"))

        def judged(looked: Column) -> Column:
            hits = F.filter(looked, lambda n: hit(n["mark"]).isNotNull())
            first = F.transform(
                F.slice(hits, 1, 1),
                lambda n: F.struct(n["node"]["path"].alias("path"), hit(n["mark"]).alias("hit")),
            )
            better = let(
                F.try_element_at(first, F.lit(1)),
                lambda f: F.when(best.isNull() | (f["path"] < best["path"]), F.coalesce(f, best)).otherwise(best),
            )
            return let(better, lambda b: state(looked, b))

        return let(marked, judged)

    def searched(value: Column) -> Column:
        root = _containers(F.array(_node(F.array().cast("array<int>"), value)))
        start = let(root, lambda level: looked_at(level, F.lit(None).cast(found)))
        depth = F.lit(max_depth) if max_depth is not None else _deepest(json)
        levels = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, start, lambda at, _: looked_at(at["open"], at["found"]))

    return let(_placed(F.when(_names_key(json, names), json)), searched)


_RECORD_KEY = f"(?:^|\u0001){_PLACE}(?:" + "|".join(M.TITLE_KEYS + M.ID_KEYS) + ")(?:\u0001|$)"


def _names_record(members: Column) -> Column:
    """One of the keys names a title or an id; of NULL members none does."""
    keys = F.array_join(F.map_keys(members), "\u0001")
    return F.lower(F.coalesce(keys, F.lit(""))).rlike(_RECORD_KEY)


def _relayed(item: Column) -> Column:
    """The object under ``node`` of an edge, else NULL; of repeated keys the last counts."""
    members = F.map_entries(F.try_variant_get(item, "$", "map<string,variant>"))
    named = F.filter(members, lambda m: F.substring(m["key"], _PLACE_LENGTH + 1, 2147483647) == "node")
    value = F.try_element_at(named, F.lit(-1))["value"]
    return F.when(F.try_variant_get(value, "$", "map<string,variant>").isNotNull(), value)


def _record_items(node: Column) -> Column:
    """Items when the node is a record list (edges unwrapped), else NULL.

    Only the first item decides, and an empty list is none.
    """
    items = node["items"]
    first = F.try_element_at(items, F.lit(1))

    def by_first(members: Column) -> Column:
        inner = F.try_variant_get(_relayed(first), "$", "map<string,variant>")
        unwrapped = F.filter(F.transform(items, _relayed), lambda v: v.isNotNull())
        return F.when(_names_record(members), items).when(members.isNotNull() & _names_record(inner), unwrapped)

    return F.when(items.isNotNull(), let(F.try_variant_get(first, "$", "map<string,variant>"), by_first))


def record_list_search(json: Column, max_depth: int | None = 4) -> Column:
    """struct<items, cut>: the first record list in reading order, as array of JSON items.

    Levels 0..max_depth are searched, all when it is None. ``cut`` is true when the limit left
    nodes unsearched in which a list could lie that comes first. Text that is no JSON has neither
    list nor cut. Numbers come out in the plain form of a VARIANT.
    """
    search = _search(
        json, M.TITLE_KEYS + M.ID_KEYS, _record_items, lambda items: items, lambda items: F.lit(True), "array<variant>", max_depth
    )

    def told(at: Column) -> Column:
        items = F.transform(at["found"]["hit"], lambda v: _own_keys(F.to_json(v)))
        return F.struct(items.alias("items"), (F.size(at["open"]) > 0).alias("cut"))

    return let(search, told)


def record_list(json: Column, max_depth: int | None = 4) -> Column:
    """Items of ``record_list_search``, NULL when there is no list."""
    return record_list_search(json, max_depth)["items"]


def record_list_at_root(json: Column) -> Column:
    """Items of a root array, else of ``jobs``, else of the first array member; may be NULL."""

    def listed(members: Column) -> Column:
        named = F.try_element_at(F.filter(members, lambda m: m["key"] == "jobs"), F.lit(1))["value"]
        arrays = F.filter(members, lambda m: F.coalesce(_is_array(m["value"]), F.lit(False)))
        return F.coalesce(named, F.try_element_at(arrays, F.lit(1))["value"])

    def chosen(text: Column) -> Column:
        return F.when(_is_array(text), text).when(_is_object(text), let(_members(text), listed))

    def items(text: Column) -> Column:
        return F.when(_is_array(text), F.from_json(text, "array<string>"))

    root = F.when(is_json(json), _mask(_trim(json)))
    return F.transform(let(let(root, chosen), items), _unmask)


def first_value_search(json: Column, keys: Sequence[str], max_depth: int | None = 6) -> Column:
    """struct<value, cut>: first non-null value under one of the keys, as text.

    ``max_depth`` and ``cut`` as in ``record_list_search``.
    """
    search = _key_search(json, keys, max_depth)
    return let(
        search,
        lambda at: F.struct(
            _own_keys(_text(at["found"]["hit"])).alias("value"), (F.size(at["open"]) > 0).alias("cut")
        ),
    )


def first_value(json: Column, keys: Sequence[str], max_depth: int | None = 6) -> Column:
    """First non-null value under one of the keys, as text."""
    return first_value_search(json, keys, max_depth)["value"]


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _key_search(json: Column, keys: Sequence[str], max_depth: int | None) -> Column:
    """``_search`` for a value under one of the keys.

    An object that has such a key ends the search below it, even when the value is
    null; the search then goes on with its siblings.
    """
    name = f"{_PLACE}(?:" + "|".join(keys) + ")"

    def own(node: Column) -> Column:
        held = F.lower(F.array_join(F.map_keys(node["object"]), "\u0001")).rlike(f"(?:^|\u0001){name}(?:\u0001|$)")
        return F.when(held, F.filter(F.map_entries(node["object"]), lambda m: F.lower(m["key"]).rlike(f"^{name}$")))

    def hit(members: Column) -> Column:
        value = F.try_element_at(members, F.lit(1))["value"]
        return F.when(~F.is_variant_null(value), value)

    def goes_on(members: Column) -> Column:
        return members.isNull() | (F.size(members) <= 0)

    return _search(json, keys, own, hit, goes_on, "variant", max_depth)


def canonical(json: Column) -> Column:
    """JSON with sorted keys, so equal values compare equal as text."""
    return F.to_json(F.try_parse_json(json))


def sample_keys(item: Column) -> Column:
    """Sorted top-level keys of a record, comma-joined."""
    return F.array_join(F.array_sort(F.json_object_keys(item)), ",")


# --- moving a request body to the next page ---------------------------------


def _named(key: Column, names: Sequence[str]) -> Column:
    """The key is one of the (lower-case) names, case ignored; a NULL key is not."""
    return F.coalesce(F.lower(key).rlike("^(?:" + "|".join(names) + ")$"), F.lit(False))


def _first_number(entries: Column, names: Sequence[str]) -> Column:
    """First member with one of the names and a JSON number; booleans are not numbers."""
    numeric = F.filter(
        entries,
        lambda e: _named(e["key"], names)
        & F.coalesce(F.schema_of_variant(e["value"]).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)),
    )
    return F.try_element_at(numeric, F.lit(1))


def _entries(body: Column) -> Column:
    return F.map_entries(F.from_json(body, "map<string,variant>"))


def _plus(value: Column, step: Column) -> Column:
    """JSON text of value + step, whole numbers kept whole."""
    whole = F.try_variant_get(value, "$", "string").rlike("^-?[0-9]+$") & step.rlike("^-?[0-9]+$")
    as_long = (F.try_variant_get(value, "$", "bigint") + step.try_cast("bigint")).cast("string")
    as_double = (F.try_variant_get(value, "$", "double") + step.try_cast("double")).cast("string")
    return F.when(whole, as_long).otherwise(as_double)


def _put(entries: Column, key: Column, json_value: Column) -> Column:
    """Object text with one member replaced in place."""
    replaced = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(e["key"] == key, F.try_parse_json(json_value)).otherwise(e["value"]).alias("value"),
        ),
    )
    return F.to_json(F.map_from_entries(replaced))


def next_page_body(body: Column, default_step: int = 20) -> Column:
    """struct<body, mechanism> one page further, NULL when no paging key holds a number."""

    def moved(entries: Column) -> Column:
        limit = F.try_variant_get(_first_number(entries, M.LIMIT_KEYS)["value"], "$", "string")
        step = F.when(limit.isNull() | (limit.try_cast("double") == 0), str(default_step)).otherwise(limit)

        def advanced(found: Column, by: Column, mechanism: str) -> Column:
            return let(
                found,
                lambda m: F.when(
                    m.isNotNull(),
                    F.struct(
                        _put(entries, m["key"], _plus(m["value"], by)).alias("body"),
                        F.lit(mechanism).alias("mechanism"),
                    ),
                ),
            )

        return F.coalesce(
            advanced(_first_number(entries, M.OFFSET_KEYS), step, "offset/limit"),
            advanced(_first_number(entries, M.PAGE_KEYS), F.lit("1"), "page number"),
        )

    return let(_entries(body), moved)


def next_page_variables(variables: Column, response: Column) -> Column:
    """As ``next_page_body``, but a cursor variable takes the cursor of the response.

    Without a cursor in the response there is no next page: none is invented. Zero, false and
    empty values are no cursors.
    """

    def moved(entries: Column, cursor: Column) -> Column:
        json = _own_keys(F.to_json(cursor))
        usable = ~F.coalesce(json.rlike(r'^(?:-?0(?:\.0)?|false|\[\]|\{\}|"")$'), F.lit(True))
        slot = F.filter(entries, lambda e: _named(e["key"], M.CURSOR_VARIABLE_KEYS))[0]
        return F.when(
            usable,
            F.struct(_put(entries, slot["key"], json).alias("body"), F.lit("cursor").alias("mechanism")),
        )

    def by_slot(entries: Column) -> Column:
        has_slot = F.exists(entries, lambda e: _named(e["key"], M.CURSOR_VARIABLE_KEYS))
        search = _key_search(response, M.CURSOR_RESPONSE_KEYS, 6)
        by_cursor = let(search["found"]["hit"], lambda c: moved(entries, c))
        return F.when(has_slot, by_cursor).otherwise(next_page_body(variables))

    return let(_entries(variables), by_slot)


def _placed_member(entries: Column, key: Column, text: Column) -> Column:
    """Entries with one member, given as JSON text, replaced in place or added at the end."""
    added = F.array(F.struct(key.alias("key"), F.try_parse_json(text).alias("value")))
    replaced = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"), F.when(e["key"] == key, F.try_parse_json(text)).otherwise(e["value"]).alias("value")
        ),
    )
    return F.when(F.exists(entries, lambda e: e["key"] == key), replaced).otherwise(F.concat(entries, added))


def _json_string(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("c"))), r"(?s)^\{\"c\":(.*)\}$", 1)


def _object_text(entries: Column) -> Column:
    return F.to_json(F.map_from_entries(entries))


def with_member(body: Column, key: Column, value: Column) -> Column:
    """Object text with one string member replaced in place or added at the end."""
    return let(_entries(body), lambda e: _object_text(_placed_member(e, key, _json_string(value))))


def member_probes(body: Column, probes: Sequence[tuple[str, str]]) -> Column:
    """``by_priority`` of ``with_member`` for every probe; the body is parsed once."""

    def built(entries: Column) -> Column:
        return by_priority(
            lambda k, v: _object_text(_placed_member(entries, F.lit(k), _json_string(F.lit(v)))), probes
        )

    return let(_entries(body), built)


def _variable_entries(body: Column) -> Column:
    """Variables of a GraphQL body's entries; without any, or empty ones, no entry."""
    given = F.try_element_at(F.filter(body, lambda e: e["key"] == "variables"), F.lit(1))["value"]

    def read(text: Column) -> Column:
        empty = text.isNull() | text.isin("", "0", "false", "[]")
        return _entries(F.when(empty, "{}").otherwise(text))

    return let(_text(given), read)


def _with_variables(body: Column, variables: Column) -> Column:
    return _object_text(_placed_member(body, F.lit("variables"), _object_text(variables)))


def with_variable(body: Column, key: Column, value: Column) -> Column:
    """GraphQL body with one string variable replaced or added; its other members stay.

    A body without variables, or with an empty value in their place, gets an object of its own.
    """
    return let(
        _entries(body),
        lambda b: let(
            _variable_entries(b), lambda v: _with_variables(b, _placed_member(v, key, _json_string(value)))
        ),
    )


def variable_probes(body: Column, probes: Sequence[tuple[str, str]]) -> Column:
    """``by_priority`` of ``with_variable`` for every probe; body and variables are parsed once."""

    def built(entries: Column, variables: Column) -> Column:
        return by_priority(
            lambda k, v: _with_variables(entries, _placed_member(variables, F.lit(k), _json_string(F.lit(v)))), probes
        )

    return let(_entries(body), lambda b: let(_variable_entries(b), lambda v: built(b, v)))


def by_priority(build: Callable[[str, str], Column], probes: Sequence[tuple[str, str]]) -> Column:
    """array<struct<priority, key, value, request>> of the probes, tried in order."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"), F.lit(k).alias("key"), F.lit(v).alias("value"),
                build(k, v).alias("request"),
            )
            for i, (k, v) in enumerate(probes)
        ]
    )
