"""Stored exchanges, payload search, body mutation and other stored results.

An order is one captured exchange; its priority class decides the shape of the payload
and of the request body. Payloads are built row by row from the order's own values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import payload as J
from crawlspark.functions import predicates as P
from crawlspark.functions import replies as R
from crawlspark.functions import urls as U
from crawlspark.operators import keyed as K
from crawlspark.plans.inputs import sql_host, table
from crawlspark.plans.registry import query
from crawlspark.sources import readers

_DECOY = '{"text":"[{\\"id\\":1}]","a":{"b":{"c":{"d":{"e":[{"id":1}]}}}}}'


def captures(spark, sf_dir):
    """(domain, seq, cls, url, method, request_body, body) of every order."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    cls = F.substring("o_orderpriority", 1, 1).cast("int")
    numbers = F.sequence(F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int"))

    def items(template: str):
        """JSON list with @K and @I of the template replaced by order key and position."""
        return F.array_join(
            F.transform(
                numbers,
                lambda i: F.replace(F.replace(F.lit(template), F.lit("@K"), key), F.lit("@I"), i.cast("string")),
            ),
            ",",
        )

    body = (
        F.when(cls == 1, F.concat(
            F.lit('{"meta":{"v":1},"data":{"found":{"edges":['), items('{"node":{"title":"role @I","id":@K}}'),
            F.lit('],"pageInfo":{"hasNext":true,"endCursor":"c'), key, F.lit('"}}}}')))
        .when(cls == 2, F.concat(
            F.lit('{"facets":[{"name":"x"}],"jobs":['), items('{"Title":"role @I","k":@K}'),
            F.lit('],"page":{"cursor":null,"deep":{"cursor":5}},"more":[{"next_cursor":'), key, F.lit("}]}")))
        .when(cls == 3, F.concat(F.lit("["), items('{"reqId":"@K","n":@I}'), F.lit("]")))
        .when(cls == 4, F.lit(_DECOY))
        .otherwise(F.concat(
            F.lit('{"z":['), items('{"Position":"p","k":@K,"i":@I}'), F.lit('],"a":[{"id":"late"}],"nextCursor":"'), key, F.lit('"}')))
    )
    request = (
        F.when(cls == 1, F.concat(
            F.lit('{"query":"q","variables":{"first":5,"after":"c'), F.col("o_custkey").cast("string"), F.lit('"}}')))
        .when(cls == 2, F.concat(F.lit('{"offset":'), key, F.lit(',"limit":25,"q":"x"}')))
        .when(cls == 3, F.concat(F.lit('{"Page":'), key, F.lit(',"pageSize":10,"skip":true}')))
        .when(cls == 4, F.concat(F.lit("a=1&b="), key))
        .otherwise(F.concat(F.lit('{"start":'), key, F.lit(',"take":0}')))
    )
    host = F.when(F.col("o_orderstatus") == "P", "www.google-analytics.com").otherwise("api.example.org")
    return o.select(
        F.col("o_custkey").alias("domain"),
        F.col("o_orderkey").alias("seq"),
        cls.alias("cls"),
        F.concat(F.lit("https://"), host, F.when(cls == 5, "/GraphQL").otherwise("/v1"), F.lit("?page=1&o="), key).alias("url"),
        F.when(cls == 2, "get").otherwise("post").alias("method"),
        request.alias("request_body"),
        body.alias("body"),
    )


_CLS = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
# Items expected per class, keys sorted, straight from the order's columns.
_SQL_ITEMS = f"""
items AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, cls, i, CASE cls
    WHEN 1 THEN '{{"id":' || o_orderkey || ',"title":"role ' || i || '"}}'
    WHEN 2 THEN '{{"Title":"role ' || i || '","k":' || o_orderkey || '}}'
    WHEN 3 THEN '{{"n":' || i || ',"reqId":"' || o_orderkey || '"}}'
    WHEN 5 THEN '{{"Position":"p","i":' || i || ',"k":' || o_orderkey || '}}' END AS item
  FROM (SELECT *, {_CLS} AS cls, unnest(range(1, o_orderkey % 3 + 2)) AS i FROM orders) WHERE cls <> 4)"""


@query(
    "payload_lists",
    f"WITH {_SQL_ITEMS} SELECT o_orderkey AS seq, i - 1 AS pos, item FROM items",
)
def payload_lists(spark, sf_dir):
    found = captures(spark, sf_dir).select("seq", F.posexplode(J.record_list(F.col("body"))).alias("pos", "item"))
    return found.select("seq", F.col("pos").cast("long").alias("pos"), J.canonical(F.col("item")).alias("item"))


@query(
    "payload_root_lists",
    f"""WITH {_SQL_ITEMS} SELECT o_orderkey AS seq, count(*) AS n_items, min(item) AS first_item FROM items
      WHERE cls IN (2, 3, 5) GROUP BY o_orderkey""",
)
def payload_root_lists(spark, sf_dir):
    items = captures(spark, sf_dir).select("seq", J.record_list_at_root(F.col("body")).alias("items"))
    one = F.when(F.col("items").isNotNull(), F.array(F.struct(
        F.size("items").cast("long").alias("n_items"),
        F.array_min(F.transform("items", lambda i: J.canonical(i))).alias("first_item"),
    )))
    return items.select("seq", F.inline(one))


@query(
    "best_payload",
    f"""WITH {_SQL_ITEMS}, counted AS (SELECT o_custkey AS domain, o_orderkey AS seq, count(*) AS n_items FROM items
      WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
    SELECT domain, seq, n_items FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n_items DESC, seq) AS rn FROM counted)
    WHERE rn = 1""",
)
def best_payload(spark, sf_dir):
    seen = captures(spark, sf_dir).where(~P.is_denied(F.col("url")) & (F.col("body") != ""))
    counted = seen.select("domain", "seq", F.size(J.record_list(F.col("body"))).cast("long").alias("n_items"))
    best = K.first_per_key(counted, ["domain"], [F.col("n_items").desc_nulls_last(), F.col("seq")])
    return best.where(F.col("n_items") > 0)


@query(
    "cursor_lookup",
    f"""SELECT o_orderkey AS seq, CASE {_CLS} WHEN 1 THEN 'c' || o_orderkey WHEN 2 THEN CAST(o_orderkey AS VARCHAR)
      WHEN 5 THEN CAST(o_orderkey AS VARCHAR) ELSE 'none' END AS cursor FROM orders""",
)
def cursor_lookup(spark, sf_dir):
    found = J.first_value(F.col("body"), M.CURSOR_RESPONSE_KEYS)
    return captures(spark, sf_dir).select("seq", F.coalesce(found, F.lit("none")).alias("cursor"))


@query(
    "next_page_body",
    f"""SELECT o_orderkey AS seq, CASE {_CLS}
        WHEN 2 THEN '{{"limit":25,"offset":' || (o_orderkey + 25) || ',"q":"x"}}'
        WHEN 3 THEN '{{"Page":' || (o_orderkey + 1) || ',"pageSize":10,"skip":true}}'
        WHEN 5 THEN '{{"start":' || (o_orderkey + 20) || ',"take":0}}' ELSE 'none' END AS next_body,
      CASE {_CLS} WHEN 2 THEN 'offset/limit' WHEN 3 THEN 'page number' WHEN 5 THEN 'offset/limit' ELSE 'none' END AS mechanism
    FROM orders""",
)
def next_page_body(spark, sf_dir):
    moved = captures(spark, sf_dir).select("seq", J.next_page_body(F.col("request_body")).alias("m"))
    return moved.select(
        "seq",
        F.coalesce(J.canonical(F.col("m.body")), F.lit("none")).alias("next_body"),
        F.coalesce("m.mechanism", F.lit("none")).alias("mechanism"),
    )


@query(
    "next_page_variables",
    f"""SELECT o_orderkey AS seq, CASE WHEN {_CLS} = 1 AND o_orderstatus = 'O' THEN 'none'
        WHEN {_CLS} = 1 THEN '{{"after":"c' || o_orderkey || '","first":5}}'
        WHEN {_CLS} = 2 THEN '{{"limit":25,"offset":' || (o_orderkey + 25) || ',"q":"x"}}'
        WHEN {_CLS} = 3 THEN '{{"Page":' || (o_orderkey + 1) || ',"pageSize":10,"skip":true}}'
        WHEN {_CLS} = 5 THEN '{{"start":' || (o_orderkey + 20) || ',"take":0}}' ELSE 'none' END AS next_variables
    FROM orders""",
)
def next_page_variables(spark, sf_dir):
    """Open orders of class 1 answered without a cursor, so their walk has no next page."""
    seen = captures(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), "o_orderstatus"), "seq"
    )
    variables = F.coalesce(F.get_json_object("request_body", "$.variables"), F.col("request_body"))
    response = F.when(F.col("o_orderstatus") == "O", '{"data":{"found":[]}}').otherwise(F.col("body"))
    moved = J.next_page_variables(variables, response)
    return seen.select("seq", F.coalesce(J.canonical(moved["body"]), F.lit("none")).alias("next_variables"))


@query(
    "filter_probes",
    f"""SELECT o_orderkey AS seq, priority, CASE WHEN {_CLS} = 2 THEN
        regexp_replace('https://' || CASE WHEN o_orderstatus = 'P' THEN 'www.google-analytics.com' ELSE 'api.example.org' END
          || '/v1?page=1&o=' || o_orderkey || '&' || k || '=' || v, ' ', '')
      WHEN {_CLS} IN (1, 5) THEN '{{"query":"{{jobs{{id}}}}","variables":' || members || '}}' ELSE members END AS request
    FROM orders, (VALUES (0, 'country', 'IN', 'country', 'IN'), (1, 'location', 'India', 'country', 'India'),
      (2, 'country', 'India', 'location', 'India'), (3, NULL, NULL, 'countryCode', 'IN'), (4, NULL, NULL, 'region', 'India')) p(priority, uk, uv, bk, bv),
      LATERAL (SELECT CASE WHEN {_CLS} = 2 THEN uk ELSE bk END AS k, CASE WHEN {_CLS} = 2 THEN uv ELSE bv END AS v),
      LATERAL (SELECT CASE WHEN k = 'region' THEN '{{"offset":' || o_orderkey || ',"region":"' || v || '"}}'
        ELSE '{{"' || k || '":"' || v || '","offset":' || o_orderkey || '}}' END AS members)
    WHERE k IS NOT NULL""",
)
def filter_probes(spark, sf_dir):
    """GET sources try URL parameters, GraphQL sources variables, the others members of a body."""
    seen = readers.exchanges(captures(spark, sf_dir))
    body = F.concat(F.lit('{"offset":'), F.col("seq").cast("string"), F.lit("}"))
    graphql = F.concat(F.lit('{"query":"{jobs{id}}","variables":'), body, F.lit("}"))
    by_url = J.by_priority(lambda k, v: U.with_params(F.col("url"), {k: v}), M.URL_FILTER_PROBES)
    by_body = J.member_probes(body, M.BODY_FILTER_PROBES)
    by_variable = J.variable_probes(graphql, M.BODY_FILTER_PROBES)
    by_post = F.when(F.col("is_graphql"), by_variable).otherwise(by_body)
    tried = seen.select("seq", F.inline(F.when(F.col("method") == "GET", by_url).otherwise(by_post)))
    sorted_keys = F.when(F.startswith("request", F.lit("{")), J.canonical(F.col("request")))
    return tried.select(
        "seq", F.col("priority").cast("long").alias("priority"), F.coalesce(sorted_keys, "request").alias("request")
    )


# --- scans of stored results ------------------------------------------------


@query(
    "exchange_scan",
    f"""SELECT o_orderkey AS seq, CASE WHEN {_CLS} = 2 THEN 'GET' ELSE 'POST' END AS method,
      CASE {_CLS} WHEN 4 THEN 'form' WHEN 1 THEN 'graphql' WHEN 5 THEN 'graphql' ELSE 'json' END AS body_type,
      {_CLS} IN (1, 5) AS is_graphql, 'o,page' AS params, CAST(o_orderkey AS VARCHAR) AS param_o, {_CLS} <> 4 AS has_json_body
    FROM orders""",
)
def exchange_scan(spark, sf_dir):
    seen = readers.exchanges(captures(spark, sf_dir))
    return seen.select(
        "seq", "method", "body_type", "is_graphql",
        F.array_join(F.array_sort(F.map_keys("query_params")), ",").alias("params"),
        F.col("query_params")["o"][0].alias("param_o"),
        F.col("json_body").isNotNull().alias("has_json_body"),
    )


@query(
    "probe_scan",
    """SELECT event_id, event_type NOT IN ('error', 'signup') AS has_json, event_type <> 'error' AS responded,
      CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'error' THEN '<p>' || props ELSE props END AS text_body FROM events""",
)
def probe_scan(spark, sf_dir):
    kind = F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "error", 503).otherwise(200).alias("status"),
        F.when(kind == "error", F.concat(F.lit("<p>"), "props"))
        .when(kind == "signup", F.lit(None).cast("string"))
        .otherwise(F.col("props"))
        .alias("body"),
    )
    return readers.probes(raw).select(
        "event_id",
        F.col("json_body").isNotNull().alias("has_json"),
        P.responded(F.col("status")).alias("responded"),
        "text_body",
    )


@query(
    "search_results",
    f"""SELECT page_id, CAST(seq AS BIGINT) AS seq, link AS url FROM (
      SELECT page_id, {sql_host('url')} AS host, unnest([0, 1, 3]) AS seq,
        unnest([url || '/Careers', 'https://elsewhere.test/jobs', 'https://' || {sql_host('url')} || '/jobs']) AS link FROM pages)
    WHERE contains(link, host)""",
)
def search_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("domain", U.host(F.col("url")))
    hit = lambda c: F.struct(c.alias("link"))
    body = F.to_json(
        F.struct(
            F.array(
                hit(F.concat("url", F.lit("/Careers"))),
                hit(F.lit("https://elsewhere.test/jobs")),
                hit(F.lit(None).cast("string")),
                hit(F.concat(F.lit("https://"), "domain", F.lit("/jobs"))),
            ).alias("organic")
        )
    )
    hits = readers.search_hits(pages.select("page_id", "domain", body.alias("body")), keep=("page_id",))
    return hits.select("page_id", F.col("seq").cast("long").alias("seq"), "url")


@query(
    "render_results",
    """SELECT page_id, CASE WHEN lang = 'fr' THEN '' ELSE html END AS html,
      CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 404 ELSE 200 END AS status, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS n_links
    FROM (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages)""",
)
def render_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    data = F.struct(
        F.col("html"),
        F.array("url").alias("links"),
        F.struct(F.when(lang == "de", 404).alias("statusCode")).alias("metadata"),
    )
    body = F.to_json(F.struct((lang != "fr").alias("success"), F.when(lang != "fr", data).alias("data")))
    rows = readers.render_results(pages.select("page_id", body.alias("body")))
    return rows.select(
        "page_id", "html", F.col("status").cast("long").alias("status"), F.size("links").cast("long").alias("n_links")
    )


@query(
    "page_scan",
    """SELECT page_id, CASE WHEN starts_with(url, 'https:') THEN html ELSE '' END AS html,
      CASE WHEN starts_with(url, 'https:') THEN 200 ELSE 0 END AS status FROM pages""",
)
def page_scan(spark, sf_dir):
    """Pages whose navigation failed (plain http here) stay as rows."""
    raw = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(F.startswith("url", F.lit("https:")), F.col("html")).alias("html"),
        F.when(F.startswith("url", F.lit("https:")), 200).alias("status"),
    )
    return readers.pages(raw).select("page_id", "html", F.col("status").cast("long").alias("status"))


@query(
    "model_replies",
    """SELECT conv_id, turn, text AS content, CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS tokens_prompt,
      CASE WHEN role = 'assistant' THEN turn + 1 ELSE 0 END AS tokens_completion FROM conversations""",
)
def model_replies(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    usage = F.struct(
        F.length("text").alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", F.col("turn") + 1).alias("completion_tokens"),
    )
    body = F.to_json(
        F.struct(
            F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"),
            F.when(F.col("role") != "user", usage).alias("usage"),
        )
    )
    replies = readers.model_replies(c.select("conv_id", "turn", body.alias("body")))
    return replies.select("conv_id", "turn", "content", "tokens_prompt", "tokens_completion")


@query(
    "fenced_json",
    """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'none' ELSE '{"conv": ' || conv_id || ', "turn": ' || turn || '}' END AS json_text,
      CASE role WHEN 'system' THEN 'x = ' || turn WHEN 'assistant' THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' ```json' || chr(10) ||
        '{"conv": ' || conv_id || ', "turn": ' || turn || '}' || chr(10) || '``` done'
        ELSE '{"conv": ' || conv_id || ', "turn": ' || turn || '}' || ' ' || regexp_replace(text, '\\s+$', '', 'g') END || chr(10) AS code_text
    FROM conversations""",
)
def fenced_json(spark, sf_dir):
    """The reply text with a named fence, a bare object or a code fence put around it."""
    c = table(spark, sf_dir, "conversations")
    obj = F.concat(F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(', "turn": '), F.col("turn").cast("string"), F.lit("}"))
    reply = (
        F.when(F.col("role") == "assistant", F.concat("text", F.lit(" ```json\n"), obj, F.lit("\n``` done\n")))
        .when(F.col("role") == "user", F.concat(obj, F.lit(" "), "text"))
        .otherwise(F.concat("text", F.lit("```python\nx = "), F.col("turn").cast("string"), F.lit("\n```{")))
    )
    return c.select(
        "conv_id", "turn",
        F.coalesce(R.json_text(reply), F.lit("none")).alias("json_text"),
        R.code_text(reply).alias("code_text"),
    )
