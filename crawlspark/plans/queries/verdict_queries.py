"""Pagination and filter verdicts over events: a user is a source, event types are probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import payload as J
from crawlspark.operators import verdicts as V
from crawlspark.plans.inputs import SQL_BUCKET, event_bucket, table
from crawlspark.plans.registry import query


def _probes(spark, sf_dir, trial_of: dict[str, str], empty_above: float, silent_above: float):
    """Items per (user, trial). Large values are empty answers, larger ones failed probes."""
    e = table(spark, sf_dir, "events")
    trial = F.create_map(*[F.lit(x) for p in trial_of.items() for x in p])[F.col("event_type")]
    item = J.canonical(F.to_json(F.struct(event_bucket().alias("bucket"), F.lit("x").alias("a"))))
    return e.where(trial.isNotNull()).select(
        "user_id",
        trial.alias("trial"),
        F.when(F.col("value") < empty_above, item).alias("item"),
        ((trial == V.BASE) | (F.col("value") < silent_above)).alias("responded"),
    )


def _sql_sets(trial_of: dict[str, str], empty_above: float, silent_above: float) -> str:
    """Per user: sorted distinct items of the base and of every trial, NULL without answer."""
    base = next(k for k, v in trial_of.items() if v == V.BASE)
    cols = []
    for kind, trial in trial_of.items():
        heard = f"event_type = '{kind}'" + ("" if kind == base else f" AND value < {silent_above}")
        n = "base" if kind == base else kind
        cols.append(
            f"list_sort(coalesce(list_distinct(list(bucket) FILTER ({heard} AND value < {empty_above})), [])) AS {n}_set, "
            f"count(*) FILTER ({heard}) > 0 AS {n}_heard"
        )
    kinds = ", ".join(f"'{k}'" for k in trial_of)
    return (
        f"sets AS (SELECT user_id, {', '.join(cols)} FROM (SELECT *, {SQL_BUCKET} AS bucket FROM events "
        f"WHERE event_type IN ({kinds})) GROUP BY user_id HAVING count(*) FILTER (event_type = '{base}' OR value < {silent_above}) > 0)"
    )


_QUERY = {"view": V.BASE, "click": "page", "purchase": "offset", "signup": "start"}
_HINT = "CASE WHEN user_id % 3 = 0 THEN 'start' WHEN user_id % 3 = 1 THEN 'other' END"


def _hint():
    u = F.col("user_id")
    return F.when(u % 3 == 0, "start").when(u % 3 == 1, "other")


def _verdict_columns(df, name="pagination"):
    v = F.col(name)
    return df.select(
        "user_id",
        v["confirmed"].alias("confirmed"),
        F.coalesce(v["mechanism"], F.lit("none")).alias("mechanism"),
        F.coalesce(v["param"], F.lit("none")).alias("param"),
        V.pagination_status(v).alias("status"),
    )


def _sql_different(kind: str) -> str:
    return f"(len(base_set) > 0 AND len({kind}_set) > 0 AND {kind}_set <> base_set)"


@query(
    "pagination_verdict",
    f"""WITH {_sql_sets(_QUERY, 30, 60)}, hits AS (SELECT user_id, list_filter(
        CASE WHEN user_id % 3 = 0 THEN ['start', 'page', 'offset'] ELSE ['page', 'offset', 'start'] END,
        lambda t: (t = 'page' AND {_sql_different('click')}) OR (t = 'offset' AND {_sql_different('purchase')})
          OR (t = 'start' AND {_sql_different('signup')}))[1] AS param FROM sets)
    SELECT user_id, param IS NOT NULL AS confirmed,
      CASE param WHEN 'page' THEN 'page number' WHEN 'offset' THEN 'offset/limit' WHEN 'start' THEN 'offset/limit' ELSE 'none' END AS mechanism,
      coalesce(param, 'none') AS param, CASE WHEN param IS NULL THEN 'unknown' ELSE 'confirmed' END AS status FROM hits""",
)
def pagination_verdict(spark, sf_dir):
    facts = V.trial_facts(_probes(spark, sf_dir, _QUERY, 30, 60), ["user_id"], list(V.QUERY_TRIALS))
    return _verdict_columns(V.query_pagination(facts, _hint()))


_URL_FILTER = {"view": V.BASE, "signup": "country=IN", "purchase": "location=India", "error": "country=India"}


@query(
    "filter_verdict",
    f"""WITH {_sql_sets(_URL_FILTER, 8, 60)} SELECT user_id,
      CASE WHEN len(signup_set) > 0 THEN 'query param country=IN' WHEN len(purchase_set) > 0 THEN 'query param location=India'
        WHEN len(error_set) > 0 THEN 'query param country=India' ELSE 'client_side_fallback' END AS any_records,
      CASE WHEN {_sql_different('signup')} THEN 'query param country=IN' WHEN {_sql_different('purchase')} THEN 'query param location=India'
        WHEN {_sql_different('error')} THEN 'query param country=India' ELSE 'client_side_fallback' END AS changed_links
    FROM sets""",
)
def filter_verdict(spark, sf_dir):
    facts = V.trial_facts(_probes(spark, sf_dir, _URL_FILTER, 8, 60), ["user_id"], V.filter_trials())
    both = V.html_filter(V.query_filter(facts, name="any_records"), name="changed_links")
    fallback = F.lit(M.CLIENT_SIDE_FILTER)
    return both.select(
        "user_id",
        F.coalesce("any_records", fallback).alias("any_records"),
        F.coalesce("changed_links", fallback).alias("changed_links"),
    )


_BODY = {"view": V.BASE, "click": V.NEXT_PAGE}


@query(
    "body_pagination",
    f"""WITH {_sql_sets(_BODY, 25, 40)}, judged AS (SELECT user_id, CASE
        WHEN len(base_set) = 0 OR NOT click_heard OR user_id % 5 = 0 THEN 0
        WHEN len(click_set) = 0 THEN 1 WHEN click_set <> base_set THEN 2 ELSE 0 END AS v FROM sets)
    SELECT user_id, v > 0 AS confirmed, CASE v WHEN 1 THEN 'single_page' WHEN 2 THEN
        CASE WHEN user_id % 2 = 0 THEN 'cursor' ELSE 'offset/limit' END ELSE 'none' END AS mechanism,
      CASE v WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 'variables' ELSE 'body' END ELSE 'none' END AS param,
      ['unknown', 'not_required', 'confirmed'][v + 1] AS status FROM judged""",
)
def body_pagination(spark, sf_dir):
    facts = V.trial_facts(_probes(spark, sf_dir, _BODY, 25, 40), ["user_id"], [V.NEXT_PAGE])
    u = F.col("user_id")
    mechanism = F.when(u % 5 == 0, None).when(u % 2 == 0, "cursor").otherwise("offset/limit")
    param = F.when(u % 2 == 0, "variables").otherwise("body")
    return _verdict_columns(V.body_pagination(facts, mechanism, param))


_BODY_FILTER = {"view": V.BASE, "click": "country=IN", "purchase": "location=India", "signup": "countryCode=IN", "error": "region=India"}


@query(
    "body_filter",
    f"""WITH {_sql_sets(_BODY_FILTER, 12, 60)} SELECT user_id, coalesce('body param ' || CASE
      WHEN len(click_set) > 0 AND click_set <> base_set THEN 'country=IN' WHEN len(purchase_set) > 0 AND purchase_set <> base_set THEN 'location=India'
      WHEN len(signup_set) > 0 AND signup_set <> base_set THEN 'countryCode=IN' WHEN len(error_set) > 0 AND error_set <> base_set THEN 'region=India' END,
      'client_side_fallback') AS mechanism FROM sets""",
)
def body_filter(spark, sf_dir):
    facts = V.trial_facts(
        _probes(spark, sf_dir, _BODY_FILTER, 12, 60), ["user_id"], V.filter_trials(M.BODY_FILTER_PROBES)
    )
    found = V.body_filter(facts)
    return found.select("user_id", F.coalesce("filter", F.lit(M.CLIENT_SIDE_FILTER)).alias("mechanism"))


_HTML = {"view": V.BASE, "click": "page", "purchase": "p", "error": "pg"}


def _sql_html(kind: str) -> str:
    return (
        f"CASE WHEN NOT {kind}_heard THEN NULL WHEN len({kind}_set) = 0 THEN 'single_page' "
        f"WHEN {kind}_set <> base_set THEN 'page number' END"
    )


@query(
    "single_page_verdict",
    f"""WITH {_sql_sets(_HTML, 14, 25)}, steps AS (SELECT *, {_sql_html('click')} AS m1, {_sql_html('purchase')} AS m2, {_sql_html('error')} AS m3,
        CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS hinted FROM sets),
      verdict AS (SELECT user_id, len(base_set) > 0 AS has_base, click_heard OR purchase_heard OR error_heard AS heard,
        CASE WHEN hinted = 1 THEN coalesce(m3, m1, m2) ELSE coalesce(m1, m2, m3) END AS m,
        CASE WHEN hinted = 1 AND m3 IS NOT NULL THEN 'pg' WHEN m1 IS NOT NULL THEN 'page' WHEN m2 IS NOT NULL THEN 'p' ELSE 'pg' END AS p FROM steps)
    SELECT user_id, has_base AND heard AS confirmed,
      CASE WHEN has_base AND heard THEN coalesce(m, 'single_page') ELSE 'none' END AS mechanism,
      CASE WHEN has_base AND m = 'page number' THEN p ELSE 'none' END AS param,
      CASE WHEN NOT (has_base AND heard) THEN 'unknown' WHEN m = 'page number' THEN 'confirmed' ELSE 'not_required' END AS status
    FROM verdict""",
)
def single_page_verdict(spark, sf_dir):
    facts = V.trial_facts(_probes(spark, sf_dir, _HTML, 14, 25), ["user_id"], list(V.HTML_TRIALS))
    hint = F.when(F.col("user_id") % 2 == 0, "pg").otherwise("nope")
    return _verdict_columns(V.html_pagination(facts, hint))


# --- page walks -------------------------------------------------------------

# A customer's orders by priority class stand for the pages of a listing.
_PAGE = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_ITEM = "CASE WHEN o_totalprice > 20000 THEN o_orderkey END"


def _order_pages(spark, sf_dir, item):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("page_no"),
        item.alias("item"),
    )


def _sql_walk(full: int) -> str:
    return f"""WITH walk AS (SELECT o_custkey AS source_id, {_PAGE} AS page_no, {_ITEM} AS item FROM orders),
    stops AS (SELECT source_id, min(page_no) AS stop FROM (SELECT source_id, page_no, count(item) AS n FROM walk GROUP BY 1, 2)
      WHERE n < {full} GROUP BY 1)
    SELECT w.source_id, CAST(w.page_no AS BIGINT) AS page_no, w.item FROM walk w LEFT JOIN stops s USING (source_id)
    WHERE w.item IS NOT NULL AND (s.stop IS NULL OR w.page_no <= s.stop)"""


def _walked(df):
    return df.select("source_id", F.col("page_no").cast("long").alias("page_no"), "item")


@query("page_walk", _sql_walk(2))
def page_walk(spark, sf_dir):
    item = F.when(F.col("o_totalprice") > 20000, F.col("o_orderkey"))
    return _walked(V.walk_until_short(_order_pages(spark, sf_dir, item), ["source_id"], "page_no", "item", 2))


@query("page_walk_empty", _sql_walk(1))
def page_walk_empty(spark, sf_dir):
    item = F.when(F.col("o_totalprice") > 20000, F.col("o_orderkey"))
    return _walked(V.walk_until_short(_order_pages(spark, sf_dir, item), ["source_id"], "page_no", "item"))


@query(
    "page_walk_links",
    f"""WITH walk AS (SELECT o_custkey AS source_id, {_PAGE} AS page_no, month(o_orderdate) AS item FROM orders),
    marked AS (SELECT *, page_no = min(page_no) OVER (PARTITION BY source_id, item) AS is_new FROM walk),
    stops AS (SELECT source_id, min(page_no) AS stop FROM (SELECT source_id, page_no, bool_or(is_new) AS adds FROM marked GROUP BY 1, 2)
      WHERE NOT adds GROUP BY 1)
    SELECT m.source_id, CAST(m.page_no AS BIGINT) AS page_no, m.item FROM marked m LEFT JOIN stops s USING (source_id)
    WHERE is_new AND (s.stop IS NULL OR m.page_no < s.stop)""",
)
def page_walk_links(spark, sf_dir):
    pages = _order_pages(spark, sf_dir, F.month("o_orderdate").cast("long"))
    return _walked(V.walk_until_known(pages, ["source_id"], "page_no", "item"))
