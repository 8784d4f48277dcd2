"""Source class, gate, stagnation, budget, routing and memory over events as attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspark import markers as M
from crawlspark.functions import urls as U
from crawlspark.operators import evidence as E
from crawlspark.operators import keyed as K
from crawlspark.operators import memory as ME
from crawlspark.plans.inputs import SQL_BUCKET, event_bucket, sql_host, sql_segments, table
from crawlspark.plans.registry import query
from crawlspark.session import shared_dir
from crawlspark.sources import readers, sinks

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
CHUNK = 10_000  # rows of the event order worked on together


def k_of():
    return F.try_variant_get(F.try_parse_json("props"), "$.k", "int")


def attempts(spark, sf_dir):
    """Events as investigation attempts, numbered per user (the run)."""
    e = table(spark, sf_dir, "events").withColumn("k", k_of())
    kind, value, k = F.col("event_type"), F.col("value"), F.col("k")
    facts = e.select(
        F.col("user_id").alias("run_id"),
        "event_id",
        F.when(kind != "signup", F.concat(F.lit("https://jobs.example.org/"), F.floor(k / 50).cast("string"))).alias("careers_url"),
        F.when(kind == "view", "rest_api").when(kind == "click", "ssr_html").when(kind == "purchase", "spa_rendered").alias("source_type"),
        F.when(value < 3, "confirmed").when(value < 5, "not_required").otherwise("unknown").alias("pagination_status"),
        F.when(value < 3, "page number").when(value < 5, "single_page").alias("pagination_mechanism"),
        F.when(k < 30, "query param country=IN").when(k < 90, M.CLIENT_SIDE_FILTER).alias("india_filter_mechanism"),
        F.when(k >= 95, k.cast("long")).alias("reported_total_count"),
    )
    return K.number_rows(facts, ["run_id"], [F.col("event_id")], K.span(F.col("event_id"), CHUNK), "attempt")


_SQL_ATTEMPTS = f"""
attempts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS attempt,
    careers_url IS NOT NULL AND source_type IS NOT NULL AND pagination_status <> 'unknown' AND india_filter_mechanism IS NOT NULL AS sufficient,
    concat_ws('|', coalesce(source_type, 'None'), coalesce(careers_url, 'None'), pagination_status, coalesce(pagination_mechanism, 'None'),
      coalesce(india_filter_mechanism, 'None'), coalesce(CAST(reported_total_count AS VARCHAR), 'None')) AS fingerprint
  FROM (SELECT user_id AS run_id, event_id,
    CASE WHEN event_type <> 'signup' THEN 'https://jobs.example.org/' || CAST(floor(k / 50) AS INTEGER) END AS careers_url,
    CASE event_type WHEN 'view' THEN 'rest_api' WHEN 'click' THEN 'ssr_html' WHEN 'purchase' THEN 'spa_rendered' END AS source_type,
    CASE WHEN value < 3 THEN 'confirmed' WHEN value < 5 THEN 'not_required' ELSE 'unknown' END AS pagination_status,
    CASE WHEN value < 3 THEN 'page number' WHEN value < 5 THEN 'single_page' END AS pagination_mechanism,
    CASE WHEN k < 30 THEN 'query param country=IN' WHEN k < 90 THEN 'client_side_fallback' END AS india_filter_mechanism,
    CASE WHEN k >= 95 THEN k END AS reported_total_count
  FROM (SELECT *, {_K} AS k FROM events)))"""


@query(
    "evidence_gate",
    f"""WITH {_SQL_ATTEMPTS} SELECT run_id, attempt, sufficient, CASE WHEN pagination_status = 'unknown' THEN 0.3
      WHEN coalesce(india_filter_mechanism, 'client_side_fallback') <> 'client_side_fallback' THEN 0.9 ELSE 0.6 END AS confidence FROM attempts""",
)
def evidence_gate(spark, sf_dir):
    return E.gate(attempts(spark, sf_dir)).select("run_id", "attempt", "sufficient", "confidence")


SQL_ATTEMPTS_WITH = f"WITH {_SQL_ATTEMPTS}"


@query(
    "fingerprint_stagnation",
    f"""{SQL_ATTEMPTS_WITH} SELECT run_id, attempt, fingerprint,
  NOT sufficient AND coalesce(fingerprint = lag(fingerprint) OVER (PARTITION BY run_id ORDER BY attempt), false) AS stagnant FROM attempts""",
)
def fingerprint_stagnation(spark, sf_dir):
    out = E.stagnation(attempts(spark, sf_dir), ["run_id"])
    return out.select("run_id", "attempt", "fingerprint", "stagnant")


# A run is a user's month, so that some runs stay within their budget.
_SQL_STEPS = f"""
steps AS (
  SELECT user_id * 10000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) % 10000 AS run_id, event_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'evidence' WHEN event_type = 'purchase' THEN 'validation' ELSE 'repair' END AS kind,
    value < 10 AS sufficient, value < 4 AS passed, {_K} % 4 = 0 AS stagnant FROM events)"""


@query(
    "attempt_budget",
    f"""WITH {_SQL_STEPS}, spent AS (SELECT *, greatest(3 - sum(CASE WHEN (kind = 'evidence' AND NOT sufficient) OR kind = 'repair' THEN 1 ELSE 0 END)
        OVER (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS left_ FROM steps)
    SELECT run_id, event_id, CAST(left_ AS BIGINT) AS attempts_left, left_ <= 0 AS exhausted,
      CASE kind WHEN 'evidence' THEN CASE WHEN sufficient THEN 'sufficient' WHEN left_ <= 0 OR stagnant THEN 'budget_exhausted' ELSE 'insufficient' END
        WHEN 'validation' THEN CASE WHEN passed THEN 'pass' WHEN left_ <= 0 THEN 'budget_exhausted' ELSE 'fail' END ELSE 'none' END AS route
    FROM spent""",
)
def attempt_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "evidence")
        .when(F.col("event_type") == "purchase", "validation")
        .otherwise("repair")
    )
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    steps = e.select(
        (F.col("user_id") * 10000 + day % 10000).alias("run_id"),
        "event_id",
        kind.alias("kind"),
        (F.col("value") < 10).alias("sufficient"),
        (F.col("value") < 4).alias("passed"),
        (k_of() % 4 == 0).alias("stagnant"),
    )
    spent = E.attempt_budget(steps, ["run_id"], [F.col("event_id")], K.span(F.col("event_id"), CHUNK), 3)
    return spent.select(
        "run_id", "event_id", "attempts_left", "exhausted", F.coalesce(E.route(), F.lit("none")).alias("route")
    )


@query(
    "evidence_class",
    f"""WITH f AS (SELECT event_id, value > 60 AS is_pdf, value > 90 AS pdf_ok,
        CASE event_type WHEN 'click' THEN 'GET' WHEN 'purchase' THEN 'POST' END AS api, k % 2 = 0 AS graphql,
        CASE WHEN value < 5 THEN 'page number' WHEN value < 10 THEN 'single_page' END AS mech,
        k % 4 AS n_rendered, k % 3 AS n_common, k % 5 = 0 AS service, k % 7 = 0 AS driven, CASE WHEN k % 6 = 0 THEN 'query param country=IN' END AS filt
      FROM (SELECT *, {_K} AS k FROM events)),
    g AS (SELECT *, CASE WHEN is_pdf AND pdf_ok THEN 'pdf' WHEN is_pdf THEN 'nopdf' WHEN api IS NOT NULL THEN 'api'
      WHEN n_rendered > 0 AND n_common > 0 THEN 'ssr' WHEN n_rendered > 0 THEN 'spa' ELSE 'dead' END AS c FROM f)
    SELECT event_id, coalesce(CASE c WHEN 'pdf' THEN 'ssr_html' WHEN 'api' THEN CASE WHEN api = 'POST' AND graphql THEN 'graphql' ELSE 'rest_api' END
        WHEN 'ssr' THEN 'ssr_html' WHEN 'spa' THEN 'spa_rendered' WHEN 'dead' THEN 'spa_no_api' END, 'none') AS source_type,
      coalesce(CASE WHEN c = 'pdf' THEN 'not_required' WHEN c IN ('api', 'ssr') THEN CASE mech WHEN 'page number' THEN 'confirmed' WHEN 'single_page' THEN 'not_required' ELSE 'unknown' END
        WHEN c = 'spa' THEN CASE WHEN driven THEN 'confirmed' ELSE 'unknown' END WHEN c = 'dead' THEN 'unknown' END, 'none') AS pagination_status,
      coalesce(CASE WHEN c = 'pdf' THEN 'single_page' WHEN c IN ('api', 'ssr') THEN mech WHEN c = 'spa' AND driven THEN 'scroll' END, 'none') AS pagination_mechanism,
      CASE WHEN c = 'nopdf' THEN 'none' WHEN c IN ('api', 'ssr') THEN coalesce(filt, 'client_side_fallback') ELSE 'client_side_fallback' END AS india_filter_mechanism,
      c = 'spa' AS requires_browser, c = 'spa' AND service AS requires_firecrawl FROM g""",
)
def evidence_class(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", k_of())
    value, k = F.col("value"), F.col("k")
    mechanism = F.when(value < 5, "page number").when(value < 10, "single_page")
    verdict = F.struct(
        mechanism.isNotNull().alias("confirmed"), mechanism.alias("mechanism"), F.lit(None).cast("string").alias("param")
    )
    served = F.when(k % 6 == 0, "query param country=IN")
    facts = e.select(
        "event_id",
        (value > 60).alias("is_pdf"),
        F.when(value > 90, F.repeat(F.lit("text "), 40)).otherwise("short").alias("pdf_text"),
        F.when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "purchase", "POST").alias("api_method"),
        (k % 2 == 0).alias("api_is_graphql"),
        verdict.alias("api_pagination"),
        served.alias("api_filter"),
        (k % 4).alias("n_rendered"),
        (k % 3).alias("n_common"),
        verdict.alias("html_pagination"),
        served.alias("html_filter"),
        F.struct(
            F.when(k % 7 == 0, "confirmed").otherwise("unknown").alias("status"),
            F.when(k % 7 == 0, "scroll").alias("mechanism"),
        ).alias("rendered"),
        (k % 5 == 0).alias("from_render_service"),
    )
    none = F.lit("none")
    return E.classify(facts).select(
        "event_id",
        *[
            F.coalesce(c, none).alias(c)
            for c in ("source_type", "pagination_status", "pagination_mechanism", "india_filter_mechanism")
        ],
        "requires_browser",
        "requires_firecrawl",
    )


_CATEGORY = "CASE event_type WHEN 'signup' THEN 'syntax_error' WHEN 'view' THEN 'http_forbidden' WHEN 'click' THEN 'other' WHEN 'purchase' THEN 'never_seen' END"


@query(
    "repair_routing",
    f"""SELECT event_id, CASE {_CATEGORY} WHEN 'syntax_error' THEN 'patch' WHEN 'http_forbidden' THEN 're-investigate' ELSE 'rewrite' END AS action,
      CASE {_CATEGORY} WHEN 'syntax_error' THEN 'docker_execute' WHEN 'http_forbidden' THEN 'investigate' ELSE 'generate_script' END AS next_stage
    FROM events""",
)
def repair_routing(spark, sf_dir):
    kind = F.col("event_type")
    category = (
        F.when(kind == "signup", "syntax_error").when(kind == "view", "http_forbidden")
        .when(kind == "click", "other").when(kind == "purchase", "never_seen")
    )
    e = table(spark, sf_dir, "events").withColumn("category", category)
    return e.select(
        "event_id", E.repair_action(F.col("category")).alias("action"), E.next_stage(F.col("category")).alias("next_stage")
    )


@query(
    "execution_category",
    f"""SELECT doc_id, CASE WHEN lang = 'de' THEN 'timeout' WHEN doc_id % 3 = 0 THEN 'none'
        WHEN lang = 'en' THEN 'syntax_error' ELSE 'runtime_error' END AS category,
      CASE WHEN lang = 'de' THEN 'The run was ended at its time limit.' WHEN doc_id % 3 = 0 THEN 'none'
        ELSE right(text || CASE WHEN lang = 'en' THEN ' SyntaxError: bad' ELSE ' ValueError' END, 2000) END AS detail FROM documents""",
)
def execution_category(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    timed_out, code = F.col("lang") == "de", (F.col("doc_id") % 3).cast("int")
    stderr = F.concat("text", F.when(F.col("lang") == "en", " SyntaxError: bad").otherwise(" ValueError"))
    return d.select(
        "doc_id",
        F.coalesce(E.execution_category(timed_out, code, stderr), F.lit("none")).alias("category"),
        F.coalesce(E.execution_detail(timed_out, code, stderr), F.lit("none")).alias("detail"),
    )


# --- memory -----------------------------------------------------------------

_SHAPE = (
    f"array_to_string(list_transform({sql_segments('url')}, lambda s: "
    "CASE WHEN regexp_matches(s, '^[0-9]+$') THEN 'N' ELSE 'S' END), '/')"
)
_LANG_HOSTS = {"fr": "boards.greenhouse.io", "de": "acme.wd3.myworkdayjobs.com", "es": "jobs.lever.co"}
_HINTS = dict(M.PLATFORM_HINTS)
_SQL_HINT = (
    f"CASE lang WHEN 'fr' THEN '{_HINTS['greenhouse.io']}' WHEN 'de' THEN '{_HINTS['myworkdayjobs.com']}' "
    f"WHEN 'es' THEN '{_HINTS['lever.co']}' END"
)


@query(
    "site_signature",
    f"""SELECT host, lang, coalesce({_SQL_HINT}, 'none') AS hint,
      substr(sha256(coalesce({_SQL_HINT}, 'unknown') || '::' || string_agg(shape, ',' ORDER BY shape)), 1, 16) AS signature
    FROM (SELECT DISTINCT {sql_host('url')} AS host, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, {_SHAPE} AS shape FROM pages)
    GROUP BY host, lang""",
)
def site_signature(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        U.host(F.col("url")).alias("host"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), "url"
    )
    shapes = ME.url_shapes(pages, ["host", "lang"])
    platform = F.create_map(*[F.lit(x) for p in _LANG_HOSTS.items() for x in p])[F.col("lang")]
    hinted = shapes.withColumn("hint", ME.platform_hint(F.coalesce(platform, F.col("host"))))
    return hinted.select(
        "host", "lang", F.coalesce("hint", F.lit("none")).alias("hint"),
        ME.site_signature(F.col("hint"), F.col("shape")).alias("signature"),
    )


_SQL_STORE = f"""
confirmed AS (SELECT substr(sha256(event_type || '::' || {SQL_BUCKET}), 1, 16) AS signature, event_type AS source_type,
    CASE WHEN value < 10 THEN 'page number' ELSE 'offset/limit' END AS pagination_mechanism,
    CASE WHEN value < 10 THEN 'page' ELSE 'offset' END AS pagination_param, 'client_side_fallback' AS india_filter_mechanism,
    CAST(NULL AS VARCHAR) AS ats_hint, floor(epoch(ts) / 3600) AS confirmed_at FROM events),
store AS (SELECT substr(sha256(kind || '::' || r_regionkey), 1, 16) AS signature, kind AS source_type, 'single_page' AS pagination_mechanism,
    CAST(NULL AS VARCHAR) AS pagination_param, 'query param country=IN' AS india_filter_mechanism, r_name AS ats_hint,
    r_regionkey + 1 AS hit_count, CAST(r_regionkey AS DOUBLE) AS last_seen FROM region, (VALUES ('view'), ('old')) t(kind)),
upserted AS (
  SELECT signature, CASE WHEN n IS NULL THEN s.source_type ELSE f.source_type END AS source_type,
    CASE WHEN n IS NULL THEN s.pagination_mechanism ELSE f.pagination_mechanism END AS pagination_mechanism,
    CASE WHEN n IS NULL THEN s.pagination_param ELSE f.pagination_param END AS pagination_param,
    CASE WHEN n IS NULL THEN s.india_filter_mechanism ELSE f.india_filter_mechanism END AS india_filter_mechanism,
    coalesce(CASE WHEN n IS NULL THEN s.ats_hint ELSE f.ats_hint END, 'none') AS ats_hint,
    coalesce(hit_count, 0) + coalesce(n, 0) AS hit_count, coalesce(seen, last_seen) AS last_seen
  FROM store s FULL JOIN (SELECT *, count(*) OVER (PARTITION BY signature) AS n, max(confirmed_at) OVER (PARTITION BY signature) AS seen,
      row_number() OVER (PARTITION BY signature ORDER BY confirmed_at DESC, source_type DESC, pagination_mechanism DESC, pagination_param DESC) AS rn
    FROM confirmed QUALIFY rn = 1) f USING (signature))"""


def _confirmed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.substring(F.sha2(F.concat("event_type", F.lit("::"), event_bucket().cast("string")), 256), 1, 16).alias("signature"),
        F.col("event_type").alias("source_type"),
        F.when(F.col("value") < 10, "page number").otherwise("offset/limit").alias("pagination_mechanism"),
        F.when(F.col("value") < 10, "page").otherwise("offset").alias("pagination_param"),
        F.lit(M.CLIENT_SIDE_FILTER).alias("india_filter_mechanism"),
        F.lit(None).cast("string").alias("ats_hint"),
        F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("double").alias("confirmed_at"),
    )


def _store(spark, sf_dir):
    kinds = F.explode(F.array(F.lit("view"), F.lit("old")))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name", kinds.alias("kind"))
    return r.select(
        ME.site_signature(F.col("kind"), F.col("r_regionkey").cast("string")).alias("signature"),
        F.col("kind").alias("source_type"),
        F.lit("single_page").alias("pagination_mechanism"),
        F.lit(None).cast("string").alias("pagination_param"),
        F.lit("query param country=IN").alias("india_filter_mechanism"),
        F.col("r_name").alias("ats_hint"),
        (F.col("r_regionkey") + 1).cast("long").alias("hit_count"),
        F.col("r_regionkey").cast("double").alias("last_seen"),
    )


@query("pattern_upsert", f"WITH {_SQL_STORE} SELECT * FROM upserted")
def pattern_upsert(spark, sf_dir):
    merged = ME.upsert(_store(spark, sf_dir), _confirmed(spark, sf_dir))
    return merged.withColumn("ats_hint", F.coalesce("ats_hint", F.lit("none")))


@query(
    "pattern_store",
    f"WITH {_SQL_STORE} SELECT signature, source_type, hit_count, last_seen FROM upserted",
)
def pattern_store(spark, sf_dir):
    """Upsert, save to a new path next to an unreadable line, load again."""
    path = shared_dir(spark, "patterns")
    sinks.write_patterns(ME.upsert(_store(spark, sf_dir), _confirmed(spark, sf_dir)), path)
    broken = table(spark, sf_dir, "region").select(F.concat("r_name", F.lit(" is not json{{{")).alias("value"))
    broken.write.mode("append").text(path)
    return readers.patterns(spark, path).select("signature", "source_type", "hit_count", "last_seen")


@query(
    "pattern_lookup",
    f"""WITH {_SQL_STORE} SELECT event_id, coalesce(pagination_param, 'none') AS hint_param, coalesce(india_filter_mechanism, 'none') AS hint_filter
      FROM (SELECT event_id, substr(sha256(event_type || '::' || {SQL_BUCKET}), 1, 16) AS signature FROM events) LEFT JOIN store USING (signature)""",
)
def pattern_lookup(spark, sf_dir):
    sources = table(spark, sf_dir, "events").select(
        "event_id", ME.site_signature(F.col("event_type"), event_bucket().cast("string")).alias("signature")
    )
    found = ME.lookup(sources, _store(spark, sf_dir))
    return found.select(
        "event_id",
        F.coalesce("hint_param", F.lit("none")).alias("hint_param"),
        F.coalesce("hint_filter", F.lit("none")).alias("hint_filter"),
    )
