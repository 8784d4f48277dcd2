"""Stored pages, captures and probes to one evidence row per domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import html as H
from crawlspark.functions import payload as J
from crawlspark.functions import predicates as P
from crawlspark.functions import urls as U
from crawlspark.operators import candidates as C
from crawlspark.operators import evidence as E
from crawlspark.operators import keyed as K
from crawlspark.operators import links as L
from crawlspark.operators import memory as ME
from crawlspark.operators import verdicts as V
from crawlspark.session import settled
from crawlspark.sources import readers

_URL_FILTERS = V.filter_trials(M.URL_FILTER_PROBES)
_BODY_FILTERS = V.filter_trials(M.BODY_FILTER_PROBES)
_API_TRIALS = [*V.QUERY_TRIALS, *_URL_FILTERS, V.NEXT_PAGE, *[t for t in _BODY_FILTERS if t not in _URL_FILTERS]]
_PLAIN = "plain fetch"
_LINK_TRIALS = [*V.HTML_TRIALS, *_URL_FILTERS, _PLAIN]


# --- one scan per table -----------------------------------------------------


def page_facts(pages: DataFrame, key: str = "domain") -> DataFrame:
    """All that the plan asks of a page, read from its HTML and PDF text in one scan; neither goes further."""
    html, url = F.col("html"), F.col("url")
    return pages.select(
        key,
        "url",
        P.is_pdf(F.col("content_type")).alias("is_pdf"),
        P.is_usable_pdf_text(F.col("pdf_text")).alias("pdf_usable"),
        "from_render_service",
        H.rendered_pagination(html, F.col("interactions")).alias("rendered"),
        H.endpoint_literals(html, url).alias("endpoints"),
        H.bundle_urls(html, url).alias("bundles"),
        H.job_links(html).alias("links"),
    )


def item_hashes(items: Column) -> Column:
    """128 bits of each item's canonical JSON, repeats once: sets compare by these, not by texts."""
    return F.array_distinct(F.transform(items, lambda i: F.unhex(F.md5(J.canonical(i)))))


def _list_facts(items: Column) -> list[Column]:
    return [
        F.coalesce(F.size(items), F.lit(0)).alias("n_items"),
        item_hashes(items).alias("hashes"),
        J.sample_keys(items[0]).alias("shape"),
    ]


def capture_facts(captures: DataFrame, key: str = "domain") -> DataFrame:
    """Captures with their record list as hashes and the paging of their request; bodies stay behind.

    ``n_items`` is 0 for tracking hosts, empty bodies and bodies without a list. Only requests that can
    be replayed by their body, with a list, have ``moved``.
    """
    seen = readers.exchanges(captures.select(key, "seq", "url", "method", "request_body", "body"))
    usable = ~P.is_denied(F.col("url")) & (F.col("body") != "")
    read = seen.select(
        key, "seq", "url", "method", "is_graphql", "json_body", "response_json",
        F.when(usable, J.record_list(F.col("response_json"))).alias("items"),
    )
    variables = F.coalesce(F.get_json_object("json_body", "$.variables"), F.lit("{}"))
    moved = F.when(
        F.col("is_graphql"), J.next_page_variables(variables, F.col("response_json"))["mechanism"]
    ).otherwise(J.next_page_body(F.col("json_body"))["mechanism"])
    by_body = (F.col("method") != "GET") & (F.size("items") > 0)
    return read.select(
        key, "seq", "url", "method", "is_graphql",
        F.get_json_object("json_body", "$").isNotNull().alias("has_json_body"),
        *_list_facts(F.col("items")),
        F.when(by_body, moved).alias("moved"),
    )


def probe_facts(probes: DataFrame, key: str = "domain") -> DataFrame:
    """Answers by kind: record lists as hashes, links, or the URL literals of a script; bodies stay behind."""
    kind, body = F.col("kind"), F.col("body")
    read = probes.where(kind.isin("api", "endpoint", "html", "bundle")).select(
        key, "kind", "trial", "status",
        F.when(kind.isin("api", "endpoint"), J.record_list(body)).alias("items"),
        F.when(kind == "html", H.job_links(body)).alias("links"),
        F.when(kind == "bundle", H.raw_endpoint_literals(body)).alias("literals"),
    )
    return read.select(key, "kind", "trial", "status", "links", "literals", *_list_facts(F.col("items")))


# --- from facts to verdicts -------------------------------------------------


def named_endpoints(
    pages: DataFrame,
    captures: DataFrame,
    probes: DataFrame,
    key: str = "domain",
    bundles: int = 12,
    urls: int = 15,
) -> DataFrame:
    """Answers of the endpoints that a page or its script bundles name, as captures. All inputs are facts.

    Bundles (probe kind ``bundle``) and endpoints (kind ``endpoint``) are found by their URL in
    ``trial``. The first ``bundles`` scripts of a site are read and the ``urls`` endpoints with the
    most marker words looked up, as the budget of one investigation allows; ``seq`` is their rank.
    """
    inline = pages.select(key, F.posexplode("endpoints").alias("seq", "endpoint_url")).withColumn("source_no", F.lit(0))
    listed = pages.select(key, F.lit(0).alias("source_no"), F.posexplode("bundles").alias("seq", "bundle_url"))
    scripts = L.all_bundles(listed, pages, captures, key)
    scripts = K.top_k_per_key(scripts, [key], [F.col("source_no"), F.col("seq")], bundles, "bundle_no")
    texts = probes.where(F.col("kind") == "bundle").select(F.col(key).alias("_key"), "trial", "literals")
    read = scripts.join(texts, scripts[key].eqNullSafe(texts["_key"]) & (F.col("bundle_url") == F.col("trial")))
    read = K.attach(read.select(key, "bundle_no", "literals"), pages.select(key, "url"), [key])
    absolute = H.absolute_endpoints(F.col("literals"), F.col("url"))
    in_scripts = read.select(key, F.col("bundle_no").alias("source_no"), F.posexplode(absolute).alias("seq", "endpoint_url"))
    named = C.dedupe_first(inline.unionByName(in_scripts), [key], "endpoint_url", ["source_no", "seq"])
    ranked = C.top_by_marker_hits(named, [key], urls, "endpoint_url", ["source_no", "seq"])
    answers = probes.where((F.col("kind") == "endpoint") & (F.col("status") < 400) & (F.col("n_items") > 0)).select(
        F.col(key).alias("_key"), "trial", "n_items", "hashes", "shape"
    )
    found = ranked.join(answers, ranked[key].eqNullSafe(answers["_key"]) & (F.col("endpoint_url") == F.col("trial")))
    return found.where(~P.is_denied(F.col("endpoint_url"))).select(
        key, F.col("rank").alias("seq"), F.lit("GET").alias("method"),
        P.is_graphql(F.col("endpoint_url"), F.lit(None).cast("string")).alias("is_graphql"),
        F.lit(False).alias("has_json_body"), "n_items", "hashes", "shape", F.lit(None).cast("string").alias("moved"),
    )


def best_api(captures: DataFrame, key: str = "domain", named: DataFrame | None = None) -> DataFrame:
    """The capture of each domain with the longest record list; the first wins a tie. Inputs are facts.

    ``named`` holds answers of endpoints that scripts name (``named_endpoints``); they count for
    domains none of whose captures has a record list.
    """
    columns = [key, "seq", "method", "is_graphql", "has_json_body", "n_items", "hashes", "shape", "moved"]
    found = captures.select(*columns).withColumn("_tier", F.lit(0))
    if named is not None:
        found = found.unionByName(named.select(*columns).withColumn("_tier", F.lit(1)))
    order = [F.col("_tier"), F.col("n_items").desc(), F.col("seq")]
    return K.first_per_key(found.where(F.col("n_items") > 0), [key], order).drop("_tier")


def _items(df: DataFrame, key: str, items: Column, responded: Column) -> DataFrame:
    """Probe answers as items; an answer without any is one row with a NULL item."""
    shown = F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(None).cast("string")))
    return df.select(key, "trial", responded.alias("responded"), F.explode(shown).alias("item"))


def _subset(facts: DataFrame, every: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``trials`` cut down to the names, in their order, from ``_all`` (one entry per trial)."""
    return facts.withColumn("trials", F.array(*[F.col("_all")[every.index(n)] for n in names]))


def api_verdicts(
    best: DataFrame, pages: DataFrame, probes: DataFrame, store: DataFrame, key: str = "domain"
) -> DataFrame:
    """Pagination and filter of each best API, by URL for GET and by body otherwise. All inputs are facts.

    A GET source is signed, with the platform of its careers page; trials are compared with the
    plain replay of its URL (trial ``base``) where one was stored. A body is only taken as
    filterable when it is JSON.
    """
    careers = pages.select(key, ME.platform_hint(U.authority(F.col("url"))).alias("_hint"))
    is_get = F.col("method") == "GET"
    signature = ME.site_signature(F.col("_hint"), F.col("shape"))
    answers = probes.where(F.col("kind") == "api").select(key, "trial", "status", "hashes")
    replayed = answers.where((F.col("trial") == V.BASE) & F.col("status").isNotNull())
    replayed = replayed.select(key, F.coalesce("hashes", F.array().cast("array<binary>")).alias("_replay"))
    answers = answers.where(F.col("trial") != V.BASE)
    base = K.attach(best.select(key, "method", "hashes"), replayed, [key])
    shown = F.when(is_get & F.col("_replay").isNotNull(), F.col("_replay")).otherwise(F.col("hashes"))
    base = base.select(key, F.lit(V.BASE).alias("trial"), shown.alias("hashes"))
    items = _items(base, key, F.col("hashes"), F.lit(True)).unionByName(
        _items(answers, key, F.col("hashes"), F.col("status").isNotNull())
    )
    signed = ME.lookup(K.attach(best.drop("hashes"), careers, [key]).withColumn("signature", F.when(is_get, signature)), store)
    facts = K.attach(V.trial_facts(items, [key], _API_TRIALS), signed.select(
        key, "method", "is_graphql", "has_json_body", "moved", "signature", "hint_param"
    ), [key]).where(F.col("method").isNotNull())
    out = facts.withColumn("_all", F.col("trials"))

    def judged(df: DataFrame, names: Sequence[str], verdict, **kw) -> DataFrame:
        return verdict(_subset(df, _API_TRIALS, names), **kw)

    out = judged(out, list(V.QUERY_TRIALS), V.query_pagination, hint=F.col("hint_param"), name="_p_get")
    out = judged(out, _URL_FILTERS, V.query_filter, name="_f_get")
    param = F.when(F.col("is_graphql"), "variables").otherwise("body")
    out = judged(out, [V.NEXT_PAGE], V.body_pagination, mechanism=F.col("moved"), param=param, name="_p_body")
    out = judged(out, _BODY_FILTERS, V.body_filter, name="_f_body")
    f_body = F.when(F.col("has_json_body"), F.col("_f_body"))
    return out.select(
        key,
        F.col("method").alias("api_method"),
        F.col("is_graphql").alias("api_is_graphql"),
        "signature",
        F.when(is_get, F.col("_p_get")).otherwise(F.col("_p_body")).alias("api_pagination"),
        F.when(is_get, F.col("_f_get")).otherwise(f_body).alias("api_filter"),
    )


def link_verdicts(
    pages: DataFrame, plain_pages: DataFrame, probes: DataFrame, store: DataFrame, key: str = "domain"
) -> DataFrame:
    """Link survival, path shapes and HTML probe verdicts of each domain.

    ``pages`` and ``probes`` are facts. The plain fetch takes part as one more trial, so one pair of
    aggregations answers all questions.
    """
    always = F.lit(True)
    rendered = pages.select(
        key, F.lit(V.BASE).alias("trial"), always.alias("responded"), F.explode("links").alias("item")
    )
    plain = plain_pages.select(
        key, F.lit(_PLAIN).alias("trial"), always.alias("responded"), F.explode(H.job_links(F.col("html"))).alias("item")
    )
    answers = probes.where(F.col("kind") == "html").select(key, "trial", "status", "links")
    items = rendered.unionByName(plain).unionByName(
        _items(answers, key, F.col("links"), F.col("status").isNotNull())
    )
    facts = V.trial_facts(
        items, [key], _LINK_TRIALS,
        of_base={"shape": lambda item: F.array_join(F.array_sort(F.collect_set(U.shape(item))), ",")},
    )
    hint = ME.platform_hint(U.authority(F.col("url")))
    located = K.attach(facts, pages.select(key, "url"), [key])
    signed = ME.lookup(located.withColumn("signature", ME.site_signature(hint, F.col("shape"))), store)
    signed = signed.withColumn("_all", F.col("trials"))
    out = V.html_pagination(
        _subset(signed, _LINK_TRIALS, V.HTML_TRIALS), F.col("hint_param"), name="html_pagination"
    )
    out = V.html_filter(_subset(out, _LINK_TRIALS, _URL_FILTERS), name="html_filter")
    return out.select(
        key,
        F.col("n_base").alias("n_rendered"),
        F.col("_all")[_LINK_TRIALS.index(_PLAIN)]["both"].alias("n_common"),
        F.col("signature").alias("link_signature"),
        "html_pagination",
        "html_filter",
    )


def build(
    pages: DataFrame,
    plain_pages: DataFrame,
    captures: DataFrame,
    probes: DataFrame,
    store: DataFrame,
    key: str = "domain",
) -> DataFrame:
    """Evidence per domain.

    pages: key, url, status, html, interactions, content_type, pdf_text, from_render_service
    (one row per domain); plain_pages: key, html; captures: key, seq, url, method,
    request_body, body; probes: key, kind (api, html, bundle or endpoint), trial, status, body;
    store: learned patterns. An endpoint that only scripts name counts when its stored answer
    holds records. PDFs and sources without job links or a GET API have no signature.

    Pages, captures and probes are scanned once each: their facts are written to the shared folder,
    and everything after reads those. No HTML, PDF text or body passes a shuffle; record sets
    compare by 128-bit hashes of their items.
    """
    captures, probes = capture_facts(captures, key), probe_facts(probes, key)
    seen, caught, answered = (
        settled(facts, f"evidence-{name}")
        for name, facts in (("pages", page_facts(pages, key)), ("captures", captures), ("probes", probes))
    )
    named = named_endpoints(seen, caught, answered, key)
    api = api_verdicts(best_api(caught, key, named), seen, answered, store, key)
    links = link_verdicts(seen, plain_pages, answered, store, key)
    facts = seen.select(
        key, F.col("url").alias("careers_url"), "is_pdf", "pdf_usable", "from_render_service", "rendered",
        F.lit(None).cast("long").alias("reported_total_count"),
    )
    joined = facts.join(api, key, "left").join(links, key, "left")
    evidence = E.gate(E.classify(joined, F.col("pdf_usable")))
    return evidence.select(
        key, "careers_url", "source_type", "pagination_status", "pagination_mechanism",
        "india_filter_mechanism", "requires_browser", "requires_firecrawl", "reported_total_count",
        F.when(F.coalesce("is_pdf", F.lit(False)), None)
        .when(F.col("api_method").isNotNull(), F.col("signature"))
        .when(F.col("n_rendered") > 0, F.col("link_signature")).alias("signature"),
        F.when(F.coalesce("is_pdf", F.lit(False)), None)
        .when(F.col("api_method").isNotNull(), F.col("api_pagination")["param"])
        .when(F.col("source_type") == "ssr_html", F.col("html_pagination")["param"]).alias("pagination_param"),
        ME.platform_hint(U.authority(F.col("careers_url"))).alias("ats_hint"),
        "sufficient", "confidence",
    )


def platform_hops(evidence: DataFrame, pages: DataFrame, key: str = "domain", hops: int = 2) -> DataFrame:
    """Evidence after following links to stored platform pages, with ``platform_hops`` taken.

    A source whose evidence is insufficient and whose page is not on a platform itself moves to the
    platform page that its page links to, and takes over that page's evidence if it has any source
    type; from there it goes on while the evidence is insufficient. Pages (key, url, html) and
    evidence (``build``) hold company and platform pages alike; of several rows of one URL a
    sufficient one counts, then the smallest key. A page that is not stored ends the way: the
    source is left there with its own evidence. NULL URLs and pages link to nothing.

    Only URLs and evidence pass the joins. Sources that take no hop get a join key of their own,
    so they spread over all tasks.
    """
    taken = [c for c in evidence.columns if c not in (key, "careers_url", "ats_hint")]
    sufficient = lambda facts: F.coalesce(facts["sufficient"], F.lit(False))
    links = pages.select(F.col("url").alias("_url"), H.ats_link(F.col("html"), F.col("url")).alias("_link"))
    links = K.first_per_key(links, ["_url"], [F.col("_link").asc_nulls_last()])
    known = evidence.select(
        F.col("careers_url").alias("_at"), F.struct(*taken).alias("_theirs"), F.col(key).alias("_by")
    )
    known = K.first_per_key(known, ["_at"], [sufficient(F.col("_theirs")).desc(), F.col("_by")]).drop("_by")
    state = evidence.select(key, "careers_url", F.struct(*taken).alias("_own"), F.lit(0).alias("platform_hops"))
    state = state.withColumn(
        "_open",
        ~sufficient(F.col("_own")) & ~F.coalesce(ME.already_on_platform(F.col("careers_url")), F.lit(False)),
    )
    stays = F.concat(F.lit("\u0001"), F.col(key).cast("string"))
    for _ in range(hops):
        at = F.coalesce(F.when(F.col("_open"), F.col("careers_url")), stays)
        step = state.withColumn("_from", at).join(links, F.col("_from") == F.col("_url"), "left")
        moves = F.col("_open") & F.coalesce(F.col("_link") != F.col("careers_url"), F.lit(False))
        step = step.withColumn("_moves", moves).withColumn("_to", F.coalesce(F.when(moves, F.col("_link")), stays))
        step = step.join(known, F.col("_to") == F.col("_at"), "left")
        takes = F.col("_moves") & F.col("_theirs")["source_type"].isNotNull()
        step = step.select(
            key,
            F.when(F.col("_moves"), F.col("_link")).otherwise(F.col("careers_url")).alias("careers_url"),
            F.when(takes, F.col("_theirs")).otherwise(F.col("_own")).alias("_own"),
            (F.col("platform_hops") + F.col("_moves").cast("int")).alias("platform_hops"),
            "_moves",
        )
        state = step.withColumn("_open", F.col("_moves") & ~sufficient(F.col("_own"))).drop("_moves")
    return state.select(
        key, "careers_url", *[F.col("_own")[c].alias(c) for c in taken],
        ME.platform_hint(U.authority(F.col("careers_url"))).alias("ats_hint"), "platform_hops",
    )


def learned(evidence: DataFrame, at: Column) -> DataFrame:
    """Patterns to remember: sufficient evidence with a signature."""
    kept = evidence.where(F.col("sufficient") & F.col("signature").isNotNull())
    return kept.select("signature", *ME.LATEST, at.alias("confirmed_at"))
