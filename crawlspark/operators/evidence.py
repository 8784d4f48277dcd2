"""Source class, sufficiency gate, stagnation, budget and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.functions import predicates as P
from crawlspark.operators import keyed as K
from crawlspark.operators.verdicts import SINGLE_PAGE, pagination_status

FINGERPRINT_FIELDS = (
    "source_type", "careers_url", "pagination_status", "pagination_mechanism",
    "india_filter_mechanism", "reported_total_count",
)


def classify(facts: DataFrame, pdf_usable: Column | None = None) -> DataFrame:
    """Evidence columns from the facts of one row per (domain, attempt).

    Reads: is_pdf, pdf_text, api_method, api_is_graphql, api_pagination, api_filter,
    n_rendered, n_common, html_pagination, html_filter, rendered (status, mechanism) and
    from_render_service. A record API beats links, links that survive a plain fetch beat
    links that only a browser shows, and a source with neither is a dead end. A PDF is a
    single static page; one without usable text stays unclassified. ``pdf_usable`` says so where
    the facts no longer hold ``pdf_text``.
    """
    has_pdf = F.coalesce(F.col("is_pdf"), F.lit(False))
    pdf_ok = has_pdf & (P.is_usable_pdf_text(F.col("pdf_text")) if pdf_usable is None else pdf_usable)
    has_api = F.col("api_method").isNotNull()
    post_graphql = (F.col("api_method") != "GET") & F.coalesce(F.col("api_is_graphql"), F.lit(False))
    has_links = F.coalesce(F.col("n_rendered"), F.lit(0)) > 0
    survives = has_links & (F.coalesce(F.col("n_common"), F.lit(0)) > 0)
    none = F.lit(None).cast("string")

    def cascade(pdf, api, ssr, spa, dead) -> Column:
        return (
            F.when(pdf_ok, pdf).when(has_pdf, none).when(has_api, api).when(survives, ssr)
            .when(has_links, spa).otherwise(dead)
        )

    fallback = F.lit(M.CLIENT_SIDE_FILTER)
    source_type = cascade(
        F.lit("ssr_html"),
        F.when(post_graphql, "graphql").otherwise("rest_api"),
        F.lit("ssr_html"),
        F.lit("spa_rendered"),
        F.lit("spa_no_api"),
    )
    status = cascade(
        F.lit("not_required"),
        pagination_status(F.col("api_pagination")),
        pagination_status(F.col("html_pagination")),
        F.col("rendered")["status"],
        F.lit("unknown"),
    )
    mechanism = cascade(
        F.lit(SINGLE_PAGE),
        F.col("api_pagination")["mechanism"],
        F.col("html_pagination")["mechanism"],
        F.col("rendered")["mechanism"],
        none,
    )
    filter_mechanism = cascade(
        fallback, F.coalesce("api_filter", fallback), F.coalesce("html_filter", fallback), fallback, fallback
    )
    browser = cascade(F.lit("n"), F.lit("n"), F.lit("n"), F.lit("y"), F.lit("n")) == "y"
    return facts.withColumns(
        {
            "source_type": source_type,
            "pagination_status": status,
            "pagination_mechanism": mechanism,
            "india_filter_mechanism": filter_mechanism,
            "requires_browser": F.coalesce(browser, F.lit(False)),
            "requires_firecrawl": F.coalesce(
                browser & F.coalesce(F.col("from_render_service"), F.lit(False)), F.lit(False)
            ),
        }
    )


def sufficient() -> Column:
    return P.is_sufficient(
        F.col("careers_url"), F.col("source_type"), F.col("pagination_status"), F.col("india_filter_mechanism")
    )


def confidence() -> Column:
    """Descriptive score only; the gate never reads it."""
    served = F.coalesce(F.col("india_filter_mechanism"), F.lit("")) 
    return (
        F.when(~P.pagination_settled(F.col("pagination_status")), 0.3)
        .when((served != "") & (served != M.CLIENT_SIDE_FILTER), 0.9)
        .otherwise(0.6)
    )


def fingerprint(fields: Sequence[str] = FINGERPRINT_FIELDS) -> Column:
    """The facts that tell two attempts apart, joined by bars."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])


def gate(evidence: DataFrame) -> DataFrame:
    return evidence.withColumns({"sufficient": sufficient(), "confidence": confidence()})


def stagnation(
    attempts: DataFrame, keys: Sequence[str], attempt: str = "attempt", chunk_width: int = 100_000
) -> DataFrame:
    """Attempts with ``stagnant``: insufficient and nothing learned since the one before."""
    marked = attempts.withColumns({"sufficient": sufficient(), "fingerprint": fingerprint()})
    out = K.previous_rows(
        marked, keys, [F.col(attempt)], K.span(F.col(attempt), chunk_width),
        {"previous_fingerprint": "fingerprint"},
    )
    same = F.coalesce(F.col("fingerprint") == F.col("previous_fingerprint"), F.lit(False))
    return out.withColumn("stagnant", ~F.col("sufficient") & same)


def attempt_budget(
    steps: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    max_attempts: int = M.MAX_ATTEMPTS,
) -> DataFrame:
    """Steps with ``attempts_left`` and ``exhausted``.

    ``kind`` is evidence, validation or repair. An insufficient evidence check and every
    repair cost one attempt; a run ends when none are left, so the budget stops at 0.
    """
    cost = F.when(
        ((F.col("kind") == "evidence") & ~F.coalesce(F.col("sufficient"), F.lit(False)))
        | (F.col("kind") == "repair"),
        1,
    ).otherwise(0)
    spent = K.running_totals(steps, keys, order, chunk, {"_spent": cost.cast("long")})
    left = F.greatest(F.lit(max_attempts) - F.col("_spent"), F.lit(0))
    return spent.withColumns({"attempts_left": left, "exhausted": left <= 0}).drop("_spent")


def route() -> Column:
    """Next edge of a step: evidence and validation checks each have three."""
    evidence = (
        F.when(F.coalesce(F.col("sufficient"), F.lit(False)), "sufficient")
        .when(F.col("exhausted") | F.coalesce(F.col("stagnant"), F.lit(False)), "budget_exhausted")
        .otherwise("insufficient")
    )
    validation = (
        F.when(F.coalesce(F.col("passed"), F.lit(False)), "pass")
        .when(F.col("exhausted"), "budget_exhausted")
        .otherwise("fail")
    )
    return F.when(F.col("kind") == "evidence", evidence).when(F.col("kind") == "validation", validation)


def repair_action(category: Column) -> Column:
    """Action for a failure category; an unknown one is rewritten. A fixed map, so no join."""
    table = F.create_map(*[F.lit(x) for pair in M.REPAIR_ACTIONS.items() for x in pair])
    return F.coalesce(table[category], F.lit("rewrite"))


def next_stage(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in M.NEXT_STAGES.items() for x in pair])
    return F.coalesce(table[repair_action(category)], F.lit("generate_script"))


def execution_category(timed_out: Column, exit_code: Column, stderr: Column) -> Column:
    """Failure category of a run that never reached its content checks, else NULL."""
    failed = F.coalesce(exit_code != 0, F.lit(False))
    return (
        F.when(F.coalesce(timed_out, F.lit(False)), "timeout")
        .when(failed & F.contains(F.coalesce(stderr, F.lit("")), F.lit("SyntaxError")), "syntax_error")
        .when(failed, "runtime_error")
    )


def execution_detail(timed_out: Column, exit_code: Column, stderr: Column, tail: int = 2000) -> Column:
    failed = F.coalesce(exit_code != 0, F.lit(False))
    text = F.coalesce(stderr, F.lit(""))
    return F.when(
        F.coalesce(timed_out, F.lit(False)), "The run was ended at its time limit."
    ).when(failed, F.right(text, F.lit(tail)))
