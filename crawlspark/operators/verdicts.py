"""Pagination and filter verdicts from stored probe results.

Input is a long table of items: ``trial`` is ``base`` for the original result set, else
the name of the probe; ``responded`` is false for a probe that failed; an answer without
items is one row with a NULL item. Items are compared as text, so pass canonical JSON or
hrefs. Order and repeats do not count: two results differ when their sets differ.

Two aggregations do all the work. The first is keyed by (source, item), which spreads a
source that owns a third of the rows over all tasks; the second folds those rows per
source and combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from crawlspark import markers as M
from crawlspark.operators import keyed as K

BASE = "base"
QUERY_TRIALS = {"page": "page number", "offset": "offset/limit", "start": "offset/limit"}
HTML_TRIALS = ("page", "p", "pg")
NEXT_PAGE = "next"
SINGLE_PAGE = "single_page"


def filter_trials(probes: Sequence[tuple[str, str]] = M.URL_FILTER_PROBES) -> list[str]:
    """Trial names of filter probes, in the order they are tried."""
    return [f"{k}={v}" for k, v in probes]


def trial_facts(
    probes: DataFrame,
    keys: Sequence[str],
    trials: Sequence[str],
    trial: str = "trial",
    item: str = "item",
    responded: str = "responded",
    of_base: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One row per source: n_base and, per trial in order, whether it answered and differs.

    ``trials`` is array<struct<seq, trial, responded, n, both, different>>. ``of_base``
    adds aggregates over the distinct base items in the same pass.
    """
    is_base = F.col(trial) == BASE
    answered = F.coalesce(F.col(responded), F.lit(True))
    # Flags, one per trial: the aggregation stays in generated code and its rows stay short.
    items = (
        probes.where(is_base | (F.col(trial).isin(*trials) & answered))
        .groupBy(*keys, item)
        .agg(
            F.max(is_base).alias("_in_base"),
            *[F.max(F.col(trial) == name).alias(f"_w{i}") for i, name in enumerate(trials)],
        )
    )
    real = f"`{item}` IS NOT NULL"
    sums = [F.expr(f"count_if({real} AND _in_base) AS n_base")]
    for i in range(len(trials)):
        sums += [
            F.expr(f"max(_w{i}) AS _r{i}"),
            F.expr(f"count_if({real} AND _w{i}) AS _n{i}"),
            F.expr(f"count_if({real} AND _w{i} AND _in_base) AS _b{i}"),
        ]
    extra = dict(of_base or {})
    base_item = F.when(F.col("_in_base"), F.col(item))
    sums += [build(base_item).alias(name) for name, build in extra.items()]
    folded = items.groupBy(*keys).agg(*sums)
    structs = ", ".join(
        f"named_struct('seq', {i}, 'trial', '{name}', 'responded', _r{i}, 'n', _n{i}, 'both', _b{i}, "
        f"'different', _n{i} <> n_base OR _b{i} <> n_base)"
        for i, name in enumerate(trials)
    )
    facts = F.expr(f"array({structs})")
    return folded.select(*keys, "n_base", facts.alias("trials"), *extra)


def _in_order(trials: Column, hint: Column | None) -> Column:
    """Trials with the hinted one first and the rest as given."""
    if hint is None:
        return trials
    return F.array_sort(
        F.transform(
            trials,
            lambda t: t.withField(
                "seq", F.when(F.coalesce(t["trial"] == hint, F.lit(False)), -1).otherwise(t["seq"])
            ),
        )
    )


def _first(trials: Column) -> Column:
    return F.try_element_at(trials, F.lit(1))


def _verdict(confirmed: Column, mechanism: Column, param: Column) -> Column:
    return F.struct(
        confirmed.alias("confirmed"),
        F.when(confirmed, mechanism).alias("mechanism"),
        F.when(confirmed, param).alias("param"),
    )


def query_pagination(
    facts: DataFrame,
    hint: Column | None = None,
    mechanisms: Mapping[str, str] = QUERY_TRIALS,
    name: str = "pagination",
) -> DataFrame:
    """First query parameter whose answer is a different, non-empty record set."""
    hit = _first(
        F.filter(
            _in_order(F.col("trials"), hint),
            lambda t: (F.col("n_base") > 0) & (t["n"] > 0) & t["different"],
        )
    )
    mechanism = F.create_map(*[F.lit(x) for pair in mechanisms.items() for x in pair])[hit["trial"]]
    return facts.withColumn(name, _verdict(hit.isNotNull(), mechanism, hit["trial"]))


def query_filter(facts: DataFrame, require_diff: bool = False, name: str = "filter") -> DataFrame:
    """First filter parameter that returns any records; a difference is not asked for."""
    hit = _first(
        F.filter(F.col("trials"), lambda t: (t["n"] > 0) & (t["different"] if require_diff else F.lit(True)))
    )
    return facts.withColumn(
        name, F.when(hit.isNotNull(), F.concat(F.lit("query param "), hit["trial"]))
    )


def body_pagination(
    facts: DataFrame, mechanism: Column, param: Column, name: str = "pagination"
) -> DataFrame:
    """Replay of a moved request body: different confirms, empty means one page."""
    t = _first(F.col("trials"))
    tested = (F.col("n_base") > 0) & t["responded"] & mechanism.isNotNull()
    moved = tested & (t["n"] > 0) & t["different"]
    ended = tested & (t["n"] == 0)
    return facts.withColumn(
        name,
        F.when(moved, _verdict(F.lit(True), mechanism, param))
        .when(ended, _verdict(F.lit(True), F.lit(SINGLE_PAGE), F.lit(None).cast("string")))
        .otherwise(_verdict(F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string"))),
    )


def body_filter(facts: DataFrame, name: str = "filter") -> DataFrame:
    """First body member whose answer is non-empty and differs from the base."""
    hit = _first(F.filter(F.col("trials"), lambda t: (t["n"] > 0) & t["different"]))
    return facts.withColumn(
        name, F.when(hit.isNotNull(), F.concat(F.lit("body param "), hit["trial"]))
    )


def html_pagination(
    facts: DataFrame, hint: Column | None = None, name: str = "pagination"
) -> DataFrame:
    """First decisive page parameter of a link listing.

    A different set confirms the parameter, an empty one means a single page; when every
    answer repeats the base set the listing ignores paging and is a single page too.
    """
    tried = F.filter(_in_order(F.col("trials"), hint), lambda t: t["responded"])
    decisive = _first(F.filter(tried, lambda t: (t["n"] == 0) | t["different"]))
    has_base = F.col("n_base") > 0
    paged = has_base & F.coalesce(decisive["n"] > 0, F.lit(False))
    single = has_base & (F.size(tried) > 0)
    none = F.lit(None).cast("string")
    return facts.withColumn(
        name,
        F.when(paged, _verdict(F.lit(True), F.lit("page number"), decisive["trial"]))
        .when(single, _verdict(F.lit(True), F.lit(SINGLE_PAGE), none))
        .otherwise(_verdict(F.lit(False), none, none)),
    )


def html_filter(facts: DataFrame, name: str = "filter") -> DataFrame:
    """First filter parameter that changes a non-empty link set into another one."""
    hit = _first(
        F.filter(
            F.col("trials"), lambda t: (F.col("n_base") > 0) & (t["n"] > 0) & t["different"]
        )
    )
    return facts.withColumn(
        name, F.when(hit.isNotNull(), F.concat(F.lit("query param "), hit["trial"]))
    )


def pagination_status(verdict: Column) -> Column:
    return (
        F.when(~F.coalesce(verdict["confirmed"], F.lit(False)), "unknown")
        .when(verdict["mechanism"] == SINGLE_PAGE, "not_required")
        .otherwise("confirmed")
    )


# --- link survival ----------------------------------------------------------


def link_survival(
    rendered: DataFrame, plain: DataFrame, keys: Sequence[str], item: str = "href"
) -> DataFrame:
    """Per source: distinct links rendered, plain and in both; a common one proves plain access."""
    tagged = rendered.select(*keys, item, F.lit(True).alias("_r")).unionByName(
        plain.select(*keys, item, F.lit(False).alias("_r"))
    )
    links = tagged.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(
        F.max("_r").alias("_rendered"), F.max(~F.col("_r")).alias("_plain")
    )
    return links.groupBy(*keys).agg(
        F.count_if("_rendered").alias("n_rendered"),
        F.count_if("_plain").alias("n_plain"),
        F.count_if(F.col("_rendered") & F.col("_plain")).alias("n_common"),
    ).withColumn("survives", F.col("n_common") > 0)


def set_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], item: str
) -> DataFrame:
    """Per source: items only left, only right and common, and whether the sets are equal."""
    tagged = left.select(*keys, item, F.lit(True).alias("_l")).unionByName(
        right.select(*keys, item, F.lit(False).alias("_l"))
    )
    sides = tagged.groupBy(*keys, item).agg(
        F.max("_l").alias("_in_left"), F.max(~F.col("_l")).alias("_in_right")
    )
    return sides.groupBy(*keys).agg(
        F.count_if(F.col("_in_left") & ~F.col("_in_right")).alias("only_left"),
        F.count_if(~F.col("_in_left") & F.col("_in_right")).alias("only_right"),
        F.count_if(F.col("_in_left") & F.col("_in_right")).alias("common"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


# --- end of a page walk -----------------------------------------------------


def walk_until_short(
    pages: DataFrame, keys: Sequence[str], page: str, item: str, limit: int = 1
) -> DataFrame:
    """Items of a page walk: an empty page ends it, a page short of ``limit`` is kept and ends it.

    Every page walked has a row, an empty one with a NULL item. The stop page is a minimum
    per source, so no source is walked in one task.
    """
    sizes = pages.groupBy(*keys, page).agg(F.count(item).alias("_n"))
    stops = sizes.where(F.col("_n") < max(limit, 1)).groupBy(*keys).agg(F.min(page).alias("_stop"))
    kept = K.attach(pages.where(F.col(item).isNotNull()), stops, keys)
    return kept.where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).drop("_stop")


def walk_until_known(
    pages: DataFrame, keys: Sequence[str], page: str, item: str, max_pages: int | None = None
) -> DataFrame:
    """Items first seen on their page, up to the first page that adds none.

    Repeats on one page stay; items of an earlier page are dropped.
    """
    looked = pages if max_pages is None else pages.where(F.col(page) <= max_pages)
    firsts = looked.groupBy(*keys, item).agg(F.min(page).alias("_first"))
    marked = K.attach(looked, firsts, [*keys, item]).withColumn(
        "_new", F.col(item).isNotNull() & (F.col(page) == F.col("_first"))
    )
    stops = (
        marked.groupBy(*keys, page)
        .agg(F.max("_new").alias("_adds"))
        .where(~F.col("_adds"))
        .groupBy(*keys)
        .agg(F.min(page).alias("_stop"))
    )
    kept = K.attach(marked.where("_new"), stops, keys)
    return kept.where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop(
        "_stop", "_new", "_first"
    )
