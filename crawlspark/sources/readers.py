"""Stored crawl results as DataFrames with typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from crawlspark.functions import predicates as P
from crawlspark.functions import replies as R
from crawlspark.functions import urls as U
from crawlspark.functions.jsontext import parsed, valid_json
from crawlspark.schema import PATTERN


def pages(df: DataFrame, url: str = "url", html: str = "html", status: str = "status") -> DataFrame:
    """Stored pages; a failed navigation is a row with status 0 and empty HTML."""
    seen = F.col(status) if status in df.columns else F.lit(200)
    return df.withColumns(
        {
            status: F.when(F.col(html).isNull(), F.coalesce(seen, F.lit(0))).otherwise(F.coalesce(seen, F.lit(200))),
            html: F.coalesce(F.col(html), F.lit("")),
        }
    )


def exchanges(df: DataFrame) -> DataFrame:
    """Captured request/response pairs.

    Reads url, method, request_body, body; adds query_params, body_type, json_body,
    response_json (JSON text or NULL) and is_graphql. A body that is not JSON is a form.
    """
    json_body = valid_json(F.col("request_body"))
    graphql = P.is_graphql(F.col("url"), json_body)
    body_type = (
        F.when(F.coalesce(F.col("request_body"), F.lit("")) == "", F.lit(None).cast("string"))
        .when(json_body.isNull(), "form")
        .when(graphql, "graphql")
        .otherwise("json")
    )
    return df.withColumns(
        {
            "method": F.upper(F.coalesce(F.col("method"), F.lit("GET"))),
            "query_params": U.query_params(F.col("url")),
            "body_type": body_type,
            "json_body": json_body,
            "response_json": valid_json(F.col("body")),
            "is_graphql": graphql,
        }
    )


def probes(df: DataFrame, body: str = "body") -> DataFrame:
    """Replayed requests: the body as text and, when it parses, as JSON."""
    return df.withColumns(
        {"json_body": valid_json(F.col(body)), "text_body": F.coalesce(F.col(body), F.lit(""))}
    )


def search_hits(
    df: DataFrame, domain: str = "domain", body: str = "body", keep: Sequence[str] = ()
) -> DataFrame:
    """(domain, seq, url) of stored search answers, in rank order, careers URLs only."""
    organic = F.from_json(F.col(body), "struct<organic:array<struct<link:string>>>")["organic"]
    hits = df.select(*keep, domain, F.posexplode(organic).alias("seq", "hit")).select(
        *keep, domain, "seq", F.col("hit.link").alias("url")
    )
    return hits.where((F.col("url") != "") & P.is_careers_url(F.col("url"), F.col(domain)))


def model_replies(df: DataFrame, body: str = "body") -> DataFrame:
    """Content and token usage of stored completions."""
    return df.withColumns(R.reply_fields(F.col(body)))


def render_results(df: DataFrame, body: str = "body") -> DataFrame:
    """Page rows from a render service: html, status, links.

    A status that was not reported is 200 on success and 0 otherwise.
    """
    answer = F.from_json(
        F.col(body),
        "struct<success:boolean,data:struct<html:string,links:array<string>,metadata:struct<statusCode:int>>>",
    )
    reported = F.nullif(answer["data"]["metadata"]["statusCode"], F.lit(0))
    return df.withColumns(
        {
            "html": F.coalesce(answer["data"]["html"], F.lit("")),
            "status": F.coalesce(reported, F.when(answer["success"], 200).otherwise(0)),
            "links": F.coalesce(answer["data"]["links"], F.array().cast("array<string>")),
        }
    )


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """Learned patterns; unreadable lines are left out, so a corrupt store reads as empty."""
    marked = T.StructType([*PATTERN.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$"))
    rows = lines.select(F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("p"))
    return rows.where(F.col("p._corrupt_record").isNull() & F.col("p.signature").isNotNull()).select(
        *[f"p.{f.name}" for f in PATTERN.fields]
    )


def trace(lines: DataFrame, line: str = "value") -> DataFrame:
    """Trace events: fixed columns plus the whole event as ``extras``.

    Works on batch and streaming input alike. A line without a type is not an event.
    """
    v = F.col("extras")

    def text(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    events = lines.withColumn("extras", parsed(F.col(line))).select(
        F.try_variant_get(v, "$.timestamp", "double").alias("timestamp"),
        text("domain").alias("domain"),
        text("run_id").alias("run_id"),
        text("type").alias("type"),
        text("node").alias("node"),
        text("summary").alias("summary"),
        text("artifact_ref").alias("artifact_ref"),
        F.try_variant_get(v, "$.tokens_prompt", "bigint").alias("tokens_prompt"),
        F.try_variant_get(v, "$.tokens_completion", "bigint").alias("tokens_completion"),
        "extras",
        F.col(line).alias("line"),
    )
    return events.where(F.col("type").isNotNull())
