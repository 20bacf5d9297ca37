"""Resolve logged or streamed inference requests to backends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.functions.answers import patch_json, read_answer

MAX_BODY_BYTES = 50_000_000
# The messages of a request that cannot be routed.
TOO_LARGE = "Request body is too large"
BAD_JSON = "Request body is not valid JSON"
DISAGREE = "X-Model and JSON model fields disagree"
UNKNOWN = "Unknown model: "
NO_MODEL = "Request must include a configured JSON model field or X-Model header"


@dataclass
class RoutingReport:
    audit: DataFrame
    routed: DataFrame
    by_status: DataFrame
    unknown_models: DataFrame
    advertised: DataFrame


def model_table(routes: DataFrame) -> DataFrame:
    """``(model, backend, served_model)``, one row per model."""
    listed = routes.where(F.col("model").isNotNull())
    one = F.min(F.struct("backend", "served_model"))  # both of the same route
    return listed.groupBy("model").agg(one.alias("r")).select(
        "model", F.col("r.backend").alias("model_backend"), F.col("r.served_model").alias("model_served")
    )


def audit(routes: DataFrame, path_routes: DataFrame, max_concurrency: int = 1) -> DataFrame:
    """``(problem, subject)`` rows; an empty result means a valid configuration."""
    spark = routes.sparkSession
    backends = routes.groupBy("backend").agg(
        F.max("url").alias("url"), F.count("model").alias("models")
    )
    owners = routes.where(F.col("model").isNotNull()).groupBy("model").agg(
        F.min("backend").alias("low"), F.max("backend").alias("high")
    )

    def problem(name: str, df: DataFrame, subject: str) -> DataFrame:
        return df.select(F.lit(name).alias("problem"), F.col(subject).alias("subject"))

    found = [
        problem("no url", backends.where(F.coalesce("url", F.lit("")) == ""), "backend"),
        problem("no models", backends.where(F.col("models") == 0), "backend"),
        problem("model configured twice", owners.where(F.col("low") != F.col("high")), "model"),
        problem("path must start with /", path_routes.where(~F.col("path").startswith("/")), "path"),
        problem(
            "path to unknown backend",
            path_routes.join(backends.select("backend"), "backend", "left_anti"),
            "path",
        ),
        problem("no backends", backends.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
                .select(F.lit("router").alias("s")), "s"),
    ]
    if max_concurrency < 1:
        found.append(spark.range(1).select(
            F.lit("max_concurrency must be at least 1").alias("problem"),
            F.lit("router").alias("subject"),
        ))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def route(
    requests: DataFrame,
    routes: DataFrame,
    path_routes: DataFrame,
    max_body_bytes: int = MAX_BODY_BYTES,
    forward: bool = False,
) -> DataFrame:
    """Add ``requested_model, status, error, backend, forwarded_model`` to requests.

    Works on batch and streaming requests alike.  The route tables are configuration,
    which the planner broadcasts by their size.
    """
    models = model_table(routes)
    served = routes.groupBy("backend").agg(F.max("served_model").alias("path_served"))
    paths = path_routes.select("path", F.col("backend").alias("path_backend")).join(
        served.withColumnRenamed("backend", "path_backend"), "path_backend", "left"
    )
    body = F.col("body")
    # A null header or body is an absent one; the tests below must not turn null.
    too_large = F.coalesce(F.octet_length(body) > max_body_bytes, F.lit(False))
    is_json = F.coalesce(
        F.lower("content_type").startswith("application/json") & (body != "") & ~too_large,
        F.lit(False),
    )
    read = read_answer(F.when(is_json, body), ["model"], "strict", drop_falsy=True)
    in_body = F.col("_read.vals")[0]
    header = F.nullif("model_header", F.lit(""))
    prepared = (
        requests.withColumns({"_json": is_json, "_too_large": too_large, "_read": read})
        .withColumn("_body_model", in_body)
        .withColumn("_header", header)
        .withColumn("requested_model", F.coalesce("_header", "_body_model"))
    )
    joined = prepared.join(
        models, F.col("requested_model") == models["model"], "left"
    ).join(paths, "path", "left")
    wants = F.col("requested_model").isNotNull()
    found = F.when(wants, F.col("model_backend")).otherwise(F.col("path_backend"))
    error = (
        F.when(F.col("_too_large"), TOO_LARGE)
        .when(F.col("_json") & ~F.col("_read.ok"), BAD_JSON)
        .when(F.col("_header") != F.col("_body_model"), DISAGREE)
        .when(wants & F.col("model_backend").isNull(), F.concat(F.lit(UNKNOWN), "requested_model"))
        .when(found.isNull(), NO_MODEL)
    )
    status = (
        F.when(F.col("error").isNull(), 200)
        .when(F.col("error") == TOO_LARGE, 413)
        .when(F.col("error").startswith(UNKNOWN), 404)
        .otherwise(400)
    )
    served_model = F.when(wants, F.col("model_served")).otherwise(F.col("path_served"))
    is_object = F.col("_json") & F.ltrim(body, F.lit(" \t\r\n")).startswith("{")
    rewritten = F.nullif(served_model, F.lit(""))
    routed = (
        joined.withColumn("error", error)
        .withColumn("status", status)
        .withColumn("backend", F.when(F.col("error").isNull(), found))
        .withColumn(
            "forwarded_model", F.when(F.col("error").isNull() & is_object, rewritten)
        )
    )
    if forward:
        edits = F.array(F.struct(F.lit("model").alias("path"), F.col("forwarded_model").alias("value")))
        patched = patch_json(F.when(F.col("forwarded_model").isNotNull(), body), edits, "compact")
        routed = routed.withColumn("forwarded_body", F.when(F.col("error").isNull(), F.coalesce(patched, body)))
    keep = [*requests.columns, "requested_model", "status", "error", "backend", "forwarded_model"]
    return routed.select(*keep, *(["forwarded_body"] if forward else []))


def status_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("backend", "status").agg(F.count(F.lit(1)).alias("requests"))


def unknown_models(routed: DataFrame) -> DataFrame:
    return (
        routed.where(F.col("status") == 404)
        .groupBy("requested_model")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def advertised(routes: DataFrame) -> DataFrame:
    """Every routed model id once."""
    return model_table(routes).select(F.col("model").alias("id"))


def routing_report(requests: DataFrame, routes: DataFrame, path_routes: DataFrame) -> RoutingReport:
    """The whole job over a request log."""
    routed = route(requests, routes, path_routes)
    return RoutingReport(
        audit(routes, path_routes),
        routed,
        status_counts(routed),
        unknown_models(routed),
        advertised(routes),
    )
