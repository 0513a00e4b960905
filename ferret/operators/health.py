"""Health roll-ups over request logs and the catalogue.

A request log is ``(event_id, rid, ts, error, hits, message, query)``: one row
per answer of a resource.  Every roll-up is a grouped aggregate (partial per
task before the shuffle), so a resource that answers a third of all requests
costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferret.functions import health as H

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def resource_counters(log: DataFrame) -> DataFrame:
    """A3: per resource: ok (answers with at least one hit), errors, last ok,
    last error, last error message.  Answers with zero hits count as neither."""
    ok = ~F.col("error") & (F.col("hits") >= 1)
    err = F.col("error")
    order = F.struct("ts", "event_id")
    return log.groupBy("rid").agg(
        F.count_if(ok).cast("int").alias("requestsok"),
        F.count_if(err).cast("int").alias("requestserr"),
        F.max(F.when(ok, F.col("ts"))).alias("lastsuccess"),
        F.max(F.when(err, F.col("ts"))).alias("lasterror"),
        F.max_by(F.col("message"), F.when(err, order)).alias("lastmessage"),
        F.max("ts").alias("lastused"),
    )


def query_counters(log: DataFrame) -> DataFrame:
    """A4: answered / failed totals and the first time seen (one row)."""
    return log.agg(
        F.count_if(~F.col("error")).alias("requestsok"),
        F.count_if(F.col("error")).alias("requestserr"),
        F.min("ts").alias("upsince"),
    )


def healthy(health: DataFrame) -> Column:
    """F20 on a health row; a missing time counts as the epoch."""
    epoch = F.to_timestamp(F.lit("1970-01-01 00:00:00"))
    return H.is_healthy(
        F.coalesce("lastsuccess", epoch), F.coalesce("lasterror", epoch), F.coalesce("requestserr", F.lit(0))
    )


def health_summary(health: DataFrame, order_col: str = "rid", mother: DataFrame | None = None) -> DataFrame:
    """A1: counts of healthy / unhealthy live resources and a last message.

    ``mother``: one health row of the parent resource, counted too.  lastmessage
    = ``rid (mother): message`` if the parent is unhealthy, else ``rid: message``
    of the last unhealthy resource (in ``order_col`` order), else of the first
    resource with a message.
    """
    h = health
    if "deleted" in h.columns:
        h = h.filter(~F.coalesce("deleted", F.lit(False)))
    h = h.select("rid", F.col(order_col).alias("_order"), "lastmessage", healthy(h).alias("ok"), F.lit(False).alias("top"))
    if mother is not None:
        h = h.unionByName(mother.select("rid", F.lit(None).cast(h.schema["_order"].dataType).alias("_order"), "lastmessage",
                                        healthy(mother).alias("ok"), F.lit(True).alias("top")))
    msg = F.concat(F.col("rid"), F.when(F.col("top"), F.lit(" (mother): ")).otherwise(F.lit(": ")), F.coalesce("lastmessage", F.lit("null")))
    bad, peer = ~F.col("ok"), ~F.col("top")
    return h.agg(
        F.count_if("ok").alias("enginesok"),
        F.count_if(bad).alias("engineserr"),
        F.coalesce(
            F.max(F.when(bad & F.col("top"), msg)),
            F.max_by(msg, F.when(bad & peer, F.col("_order"))),
            F.min_by(msg, F.when(peer & F.col("lastmessage").isNotNull(), F.col("_order"))),
        ).alias("lastmessage"),
    )


def max_prior(resources: DataFrame, now: Column) -> DataFrame:
    """A2: the largest effective prior, never below 0 (one row)."""
    p = H.effective_prior("prior", "requestsok", "requestserr", "upsince", now)
    return resources.agg(F.greatest(F.max(p), F.lit(0.0)).alias("max_prior"))


def uptime_report(resources: DataFrame, health: DataFrame) -> DataFrame:
    """A5: per resource ``Ok`` / ``Error`` / ``No health`` and uptime percent.

    Both times start together, so a resource that succeeded and never failed is
    ``Ok``; one that did neither is ``Error``.
    """
    j = resources.select(F.col("id").alias("rid")).join(health, "rid", "left")
    has = F.col("requestsok").isNotNull()
    fmt_ok = F.coalesce(F.date_format("lastsuccess", TS_FORMAT), F.lit(""))
    fmt_err = F.coalesce(F.date_format("lasterror", TS_FORMAT), F.lit(""))
    status = (
        F.when(~has, F.lit("No health"))
        .when(fmt_ok > fmt_err, F.lit("Ok"))
        .otherwise(F.lit("Error"))
    )
    uptime = F.when(
        has, F.lit(100.0) * F.col("requestsok") / (F.col("requestsok") + F.col("requestserr") + F.lit(0.01))
    ).otherwise(F.lit(float("nan")))
    return j.select("rid", status.alias("conclusion"), uptime.alias("uptime"))


def seconds_since_use(health: DataFrame, now: Column) -> DataFrame:
    """F17 over the last use of each resource."""
    return health.select("rid", H.seconds_ago(F.col("lastused"), now).alias("seconds_ago"))


def result_quality(results: DataFrame) -> DataFrame:
    """Test verdicts per (rid, query) answer.

    ``results``: (rid, query, testquery, rerank, hit_id, title, hit_rid), one row
    per hit and one row with a null hit_id for an empty answer.  Optional
    columns directaccess, apitemplate and page_id, page_apitemplate,
    page_directaccess (the resource as its own answer describes it) add the
    check that a direct-access resource names itself.

    Errors, the first that holds: an inconsistent direct-access description;
    for the test query only, no hit (with a hint when a rerank model is set) or
    a hit with neither title nor rid.  Warnings: fewer than 10 or more than 49 hits.
    """
    has_hit = F.col("hit_id").isNotNull()
    empty = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    direct = [c for c in ("directaccess", "apitemplate", "page_id", "page_apitemplate", "page_directaccess") if c in results.columns]
    g = results.groupBy("rid", "query").agg(
        F.count_if(has_hit).alias("n_hits"),
        F.bool_or(has_hit & empty("title") & empty("hit_rid")).alias("bad_hit"),
        F.max("rerank").alias("rerank"),
        F.max("testquery").alias("testquery"),
        *[F.max(c).alias(c) for c in direct],
    )
    is_test = F.col("query") == F.col("testquery")
    no_results = F.concat(F.lit("No results for test query: "), F.col("query"))
    error = F.when(F.lit(False), F.lit(None).cast("string"))
    if len(direct) == 5:
        has = F.col("directaccess").isNotNull()
        error = (
            error.when(has & ~F.col("rid").eqNullSafe(F.col("page_id")), F.lit("DirectAccess engine must have resource with same Id."))
            .when(has & ~F.col("apitemplate").eqNullSafe(F.col("page_apitemplate")), F.lit("DirectAccess engine must have same APItemplate."))
            .when(has & F.col("page_directaccess").isNull(), F.lit("DirectAccess engine must also have 'directaccess'."))
        )
    error = (
        error.when(is_test & (F.col("n_hits") == 0),
                   F.when(F.col("rerank").isNotNull(), F.concat(no_results, F.lit("; Try removing rerank."))).otherwise(no_results))
        .when(is_test & F.col("bad_hit"), F.lit("Search result must have a title or a rid."))
    )
    warning = (
        F.when(F.col("n_hits") < 10, F.lit("less than 10 results"))
        .when(F.col("n_hits") > 49, F.lit("more than 49 results"))
    )
    return g.select("rid", "query", "n_hits", error.alias("error"), warning.alias("warning"))


def failed_count(quality: DataFrame) -> DataFrame:
    """Number of resources with at least one failing test (one row)."""
    per = quality.groupBy("rid").agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return per.agg(F.count_if("failed").alias("failed"), F.count(F.lit(1)).alias("tested"))
