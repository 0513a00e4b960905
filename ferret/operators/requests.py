"""Request planning and the result cache.

``plan_requests`` turns a table of (query, resource) requests into what a
fetcher would do: the URL and body to send, a redirect, or an error.  Fetching
itself is outside Spark.  The cache lookup is an equi-join on (query, rid)
with the first queued page per key picked by a grouped ``min_by``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferret.functions import urls as U
from ferret.operators.catalog import conform


def plan_requests(requests: DataFrame, catalog: DataFrame, verdicts: DataFrame | None = None,
                  cached: DataFrame | None = None) -> DataFrame:
    """(req_id, rid, action, method, url, body, error) per request.

    ``requests``: (req_id, rid, query, page).  ``catalog``: resources with
    apitemplate, post, postencode, directaccess, deleted, privateparameters.
    ``verdicts``: optional (req_id, accepted) from the rate limiter (ST2);
    ``cached``: optional (req_id) of requests that the cache answers (J6), which
    need no allowance and are no request to the limiter.
    Order of checks: unknown resource, tombstone (gone), ``directaccess`` =
    'yes' (redirect, to the first page), cached, rate limit, missing template,
    template errors, signed resource (signing is not built).  Error texts go
    through F12, so private values never show.
    """
    cat = conform(catalog).select(
        F.col("id").alias("rid"), "apitemplate", "post", "postencode", "directaccess", "deleted", "privateparameters",
        "signature", F.lit(True).alias("_known"),
    )
    r = requests.join(cat, "rid", "left")
    if verdicts is not None:
        r = r.join(verdicts.select("req_id", "accepted"), "req_id", "left")
    else:
        r = r.withColumn("accepted", F.lit(True))
    if cached is not None:
        r = r.join(cached.select("req_id", F.lit(True).alias("_cached")).distinct(), "req_id", "left")
    else:
        r = r.withColumn("_cached", F.lit(False))
    r = r.withColumn("_first", F.lit(None).cast("int"))
    q = U.form_encode("query")
    url, url_err = U.fill_template("apitemplate", q, "page", "privateparameters")
    has_post = F.col("post").isNotNull() & (F.col("post") != F.lit(""))
    body, body_err = U.fill_template("post", U.encode_query("query", "postencode"), "page", "privateparameters")
    to, to_err = U.fill_template("apitemplate", q, "_first", "privateparameters")
    direct = F.coalesce(F.col("directaccess") == F.lit("yes"), F.lit(False))
    in_cache = F.coalesce(F.col("_cached"), F.lit(False))
    signed = F.coalesce(F.length("signature") > 0, F.lit(False))
    action = (
        F.when(F.col("_known").isNull(), F.lit("error"))
        .when(F.coalesce("deleted", F.lit(False)), F.lit("gone"))
        .when(direct & F.col("apitemplate").isNotNull() & to_err.isNull(), F.lit("redirect"))
        .when(direct, F.lit("error"))
        .when(in_cache, F.lit("cached"))
        .when(~F.coalesce("accepted", F.lit(True)), F.lit("error"))
        .when(F.col("apitemplate").isNull(), F.lit("error"))
        .when(url_err.isNotNull() | (has_post & body_err.isNotNull()) | signed, F.lit("error"))
        .otherwise(F.lit("fetch"))
    )
    error = (
        F.when(F.col("_known").isNull(), F.lit("Unknown resource"))
        .when(F.coalesce("deleted", F.lit(False)), F.lit("Gone"))
        .when(direct & F.col("apitemplate").isNull(), F.lit("No API Template"))
        .when(direct, to_err)
        .when(in_cache, F.lit(None).cast("string"))
        .when(~F.coalesce("accepted", F.lit(True)), F.lit("Too many queries"))
        .when(F.col("apitemplate").isNull(), F.lit("No API Template"))
        .when(url_err.isNotNull(), url_err)
        .when(has_post & body_err.isNotNull(), body_err)
        .when(signed, F.lit("Signed resources are not supported"))
    )
    out = r.select(
        "req_id", "rid", action.alias("action"),
        F.when(action == F.lit("fetch"), F.when(has_post, F.lit("POST")).otherwise(F.lit("GET"))).alias("method"),
        F.when(action == F.lit("redirect"), to).when(action == F.lit("fetch"), url).alias("url"),
        F.when((action == F.lit("fetch")) & has_post, body).alias("body"),
        U.redact(error, F.col("privateparameters")).alias("error"),
    )
    return out


def cache_lookup(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """The first queued page with the same (query, rid) for each request.

    ``queue``: (page_id, query, rid, ts); arrival order is (ts, page_id).  Null
    query or rid never matches.  The first page per key is a grouped
    ``min_by`` (partial per task), then an equi-join.
    """
    first = (
        queue.filter(F.col("query").isNotNull() & F.col("rid").isNotNull())
        .groupBy("query", "rid")
        .agg(F.min_by("page_id", F.struct("ts", "page_id")).alias("page_id"))
    )
    return requests.join(first, ["query", "rid"], "left")


def cached_results(requests: DataFrame, queue: DataFrame, pages: DataFrame) -> DataFrame:
    """Cached hits for each request, censored (no query, no rid).

    ``pages``: (page_id, pos, hit STRUCT).  Returns (req_id, pos, hit).
    """
    hit = cache_lookup(requests, queue).filter(F.col("page_id").isNotNull()).select("req_id", "page_id")
    p = pages.select("page_id", "pos", F.col("hit").dropFields("query", "rid").alias("hit"))
    return hit.join(p, "page_id").drop("page_id")


def without_results(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Queries that found nothing locally."""
    return queries.join(results.select("qid").distinct(), "qid", "left_anti")


def with_fallback(queries: DataFrame, results: DataFrame, fallback: DataFrame) -> DataFrame:
    """Local results, plus the fallback source's results for queries with none."""
    missing = without_results(queries, results).select("qid")
    return results.unionByName(fallback.join(missing, "qid", "left_semi"), allowMissingColumns=True)
