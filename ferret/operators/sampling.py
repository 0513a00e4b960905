"""Sampling and crawl bookkeeping.

Random choices use a hash of (seed, key) instead of ``rand()``: the same rows
are chosen however the data is partitioned and when a task is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions import text as T


def sample_resource(resources: DataFrame, seed: int, mother: str | None = None) -> DataFrame:
    """One live resource chosen uniformly (mother when none is live).

    A global minimum of a hash key: partial per task, one row shuffled each.
    """
    live = resources.filter(~F.coalesce("deleted", F.lit(False)))
    pick = live.agg(F.min_by("id", T.seeded_key(seed, "id")).alias("id"))
    if mother is not None:
        pick = pick.select(F.coalesce("id", F.lit(mother)).alias("id"))
    return pick


def next_probe(hits: DataFrame, last_query: DataFrame, seed: int) -> DataFrame:
    """Per resource, the next sampling query.

    A random hit of the resource (grouped ``min_by`` on a hash key), then a
    random non-empty token of its title + description that differs from the
    resource's last query (scanning onward from a random start, wrapping);
    null when there is none.
    """
    pick = hits.groupBy("rid").agg(
        F.min_by(T.title_description("title", "description"), T.seeded_key(seed, "hit_id")).alias("text")
    )
    j = pick.join(last_query.select("rid", F.col("query").alias("last")), "rid", "left")
    toks = F.filter(F.split(F.lower("text"), T.SIMPLE_SPLIT), lambda t: (t != F.lit("")) & (t != F.coalesce(F.col("last"), F.lit(""))))
    n = F.size(toks)
    draw = F.conv(F.substring(T.seeded_key(seed, "rid"), 1, 8), 16, 10).cast("long")
    start = F.pmod(draw, F.greatest(n, F.lit(1)).cast("long"))
    return j.select("rid", F.when(n > 0, F.element_at(toks, (start + 1).cast("int"))).alias("query"))


def catalog_from_pages(listing: DataFrame) -> DataFrame:
    """Entries of a paged listing in first-seen order, up to the first page
    that adds nothing new.

    ``listing``: (page, pos, rid).  First sightings are ``min_by`` per rid (no
    per-key window); the stop page is the smallest page without a first
    sighting.
    """
    firsts = listing.filter(F.col("rid").isNotNull()).groupBy("rid").agg(
        F.min(F.struct("page", "pos")).alias("at")
    ).select("rid", F.col("at.page").alias("page"), F.col("at.pos").alias("pos"))
    pages = listing.select("page").distinct()
    with_new = firsts.select("page").distinct().withColumn("has_new", F.lit(True))
    stop = pages.join(with_new, "page", "left").filter(F.col("has_new").isNull()).agg(F.min("page")).scalar()
    return firsts.filter(stop.isNull() | (F.col("page") < stop))


def not_yet_seen(seen: DataFrame, done: DataFrame, key: str = "rid") -> DataFrame:
    """Ids seen but not yet handled."""
    return seen.join(done.select(key), key, "left_anti")
