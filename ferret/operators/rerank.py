"""Re-ranking of result lists, per (qid, rid) list.

A result list is a table ``(qid, pos, hit_id, rid, title, text, score, rscore)``
where ``text`` is the hit's F6 text; ``queries`` is ``(qid, query)``.  Query
terms are a *set* here (unlike search and name scoring).

Each query's term set is joined to its own hits (equi-join on qid); overlap is
``size(array_intersect(...))`` per row, so no list is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions import text as T

# Fixed values of the re-ranking rule.
TEXT_WEIGHT = 0.1
TITLE_WEIGHT = 0.01
RANDOM_BONUS = 0.01
RANDOM_BONUS_COUNT = 10
MIN_SCORE = 0.001


def _with_terms(results: DataFrame, queries: DataFrame) -> DataFrame:
    q = queries.select("qid", F.array_distinct(T.tokenize("query")).alias("qterms"))
    return results.join(q, "qid", "left").withColumn("qterms", F.coalesce("qterms", F.array().cast("array<string>")))


def _first_n(results: DataFrame, order: list[Column], n: int) -> DataFrame:
    """(qid, pos) of the first ``n`` rows per query in ``order``.

    ``row_number() <= n`` becomes a partial window-group limit before the
    shuffle, so a huge list sends at most ``n`` rows per task.
    """
    w = Window.partitionBy("qid").orderBy(*order)
    return results.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).select("qid", "pos")


def _general(results: DataFrame, queries: DataFrame, bonus_order: list[Column] | None) -> DataFrame:
    """General model; with ``bonus_order`` the first 10 rows in that order get +0.01."""
    r = _with_terms(results, queries)
    score = T.text_overlap(T.tokenize("text"), F.col("qterms"), TEXT_WEIGHT) + T.text_overlap(
        T.tokenize("title"), F.col("qterms"), TITLE_WEIGHT
    )
    if bonus_order is not None:
        first = _first_n(results, bonus_order, RANDOM_BONUS_COUNT).withColumn("_bonus", F.lit(RANDOM_BONUS))
        r = r.join(first, ["qid", "pos"], "left")
        score = score + F.coalesce(F.col("_bonus"), F.lit(0.0))
    return (
        r.withColumn("new_score", score)
        .filter(F.col("new_score") > MIN_SCORE)
        .withColumn("score", F.col("new_score"))
        .drop("new_score", "qterms", "_bonus")
    )


def rerank_order(model: str | None) -> list[Column]:
    """Order of a re-ranked list (within one qid)."""
    if model == "random":
        return [F.col("shuffle_key"), F.col("pos")]
    if model == "anyresult":
        return [F.col("pos")]
    keys = [F.coalesce(F.col("rscore"), F.lit(0.0)).desc(), F.col("rid").desc_nulls_last(), F.col("score").desc()]
    return keys + ([F.col("shuffle_key")] if model == "bestrandom" else []) + [F.col("pos")]


def rerank(results: DataFrame, queries: DataFrame, model: str | None, seed: int = 0) -> DataFrame:
    """Apply a re-ranking model to every list (one list per ``qid``).

    ``random``     uniform shuffle (T8), nothing dropped or rescored;
    ``anyresult``  whole list if any hit has a query term in its text, else empty (W5);
    ``bestrandom`` shuffle, then general scoring with +0.01 for the first 10;
    other names    general: 0.1 x text overlap + 0.01 x title overlap, keep > 0.001.

    Rows come back unordered with the columns that define the new order
    (:func:`rerank_order`); :func:`with_rank` numbers them when a list is known
    to be small.
    """
    if model == "random":
        return results.withColumn("shuffle_key", T.seeded_key(seed, "qid", "pos"))
    if model == "anyresult":
        return any_match(results, queries).filter("any_match").drop("any_match")
    if model == "bestrandom":
        results = results.withColumn("shuffle_key", T.seeded_key(seed, "qid", "pos"))
        return _general(results, queries, [F.col("shuffle_key"), F.col("pos")])
    return _general(results, queries, None)


def with_rank(reranked: DataFrame, model: str | None) -> DataFrame:
    return reranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*rerank_order(model))))


def any_match(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Flag every row of a query's list when any row matches a query term.

    A grouped ``max`` (partial per task) joined back, not a window, so a huge
    list is never sorted in one task.
    """
    r = _with_terms(results, queries)
    hit = (F.size(F.array_intersect(T.tokenize("text"), F.col("qterms"))) > 0).cast("int")
    r = r.withColumn("_hit", hit)
    flags = r.groupBy("qid").agg((F.max("_hit") == 1).alias("any_match"))
    return r.join(flags, "qid").drop("qterms", "_hit")
