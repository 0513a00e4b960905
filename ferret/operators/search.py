"""Idf-ranked retrieval for a whole table of queries at once.

Plan (every step a DataFrame operator):

1. query terms: analyze each query (stop words out, repeats kept) and count
   repeats per (qid, term) -- the table is tiny next to the postings;
2. the postings of query terms only (left-semi join against the distinct query
   vocabulary; Spark broadcasts it when its measured size allows);
3. df per (field, term) of those postings (partial aggregation per task, so a
   hot term ships one row per task), N as a scalar sub-query, idf;
4. weight per (qid, field, term) = repeats x field boost x idf; broadcast to
   the postings, which are dealt by hit (:func:`by_hit`), and summed per
   (qid, hit_id) without another shuffle;
5. top-k per query with ``row_number() <= k``: Spark inserts a partial
   window-group limit before the shuffle, so at most k rows per query and task
   cross the network even when one query matches a third of all hits.

With BM25(k1=0, b=0) term frequency and length drop out, so a hit scores
``sum over query tokens of boost(field) * idf(field, term)`` over the fields
where the term occurs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions import text as T
from ferret.operators.index import Index, StoredIndex, idf
from ferret.session import materialize_small

# Field boosts and the default number of hits per search.
BOOSTS = {"terms": 1.0, "title": 0.02}
TOP_K = 80


def nonblank(queries: DataFrame, col: str = "query") -> DataFrame:
    """Keep queries whose trimmed text is not empty."""
    return queries.filter(F.length(F.trim(F.col(col))) > 0)


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, cnt): analyzed query tokens with their repeat counts."""
    return (
        nonblank(queries)
        .select("qid", F.explode(T.analyze("query")).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def _boost():
    expr = None
    for field, b in BOOSTS.items():
        cond = F.col("field") == F.lit(field)
        expr = F.when(cond, F.lit(b)) if expr is None else expr.when(cond, F.lit(b))
    return expr.otherwise(F.lit(0.0))


def _weights(qt: DataFrame, stats: DataFrame, n) -> DataFrame:
    """(qid, field, term, w): repeats x field boost x idf."""
    return qt.join(stats, "term").select("qid", "field", "term", (F.col("cnt") * _boost() * idf(F.col("df"), n)).alias("w"))


# Pairs of a query and a hit that one task sums: they are its memory.
PAIRS = 500_000


def hit_tasks(queries: DataFrame, n_docs: int) -> int:
    """Tasks to which the postings of a search are dealt: in proportion to queries x hits."""
    return max(queries.sparkSession.sparkContext.defaultParallelism, math.ceil(queries.count() * n_docs / PAIRS))


def by_hit(postings: DataFrame, tasks: int) -> DataFrame:
    """Postings with all those of a hit in one of ``tasks`` tasks.  The number is
    given, as Spark would merge tasks by their bytes, and a posting of a few bytes
    becomes as many pairs as there are queries with its term."""
    return postings.repartition(tasks, "hit_id")


def _score(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(qid, hit_id, score) of postings dealt :func:`by_hit`.  The weights (one row
    per term of a query) are broadcast, so the postings stay where they are."""
    return postings.join(F.broadcast(weights), ["field", "term"]).groupBy("qid", "hit_id").agg(F.sum("w").alias("score"))


def score_hits(queries: DataFrame, index: Index, qt: DataFrame | None = None) -> DataFrame:
    """(qid, hit_id, score) for every hit matching at least one query term."""
    qt = query_terms(queries) if qt is None else qt
    # Postings of query terms, hash-partitioned by hit once: the df count and
    # the scoring join both read this one exchange (Spark reuses it), and the
    # (qid, hit_id) sum below needs no further shuffle.  Hits are unique keys,
    # so the partitions are even however hot a term is.
    postings = by_hit(index.postings.join(qt.select("term").distinct(), "term", "left_semi"), hit_tasks(queries, index.docs.count()))
    dfs = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    return _score(postings, _weights(qt, dfs, index.n_docs()))


def top_per_query(scored: DataFrame, k: int = TOP_K, score: str = "score", tie: str = "hit_id") -> DataFrame:
    """Best ``k`` per query; ties broken on ``tie`` (scores compared at 1e-9)."""
    w = Window.partitionBy("qid").orderBy(F.round(F.col(score), 9).desc(), F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = TOP_K, hit_cols=("rid", "type", "title", "url")) -> DataFrame:
    """Top-k hits per query with their stored columns.

    The ``query`` member of a stored hit is never returned (privacy rule).
    """
    top = top_per_query(score_hits(queries, index), k)
    return _with_columns(top, index.docs, hit_cols)


def _with_columns(top: DataFrame, docs: DataFrame, hit_cols) -> DataFrame:
    cols = [c for c in hit_cols if c != "query"]
    return top.join(docs.select("hit_id", *cols), "hit_id").select("qid", "rank", "hit_id", "score", *cols)


def boolean_match(queries: DataFrame, index: Index | StoredIndex, required: DataFrame, prohibited: DataFrame) -> DataFrame:
    """P10: AND / NOT terms on top of the default OR scoring.

    ``required`` and ``prohibited`` are (qid, term) tables.  A hit stays iff it
    has every required term (in any field) and none of the prohibited ones.
    Only the postings of terms that some query names are read; a query with
    required terms scores only the hits that hold them all.
    """
    qt = query_terms(queries)
    named = qt.select("term").unionByName(required.select("term")).unionByName(prohibited.select("term")).distinct()
    if isinstance(index, StoredIndex):
        postings = index.postings_of(named).repartition("hit_id")
        stats = index.df(qt.select("term").distinct())
    else:
        postings = index.postings.join(named, "term", "left_semi").repartition("hit_id")
        stats = postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = _weights(qt, stats, index.n_docs())
    req = required.distinct()
    need = req.groupBy("qid").agg(F.count(F.lit(1)).alias("n_req"))
    have = (
        postings.join(req, "term").groupBy("qid", "hit_id").agg(F.count_distinct("term").alias("n_have"))
        .join(need, "qid").filter(F.col("n_have") == F.col("n_req")).select("qid", "hit_id")
    )
    with_req = need.select("qid")
    narrow = postings.join(have, "hit_id").join(weights, ["qid", "field", "term"])
    wide = postings.join(weights.join(with_req, "qid", "left_anti"), ["field", "term"])
    scored = (narrow.select("qid", "hit_id", "w").unionByName(wide.select("qid", "hit_id", "w"))
              .groupBy("qid", "hit_id").agg(F.sum("w").alias("score")))
    bad = postings.join(prohibited.distinct(), "term").select("qid", "hit_id").distinct()
    return scored.join(bad, ["qid", "hit_id"], "left_anti")


def search_stored(queries: DataFrame, index: StoredIndex, k: int = TOP_K, hit_cols=("rid", "type", "title", "url")) -> DataFrame:
    """R4 over a stored index: same answers as :func:`search`.

    The stored statistics replace the df pass, and the postings are read for
    the query terms only: a semi-join whose broadcast vocabulary (if small by
    its measured size) stays a filter on the scan of the term-clustered files.
    They are dealt by hit before they meet the weights: files in the order of
    the terms hold no two postings of a pair, so a sum over them would ship them all.
    """
    qt = query_terms(queries)
    vocab = qt.select("term").distinct()
    postings = by_hit(index.postings_of(vocab), hit_tasks(queries, index.count()))
    scored = _score(postings, _weights(qt, index.df(vocab), index.n_docs()))
    cols = [c for c in hit_cols if c != "query"]
    return index.with_columns(top_per_query(scored, k), cols).select("qid", "rank", "hit_id", "score", *cols)


# --- R4 with score bounds ------------------------------------------------------

# Postings per wanted hit that the opening terms of a query may have together.
OPENING = 10
# Scores are sums of doubles: bounds this close to a threshold are not used.
SLACK = 1e-6


def _ordered_weights(qt: DataFrame, df: DataFrame, n) -> DataFrame:
    """(qid, field, term, df, w, seen, rest): a query's terms from the heaviest to
    the lightest, with the postings before each and the weight from each on."""
    heavy = Window.partitionBy("qid").orderBy(F.col("w").desc(), "field", "term")
    w = qt.join(df, "term").select("qid", "field", "term", "df", (F.col("cnt") * _boost() * idf(F.col("df"), n)).alias("w"))
    seen = F.sum("df").over(heavy.rowsBetween(Window.unboundedPreceding, -1))
    return w.withColumn("seen", F.coalesce(seen, F.lit(0))).withColumn("rest", F.sum("w").over(heavy.rowsBetween(0, Window.unboundedFollowing)))


def _terms(weights: DataFrame) -> DataFrame:
    return weights.select("term").distinct()


def _full_scores(hits: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(qid, hit_id, score) of a few hits per query by all of the query's terms.

    The hits (at most k a query) and the weights are broadcast, so the postings
    are read where they lie."""
    held = postings.join(F.broadcast(hits.select("qid", "hit_id")), "hit_id").join(F.broadcast(weights.select("qid", "field", "term", "w")), ["qid", "field", "term"])
    return held.groupBy("qid", "hit_id").agg(F.sum("w").alias("score"))


def _look_up(left: DataFrame, light: DataFrame) -> DataFrame:
    """Add the scores ``light`` of some terms to those of the hits ``left``: both
    lie by hit in the same number of tasks, so neither moves."""
    both = left.select("qid", "hit_id", "score", F.lit(True).alias("own")).unionByName(light.select("qid", "hit_id", "score", F.lit(False).alias("own")))
    return both.groupBy("qid", "hit_id").agg(F.sum("score").alias("score"), F.max("own").alias("own")).filter("own").drop("own")


def bounded_terms(queries: DataFrame, index: StoredIndex, k: int = TOP_K) -> DataFrame:
    """Each query's weighted terms, told apart by a score that its k-th hit is sure to reach.

    A query's heaviest terms (up to ``OPENING * k`` postings) give k hits; the
    least of their full scores is ``theta``.  A term is ``essential`` unless it
    and all lighter ones together stay below ``theta``: a hit that has none but
    such terms cannot be among the best k.  Queries with fewer than k hits there
    keep all terms.  One row per query and term, so the table is stored once.
    """
    qt = query_terms(queries)
    vocab = qt.select("term").distinct()
    w = materialize_small(_ordered_weights(qt, index.df(vocab), index.n_docs()))
    opening = w.filter(F.col("seen") < OPENING * k)
    postings = by_hit(index.postings_of(_terms(opening)), hit_tasks(queries, index.count()))
    found = top_per_query(_score(postings, opening.select("qid", "field", "term", "w")), k)
    full = _full_scores(found, w, index.postings_of(_terms(w)))
    theta = full.groupBy("qid").agg(F.min("score").alias("theta"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).drop("n")
    known = F.col("theta").isNotNull() & (F.col("rest") < F.col("theta") - SLACK)
    return materialize_small(w.join(theta, "qid", "left").withColumn("essential", ~known))


def search_bounded(queries: DataFrame, index: StoredIndex, k: int = TOP_K, hit_cols=("rid", "type", "title", "url")) -> DataFrame:
    """R4 over a stored index with score bounds: same answers as :func:`search_stored`.

    Hits come from the postings of essential terms alone; those that could not
    reach their query's threshold with all other terms are dropped, and the
    other terms are only looked up for the hits that are left.  Exact, as the
    weight of a term is the same in every hit.  What is shuffled are postings,
    dealt by hit; pairs of a query and a hit are made and dropped inside a task.
    """
    terms = bounded_terms(queries, index, k)
    heavy, light = terms.filter("essential"), terms.filter("not essential")
    tasks = hit_tasks(queries, index.count())
    score = lambda some: _score(by_hit(index.postings_of(_terms(some)), tasks), some.select("qid", "field", "term", "w"))
    part = score(heavy)
    reach = terms.groupBy("qid").agg(F.max("theta").alias("theta"), F.sum(F.when(~F.col("essential"), F.col("w")).otherwise(0.0)).alias("light"))
    left = part.join(F.broadcast(reach), "qid").filter(F.col("theta").isNull() | (F.col("score") + F.col("light") >= F.col("theta") - SLACK))
    scored = _look_up(left, score(light))
    cols = [c for c in hit_cols if c != "query"]
    return index.with_columns(top_per_query(scored, k), cols).select("qid", "rank", "hit_id", "score", *cols)


def joined_postings(queries: DataFrame, index: StoredIndex, k: int = TOP_K) -> DataFrame:
    """One row (plain, bounded): postings joined to query terms by :func:`search_stored`
    and by :func:`search_bounded` (opening, threshold, essential terms and lookups)."""
    terms = bounded_terms(queries, index, k)
    opening = terms.filter(F.col("seen") < OPENING * k)
    heavy, light = terms.filter("essential"), terms.filter("not essential")
    found = top_per_query(_score(index.postings_of(_terms(opening)), opening.select("qid", "field", "term", "w")), k)
    part = _score(index.postings_of(_terms(heavy)), heavy.select("qid", "field", "term", "w"))
    reach = terms.groupBy("qid").agg(F.max("theta").alias("theta"), F.sum(F.when(~F.col("essential"), F.col("w")).otherwise(0.0)).alias("light"))
    left = part.join(reach, "qid").filter(F.col("theta").isNull() | (F.col("score") + F.col("light") >= F.col("theta") - SLACK))
    pairs = lambda hits, some: hits.select("qid", "hit_id").join(some, "qid").join(index.postings_of(_terms(some)), ["field", "term", "hit_id"])
    sums = terms.agg(F.sum("df").alias("plain"), F.sum(F.when(F.col("seen") < OPENING * k, F.col("df")).otherwise(0)).alias("opening"),
                     F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).alias("essential"))
    looked = pairs(found, terms).select("qid").unionAll(pairs(left, light).select("qid")).agg(F.count(F.lit(1)).alias("looked"))
    return sums.crossJoin(looked).select("plain", (F.col("opening") + F.col("essential") + F.col("looked")).alias("bounded"), "opening", "essential", "looked")
