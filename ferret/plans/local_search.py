"""Local search end to end, for a whole table of queries.

P6 -> R4 (idf search over the local index) -> U2 (queries without a local hit
take the fallback source's answers, J8) -> R7 (resource selection and paging);
blank queries get the listing of R8.  :func:`answer_pages` renders S7, one JSON
answer per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferret.operators import requests as RQ
from ferret.operators import search as S
from ferret.operators import selection as SEL
from ferret.operators.index import Index
from ferret.session import materialize_small
from ferret.sources import exports as EX


def local_search(
    queries: DataFrame,
    index: Index,
    resources: DataFrame,
    fallback_index: Index | None = None,
    max_: int = 10,
    start: int = 0,
    now: Column | None = None,
) -> DataFrame:
    """(qid, rank, rid, hit_id, score, rscore, run) of each query's answer page."""
    q = S.nonblank(queries)
    blank = queries.join(q.select("qid"), "qid", "left_anti")
    # at most k rows per query, read by the anti join, the union and selection
    local = materialize_small(S.search(q, index).select("qid", F.col("rank").alias("pos"), "hit_id", "rid", "type", "score"))
    if fallback_index is not None:
        fb = S.search(RQ.without_results(q, local), fallback_index).select(
            "qid", F.col("rank").alias("pos"), "hit_id", "rid", "type", "score"
        )
        local = RQ.with_fallback(q, local, fb)
    found = SEL.select_resources(local, q, resources, max_, start, now)
    return found.unionByName(SEL.list_resources(blank, resources, max_, start, now))


def answer_pages(selected: DataFrame) -> DataFrame:
    """S7 for R9: one JSON page per query, hits in rank order."""
    return EX.result_page(selected.withColumnRenamed("rank", "pos"), ["qid"])
