"""Resource selection: name score (R6), top resources (T1), hit-driven
selection with per-resource caps (R7), resource listing (R8) and the
filters, windows and paging they use (P1-P3, J1-J3, W1-W3, U1, T2, T4).

Everything is per query (``qid``), so a table of queries is answered at once.
Windows are partitioned by ``qid`` (and ``rid``); the lists they see are
bounded by the search's top-k plus the resource page size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferret.functions import health as H
from ferret.functions import text as T

# Fixed values of the selection rule.
HIT_BOOST = 0.05
PER_RESOURCE = 4


def type_matches(text: Column, wanted: Column) -> Column:
    """No wanted type = keep; otherwise ``text`` must contain it."""
    return wanted.isNull() | (wanted == F.lit("")) | (text.isNotNull() & text.contains(wanted))


def with_prior(resources: DataFrame, now: Column) -> DataFrame:
    """Catalogue with F18's effective prior (rounded to 1e-9 for stable order)."""
    return resources.withColumn(
        "eff_prior",
        F.round(H.effective_prior("prior", "requestsok", "requestserr", "upsince", now), 9),
    )


def live(resources: DataFrame) -> DataFrame:
    """Resources that are not tombstoned."""
    return resources.filter(~F.coalesce(F.col("deleted"), F.lit(False)))


def resource_name_score(queries: DataFrame, resources: DataFrame) -> DataFrame:
    """(qid, id, name_score) for pairs with at least one shared token.

    Query tokens count with repeats; a resource's token set is its name's
    tokens plus its lower-cased id.  Repeats are counted before the join, so a
    pair costs one row per shared token.  Pairs without overlap score 0 and are
    not produced (equi-join on the token, never a product of the two tables).
    """
    qtok = (queries.filter(F.col("query").isNotNull()).select("qid", F.explode(T.tokenize("query")).alias("tok"))
            .groupBy("qid", "tok").agg(F.count(F.lit(1)).alias("cnt")))
    rtok = resources.filter(F.col("name").isNotNull()).select(
        "id", F.explode(F.array_distinct(F.concat(T.tokenize("name"), F.array(F.lower("id"))))).alias("tok")
    )
    return qtok.join(rtok, "tok").groupBy("qid", "id").agg(F.sum("cnt").cast("double").alias("name_score"))


# Characters of a gram in the substring join.
GRAM = 3


def _grams(text: str, sizes) -> Column:
    """(gram, at) of every place of ``text`` for each gram size (an array of structs)."""
    def of(n):
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.substring(F.col(text), i, F.lit(n)).alias("gram"), i.alias("at")))

    return F.concat(*[of(n) for n in sizes])


def containing(wanted: DataFrame, texts: DataFrame, w: str = "wanted", t: str = "text", gram: int = GRAM) -> DataFrame:
    """(w, t): every pair of distinct values where the text contains the wanted one.

    An equi-join instead of a test of every pair: a wanted text is represented by
    one of its grams with its place in it -- the one that the fewest texts hold
    -- and meets only the texts that hold this gram; there the rest is compared
    at the place the gram tells.  Wanted texts shorter than ``gram`` are their
    own gram.  An empty wanted text is in every text, null ones included; null
    is nowhere.  What is joined grows with the texts that hold the rarest gram.
    """
    texts, wanted = texts.select(t).distinct(), wanted.select(w).filter(F.col(w).isNotNull()).distinct()
    places = texts.filter(F.col(t).isNotNull()).select(t, F.inline(_grams(t, range(1, gram + 1))))
    size = F.least(F.length(w), F.lit(gram))
    asked = wanted.filter(F.col(w) != "").select(w, F.inline(_grams(w, range(1, gram + 1)))).filter(F.length("gram") == size)
    # only grams that are asked for are counted and joined
    places = places.join(asked.select("gram").distinct(), "gram", "left_semi")
    held = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = Window.partitionBy(w).orderBy(F.coalesce("n", F.lit(0)), "at")
    mark = (asked.join(held, "gram", "left").withColumn("r", F.row_number().over(rare)).filter("r = 1 and n is not null")
            .select(w, "gram", F.col("at").alias("off")))
    at = F.col("at") - F.col("off") + 1
    # both grow with the input, and exploded tables are underestimated: never sent whole to every task
    pairs = mark.join(places.hint("merge"), "gram").filter((at > 0) & (F.substring(F.col(t), at, F.length(w)) == F.col(w))).select(w, t).distinct()
    # the empty text, at most one row; a constant key would make this a product of both tables
    empty = F.broadcast(wanted.filter(F.col(w) == ""))
    every = texts.withColumn(w, F.coalesce(F.substring(t, 1, 0), F.lit(""))).join(empty, w).select(w, t)
    return pairs.unionByName(every)


def types_matched(queries: DataFrame, resources: DataFrame) -> DataFrame:
    """(wanted, type): which distinct resource type text satisfies which distinct
    wanted text (P2).

    A match is a substring test, made between the two dictionaries of distinct
    texts (:func:`containing`); rows meet by equality on both.
    """
    wanted = queries.select(F.coalesce("qtype", F.lit("")).alias("wanted"))
    return containing(wanted, resources.select("type"), "wanted", "type")


def top_resources(queries: DataFrame, resources: DataFrame, k: int, now: Column) -> DataFrame:
    """Per query the best ``k`` live resources of the query's type.

    score = name score + effective prior; order score desc, id desc.

    Exact without pairing every query with every resource: a resource without
    name overlap scores its prior only, so the zero-overlap winners of any query
    are among the ``k`` best by prior of its type.  Candidates are therefore
    the overlapping pairs plus that per-type list (one per distinct query type).
    """
    cat = with_prior(live(resources), now).select("id", "type", "eff_prior", "name")
    qtypes = queries.select("qid", F.coalesce("qtype", F.lit("")).alias("wanted"))
    # a resource without a type is matched by equality too (null-safe key)
    key = F.coalesce(F.concat(F.lit("t"), F.col("type")), F.lit(""))
    matched = types_matched(queries, cat).select("wanted", key.alias("tkey"))
    cat = cat.withColumn("tkey", key)
    overlap = (
        resource_name_score(queries, cat).join(cat, "id").join(qtypes, "qid").join(matched, ["wanted", "tkey"])
        .select("qid", "id", (F.col("name_score") + F.col("eff_prior")).alias("score"))
    )
    by_prior = Window.partitionBy("wanted").orderBy(F.col("eff_prior").desc(), F.col("id").desc())
    per_type = (
        cat.join(matched, "tkey").withColumn("r", F.row_number().over(by_prior))
        .filter(F.col("r") <= k)
        .select("wanted", "id", F.col("eff_prior").alias("score"))
    )
    prior_only = qtypes.join(per_type, "wanted").select("qid", "id", "score")
    cand = overlap.unionByName(prior_only).groupBy("qid", "id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("id").desc())
    return cand.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(
        "qid", F.col("id").alias("rid"), F.col("score").alias("top")
    )


def hit_order() -> list[Column]:
    """Rscore desc, rid desc (nulls last), score desc, then position."""
    return [
        F.col("rscore").desc(),
        F.col("rid").desc_nulls_last(),
        F.col("score").desc(),
        F.col("pos").asc_nulls_last(),
        F.col("hit_id").asc_nulls_last(),
    ]


def page_of_resources(ranked: DataFrame, max_: int, start: int) -> DataFrame:
    """T4 (with W3): rows of resource runs ``start+1 .. start+max``.

    A run starts at every change of non-null rid in T2 order; rows without rid
    belong to the current run.  Fewer than ``start + 1`` runs give an empty page.
    """
    order = Window.partitionBy("qid").orderBy(*hit_order())
    prev = F.last("rid", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new_run = (F.col("rid").isNotNull() & (prev.isNull() | (F.col("rid") != prev))).cast("int")
    ranked = ranked.withColumn("new_run", new_run)
    ranked = ranked.withColumn("run", F.sum("new_run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if start <= 0:
        page = ranked.filter(F.col("run") <= max_)
    else:
        page = ranked.filter(F.col("run").between(start + 1, start + max_))
    return page.withColumn("rank", F.row_number().over(order)).drop("new_run")


def select_resources(
    results: DataFrame,
    queries: DataFrame,
    resources: DataFrame,
    max_: int = 10,
    start: int = 0,
    now: Column | None = None,
    per_resource: int = PER_RESOURCE,
) -> DataFrame:
    """Resource selection over each query's ranked hits.

    ``results``: (qid, pos, hit_id, rid, type, score) in search order.
    ``queries``: (qid, query, qtype).  ``resources``: the catalogue.
    Returns (qid, rank, rid, hit_id, score, rscore, run) for the page.
    """
    now = now if now is not None else F.current_timestamp()
    k = max_ + start
    cat = with_prior(resources, now).select(F.col("id").alias("rid"), "deleted", "eff_prior")
    tops = top_resources(queries, resources, k, now)

    h = (
        results.join(queries.select("qid", "qtype"), "qid")
        .filter(type_matches(F.col("type"), F.col("qtype")))  # P1
        .join(cat, "rid", "left")  # J1
        .filter(~F.coalesce(F.col("deleted"), F.lit(False)))  # P3
        .select(
            "qid", F.col("pos").cast("long").alias("pos"), "hit_id", "rid", F.round("score", 9).alias("raw"),
            F.coalesce("eff_prior", F.lit(0.0)).alias("p"), F.lit(None).cast("double").alias("top"),
        )
    )
    t = tops.select(
        "qid", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("hit_id"), "rid",
        F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("p"), "top",
    )
    # One pass over (qid, rid): the hit rows and the top-resource rows meet in
    # the same window partition, so the boost lookup (J2) and the "resource
    # without hits" test (J3) need neither a join nor a second copy of the
    # search plan.
    u = h.unionByName(t).withColumn("is_hit", F.col("top").isNull())
    by_rid_all = Window.partitionBy("qid", "rid")
    u = u.withColumn("rid_top", F.max("top").over(by_rid_all)).withColumn(
        "has_hit", F.max(F.col("is_hit").cast("int")).over(by_rid_all) == 1
    )
    by_rid = Window.partitionBy("qid", "rid").orderBy(F.col("is_hit").desc(), F.col("pos"))
    u = u.withColumn("rn", F.row_number().over(by_rid))
    top = F.col("rid_top")
    p = F.when((F.col("rn") == 1) & top.isNotNull() & (top > F.col("p")), top).otherwise(F.col("p"))
    s = (
        F.when(~F.col("is_hit"), F.col("top"))
        .when(F.col("rid").isNull(), F.col("raw"))
        .otherwise(p + F.lit(HIT_BOOST) * F.col("raw"))
    )
    u = u.withColumn("score", s)
    run_max = F.max("score").over(by_rid.rowsBetween(Window.unboundedPreceding, 0))  # W1
    prev_max = F.max("score").over(by_rid.rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn(
        "rscore",
        F.when(~F.col("is_hit"), F.col("top")).when(F.col("rid").isNull(), F.lit(HIT_BOOST) * F.col("raw")).otherwise(run_max),
    ).withColumn(
        "keep",
        F.when(~F.col("is_hit"), ~F.col("has_hit"))  # U1: only resources without any hit
        # At most ``per_resource`` unless a strict new maximum
        .otherwise(F.col("rid").isNull() | (F.col("rn") <= per_resource) | prev_max.isNull() | (F.col("score") > prev_max)),
    )
    kept = u.filter("keep").select("qid", "pos", "hit_id", "rid", "score", "rscore")
    return page_of_resources(kept, max_, start).select("qid", "rank", "rid", "hit_id", "score", "rscore", "run")


def list_resources(queries: DataFrame, resources: DataFrame, max_: int = 10, start: int = 0, now: Column | None = None) -> DataFrame:
    """Blank-query listing: the best resources by prior, paged like R7."""
    now = now if now is not None else F.current_timestamp()
    blank = queries.select("qid", F.lit(None).cast("string").alias("query"), "qtype")
    empty = blank.select(
        "qid",
        F.lit(None).cast("long").alias("pos"),
        F.lit(None).cast("string").alias("hit_id"),
        F.lit(None).cast("string").alias("rid"),
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("double").alias("score"),
    ).filter(F.lit(False))
    return select_resources(empty, blank, resources, max_, start, now)
