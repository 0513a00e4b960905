"""Resource selection (R7/R8): golden counts in the style of the reference's
web tests, the per-resource cap, and paging invariants."""

import random

from pyspark.sql import functions as F

from ferret.operators import selection as SEL
from paths import SF001


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))
RES_SCHEMA = "id string, name string, type string, prior double, deleted boolean, requestsok int, requestserr int, upsince timestamp"


def resources(spark, rows):
    return spark.createDataFrame(rows, RES_SCHEMA)


def catalog(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return resources(spark, [
        ("a", "Wiki", "web", 0.3, False, 0, 0, t),
        ("b", "Blog one", "blog", 0.2, False, 0, 0, t),
        ("c", "Blog two", "blog web", 0.1, False, 0, 0, t),
        ("d", "Gone", "blog", 0.9, True, 0, 0, t),
    ])


RESULT_SCHEMA = "qid long, pos long, hit_id string, rid string, type string, score double"


def test_one_hit_without_rid_and_three_resources(spark):
    q = spark.createDataFrame([(1, "x", None)], "qid long, query string, qtype string")
    res = spark.createDataFrame([(1, 1, "@t", None, None, 1.0)], RESULT_SCHEMA)
    out = SEL.select_resources(res, q, catalog(spark), 10, 0, now()).collect()
    assert len(out) == 4
    typed = spark.createDataFrame([(1, "x", "blog")], "qid long, query string, qtype string")
    out = SEL.select_resources(res, typed, catalog(spark), 10, 0, now()).collect()
    assert sorted(r.rid for r in out) == ["b", "c"]


def test_name_match_lifts_a_resource(spark):
    q = spark.createDataFrame([(1, "blog two", None)], "qid long, query string, qtype string")
    empty = spark.createDataFrame([], RESULT_SCHEMA)
    out = SEL.select_resources(empty, q, catalog(spark), 10, 0, now()).orderBy("rank").collect()
    assert [r.rid for r in out] == ["c", "b", "a"]  # c: 2 shared words, b: 1 ('blog'), a: prior only
    listed = SEL.list_resources(q, catalog(spark), 10, 0, now()).orderBy("rank").collect()
    assert [r.rid for r in listed] == ["a", "b", "c"]  # a blank query lists by prior


def test_cap_of_four_unless_new_maximum(spark):
    q = spark.createDataFrame([(1, "x", None)], "qid long, query string, qtype string")
    rows = [(1, i, f"h{i}", "a", "web", s) for i, s in enumerate([5.0, 4.0, 3.0, 2.0, 1.0, 9.0, 0.5], start=1)]
    res = spark.createDataFrame(rows, RESULT_SCHEMA)
    out = SEL.select_resources(res, q, catalog(spark), 10, 0, now()).filter("rid = 'a'").collect()
    kept = sorted(r.hit_id for r in out if r.hit_id)
    assert kept == ["h1", "h2", "h3", "h4", "h6"]


def test_pages_are_disjoint_and_cover(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    many = resources(spark, [(f"r{i:02d}", f"Engine {i}", "web", i / 100.0, False, 0, 0, t) for i in range(12)])
    q = spark.createDataFrame([(1, "x", None)], "qid long, query string, qtype string")
    full = [r.rid for r in SEL.list_resources(q, many, 9, 0, now()).orderBy("rank").collect()]
    pages = []
    for start in (0, 3, 6):
        pages += [r.rid for r in SEL.list_resources(q, many, 3, start, now()).orderBy("rank").collect()]
    assert pages == full and len(set(pages)) == 9
    assert SEL.list_resources(q, many, 3, 12, now()).count() == 0


def test_substring_join_equals_every_pair(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(9))) for _ in range(150)] + [None, "", "aaaa", "aaab"]
    wanted = ["".join(rng.choice("abé ") for _ in range(rng.randrange(6))) for _ in range(120)] + [None, "aa", "zzz", "ab\U0001F600"]
    got = SEL.containing(spark.createDataFrame([(w,) for w in wanted], "wanted string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(w, t) for w in wanted if w is not None for t in texts if w == "" or (t is not None and w in t)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 1000


def test_no_pairs_by_nested_loops(spark):
    from ferret.plans import registry

    for name in ("select_resources", "select_resources_typed_page", "list_resources", "matched_texts"):
        plan = registry.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_substring_join_sends_no_growing_table(spark):
    # of what grows with the input nothing is broadcast: the one empty text, and tables with a row per gram
    texts = spark.createDataFrame([("abc/d",), ("x/abc",), (None,), ("",)], "text string")
    pairs = SEL.containing(texts.select(F.explode(F.split("text", "/")).alias("wanted")), texts)
    got = {tuple(r) for r in pairs.collect()}
    assert got == {("abc", "abc/d"), ("abc", "x/abc"), ("d", "abc/d"), ("x", "x/abc"), ("", "abc/d"), ("", "x/abc"), ("", ""), ("", None)}
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    tops = [line for line in plan.splitlines() if "Join [gram" in line and "Inner" in line]
    assert tops and all("SortMergeJoin" in line for line in tops)
