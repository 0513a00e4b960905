"""Re-ranking models on a list of two hits."""

from ferret.functions import text as T
from ferret.operators import rerank as RR

SCHEMA = "qid long, pos long, hit_id string, rid string, title string, text string, score double, rscore double"


def lists(spark, query):
    h1 = ("Pears", "fruit", "https://a.example.net/test.html", "https://a.example.net/icon.png")
    h2 = ("A test of apples", "sweet fruit", "https://b.example.net/apples", "https://b.example.net/icon.png")
    rows = [(1, i, h[2], None, h[0], " ".join(h), 0.0, None) for i, h in enumerate([h1, h2], start=1)]
    hits = spark.createDataFrame(rows, SCHEMA)
    q = spark.createDataFrame([(1, query)], "qid long, query string")
    return hits, q


def test_title_match_first(spark):
    hits, q = lists(spark, "test")
    out = RR.with_rank(RR.rerank(hits, q, "or"), "or").orderBy("rank").collect()
    assert [r.hit_id for r in out] == ["https://b.example.net/apples", "https://a.example.net/test.html"]


def test_anyresult_keeps_whole_list(spark):
    hits, q = lists(spark, "fruit")
    assert RR.rerank(hits, q, "anyresult").count() == 2


def test_no_match_empties(spark):
    hits, q = lists(spark, "doesnotmatch")
    assert RR.rerank(hits, q, "or").count() == 0
    assert RR.rerank(hits, q, "anyresult").count() == 0


def test_random_keeps_everything_and_is_reproducible(spark):
    hits, q = lists(spark, "x")
    a = [r.hit_id for r in RR.with_rank(RR.rerank(hits, q, "random", seed=7), "random").orderBy("rank").collect()]
    b = [r.hit_id for r in RR.with_rank(RR.rerank(hits, q, "random", seed=7), "random").orderBy("rank").collect()]
    assert a == b and sorted(a) == sorted(r.hit_id for r in hits.collect())


def test_bestrandom_bonus_keeps_unmatched_first_ten(spark):
    hits, q = lists(spark, "doesnotmatch")
    assert RR.rerank(hits, q, "bestrandom", seed=1).count() == 2
