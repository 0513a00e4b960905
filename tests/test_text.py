from pyspark.sql import functions as F

from ferret.functions import text as T


def one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_tokenize_drops_empty_and_accents_split(spark):
    out = one(spark, T.tokenize("x"), [(",Hello World-42 Università",)])
    assert out[0] == ["hello", "world", "42", "universit"]


def test_analyze_removes_stop_words_keeps_repeats(spark):
    out = one(spark, T.analyze("x"), [("The retrieval of the Retrieval, l'eau e.g. Università",)])
    assert out[0] == ["retrieval", "retrieval", "l'eau", "e.g", "università"]


def test_strip_html(spark):
    out = one(spark, T.strip_html("x"), [("<b>Bold</b> <span class='x'>s</span> a &amp; b <i>i</i> 1 < 2",)])
    assert out[0] == "Bold s a  b i 1  2"


def test_clean_extracted_trims_and_spaces_tags(spark):
    out = one(spark, T.clean_extracted("x"), [("  \t<em>a</em><br/>b�c \n",)])
    assert out[0] == "a b c"


def test_hit_id(spark):
    df = spark.createDataFrame([("r", "u", "t"), (None, "u", "t"), ("r", None, "t"), ("r", None, None)], "rid string, url string, title string")
    assert [r[0] for r in df.select(T.hit_id("rid", "url", "title")).collect()] == ["r@u", "@u", "@t", "@null"]


def test_score_cast_like_the_reference_cases(spark):
    df = spark.createDataFrame([("0.1",), ("wrong means zero",), ("1.0",), ("1",), ("9.7E-4",), (None,)], "x string")
    got = [r[0] for r in df.select(T.score_cast("x")).collect()]
    assert abs(got[0] - 0.1) < 1e-4 and got[1] == 0.0 and got[2] == 1.0 and got[3] == 1.0 and got[4] > 0 and got[5] == 0.0


def test_json_element_name(spark):
    out = one(spark, T.json_element_name("x"), [("a b",), ("1abc",), ("ok-name.x",), ("$x",)])
    assert out == ["a_b", "_1abc", "ok-name.x", "_x"]


def test_text_overlap_counts_distinct_terms(spark):
    df = spark.createDataFrame([("test the test yeah",)], "x string")
    got = df.select(T.text_overlap(T.tokenize("x"), F.array(F.lit("test"), F.lit("yeah"), F.lit("no")), 0.1)).first()[0]
    assert abs(got - 0.2) < 1e-9
