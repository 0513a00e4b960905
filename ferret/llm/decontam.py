"""Benchmark decontamination over a positional inverted index.

Native DataFrame operations only.  The index is one table of postings
(document, term, position), written document by document straight from the
scan, without a shuffle.  A phrase is found from its rarest terms: their
position lists, moved back by the term's offset, are intersected first; what
survives is checked against the postings of all other terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferret.llm.common import stored, table, text_or_empty

WINDOW = 10
# Lists intersected before the full check of a phrase.
RAREST = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: everything that is not part of a word, before A-Z is lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only; a word of ASCII alone takes the fast function."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), SEPARATORS), lambda x: x != ""), lower_ascii)


@dataclass
class Index:
    """``postings``: (doc_id, h, tid, pos); tid 0 at position n marks the end of a text of n words.

    ``h`` is the hash of the text: repeated ids with different texts stay apart.
    """

    postings: DataFrame


def term_id(c: Column) -> Column:
    return F.when(c == "", F.lit(0).cast("long")).otherwise(F.xxhash64(c))


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index of whole texts; with ``terms`` (a column ``term``) only postings of those are stored.

    A posting of a term that no query holds can never be read, so an index
    made for one set of queries leaves it out.  The terms are joined by
    Spark's own choice: a small table is broadcast from its measured size.
    """
    # the added blank makes '' the last token of every text, and its position the length
    flat = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("h"),
                       F.posexplode(F.split(F.concat(text_or_empty(text_col), F.lit(" ")), SEPARATORS)).alias("pos", "raw"))
    flat = flat.select("doc_id", "h", "pos", lower_ascii(F.col("raw")).alias("term"))
    if terms is not None:
        marked = terms.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
        flat = flat.join(stored(marked.coalesce(1), "decontam-terms"), "term")
    return Index(stored(flat.select("doc_id", "h", term_id(F.col("term")).alias("tid"), "pos"), "decontam-postings"))


def lengths(index: Index) -> DataFrame:
    """(doc_id, h, n_words, copies): copies counts rows of the same id and text."""
    ends = index.postings.where("tid = 0").groupBy("doc_id", "h").agg(
        F.max("pos").alias("last"), F.min("pos").alias("first"), F.count("*").alias("n"))
    # a text that begins with a separator has one empty token before its words
    lead = (F.col("first") == 0) & (F.col("last") > 0)
    return ends.select("doc_id", "h", (F.col("last") - lead.cast("int")).cast("long").alias("n_words"),
                       F.when(lead, F.col("n") / 2).otherwise(F.col("n")).cast("int").alias("copies"))


def windows(items: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(wid, item, words): ``n`` consecutive words; an item of fewer words is one window.

    Items without words or without an id have no window.
    """
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("ws"))
    w = w.where("item is not null and size(ws) > 0")
    cut = w.select("item", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (n - 1), F.lit(1)))).alias("i"))
    cut = cut.select("item", F.slice("ws", F.col("i"), F.lit(n)).alias("words"))
    return cut.select(F.xxhash64(F.array_join("words", " ")).alias("wid"), "item", "words").distinct()


def _window_terms(index: Index, wins: DataFrame) -> DataFrame:
    """(wid, off, tid, n, rank) of windows whose every term is indexed; rank 1 is the rarest term."""
    df = index.postings.where("tid <> 0").groupBy("tid").agg(F.count("*").alias("df"))
    flat = wins.select("wid", "words").distinct().select("wid", F.size("words").alias("n"),
                                                         F.posexplode("words").alias("off", "term"))
    flat = flat.select("wid", "n", "off", F.xxhash64("term").alias("tid")).join(df, "tid")
    by = Window.partitionBy("wid")
    return (flat.withColumn("found", F.count("*").over(by)).where("found = n")
            .withColumn("rank", F.row_number().over(by.orderBy("df", "off"))).select("wid", "n", "off", "tid", "rank"))


def phrases(index: Index, wins: DataFrame, rarest: int = RAREST) -> DataFrame:
    """Exact occurrences (doc_id, h, wid, start, n) of every window."""
    key = ["doc_id", "h", "wid", "start"]
    terms = stored(_window_terms(index, wins).coalesce(1), "decontam-windows")
    first = terms.where(F.col("rank") <= rarest)
    near = (index.postings.join(first, "tid")
            .select("doc_id", "h", "wid", (F.col("pos") - F.col("off")).alias("start"), F.least("n", F.lit(rarest)).alias("need"), "rank")
            .groupBy(*key).agg(F.count_distinct("rank").alias("got"), F.first("need").alias("need"))
            .where("got = need").select(*key))
    near = stored(near, "decontam-near")
    some = stored(near.select("doc_id", "h").distinct().coalesce(1), "decontam-docs")
    # null ids never equal: they are compared as nulls by <=>
    left = index.postings.alias("p").join(some.alias("s"), F.expr("p.h = s.h and p.doc_id <=> s.doc_id"), "left_semi")
    expect = near.join(terms, "wid").select(*key, "n", "tid", (F.col("start") + F.col("off")).alias("pos"))
    full = (expect.alias("e").join(left.distinct().alias("p"), F.expr(
        "e.h = p.h and e.tid = p.tid and e.pos = p.pos and e.doc_id <=> p.doc_id"))
        .select("e.*").groupBy(*key, "n").agg(F.count("*").alias("got")).where("got = n"))
    return full.select(*key, "n")


def proximity(index: Index, wins: DataFrame, span: int) -> DataFrame:
    """(doc_id, h, wid, at): all terms of the window lie within ``span`` words of its rarest term at position ``at``.

    Order and repeats of terms do not matter.
    """
    terms = _window_terms(index, wins).groupBy("wid", "tid").agg(F.min("rank").alias("rank"))
    terms = terms.withColumn("n", F.count("*").over(Window.partitionBy("wid")))
    terms = stored(terms.coalesce(1), "decontam-near-terms")
    lead = F.min("rank").over(Window.partitionBy("wid"))
    rare = terms.withColumn("lead", lead).where("rank = lead").select("wid", "tid", "n")
    at = index.postings.join(rare, "tid").select("doc_id", "h", "wid", "n", F.col("pos").alias("at")).distinct()
    cell = at.withColumn("cell", F.explode(F.array(*[F.floor(F.col("at") / span) + d for d in (-1, 0, 1)])))
    want = cell.join(terms.select("wid", "tid"), "wid")
    have = index.postings.where("tid <> 0").withColumn("cell", F.floor(F.col("pos") / span))
    hit = want.alias("w").join(have.alias("p"), F.expr(
        f"w.tid = p.tid and w.cell = p.cell and w.h = p.h and w.doc_id <=> p.doc_id and abs(p.pos - w.at) <= {int(span)}"))
    return (hit.groupBy("w.doc_id", "w.h", "w.wid", "w.at", "w.n").agg(F.count_distinct("p.tid").alias("got"))
            .where("got = n").select("doc_id", "h", "wid", "at"))


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, h, n_words, copies, n_hit, items): hit words and matched item ids of each distinct (id, text).

    Null and empty texts have no words; ``copies`` tells how many equal rows
    the input has.  Without items (or windows) nothing is hit.
    """
    wins = stored(windows(items, n, item_col, item_text).coalesce(1), "decontam-items")
    index = build_index(docs, wins.select(F.explode("words").alias("term")), id_col, text_col)
    found = stored(phrases(index, wins), "decontam-found")
    hit = (found.select("doc_id", "h", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")).distinct()
           .groupBy("doc_id", "h").agg(F.count("*").alias("n_hit")))
    names = (found.select("doc_id", "h", "wid").distinct().join(wins.select("wid", "item"), "wid")
             .groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item")).alias("items")))
    same = "{0}.h = {1}.h and {0}.doc_id <=> {1}.doc_id"
    hits = hit.alias("a").join(names.alias("b"), F.expr(same.format("a", "b"))).select("a.*", "items")
    return (lengths(index).alias("l").join(hits.alias("x"), F.expr(same.format("l", "x")), "left")
            .select("l.*", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS k
       FROM (SELECT item, ws, least(len(ws), 10) AS m, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dp AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k
       FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
occ AS (SELECT DISTINCT doc_id, i, m, item FROM dp JOIN bw USING (k, m)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
