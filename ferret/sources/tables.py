"""Domain tables derived from the driver's parquet tables.

The reference works on hits, resources, queries and request logs; the driver
ships documents, labels, pages, benchmark, events, conversations and a TPC-H
style star.  Each function below is a plain projection / aggregation, so the
derived tables grow with their inputs and every plan stays lazy.

Mapping (fixed, documented in the README):

* hits      <- documents: url = 'doc/'||doc_id, title = first line, description
               = text, rid = source, type = lang
* web hits  <- pages: url, title = <title> text, description = stripped body,
               rid = host of url
* resources <- documents grouped by source, with labels for prior and health
* queries   <- benchmark: qid = item_id, query = the whole item text
* request log <- events: rid = 'u'||user_id, event_type 'error' = failed
* result lists <- conversations: qid = conv_id, pos = turn
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.functions import text as T
from ferret.session import table

# Fixed "now" for every time-dependent rule, so results are reproducible.
NOW = "2024-02-01 00:00:00"
UP_SINCE = "2024-01-01 00:00:00"


def now_col():
    return F.to_timestamp(F.lit(NOW))


def hits_from_documents(documents: DataFrame) -> DataFrame:
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    title = F.substring_index(F.col("text"), "\n", 1)
    return documents.select(
        F.col("doc_id"),
        T.hit_id(F.col("source"), url, title).alias("hit_id"),
        F.col("source").alias("rid"),
        url.alias("url"),
        title.alias("title"),
        F.col("text").alias("description"),
        F.col("lang").alias("type"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_from_documents(table(spark, sf_dir, "documents"))


HOST = r"^[a-z]+://([^/?#:]+)"


def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from raw web pages: one hit per page, rid = host."""
    pages = table(spark, sf_dir, "pages")
    title = T.clean_extracted(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    host = F.regexp_extract("url", HOST, 1)
    return pages.select(
        F.col("page_id"),
        T.hit_id(host, F.col("url"), title).alias("hit_id"),
        host.alias("rid"),
        F.col("url"),
        title.alias("title"),
        T.clean_extracted(F.regexp_replace("html", r"(?is)<title[^>]*>.*?</title>|<script.*?</script>|<style.*?</style>", " ")).alias("description"),
    )


def resources_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One resource per document source.

    name = title of the source's first document; type = its languages (sorted,
    space separated); prior = 0.1 x mean quality label; tombstoned when the mean
    toxicity label is above 0.25; ok / error counters = good / bad labels.
    """
    lab = labels.select("doc_id", "quality", "toxic")
    docs = documents.select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("title"))
    j = docs.join(lab, "doc_id", "left")
    return j.groupBy(F.col("source").alias("id")).agg(
        F.min_by("title", "doc_id").alias("name"),
        F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("type"),
        (F.avg("quality") * F.lit(0.1)).alias("prior"),
        F.coalesce(F.avg("toxic") > F.lit(0.25), F.lit(False)).alias("deleted"),
        F.count_if(F.col("quality") == 1).cast("int").alias("requestsok"),
        F.count_if(F.col("quality") == 0).cast("int").alias("requestserr"),
    ).withColumn("upsince", F.to_timestamp(F.lit(UP_SINCE)))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resources_from_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of resources, from events.

    rid = 'u'||user_id; an ``error`` event is a failed answer with ``props`` as
    its message; any other event is an answer with floor(value) hits (so values
    under 1 are answers without hits); query = event_type.
    """
    e = table(spark, sf_dir, "events")
    err = F.col("event_type") == F.lit("error")
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"),
        F.col("ts"),
        err.alias("error"),
        F.when(err, F.lit(0)).otherwise(F.floor("value").cast("int")).alias("hits"),
        F.when(err, F.col("props")).alias("message"),
        F.col("event_type").alias("query"),
    )


def result_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Result lists for re-ranking, from conversations.

    One list per conversation: the later turns are the hits (pos = turn,
    title = role, F6 text = role + text + url); the opening turn's whole text is
    the list's query.
    """
    c = table(spark, sf_dir, "conversations")
    url = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    hits = c.filter(F.col("turn") > 0).select(
        F.col("conv_id").alias("qid"),
        F.col("turn").alias("pos"),
        url.alias("hit_id"),
        F.lit(None).cast("string").alias("rid"),
        F.col("role").alias("title"),
        T.hit_text("role", "text", url).alias("text"),
        F.lit(0.0).alias("score"),
        F.lit(None).cast("double").alias("rscore"),
    )
    queries = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("qid"), F.col("text").alias("query"))
    return hits, queries


API = "https://api.example.org/search/"


def _access_rules(balance, live=None):
    """post / postencode / directaccess by balance: above 5000 the resource
    takes POST requests (JSON-encoded above 8000); from 0 to 1000 it allows
    direct access, from 1000 to 2000 it says so with another value than yes."""
    live = F.lit(True) if live is None else live
    return [
        F.when(live & (balance > 5000), F.lit("q={searchTerms}&key={apikey}&page={startPage?}")).alias("post"),
        F.when(live & (balance > 8000), F.lit("application/json")).alias("postencode"),
        F.when(live & (balance >= 0) & (balance <= 1000), F.lit("yes"))
        .when(live & (balance > 1000) & (balance <= 2000), F.lit("no")).alias("directaccess"),
    ]


def catalog_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalogue: one resource per supplier.

    id = 's'||s_suppkey, name = s_name, type = lower(nation name), prior =
    s_acctbal / 10000, api template with a private key slot, private key =
    md5(name); health: s_nationkey answers, no errors, up and updated since
    2024-01-01.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("type"))
    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        sid.alias("id"),
        F.col("s_name").alias("name"),
        F.col("type"),
        (F.col("s_acctbal") / F.lit(10000.0)).alias("prior"),
        F.concat(F.lit(API), sid, F.lit("?q={searchTerms}&page={startPage?}&key={apikey}")).alias("apitemplate"),
        F.create_map(F.lit("apikey"), F.md5("s_name")).alias("privateparameters"),
        *_access_rules(F.col("s_acctbal")),
        F.col("s_nationkey").cast("int").alias("requestsok"),
        F.lit(0).alias("requestserr"),
        F.to_timestamp(F.lit(UP_SINCE)).alias("lastupdated"),
        F.to_timestamp(F.lit(UP_SINCE)).alias("upsince"),
        F.timestamp_add("HOUR", F.col("s_nationkey"), F.to_timestamp(F.lit(UP_SINCE))).alias("lastsuccess"),
        F.when(F.col("s_nationkey") % 2 == 0, F.to_timestamp(F.lit(UP_SINCE))).alias("lasterror"),
    )


def catalog_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of resource versions.

    Every supplier is announced again with its prior rounded to 2 places (a
    change only when that moves it by more than 0.001), a new private key and
    empty headers (never a change); suppliers with a negative balance are tombstoned; every
    customer is a new resource (id 'c'||c_custkey, type = lower(segment)).
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("type"))
    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    gone = F.col("s_acctbal") < 0
    sup = s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        sid.alias("id"),
        F.when(~gone, F.col("s_name")).alias("name"),
        F.when(~gone, F.col("type")).alias("type"),
        F.when(~gone, F.round(F.col("s_acctbal") / F.lit(10000.0), 2)).alias("prior"),
        F.when(~gone, F.concat(F.lit(API), sid, F.lit("?q={searchTerms}&page={startPage?}&key={apikey}"))).alias("apitemplate"),
        F.when(~gone, F.create_map(F.lit("apikey"), F.md5(F.concat("s_name", F.lit("/2"))))).alias("privateparameters"),
        *_access_rules(F.col("s_acctbal"), ~gone),
        F.create_map().cast("map<string,string>").alias("headers"),
        gone.alias("deleted"),
    )
    c = table(spark, sf_dir, "customer")
    cid = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    cus = c.select(
        cid.alias("id"),
        F.col("c_name").alias("name"),
        F.lower("c_mktsegment").alias("type"),
        (F.col("c_acctbal") / F.lit(10000.0)).alias("prior"),
        F.concat(F.lit(API), cid, F.lit("?q={searchTerms}")).alias("apitemplate"),
        F.lit(None).cast("map<string,string>").alias("privateparameters"),
        *_access_rules(F.lit(None).cast("double")),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.lit(False).alias("deleted"),
    )
    return sup.unionByName(cus)


def export_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalogue with members that reach every export rule:
    tombstones that still have a name, other mimetypes and rates."""
    return catalog_base(spark, sf_dir).select(
        "*",
        (F.col("prior") < 0).alias("deleted"),
        F.when(F.col("type").like("i%"), F.lit("text/html")).alias("mimetype"),
        F.when(F.col("prior") > 0.5, F.lit(500)).otherwise(F.lit(1000)).alias("maxqueriesperday"),
        F.concat(F.lit("https://www.example.org/"), F.col("id"), F.lit("?q={q}")).alias("urltemplate"),
        F.lit("https://www.example.org/suggest").alias("suggesttemplate"),
    )


def made_pages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Result pages (page_id, url, html, rid) written from ``customer``.

    Every kind has an item with the customer's name and a link (and, but for
    ``result``, the segment among its tags) and a second one with a title only;
    ``json`` holds them one level down, after two more, one in the other.  Every
    tenth page is broken off; for callbacks it starts with another object.  Texts
    hold braces and quotes where a format lets them.
    """
    c = table(spark, sf_dir, "customer")
    key, name, seg = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    parts = {
        "xml": ["<?xml version='1.0'?><feed><item><title>", name, "</title><link>/c/", key, "</link><tag>", seg, "</tag><tag>x</tag></item>",
                "<item><title>second <b>of</b> ", key, "</title></item></feed>"],
        "json": ['{"response":{"hits":[{"title":"', name, '","url":"/c/', key, '","tags":["', seg, '","x"],"o":{"k":1}},{"title":"second of ', key,
                 '"}],"also":[{"hits":{"title":"third of ', key, '","more":{"hits":[{"title":"fourth of ', key, '"}]}}}]},"query":"q"}'],
        "callback": ['cb({"title":"', name, '","url":"/c/', key, '","tags":["', seg, '","x"],"m":{"b":{"c":"}\\"{"}}},{"title":"second of ', key, '"},{broken})'],
        "result": ['{"hits":[{"title":"<b>', name, '</b>","url":"/c/', key, '","tags":["x"]},{"title":"second of ', key, '"}],"resource":{"id":"z"}}'],
        "html+json": ['{"items":[{"html":"<p><a href=\\"/c/', key, '\\">', name, '</a><i>', seg, '</i><i>x</i></p>"},{"html":"<a>second of ', key, '</a>"}]}'],
        "json+html": ["<div data-x='{\"title\":\"", name, '","url":"/c/', key, '","tags":["', seg, "\",\"x\"]}'></div><p><div class='r' data-x=\"{&quot;title&quot;:&quot;second of ",
                      key, '&quot;}"></div>'],
    }[kind]
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    broken = F.concat(F.lit('cb({"a":{"b":1}},'), F.col("t"), F.lit(")")) if kind == "callback" else F.expr("substring(t, 1, length(t) - 12)")
    return c.select(F.col("c_custkey").alias("page_id"), F.lit("https://shop.example.org/list/all").alias("url"), text.alias("t")).select(
        "page_id", "url", F.when(F.col("page_id") % 10 == 3, broken).otherwise(F.col("t")).alias("html"), F.lit("r").alias("rid"))


def free_pages(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    """Raw result pages (one JSON text each) written from ``customer`` in two batches.

    A hit holds the segment and a number word under a member of its own name by
    batch, and the balance as a number.  The second batch announces the odd
    customers, and every third again under a new title.
    """
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    words = F.concat(F.col("c_mktsegment"), F.lit(" b"), (k % 50).cast("string"))
    if batch == 0:
        own = c.filter(k % 2 == 0)
        hit = F.struct(F.col("c_name").alias("title"), F.concat(F.lit("/c/"), k.cast("string")).alias("url"), words.alias("tag"), F.col("c_acctbal").alias("balance"))
    else:
        own = c.filter((k % 2 == 1) | (k % 3 == 0))
        hit = F.struct(F.concat("c_name", F.lit(" <b>new</b>")).alias("title"), F.concat(F.lit("/c/"), k.cast("string")).alias("url"), words.alias("label"))
    page = F.struct(F.array(hit).alias("hits"), F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id")).alias("resource"))
    return own.select(F.to_json(page).alias("value"))


def marked_up_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages in other ways of markup by page: list items never closed,
    links in single quotes or in none, a list inside an item with a link."""
    k, h = F.col("page_id"), F.col("html")
    nested = F.replace(F.replace(h, F.lit("<nav><ul>"), F.lit('<nav><ul><li><a href="/top">Top</a><ul>')), F.lit("</ul></nav>"), F.lit("</ul></li></ul></nav>"))
    html = (F.when(k % 8 == 4, nested).when(k % 4 == 1, F.replace(h, F.lit("</li>"), F.lit("")))
            .when(k % 4 == 2, F.regexp_replace(h, 'href="([^"]*)"', "href='$1'")).when(k % 4 == 3, F.regexp_replace(h, r'href="([^"\s]+)"', "href=$1")).otherwise(h))
    return table(spark, sf_dir, "pages").withColumn("html", html)


def resource_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource definitions as JSON texts, one per supplier; every ninth is cut short, every seventh names few members."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    whole = F.to_json(F.struct(F.struct(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.when(k % 7 > 0, F.lit("https://{host?}/q={searchTerms}")).alias("apitemplate"),
        F.when(k % 7 > 0, F.col("s_acctbal")).alias("prior"), F.when(k % 7 > 0, (k % 50).cast("int")).alias("maxqueriesperday"),
        F.when(k % 5 == 0, F.lit(True)).alias("deleted"),
        F.when(k % 3 == 0, F.create_map(F.lit("title"), F.lit("./a"), F.lit("url"), F.lit("./a/@href"))).alias("extractors")).alias("resource")))
    return s.select("s_name", k, whole.alias("w")).select("s_name", F.when(k % 9 == 4, F.expr("left(w, 12)")).otherwise(F.col("w")).alias("json"))


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: one per event; rid = 's'||user_id (ids beyond the supplier
    range are unknown resources), query = event_type, page = props.k."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("req_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("rid"),
        F.col("event_type").alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("page"),
        F.col("ts"),
    )
