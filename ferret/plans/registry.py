"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or tables Spark derives from them) in
full; doubles are rounded to 6 places so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferret.operators import index as IX
from ferret.functions import text as T
from ferret.operators import catalog as CAT
from ferret.operators import extract as X
from ferret.operators import health as HL
from ferret.operators import requests as RQ
from ferret.operators import sampling as SMP
from ferret.sources import exports as EX
from ferret.sources import pages as PG
from ferret.operators import rerank as RR
from ferret.streaming import health as SH
from ferret.streaming import ingest as SI
from ferret.streaming import rate_limit as RL
from ferret.operators import search as S
from ferret.operators import selection as SEL
from ferret.session import materialize_small, table, text_tasks
from ferret.plans import local_search as LS
from ferret.plans import oracle_sql as O
from ferret.sources import tables as TB

Query = Callable[[SparkSession, str], DataFrame]


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def f6(c):
    """Cut to 6 places with floor: the same bits in every engine for values
    computed by the same sequence of operations (round() differs between
    engines on decimal ties)."""
    return (F.floor(F.col(c) * F.lit(1e6)) / F.lit(1e6)).alias(c)


def q_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark))
    res = S.search(TB.queries(spark, sf_dir), idx)
    return res.select("qid", "rank", "hit_id", r6("score"), "rid", "type", "title", "url")


def q_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark))
    return IX.term_stats(idx).select("field", "term", "df", "n", r6("idf"))


def _queries(spark, sf_dir, qtype=None):
    return TB.queries(spark, sf_dir).withColumn("qtype", F.lit(qtype).cast("string"))


def _selection(spark, sf_dir, max_, start, qtype):
    q = _queries(spark, sf_dir, qtype)
    idx = IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark))
    res = S.search(q, idx).select("qid", F.col("rank").alias("pos"), "hit_id", "rid", "type", "score")
    cat = materialize_small(TB.resources(spark, sf_dir))
    sel = SEL.select_resources(res, q, cat, max_, start, TB.now_col())
    return sel.select("qid", "rank", "rid", "hit_id", r6("score"), r6("rscore"), F.col("run").cast("long").alias("run"))


def q_select_resources(spark, sf_dir):
    return _selection(spark, sf_dir, 10, 0, None)


def q_select_resources_typed_page(spark, sf_dir):
    return _selection(spark, sf_dir, 5, 5, "fr")


def q_list_resources(spark, sf_dir):
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("qtype")).distinct()
    q = langs.select(F.col("qtype").alias("qid"), "qtype")
    sel = SEL.list_resources(q, materialize_small(TB.resources(spark, sf_dir)), 10, 0, TB.now_col())
    return sel.select("qid", "rank", "rid", "hit_id", r6("score"), r6("rscore"), F.col("run").cast("long").alias("run"))


def q_matched_texts(spark, sf_dir):
    """P2's substring match between two dictionaries: in how many page addresses
    each part of a page address occurs."""
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("text"))
    parts = urls.select(F.explode(F.split("text", "[/.?=&:]+")).alias("wanted"))
    return SEL.containing(parts, urls).groupBy("wanted").agg(F.count(F.lit(1)).alias("n_texts"), F.min("text").alias("first"))


def _rerank(model):
    def q(spark, sf_dir):
        hits, qs = TB.result_lists(spark, sf_dir)
        out = RR.rerank(hits, qs, model, seed=42)
        cols = ["qid", "pos", "hit_id"]
        if model not in ("random", "anyresult"):
            cols.append(r6("score"))
        if model in ("random", "bestrandom"):
            cols.append("shuffle_key")
        return out.select(*cols)

    return q


def q_resource_health(spark, sf_dir):
    return HL.resource_counters(TB.request_log(spark, sf_dir))


def q_health_summary(spark, sf_dir):
    return HL.health_summary(HL.resource_counters(TB.request_log(spark, sf_dir)))


def q_health_summary_mother(spark, sf_dir):
    """A1 with a parent resource that only ever failed or found nothing."""
    log = TB.request_log(spark, sf_dir)
    mother = log.filter(F.col("error") | (F.col("hits") == 0)).withColumn("rid", F.lit("m"))
    return HL.health_summary(HL.resource_counters(log), mother=HL.resource_counters(mother))


def q_query_counters(spark, sf_dir):
    return HL.query_counters(TB.request_log(spark, sf_dir))


def q_uptime_report(spark, sf_dir):
    res = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"))
    # every third user never fails: their failures count as answers
    log = TB.request_log(spark, sf_dir)
    never = F.substring("rid", 2, 20).cast("long") % 3 == 0
    log = log.withColumn("hits", F.when(never, F.lit(1)).otherwise(F.col("hits"))).withColumn("error", F.col("error") & ~never)
    rep = HL.uptime_report(res, HL.resource_counters(log))
    return rep.select("rid", "conclusion", F.when(~F.isnan("uptime"), F.round("uptime", 6)).alias("uptime"))


def q_seconds_since_use(spark, sf_dir):
    return HL.seconds_since_use(HL.resource_counters(TB.request_log(spark, sf_dir)), TB.now_col())


def q_max_prior(spark, sf_dir):
    return HL.max_prior(TB.resources(spark, sf_dir), TB.now_col()).select(r6("max_prior"))


def q_merge_resources(spark, sf_dir):
    m = CAT.merge_resources(TB.catalog_base(spark, sf_dir), TB.catalog_updates(spark, sf_dir), TB.now_col())
    return m.select(
        "id", "name", "type", r6("prior"), "deleted", "apitemplate",
        F.col("privateparameters")["apikey"].alias("apikey"),
        "requestsok", "requestserr", "lastupdated", "upsince", "lastmessage", "lastsuccess", "lasterror",
    )


def q_rate_limit(spark, sf_dir):
    log = TB.request_log(spark, sf_dir).select(F.col("event_id").alias("req_id"), "rid", "ts")
    out = RL.rate_limit(log, rate=2)
    return out.select("req_id", "rid", "ts", f6("allowance"), "accepted")


def q_plan_requests(spark, sf_dir):
    reqs = TB.requests_from_events(spark, sf_dir)
    # every tenth request is answered by the cache and asks for no allowance
    cached = reqs.filter(F.col("req_id") % 10 == 0).select("req_id")
    verdicts = RL.rate_limit(reqs.filter(F.col("req_id") % 10 != 0).select("req_id", "rid", "ts"), rate=2)
    return RQ.plan_requests(reqs, TB.catalog_base(spark, sf_dir), verdicts, cached)


def q_cache_lookup(spark, sf_dir):
    log = TB.request_log(spark, sf_dir)
    queue = log.select(F.col("event_id").alias("page_id"), "query", "rid", "ts")
    reqs = log.select("query", "rid").distinct()
    return RQ.cache_lookup(reqs, queue).select("query", "rid", "page_id")


def _long_pages(spark, sf_dir):
    """The pages in four ways of markup, each body eight times over, so that pages exceed the item limit."""
    return TB.marked_up_pages(spark, sf_dir).withColumn("html", F.repeat("html", F.lit(8)))


def q_extract_page_links(spark, sf_dir):
    out = X.extract_links(_long_pages(spark, sf_dir), limit=X.MAX_ITEMS)
    return out.select("page_id", F.col("pos").cast("int").alias("pos"), "title", "url", "rid")


def q_extract_html(spark, sf_dir):
    """X1 general path with the same rule (items //li, title ./a, url ./a/@href)."""
    pages = _long_pages(spark, sf_dir)
    out = X.extract_html(pages, "//li", {"title": "./a", "url": "./a/@href"})
    rid = pages.select("page_id", F.regexp_extract("url", TB.HOST, 1).alias("rid"))
    out = out.join(rid, "page_id").select(
        "page_id", "pos", F.try_element_at("fields", F.lit("title")).alias("title"), F.try_element_at("fields", F.lit("url")).alias("url"), "rid", "error")
    # items without a title and a url are no hits; an error row would show as one
    return out.filter("title is not null or url is not null or error is not null").drop("error")


def _extracted(df):
    at = lambda k: F.try_element_at("fields", F.lit(k)).alias(k)
    return df.select("page_id", F.col("pos").cast("int").alias("pos"), at("title"), at("url"), at("note"), "error")


def q_extract_xml(spark, sf_dir):
    return _extracted(X.extract_xml(TB.made_pages(spark, sf_dir, "xml"), "//item", {"title": "./title", "url": "./link", "note": "./tag"}))


def q_extract_json(spark, sf_dir):
    return _extracted(X.extract_json(TB.made_pages(spark, sf_dir, "json"), "//hits", {"title": "./title", "url": "./url", "note": "./tags"}))


def q_extract_callback(spark, sf_dir):
    return _extracted(X.extract_callback(TB.made_pages(spark, sf_dir, "callback"), {"title": "./title", "url": "./url", "note": "./tags"}))


def q_extract_json_of_html(spark, sf_dir):
    """JSON pages whose items are HTML."""
    return _extracted(X.extract_json_of_html(TB.made_pages(spark, sf_dir, "html+json"), "//items", "html", {"title": ".//a", "url": ".//a/@href", "note": ".//i"}))


def q_extract_html_with_json(spark, sf_dir):
    """HTML pages whose elements hold JSON, in either kind of quotes."""
    return _extracted(X.extract_html_with_json(TB.made_pages(spark, sf_dir, "json+html"), "div", "data-x", {"title": "./title", "url": "./url", "note": "./tags"}))


def q_parse_resources(spark, sf_dir):
    """S3: resource definitions as catalogue rows with defaults; suppliers whose text gives none are told by name."""
    raw = TB.resource_texts(spark, sf_dir)
    good = PG.parse_resources(raw).select(
        "id", "name", "apitemplate", r6("prior"), "maxqueriesperday", "deleted", "mimetype", "testquery", F.try_element_at("extractors", F.lit("url")).alias("url_path"),
        F.lit(False).alias("bad"))
    bad = raw.join(PG.bad_resources(raw).select(F.col("text").alias("json")).distinct(), "json").select(F.col("s_name").alias("name"), F.lit(True).alias("bad"))
    return good.unionByName(bad, allowMissingColumns=True)


def q_extract_result_pages(spark, sf_dir):
    """Pages of the default kind (S1, S2), of XML and JSON, of a kind not supported and of a resource without a rule."""
    kinds = ("result", "xml", "json", "result", "result")
    pages = [TB.made_pages(spark, sf_dir, k).filter(F.col("page_id") % len(kinds) == i).withColumn("rid", F.lit(f"r{i}")) for i, k in enumerate(kinds)]
    rules = [{"rid": "r0"}, {"rid": "r1", "mimetype": "application/xml", "itempath": "//item", "extractors": {"title": "./title", "url": "./link"}},
             {"rid": "r2", "mimetype": "application/json", "itempath": "//hits", "extractors": {"title": "./title", "url": "./url"}},
             {"rid": "r3", "mimetype": "image/png"}]
    allp = pages[0]
    for x in pages[1:]:
        allp = allp.unionByName(x)
    return _extracted(X.extract_pages(allp, rules)).drop("note")


def _schema(spark, sf_dir, name):
    return table(spark, sf_dir, name).schema


def q_ingest_stream(spark, sf_dir):
    """ST1/ST4: documents arrive as a stream of pages; the hit table is the
    upserted result."""
    path = SI.ingest_stream(spark, f"{sf_dir}/documents.parque[t]", _schema(spark, sf_dir, "documents"), TB.hits_from_documents)
    return SI.hits_view(spark, path).select("hit_id", "rid", "url", "title", "type")


def q_hit_log(spark, sf_dir):
    """ST4/M3: four batches of hits written into the bucketed log, each with hits of
    earlier ones; the log is compacted after the third, the fourth comes twice."""
    from ferret.streaming import common as C

    hits = TB.hits(spark, sf_dir)
    path = f"{C.job_dir(spark, 'hit-log')}/hits"
    for k in (0, 1, 2, 3, 3):
        part = hits.filter((F.col("doc_id") % 4 == k) | (F.col("doc_id") % 7 == k))
        C.write_log(part.select("hit_id", "rid", F.concat(F.lit(f"v{k} "), "title").alias("title")), k, path, ["hit_id"])
        if k == 2:
            C.compact_log(spark, path, ["hit_id"], most=2)
    return C.read_log(spark, path, ["hit_id"]).select("hit_id", "rid", "title")


def q_search_ingested(spark, sf_dir):
    """ST1, S1, S2, F6, R2, R4 in one job: raw result pages arrive in two batches with
    members of other names, become hits and parts of an index, and are searched."""
    from ferret.streaming.common import job_dir

    base = job_dir(spark, "ingest-pages")
    for k in range(2):
        TB.free_pages(spark, sf_dir, k).write.text(f"{base}/pages/batch={k}")
        SI.ingest_stream(
            spark, f"{base}/pages/*", "value string", lambda p: PG.free_hits(PG.parse_result_pages(p.select(F.xxhash64("value").alias("page_id"), F.col("value").alias("json")))),
            files_per_trigger=1000, base=base, index=f"{base}/index", index_how={"members": "strings"}, source_format="text")
    words = table(spark, sf_dir, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(" b"), (F.col("c_custkey") % 50).cast("string")).alias("query")).distinct()
    res = S.search_stored(words.withColumn("qid", F.col("query")), IX.read_index(spark, f"{base}/index"), hit_cols=("rid", "title", "url", "fields"))
    member = lambda m: F.try_element_at("fields", F.lit(m)).alias(m)
    return res.select("qid", "rank", "hit_id", r6("score"), "rid", "title", "url", member("tag"), member("label"))


def q_refresh_stream(spark, sf_dir):
    """ST5 as a stream: four slices of the events arrive one after another, the job
    is started again for each.  The parent knows all
    ids but multiples of 7; a resource is stale after 10 days."""
    from ferret.streaming.common import job_dir

    src, write = _event_slices(spark, sf_dir, 4)
    catalog = job_dir(spark, "refresh-catalog")
    base_rows = CAT.conform(TB.catalog_base(spark, sf_dir).withColumn(
        "lastupdated", F.when(F.substring("id", 2, 20).cast("long") % 2 == 0, F.col("lastupdated"))))
    base_rows = base_rows.withColumn("lastupdated", F.coalesce("lastupdated", F.to_timestamp(F.lit("2020-01-01 00:00:00"))))
    EX.write_catalog(base_rows, F.to_timestamp(F.lit("1970-01-01 00:00:00")), catalog)

    def parent(ids):
        # the parent knows every id but multiples of 7, and says a new name
        k = F.substring("id", 2, 20).cast("long")
        return ids.filter(k % 7 != 0).select("id", F.concat(F.lit("parent's "), "id").alias("name"))

    base = None
    for k in range(4):
        write(k)
        base = SI.refresh_stream(
            spark, f"{src}/*", _schema(spark, sf_dir, "events"), lambda ev: ev.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("rid"), "ts"),
            catalog, parent, seconds=10 * 86400, files_per_trigger=1000, base=base)
    log = spark.read.parquet(f"{base}/refreshed").select("batch_id", "rid", "found", "asked")
    now = SI.refreshed_catalog(spark, catalog, base).select(F.col("id").alias("rid"), "name", "lastupdated")
    return log.join(now, "rid", "left").select("batch_id", "rid", "found", "asked", "name", "lastupdated")


def q_health_stream(spark, sf_dir):
    """ST3: resource health from the stream of answers (events)."""
    def to_log(ev):
        err = F.col("event_type") == F.lit("error")
        return ev.select(
            "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), "ts", err.alias("error"),
            F.when(err, F.lit(0)).otherwise(F.floor("value").cast("int")).alias("hits"),
            F.when(err, F.col("props")).alias("message"),
        )
    path = SH.health_stream(spark, f"{sf_dir}/events.parque[t]", _schema(spark, sf_dir, "events"), to_log)
    return SH.health_view(spark, path)


def q_rate_limit_stream(spark, sf_dir):
    """ST2 as a stateful stream over the answers (events)."""
    def to_req(ev):
        return ev.select(F.col("event_id").alias("req_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), "ts")
    path = RL.rate_limit_stream(spark, f"{sf_dir}/events.parque[t]", _schema(spark, sf_dir, "events"), to_req, rate=2)
    return spark.read.parquet(path).select("req_id", "rid", "ts", f6("allowance"), "accepted")


def _event_slices(spark, sf_dir, n):
    """``events`` in ``n`` folders of equal spans of time, in order: (base folder, writer of slice k)."""
    from ferret.streaming.common import job_dir

    e = table(spark, sf_dir, "events")
    # files without a time zone give timestamp_ntz, which unix_micros does not take
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = e.agg(F.min(at), F.max(at)).first()
    place = F.least(F.floor((at - F.lit(low)) * F.lit(n) / F.lit(max(1, high - low))), F.lit(n - 1))
    base = job_dir(spark, "event-slices")
    return base, lambda k: e.filter(place == k).write.parquet(f"{base}/slice={k}")


def q_rate_limit_stateful(spark, sf_dir):
    """ST2 as keyed state: three slices of the answers arrive one after another, and
    the job is started again for each.  The buckets in the state store are those
    after each resource's last verdict."""
    src, write = _event_slices(spark, sf_dir, 3)
    base = None
    for k in range(3):
        write(k)
        base = RL.rate_limit_stateful(
            spark, f"{src}/*", _schema(spark, sf_dir, "events"), lambda ev: ev.select(
                F.col("event_id").alias("req_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), "ts"), rate=2, base=base)
    out = spark.read.parquet(f"{base}/verdicts")
    last = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("ts").desc(), F.col("req_id").desc())) == 1
    left = RL.stored_buckets(spark, base).select("rid", F.col("allowance").alias("left"))
    out = out.withColumn("last", last).join(left, "rid")
    return out.select("req_id", "rid", "ts", f6("allowance"), "accepted", F.when(F.col("last"), F.floor(F.col("left") * 1e6) / 1e6).alias("left"))


def _per_resource(log):
    """Rates by resource: 400 a day for every fifth user (the start allowance is
    above it), 1 for the others but every third (2)."""
    user = F.substring("rid", 2, 20).cast("long")
    rate = F.when(user % 5 == 0, F.lit(400)).when(user % 3 == 0, F.lit(2)).otherwise(F.lit(1))
    return log.withColumn("rate", rate)


def q_rate_limit_per_resource(spark, sf_dir):
    """ST2 with each resource's own rate."""
    log = TB.request_log(spark, sf_dir).select(F.col("event_id").alias("req_id"), "rid", "ts")
    return RL.rate_limit(_per_resource(log)).select("req_id", "rid", "ts", f6("allowance"), "accepted")


def q_url_functions(spark, sf_dir):
    """F7, F8, F11-F15, F21 over the customers' names and segments, with the
    characters that need care: blanks, quotes, braces, dollars, accents."""
    from ferret.functions import text as T
    from ferret.functions import urls as U

    c = table(spark, sf_dir, "customer")
    odd = F.concat(F.col("c_name"), F.element_at(F.array(*[F.lit(x) for x in (" a&b", "$1", '"q"', "é/ñ", "{x}", "")]), (F.col("c_custkey") % 6 + 1).cast("int")))
    own = F.concat(F.lit("https://idx.example.org/"), F.element_at(F.array(F.lit("idx/idx?q={q}"), F.lit("s?r=idx&k={key?}"), F.lit("none")), (F.col("c_custkey") % 3 + 1).cast("int")))
    x = c.select("c_custkey", odd.alias("odd"), own.alias("own"), F.lit("idx").alias("me"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").cast("string").alias("bal"))
    x = x.withColumn("secret", F.create_map(F.lit("key"), F.col("odd")))
    url, error = U.resource_url("own", "me", "odd")
    note = F.concat(F.lit("No answer for "), F.col("odd"), F.lit(" at: https://x.example.org/?k=1 end"))
    return x.select(
        "c_custkey", T.title_description("odd", F.when(F.col("c_custkey") % 4 > 0, F.col("seg"))).alias("title_description"),
        F.round(T.score_cast(F.when(F.col("c_custkey") % 5 > 0, F.col("bal")).otherwise(F.col("seg"))), 6).alias("score"),
        url.alias("url"), error.alias("error"), U.redact(note, F.col("secret")).alias("redacted"), U.template_key("own").alias("template_key"),
        U.normalize_template(F.regexp_replace("own", "[?].*", ""), "me").alias("normal"), U.hash_key("odd").alias("hash"), T.json_element_name("odd").alias("element"))


def q_contains_id(spark, sf_dir):
    """Which requested ids the catalogue holds, and the names of those it does."""
    ids = TB.requests_from_events(spark, sf_dir).select(F.col("rid").alias("id")).distinct()
    cat = TB.catalog_base(spark, sf_dir)
    found = CAT.get_by_id(cat, ids).select("id", "name")
    return CAT.contains_id(ids, cat).join(found, "id", "left")


def q_check_ids(spark, sf_dir):
    """M6: the change batch against two reserved ids; the server's own is in the catalogue."""
    return CAT.check_ids(TB.catalog_updates(spark, sf_dir), TB.catalog_base(spark, sf_dir), "c1", "s2")


def q_tombstones(spark, sf_dir):
    """M7 through M4 and S8: suppliers that the change batch drops become
    tombstones; the shared export shows their id only."""
    gone = TB.catalog_updates(spark, sf_dir).filter("deleted").select("id")
    cat = CAT.merge_resources(TB.catalog_base(spark, sf_dir), CAT.tombstone(gone), TB.now_col())
    return EX.catalog_shared(cat).select("id", "deleted", "name", "apitemplate")


def q_update_allowance(spark, sf_dir):
    """M9: allowances counted from the requests, copied into the catalogue."""
    used = TB.requests_from_events(spark, sf_dir).groupBy(F.col("rid").alias("id")).agg(F.count("*").cast("int").alias("dayallowance"))
    cat = TB.catalog_base(spark, sf_dir).withColumn("dayallowance", F.lit(7))
    return CAT.update_allowance(cat, used).select("id", "name", "dayallowance")


def q_strip_provenance(spark, sf_dir):
    """M2 and M1: hits of untrusted languages lose their source, then all are stamped."""
    h = TB.hits(spark, sf_dir).select("doc_id", "rid", F.col("type").alias("query"), "type")
    h = CAT.strip_provenance(h, F.col("type") == "en")
    return CAT.stamp(h, F.lit("me"), TB.now_col()).select("doc_id", "rid", "query", "foundBefore")


def q_not_yet_seen(spark, sf_dir):
    """Customers that never asked."""
    seen = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("rid"))
    return SMP.not_yet_seen(seen, TB.request_log(spark, sf_dir).select("rid").distinct())


def q_cached_results(spark, sf_dir):
    """The first queued answer to each (query, resource), without query and resource."""
    log = TB.request_log(spark, sf_dir)
    queue = log.select(F.col("event_id").alias("page_id"), "query", "rid", "ts")
    pages = log.select(F.col("event_id").alias("page_id"), F.lit(1).alias("pos"),
                       F.struct(F.col("message").alias("title"), F.col("rid"), F.col("query"), F.col("hits").alias("score")).alias("hit"))
    reqs = log.select(F.col("event_id").alias("req_id"), "query", "rid")
    out = RQ.cached_results(reqs, queue, pages)
    return out.select("req_id", "pos", F.to_json("hit").alias("hit"))


def q_local_projection(spark, sf_dir):
    """S10 with every supplier in turn as the parent."""
    return EX.local_projection(TB.export_catalog(spark, sf_dir))


def q_with_default_hit(spark, sf_dir):
    """U4: a built-in hit joins the hit table under its own identity."""
    hit = {"title": "Welcome", "description": "The built-in hit", "url": "https://start.example.org", "type": "web"}
    return IX.with_default_hit(TB.hits(spark, sf_dir), hit).select("hit_id", "title", "url", "type")


def q_export_hits(spark, sf_dir):
    """Every hit as one JSON line."""
    return EX.export_hits(TB.hits(spark, sf_dir), ["hit_id", "rid", "type"])


def q_saved_catalog(spark, sf_dir):
    """Two saves, the second of what changed since the first (and of
    rows at its mark), read back as one catalogue."""
    from ferret.streaming.common import job_dir

    path = job_dir(spark, "catalog")
    base = CAT.conform(TB.catalog_base(spark, sf_dir))
    mark = EX.write_catalog(base, F.to_timestamp(F.lit("1970-01-01 00:00:00")), path).first().since
    merged = CAT.merge_resources(base, TB.catalog_updates(spark, sf_dir), TB.now_col())
    for _ in range(2):  # a save made again replaces itself
        EX.write_catalog(merged, F.lit(mark), path)
    cat, _ = PG.read_catalog(spark, path)
    return cat.select("id", "name", "type", r6("prior"), "deleted", "lastupdated")


def q_upsert_hits(spark, sf_dir):
    """M3 + M1: re-judged documents (those with labels) overwrite their hits."""
    base = TB.hits(spark, sf_dir).select("hit_id", "rid", "url", "title", "type", F.lit(0).alias("seq"))
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    upd = TB.hits(spark, sf_dir).join(lab, "doc_id").select(
        "hit_id", "rid", "url",
        F.concat("title", F.lit(" [quality "), F.col("quality").cast("string"), F.lit("]")).alias("title"),
        "type", F.lit(1).alias("seq"),
    )
    upd = CAT.stamp(upd, F.lit(None).cast("string"), TB.now_col())
    return CAT.upsert_hits(base, upd).select("hit_id", "rid", "url", "title", "type", "seq", "foundBefore")


def q_valid_resources(spark, sf_dir):
    v = CAT.valid_resource(CAT.conform(TB.catalog_base(spark, sf_dir)))
    return v.select("id", F.array_join("violations", "; ").alias("violations"))


def q_export_health(spark, sf_dir):
    """Suppliers as resources, the answers to events as their log."""
    log = TB.request_log(spark, sf_dir).withColumn("rid", F.concat(F.lit("s"), F.substring("rid", 2, 20)))
    out = RL.rate_limit(log.select(F.col("event_id").alias("req_id"), "rid", "ts"), rate=2)
    last = out.groupBy("rid").agg(F.max_by(F.struct("allowance", "ts"), F.struct("ts", "req_id")).alias("s")).select("rid", "s.*")
    cat = TB.catalog_base(spark, sf_dir).withColumn("maxqueriesperday", F.lit(2))
    return EX.health_export(cat, HL.resource_counters(log), last, TB.now_col())


def q_export_catalog_shared(spark, sf_dir):
    s = EX.catalog_shared(TB.export_catalog(spark, sf_dir))
    return s.select("id", "name", "type", "apitemplate", "deleted", r6("prior"), "maxqueriesperday", "urltemplate",
                    "suggesttemplate", "mimetype", "post", "directaccess")


def q_result_page_roundtrip(spark, sf_dir):
    """S7 -> S1 -> S2: search answers written as JSON result pages (one per
    query and resource) and read back as hits."""
    res = S.search(_queries(spark, sf_dir), IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark)))
    hits = res.select("qid", "rid", F.col("rank").alias("pos"), "title", "url")
    pages = EX.result_page(hits, ["qid", "rid"]).select(
        F.concat_ws("/", F.col("qid").cast("string"), "rid").alias("page_id"), "json"
    )
    norm = PG.normalize_hits(PG.parse_result_pages(pages))
    return norm.select(
        "page_id", F.col("pos").cast("int").alias("pos"),
        F.col("fields")["title"].alias("title"), F.col("fields")["url"].alias("url"),
    )


def q_catalog_from_pages(spark, sf_dir):
    links = X.extract_links(TB.marked_up_pages(spark, sf_dir))
    listing = links.select(F.col("page_id").alias("page"), "pos", F.col("url").alias("rid"))
    return SMP.catalog_from_pages(listing).select("rid", "page", F.col("pos").cast("int").alias("pos"))


def q_sample_resource(spark, sf_dir):
    return SMP.sample_resource(TB.resources(spark, sf_dir), seed=42)


def q_next_probe(spark, sf_dir):
    last = TB.resources(spark, sf_dir).select(F.col("id").alias("rid"), F.lit("the").alias("query"))
    return SMP.next_probe(TB.hits(spark, sf_dir), last, seed=42)


def q_result_quality(spark, sf_dir):
    res = S.search(_queries(spark, sf_dir), IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark)))
    # the answer of a source to a query: its German and French hits among the
    # best 80, German ones without a title; even queries are test queries
    hit = F.col("type").isin("fr", "de")
    q = F.col("qid").cast("string")
    r = res.select(
        "rid", q.alias("query"), F.when(F.col("qid") % 2 == 0, q).otherwise(F.lit("other")).alias("testquery"),
        F.when(F.col("qid") % 4 == 0, F.lit("or")).alias("rerank"), F.when(hit, F.col("hit_id")).alias("hit_id"),
        F.when(hit & (F.col("type") == "fr"), F.col("title")).alias("title"), F.lit(None).cast("string").alias("hit_rid"))
    return HL.result_quality(r)


def q_local_search(spark, sf_dir):
    """The German documents are the local index; queries without a hit there
    fall back to the index of web pages (title and body, rid = host); every
    tenth query is blank and gets the listing."""
    q = _queries(spark, sf_dir).withColumn("query", F.when(F.col("qid") % 10 == 0, F.lit(" ")).otherwise(F.col("query")))
    web = TB.web_hits(spark, sf_dir).withColumn("type", F.lit(None).cast("string"))
    own = TB.hits(spark, sf_dir).filter("type = 'de'")
    out = LS.local_search(q, IX.build_index(own, tasks=text_tasks(spark)), materialize_small(TB.resources(spark, sf_dir)),
                          IX.build_index(web, tasks=text_tasks(spark)), 10, 0, TB.now_col())
    return out.select("qid", "rank", "rid", "hit_id", r6("score"), r6("rscore"), F.col("run").cast("long").alias("run"))


def q_boolean_search(spark, sf_dir):
    """P10: OR scoring restricted to hits that hold each query's longest word (of
    ties the first), and for odd queries not its last one in order; top 80."""
    q = TB.queries(spark, sf_dir)
    idx = IX.build_index(TB.hits(spark, sf_dir), tasks=text_tasks(spark))
    toks = q.select("qid", F.explode(T.analyze("query")).alias("term")).distinct()
    w = Window.partitionBy("qid").orderBy(F.length("term").desc(), F.col("term"))
    required = toks.withColumn("r", F.row_number().over(w)).filter("r = 1").select("qid", "term")
    prohibited = toks.groupBy("qid").agg(F.max("term").alias("term")).join(required.withColumnRenamed("term", "req"), "qid")
    prohibited = prohibited.filter("term <> req and qid % 2 = 1").select("qid", "term")
    scored = S.boolean_match(q, idx, required, prohibited)
    return S.top_per_query(scored).select("qid", "rank", "hit_id", r6("score"))


def q_request_pages(spark, sf_dir):
    """F16 over every request: page = props.k, max = floor(value)."""
    from ferret.functions import health as H

    e = table(spark, sf_dir, "events")
    m, start = H.page_window(F.get_json_object("props", "$.k"), F.floor("value"))
    return e.select("event_id", m.alias("max"), start.alias("start"))


def q_allowance_now(spark, sf_dir):
    """F19 + ST2: each resource's day allowance at "now", from the limiter's
    last state (allowance and time of its last request)."""
    from ferret.functions import health as H

    log = TB.request_log(spark, sf_dir).select(F.col("event_id").alias("req_id"), "rid", "ts")
    out = RL.rate_limit(log, rate=2)
    last = out.groupBy("rid").agg(F.max_by(F.struct("allowance", "ts"), F.struct("ts", "req_id")).alias("s"))
    return last.select("rid", H.allowance(F.col("s.allowance"), F.col("s.ts"), F.lit(2), TB.now_col()).alias("dayallowance"))


def q_refresh_candidates(spark, sf_dir):
    """ST5 (P5 + T10): per day of events, the resource ids seen that are
    unknown or stale in the stored catalogue, at most 11 per day."""
    e = table(spark, sf_dir, "events")
    seen = e.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("rid"),
                    F.to_date("ts").cast("string").alias("batch_id"))
    return SI.refresh_candidates(seen, TB.catalog_base(spark, sf_dir), TB.now_col()).select("batch_id", "rid")


def q_failed_count(spark, sf_dir):
    return HL.failed_count(q_result_quality(spark, sf_dir))


def q_export_catalog_unshared(spark, sf_dir):
    return EX.catalog_unshared(TB.export_catalog(spark, sf_dir)).select(
        "id", "deleted", "name", "urltemplate", "type", "mimetype", "maxqueriesperday", "directaccess")


def q_delete_resources(spark, sf_dir):
    """M8: hard delete of the suppliers tombstoned in the change batch, and of
    ids that are not in the catalogue (reported as unknown)."""
    gone = TB.catalog_updates(spark, sf_dir).filter("deleted").select("id")
    kept, unknown = CAT.delete_resource(TB.catalog_base(spark, sf_dir), gone)
    return kept.select("id", "name")


def q_valid_hits(spark, sf_dir):
    """P8 over extracted page items."""
    items = X.extract_links(_long_pages(spark, sf_dir)).withColumn("rid", F.lit(None).cast("string"))
    return CAT.valid_hit(items).select("page_id", F.col("pos").cast("int").alias("pos"), "title")


def _stored_path(spark, hits):
    from ferret.streaming.common import job_dir

    path = job_dir(spark, "index")
    IX.write_index(IX.build_index(hits, tasks=text_tasks(spark)), path)
    return path


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark, sf_dir):
    """The index of the table's hits, written once per session and folder (under the shared checkpoint folder)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = _stored_path(spark, TB.hits(spark, sf_dir))
    return IX.read_index(spark, _STORED[key])


def q_search_stored(spark, sf_dir):
    """R4 over the stored index: the same answers as ``search``."""
    res = S.search_stored(TB.queries(spark, sf_dir), stored_index(spark, sf_dir))
    return res.select("qid", "rank", "hit_id", r6("score"), "rid", "type", "title", "url")


def q_search_bounded(spark, sf_dir):
    """R4 over the stored index with score bounds: the same answers as ``search``."""
    res = S.search_bounded(TB.queries(spark, sf_dir), stored_index(spark, sf_dir))
    return res.select("qid", "rank", "hit_id", r6("score"), "rid", "type", "title", "url")


def q_search_incremental(spark, sf_dir):
    """R2 kept current: the index first holds three quarters of the documents,
    the odd ones by title alone.  Five batches of odd documents then add and
    replace, each as a part of its own, and parts of one size are merged.  The
    answers equal those of a full rebuild."""
    hits = TB.hits(spark, sf_dir)
    path = _stored_path(spark, hits.withColumn("description", F.when(F.col("doc_id") % 2 == 0, F.col("description"))).filter("doc_id % 4 <> 3"))
    for k in range(5):
        IX.update_index(hits.filter((F.col("doc_id") % 2 == 1) & (F.pmod("doc_id", F.lit(5)) == k)), path, tasks=text_tasks(spark))
    res = S.search_stored(TB.queries(spark, sf_dir), IX.read_index(spark, path))
    return res.select("qid", "rank", "hit_id", r6("score"), "rid", "type", "title", "url")


QUERIES: dict[str, Query] = {
    "search": q_search,
    "term_stats": q_term_stats,
    "select_resources": q_select_resources,
    "select_resources_typed_page": q_select_resources_typed_page,
    "list_resources": q_list_resources,
    "matched_texts": q_matched_texts,
    "rerank_general": _rerank("or"),
    "rerank_anyresult": _rerank("anyresult"),
    "rerank_bestrandom": _rerank("bestrandom"),
    "rerank_random": _rerank("random"),
    "resource_health": q_resource_health,
    "health_summary": q_health_summary,
    "health_summary_mother": q_health_summary_mother,
    "query_counters": q_query_counters,
    "uptime_report": q_uptime_report,
    "seconds_since_use": q_seconds_since_use,
    "max_prior": q_max_prior,
    "merge_resources": q_merge_resources,
    "rate_limit": q_rate_limit,
    "plan_requests": q_plan_requests,
    "cache_lookup": q_cache_lookup,
    "extract_page_links": q_extract_page_links,
    "extract_html": q_extract_html,
    "extract_xml": q_extract_xml,
    "extract_json": q_extract_json,
    "extract_callback": q_extract_callback,
    "extract_json_of_html": q_extract_json_of_html,
    "extract_html_with_json": q_extract_html_with_json,
    "parse_resources": q_parse_resources,
    "extract_result_pages": q_extract_result_pages,
    "ingest_stream": q_ingest_stream,
    "hit_log": q_hit_log,
    "search_ingested": q_search_ingested,
    "refresh_stream": q_refresh_stream,
    "health_stream": q_health_stream,
    "rate_limit_stream": q_rate_limit_stream,
    "rate_limit_stateful": q_rate_limit_stateful,
    "rate_limit_per_resource": q_rate_limit_per_resource,
    "upsert_hits": q_upsert_hits,
    "url_functions": q_url_functions,
    "contains_id": q_contains_id,
    "check_ids": q_check_ids,
    "tombstones": q_tombstones,
    "update_allowance": q_update_allowance,
    "strip_provenance": q_strip_provenance,
    "not_yet_seen": q_not_yet_seen,
    "cached_results": q_cached_results,
    "local_projection": q_local_projection,
    "with_default_hit": q_with_default_hit,
    "export_hits": q_export_hits,
    "saved_catalog": q_saved_catalog,
    "valid_resources": q_valid_resources,
    "export_health": q_export_health,
    "export_catalog_shared": q_export_catalog_shared,
    "result_page_roundtrip": q_result_page_roundtrip,
    "catalog_from_pages": q_catalog_from_pages,
    "sample_resource": q_sample_resource,
    "next_probe": q_next_probe,
    "result_quality": q_result_quality,
    "local_search": q_local_search,
    "boolean_search": q_boolean_search,
    "request_pages": q_request_pages,
    "allowance_now": q_allowance_now,
    "refresh_candidates": q_refresh_candidates,
    "failed_count": q_failed_count,
    "export_catalog_unshared": q_export_catalog_unshared,
    "delete_resources": q_delete_resources,
    "valid_hits": q_valid_hits,
    "search_stored": q_search_stored,
    "search_bounded": q_search_bounded,
    "search_incremental": q_search_incremental,
}

ORACLE: dict[str, str] = {
    "search": O.SEARCH,
    "term_stats": O.TERM_STATS,
    "local_search": O.LOCAL_SEARCH,
    "select_resources": O.select_resources_sql(10, 0, None),
    "select_resources_typed_page": O.select_resources_sql(5, 5, "fr"),
    "list_resources": O.list_resources_sql(10, 0),
    "matched_texts": O.MATCHED_TEXTS,
    "rerank_general": O.RERANK_GENERAL,
    "rerank_anyresult": O.RERANK_ANYRESULT,
    "rerank_random": O.RERANK_RANDOM,
    "rerank_bestrandom": O.RERANK_BESTRANDOM,
    "sample_resource": O.SAMPLE_RESOURCE,
    "next_probe": O.NEXT_PROBE,
    "resource_health": O.RESOURCE_HEALTH,
    "health_summary": O.HEALTH_SUMMARY,
    "health_summary_mother": O.HEALTH_SUMMARY_MOTHER,
    "query_counters": O.QUERY_COUNTERS,
    "uptime_report": O.UPTIME_REPORT,
    "seconds_since_use": O.SECONDS_SINCE_USE,
    "max_prior": O.MAX_PRIOR,
    "merge_resources": O.MERGE_RESOURCES,
    "rate_limit": O.RATE_LIMIT,
    "plan_requests": O.PLAN_REQUESTS,
    "cache_lookup": O.CACHE_LOOKUP,
    "extract_page_links": O.EXTRACT_LINKS,
    "extract_html": O.EXTRACT_LINKS,
    "extract_xml": O.EXTRACT_XML,
    "extract_json": O.EXTRACT_JSON,
    "extract_callback": O.EXTRACT_CALLBACK,
    "extract_json_of_html": O.EXTRACT_JSON_OF_HTML,
    "extract_html_with_json": O.EXTRACT_HTML_WITH_JSON,
    "parse_resources": O.PARSE_RESOURCES,
    "extract_result_pages": O.EXTRACT_RESULT_PAGES,
    "ingest_stream": O.INGEST,
    "hit_log": O.HIT_LOG,
    "search_ingested": O.SEARCH_INGESTED,
    "refresh_stream": O.REFRESH_STREAM,
    "health_stream": O.RESOURCE_HEALTH,
    "rate_limit_stream": O.RATE_LIMIT,
    "rate_limit_stateful": O.RATE_LIMIT_STATEFUL,
    "rate_limit_per_resource": O.RATE_LIMIT_PER_RESOURCE,
    "upsert_hits": O.UPSERT_HITS,
    "url_functions": O.URL_FUNCTIONS,
    "contains_id": O.CONTAINS_ID,
    "check_ids": O.CHECK_IDS,
    "tombstones": O.TOMBSTONES,
    "update_allowance": O.UPDATE_ALLOWANCE,
    "strip_provenance": O.STRIP_PROVENANCE,
    "not_yet_seen": O.NOT_YET_SEEN,
    "cached_results": O.CACHED_RESULTS,
    "local_projection": O.LOCAL_PROJECTION,
    "with_default_hit": O.WITH_DEFAULT_HIT,
    "export_hits": O.EXPORT_HITS,
    "saved_catalog": O.SAVED_CATALOG,
    "valid_resources": O.VALID_RESOURCES,
    "export_health": O.EXPORT_HEALTH,
    "export_catalog_shared": O.EXPORT_CATALOG_SHARED,
    "result_page_roundtrip": O.RESULT_PAGE_ROUNDTRIP,
    "catalog_from_pages": O.CATALOG_FROM_PAGES,
    "result_quality": O.RESULT_QUALITY,
    "boolean_search": O.BOOLEAN_SEARCH,
    "request_pages": O.REQUEST_PAGES,
    "allowance_now": O.ALLOWANCE_NOW,
    "refresh_candidates": O.REFRESH_CANDIDATES,
    "failed_count": O.FAILED_COUNT,
    "export_catalog_unshared": O.EXPORT_CATALOG_UNSHARED,
    "delete_resources": O.DELETE_RESOURCES,
    "valid_hits": O.VALID_HITS,
    "search_stored": O.SEARCH,
    "search_bounded": O.SEARCH,
    "search_incremental": O.SEARCH,
}
#: Work that a query finds done: name -> callable(spark, sf_dir).  The queries do
#: it themselves where it was not; a bench times it apart from them.
PREPARE = {"search_stored": stored_index, "search_bounded": stored_index}
FLAGSHIP = "select_resources"
