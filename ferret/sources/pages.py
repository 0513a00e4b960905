"""Readers for stored JSON result pages and resource definitions.

A result page is ``{"hits": [{...}, ...], "resource": {...}, "query": ..,
"version": version}``; a resource file holds one object under ``resource``.
Files are read whole (``wholetext``), one page per file, and parsed with
Spark's JSON functions; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferret.functions import text as T
from ferret.operators import catalog as CAT

# JSON scalar kinds kept in a hit (arrays, objects and nulls are dropped).
SCALAR_KINDS = ("STRING", "BOOLEAN", "BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def parse_result_pages(df: DataFrame, col: str = "json", page_id: str = "page_id", version: str = "version") -> DataFrame:
    """S1 on a column of page texts: (page_id, query, rid, version, pos, hit).

    ``hit`` is a VARIANT object; missing ``hits`` gives no rows, missing
    ``resource`` / version give nulls.  Pages that do not parse are
    dropped (``try_parse_json``).  ``version`` names the member that holds the
    version of the page format.
    """
    v = df.select(page_id, F.try_parse_json(F.col(col)).alias("v")).filter(F.col("v").isNotNull())
    hits = F.try_variant_get("v", "$.hits", "array<variant>")
    return v.select(
        page_id,
        F.try_variant_get("v", "$.query", "string").alias("query"),
        F.try_variant_get("v", "$.resource.id", "string").alias("rid"),
        F.try_variant_get("v", f"$.{version}", "string").alias("version"),
        F.posexplode(F.coalesce(hits, F.array().cast("array<variant>"))).alias("pos", "hit"),
    ).withColumn("pos", F.col("pos") + 1)


def read_result_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON result-page files (one page per file)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), F.col("value").alias("json"))
    return parse_result_pages(raw)


def normalize_hits(pages: DataFrame, hit_col: str = "hit") -> DataFrame:
    """A hit as ``map<string,string>`` of its JSON scalars, strings with
    HTML stripped (F2); nested arrays / objects and nulls are dropped."""
    m = F.col(hit_col).try_cast("map<string,variant>")
    kept = F.map_filter(m, lambda k, v: F.schema_of_variant(v).isin(*SCALAR_KINDS) | F.schema_of_variant(v).startswith("DECIMAL"))
    as_text = F.transform_values(kept, lambda k, v: T.strip_html(v.cast("string")))
    return pages.withColumn("fields", as_text).drop(hit_col)


def free_hits(pages: DataFrame, hit_col: str = "hit") -> DataFrame:
    """S1 rows as hits whose members are free.

    Returns (page_id, pos, hit_id, rid, title, url, description, type, fields,
    strings): ``fields`` holds every scalar member as text, ``strings`` the string
    members alone, which are what an index of the hit covers (F6, see the
    ``members`` of :func:`ferret.operators.index.build_index`).  A hit without a
    rid takes its page's.  Members may differ from hit to hit and from batch to
    batch: they are keys of a map, never columns.
    """
    m = F.col(hit_col).try_cast("map<string,variant>")
    own = F.map_filter(m, lambda k, v: F.schema_of_variant(v) == "STRING")
    strings = F.transform_values(own, lambda k, v: T.strip_html(v.cast("string")))
    rid = F.create_map(F.lit("rid"), F.col("rid"))
    strings = F.when(F.col("rid").isNotNull() & ~F.map_contains_key(strings, "rid"), F.map_concat(strings, rid)).otherwise(strings)
    h = normalize_hits(pages.withColumn("strings", strings).withColumn("_hit", F.col(hit_col)), "_hit")
    at = lambda k: F.try_element_at("strings", F.lit(k))
    h = h.select("page_id", "pos", *[at(k).alias(k) for k in ("rid", "title", "url", "description", "type")], "fields", "strings")
    return h.withColumn("hit_id", T.hit_id("rid", "url", "title"))


RESOURCE_JSON_SCHEMA = (
    "resource struct<id:string, name:string, apitemplate:string, urltemplate:string, suggesttemplate:string, "
    "favicon:string, banner:string, post:string, postencode:string, signature:string, rerank:string, "
    "directaccess:string, itempath:string, type:string, mimetype:string, testquery:string, deleted:boolean, "
    "prior:double, maxqueriesperday:int, extractors:map<string,string>, headers:map<string,string>, "
    "privateparameters:map<string,string>>"
)


def parse_resources(df: DataFrame, col: str = "json") -> DataFrame:
    """S3 on a column of resource texts: typed catalogue rows with defaults.

    Unparseable text gives a null resource and is reported in ``_corrupt``
    (S4's "skip with a warning")."""
    p = df.select(F.from_json(F.col(col), RESOURCE_JSON_SCHEMA, {"mode": "PERMISSIVE"}).alias("p"), F.col(col).alias("_raw"))
    ok = p.filter(F.col("p.resource.id").isNotNull()).select("p.resource.*")
    return CAT.conform(ok)


def bad_resources(df: DataFrame, col: str = "json") -> DataFrame:
    """The texts that do not yield a resource with an id."""
    p = df.select(F.from_json(F.col(col), RESOURCE_JSON_SCHEMA).alias("p"), F.col(col).alias("text"))
    return p.filter(F.col("p.resource.id").isNull()).select("text")


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """S3: resource definition files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
    return parse_resources(raw)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reload a stored catalogue (the saves of S5 folded by id, latest
    ``lastupdated`` wins); returns (catalogue, high-water mark row)."""
    log = spark.read.parquet(path).drop("saved_since")
    cat = CAT.conform(CAT.last_row(log, ["id"], ["lastupdated"]))
    return cat, cat.agg(F.max("lastupdated").alias("since"))
