"""Catalogue and hit-table maintenance.

The catalogue is a table with one row per resource id.  Updates arrive as a
table of resource versions; merging is a full outer join on ``id`` (J7), never
a per-row loop.  The last writer of a key is ``row_number() = 1`` in a total
order (sequence, then a hash of the row), which Spark limits to one row per key
and task before the shuffle; a stored table is only probed by the updates'
keys, never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ferret.functions import health as H

# Neutral defaults; a catalogue with other ones passes them to ``conform``.
DEFAULT_MIMETYPE = "application/result-page+json"
DEFAULT_TESTQUERY = "test"
DEFAULT_RATE = 1000
PRIOR_TOLERANCE = 0.001
REFRESH_BUDGET = 11  # updates per check
STALE_REFRESH_SECONDS = 7200
STALE_LOOKUP_SECONDS = 9600

# The configured string members compared by change detection (M5).
COMPARED_STRINGS = [
    "id", "name", "signature", "mimetype", "rerank", "favicon", "banner", "directaccess", "post",
    "postencode", "type", "testquery", "itempath", "apitemplate", "urltemplate", "suggesttemplate",
]
STRING_FIELDS = COMPARED_STRINGS
MAP_FIELDS = ["extractors", "headers", "privateparameters"]
HEALTH_FIELDS = [
    ("requestsok", Ty.IntegerType()),
    ("requestserr", Ty.IntegerType()),
    ("lastsuccess", Ty.TimestampType()),
    ("lasterror", Ty.TimestampType()),
    ("lastupdated", Ty.TimestampType()),
    ("upsince", Ty.TimestampType()),
    ("lastmessage", Ty.StringType()),
    ("dayallowance", Ty.IntegerType()),
]

CATALOG_SCHEMA = Ty.StructType(
    [Ty.StructField(c, Ty.StringType()) for c in STRING_FIELDS]
    + [
        Ty.StructField("deleted", Ty.BooleanType()),
        Ty.StructField("prior", Ty.DoubleType()),
        Ty.StructField("maxqueriesperday", Ty.IntegerType()),
    ]
    + [Ty.StructField(c, Ty.MapType(Ty.StringType(), Ty.StringType())) for c in MAP_FIELDS]
    + [Ty.StructField(c, t) for c, t in HEALTH_FIELDS]
)
CONFIG_COLUMNS = STRING_FIELDS + ["deleted", "prior", "maxqueriesperday"] + MAP_FIELDS
COLUMNS = [f.name for f in CATALOG_SCHEMA.fields]


def conform(df: DataFrame, mimetype: str = DEFAULT_MIMETYPE, testquery: str = DEFAULT_TESTQUERY) -> DataFrame:
    """Give a resource table every catalogue column, with defaults.

    Built as SQL expression text (one call per column) because the projection
    is wide; the plan is the same as with column objects.
    """
    have = set(df.columns)
    defaults = {"mimetype": f"'{mimetype}'", "testquery": f"'{testquery}'",
                "deleted": "false", "maxqueriesperday": str(DEFAULT_RATE)}
    exprs = []
    for f in CATALOG_SCHEMA.fields:
        t = f.dataType.simpleString()
        c = f"CAST(`{f.name}` AS {t})" if f.name in have else f"CAST(NULL AS {t})"
        if f.name in defaults:
            c = f"coalesce({c}, {defaults[f.name]})"
        exprs.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*exprs)


def last_row(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key in a total order: ``order`` columns, then a hash of
    128 bits of the whole row, so equal sequence numbers give the same winner on
    every run.  Only the hash is sorted, never the row's text."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.col("_tie").desc(), F.col("_tie2").desc())
    row = [_hashable(f) for f in df.schema.fields]
    return (df.withColumns({"_tie": F.xxhash64(F.lit(0), *row), "_tie2": F.xxhash64(F.lit(1), *row)})
            .withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_tie", "_tie2"))


def _hashable(field: Ty.StructField) -> Column:
    """A column as Spark hashes it: a map by its sorted entries, other types that hold one (or a VARIANT) as text."""
    t = field.dataType
    flat = t.simpleString()
    if isinstance(t, Ty.MapType) and "map" not in t.valueType.simpleString() and "variant" not in flat:
        return F.array_sort(F.map_entries(F.col(field.name)))
    return F.to_json(F.struct(F.col(field.name))) if "map" in flat or "variant" in flat else F.col(field.name)


def _changed_sql(a: str, b: str) -> str:
    # no map and an empty map are the same configuration
    def map_eq(c):
        return (f"array_sort(map_entries(coalesce({a}{c}, map()))) = array_sort(map_entries(coalesce({b}{c}, map())))")

    same = [f"{a}{c} <=> {b}{c}" for c in COMPARED_STRINGS + ["deleted", "maxqueriesperday"]]
    same.append(f"abs(coalesce({a}prior, 0D) - coalesce({b}prior, 0D)) <= {PRIOR_TOLERANCE}D")
    same += [map_eq("extractors"), map_eq("headers")]
    return "NOT (" + " AND ".join(same) + ")"


def resource_changed(a: str, b: str) -> Column:
    """M5: do versions ``a`` and ``b`` (column prefixes) differ?

    Compares the 16 configured strings (null equals null), tombstone flag, rate,
    prior within 0.001 (null = 0), extractors and headers (null equals empty).
    Private parameters are not compared.
    """
    return F.expr(_changed_sql(a, b))


def merge_resources(catalog: DataFrame, updates: DataFrame, now: Column, seq: str | None = None) -> DataFrame:
    """M4 (J7): apply a table of resource versions to the catalogue.

    New id: inserted (up since now, counters 0).  Known id: ``lastupdated`` =
    now; if changed, every configured member (private parameters too) is
    overwritten, ``upsince`` = now, counters 0, message cleared, and the times
    of the last success and error stay; if unchanged, everything else is kept.
    Rows of untouched ids are kept as they are.  Of several versions of one id
    in ``updates`` the last by ``seq`` counts.
    """
    old = conform(catalog).selectExpr(*[f"`{c}` AS o_{c}" for c in COLUMNS])
    new = conform(last_version(updates, seq)).selectExpr(*[f"`{c}` AS n_{c}" for c in COLUMNS])
    j = old.join(new, old["o_id"] == new["n_id"], "full_outer").withColumn("_now", now)
    j = j.selectExpr("*", f"(o_id IS NULL OR (n_id IS NOT NULL AND {_changed_sql('o_', 'n_')})) AS _take")
    out = [f"CASE WHEN _take THEN n_{c} ELSE o_{c} END AS `{c}`" for c in CONFIG_COLUMNS]
    out += [
        "CASE WHEN _take THEN 0 ELSE o_requestsok END AS requestsok",
        "CASE WHEN _take THEN 0 ELSE o_requestserr END AS requestserr",
        "o_lastsuccess AS lastsuccess",
        "o_lasterror AS lasterror",
        "CASE WHEN n_id IS NULL THEN o_lastupdated ELSE _now END AS lastupdated",
        "CASE WHEN _take THEN _now ELSE o_upsince END AS upsince",
        "CASE WHEN _take THEN CAST(NULL AS STRING) ELSE o_lastmessage END AS lastmessage",
        "CASE WHEN o_id IS NULL THEN n_dayallowance ELSE o_dayallowance END AS dayallowance",
    ]
    return j.selectExpr(*out)


def last_version(updates: DataFrame, seq: str | None = None) -> DataFrame:
    """One version per id: the last by ``seq`` (see :func:`last_row` for ties)."""
    return last_row(updates, ["id"], [seq] if seq else [])


def check_ids(updates: DataFrame, catalog: DataFrame, mother_id: str | None, me_id: str | None) -> DataFrame:
    """M6: (id, problem) for updates that may not be applied.

    An update may not use the id of mother or me; me may not reuse a
    catalogue id.
    """
    reserved = [x for x in (mother_id, me_id) if x is not None]
    bad = updates.filter(F.col("id").isin(reserved)).select("id", F.lit("reserved id").alias("problem"))
    if me_id is not None:
        clash = catalog.filter(F.col("id") == F.lit(me_id)).select("id", F.lit("server id already exists").alias("problem"))
        bad = bad.unionByName(clash)
    return bad


def tombstone(ids: DataFrame) -> DataFrame:
    """M7: resource versions that mark ids as gone (id + deleted only)."""
    return ids.select("id", F.lit(True).alias("deleted"))


def delete_resource(catalog: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M8: hard delete; returns (catalogue without the ids, unknown ids)."""
    kept = catalog.join(ids.select("id"), "id", "left_anti")
    unknown = ids.select("id").join(catalog.select("id"), "id", "left_anti")
    return kept, unknown


def update_allowance(catalog: DataFrame, other: DataFrame) -> DataFrame:
    """M9: copy only the day allowance from another version of each resource."""
    o = other.select("id", F.col("dayallowance").alias("_allow"))
    return catalog.join(o, "id", "left").withColumn(
        "dayallowance", F.coalesce("_allow", "dayallowance")
    ).drop("_allow")


def stamp(hits: DataFrame, rid: Column, date: Column) -> DataFrame:
    """M1: add rid and foundBefore (yyyy-MM-dd) only where absent."""
    h = hits
    if "rid" not in h.columns:
        h = h.withColumn("rid", F.lit(None).cast("string"))
    if "foundBefore" not in h.columns:
        h = h.withColumn("foundBefore", F.lit(None).cast("string"))
    return h.withColumn("rid", F.coalesce("rid", rid)).withColumn(
        "foundBefore", F.coalesce("foundBefore", F.date_format(date, "yyyy-MM-dd"))
    )


def strip_provenance(hits: DataFrame, trusted: Column) -> DataFrame:
    """M2: drop rid and query of hits from untrusted sources."""
    out = hits
    for c in ("rid", "query"):
        if c in out.columns:
            out = out.withColumn(c, F.when(trusted, F.col(c)))
    return out


def upsert_hits(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """M3: replace by hit id, last writer (highest ``seq``) wins.

    ``base`` holds one row per hit id and is older than ``updates``; its rows
    are only probed by the keys of the updates (anti join), never sorted or
    aggregated.  Of several updates of one hit the last in the total order
    (seq, row) counts.
    """
    last = last_row(updates, ["hit_id"], [seq])
    kept = base.join(updates.select("hit_id").distinct(), "hit_id", "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def stale(requests: DataFrame, catalog: DataFrame, seconds: int, now: Column) -> DataFrame:
    """P5: requested ids that are unknown or older than ``seconds``."""
    c = catalog.select(F.col("id").alias("rid"), "lastupdated")
    j = requests.join(c, "rid", "left")
    ago = H.seconds_ago(F.col("lastupdated"), now)
    return j.filter(F.col("lastupdated").isNull() | (ago > F.lit(seconds))).drop("lastupdated")


def valid_resource(df: DataFrame) -> DataFrame:
    """List rule violations per resource (empty list = valid).

    Any ``directaccess`` value and any headers or private parameters member,
    an empty one too, count as present.
    """
    direct = F.col("directaccess").isNotNull()
    checks = F.array_compact(F.array(
        F.when(F.col("id").isNull(), F.lit("Missing Identifier")),
        F.when(direct & F.col("headers").isNotNull(), F.lit("directaccess with headers")),
        F.when(direct & F.col("privateparameters").isNotNull(), F.lit("directaccess with private parameters")),
        F.when(direct & F.col("post").isNotNull(), F.lit("directaccess with post")),
        F.when(direct & (F.coalesce("mimetype", F.lit(DEFAULT_MIMETYPE)) != F.lit(DEFAULT_MIMETYPE)),
               F.lit("directaccess with mimetype")),
        F.when(F.col("apitemplate").startswith("file"), F.lit("apitemplate may not be a file")),
    ))
    return df.withColumn("violations", checks)


def refresh_budget(candidates: DataFrame, batch: str, order: list[Column], budget: int = REFRESH_BUDGET) -> DataFrame:
    """At most ``budget`` refreshes per check batch."""
    w = Window.partitionBy(batch).orderBy(*order)
    return candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= budget).drop("_r")


def valid_hit(hits: DataFrame) -> DataFrame:
    """A hit needs a title or a rid (non-empty)."""
    return hits.filter(
        (F.coalesce(F.length("title"), F.lit(0)) > 0) | (F.coalesce(F.length("rid"), F.lit(0)) > 0)
    )


def get_by_id(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue rows for a table of ids (left-semi join)."""
    return catalog.join(ids.select("id"), "id", "left_semi")


def contains_id(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each id with a flag telling whether the catalogue holds it."""
    known = catalog.select("id").distinct().withColumn("known", F.lit(True))
    return ids.join(known, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def get_hit(hits: DataFrame, hit_ids: DataFrame) -> DataFrame:
    """Stored hits for a table of hit ids."""
    return hits.join(hit_ids.select("hit_id"), "hit_id", "left_semi")
