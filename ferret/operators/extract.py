"""Extraction jobs: stored result pages -> hit rows.

A rule is an argument of the call: ``itempath`` and ``extractors`` (field ->
path) are constants, so every rule is a plan of its own.  Every field value is
cleaned by F3 and ``url`` is resolved by F4.  At most ``limit`` items are taken
per page (T9).  A page that cannot be read, or a path that is not supported,
gives one row with ``error`` and position 0; no job fails and no page is lost
without a word.

* :func:`extract_links` -- the common "list of linked items" rule on any HTML,
  closed or not, with regular expressions only.
* :func:`extract_html` (X1) -- item and field paths on tolerant HTML: a small
  per-page helper on the standard library's parser inside ``mapInPandas``.
* :func:`extract_xml` (X2) -- Spark's ``xpath`` on each item of a page.
* :func:`extract_json` (X3), :func:`extract_callback` (X4) -- VARIANT functions.
* :func:`extract_json_of_html` (X5), :func:`extract_html_with_json` (X6) --
  X3 and the HTML rules applied to each other's values.
* :func:`extract_pages` (X7) -- each page by the rule and mimetype of its resource.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial, reduce
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.pandas.types import to_arrow_schema

from ferret.functions import text as T
from ferret.functions import urls as U
from ferret.operators.catalog import DEFAULT_MIMETYPE
from ferret.session import materialize_small
from ferret.sources import pages as PG

MAX_ITEMS = 30  # T9: default number of items taken per page
OUT = ["page_id", "pos", "fields", "error"]


def extract_links(pages: DataFrame, item_tag: str = "li", rid=None, limit: int | None = None) -> DataFrame:
    """Native X1 for ``//<item_tag>`` items with title = ``./a`` and url = ``./a/@href``.

    Items need not be closed, links may be quoted in either way or not at all,
    and an item that holds a list keeps the link before it.
    ``pages``: (page_id, url, html).  ``limit`` (T9) keeps the first items of a
    page only; none keeps all.  Returns (page_id, pos, title, url, rid).
    Items without a title and without a url are dropped (an empty field is an
    absent field, and a hit needs a title or a rid).
    """
    # an item reaches from its opening tag to the next one, or to its own or its list's end
    parts = F.split("html", rf"(?i)<{item_tag}(?:\s[^>]*|/)?>")
    items = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: F.regexp_replace(x, rf"(?is)</(?:{item_tag}|ul|ol|menu)\s*>.*", ""))
    if limit is not None:
        items = F.slice(items, 1, limit)
    p = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(items).alias("pos", "item"))
    title = T.clean_extracted(F.regexp_extract("item", r"(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)", 1))
    quoted = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    href = F.concat(*[F.regexp_extract("item", quoted, k) for k in (1, 2, 3)])
    link = T.clean_extracted(U.absolute_url(F.col("page_url"), F.when(href != F.lit(""), href)))
    out = p.select(
        "page_id",
        (F.col("pos") + 1).alias("pos"),
        F.when(title != F.lit(""), title).alias("title"),
        F.when(link != F.lit(""), link).alias("url"),
        (rid if rid is not None else F.regexp_extract("page_url", r"^[a-z]+://([^/?#:]+)", 1)).alias("rid"),
    )
    return out.filter(F.col("title").isNotNull() | F.col("url").isNotNull())


def _finish(rows: DataFrame, base: Column) -> DataFrame:
    """(page_id, pos, fields, error): empty values are absent, ``url`` is resolved, all are cleaned."""
    value = lambda k, v: T.clean_extracted(F.when(k == F.lit("url"), U.absolute_url(base, v)).otherwise(v))
    kept = F.map_filter("fields", lambda k, v: v.isNotNull() & (v != F.lit("")))
    return rows.select("page_id", "pos", F.transform_values(kept, value).alias("fields"), "error")


def _map(fields: dict[str, Column]) -> Column:
    if not fields:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))])


# Pages or items that one task reads.
PER_TASK = 10_000


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by page to tasks of about ``PER_TASK`` rows.  The number is given,
    as a scan or Spark's merging goes by bytes, and parsing a page costs far more."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / PER_TASK))
    return rows.repartition(tasks, "page_id")


NO_FIELDS = "map<string,string>"


def _errors(pages: DataFrame, message) -> DataFrame:
    message = F.lit(message) if isinstance(message, str) else message
    return pages.select("page_id", F.lit(0).alias("pos"), F.create_map().cast(NO_FIELDS).alias("fields"), message.alias("error"))


# --- X1: item and field paths on tolerant HTML (small per-page helper) -------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# an opening tag of the key closes an open element of these (implied end tags)
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"},
               "th": {"td", "th"}, "option": {"option"}}
# block elements that end an open paragraph
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}


class _TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("document")
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED_END.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if closes and self.stack[-1].tag in closes:
            self.stack.pop()
        el = ET.SubElement(self.stack[-1], tag, {k: (v or "") for k, v in attrs if re.fullmatch(r"[A-Za-z_][\w.\-]*", k)})
        if tag not in VOID:
            self.stack.append(el)

    def handle_startendtag(self, tag, attrs):
        ET.SubElement(self.stack[-1], tag, {k: (v or "") for k, v in attrs if re.fullmatch(r"[A-Za-z_][\w.\-]*", k)})

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        cur = self.stack[-1]
        if len(cur):
            cur[-1].tail = (cur[-1].tail or "") + data
        else:
            cur.text = (cur.text or "") + data


def html_tree(html: str) -> ET.Element:
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def _select(node: ET.Element, path: str) -> list[str]:
    """Values of ``path`` below ``node``: element text, ``@attr`` or ``text()``."""
    path = path.strip()
    attr = None
    m = re.search(r"/@([\w\-.]+)$", path) or re.fullmatch(r"@([\w\-.]+)", path)
    if m:
        attr = m.group(1)
        path = path[: m.start()] if m.start() > 0 else "."
    text_only = path.endswith("/text()")
    if text_only:
        path = path[: -len("/text()")] or "."
    if path.startswith("//"):
        path = "." + path
    elif path.startswith("/"):
        path = "." + path
    found = [node] if path in (".", "") else node.findall(path)
    if attr is not None:
        return [e.get(attr) for e in found if e.get(attr) is not None]
    if text_only:
        return [e.text or "" for e in found]
    return ["".join(e.itertext()) for e in found]



# Pages whose trees and items one worker holds at a time.
AT_ONCE = 64


def _html_items(itempath: str, extractors: dict[str, str], limit: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = itempath if itempath.startswith(".") else "." + itempath
    for start, batch in ((i, b) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
        rows = []
        pages = batch.slice(start, AT_ONCE).to_pydict()
        for page_id, base, html in zip(pages["page_id"], pages["base"], pages["html"]):
            try:
                root = html_tree(html)
                items = [root] if path == "." else root.findall(path)
                for pos, item in enumerate(items[:limit], start=1):
                    rows.append((page_id, base, pos, [(f, " ".join(_select(item, p))) for f, p in extractors.items()], None))
            except Exception as e:  # noqa: BLE001 - a bad page or path is an error row, not a failed task
                rows.append((page_id, base, 0, [], f"{type(e).__name__}: {e}"))
        columns = zip(*rows) if rows else [[]] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def extract_html(pages: DataFrame, itempath: str, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """(page_id, pos, fields, error) for HTML pages (page_id, url, html).

    Paths: ``//tag``, ``./a/b``, ``[@x='y']``, ``[tag]``, ``@attr``, ``text()``.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    out = Ty.StructType.fromDDL(f"page_id {kind}, base string, pos int, fields map<string,string>, error string")
    rows = pages.select("page_id", F.col("url").alias("base"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        partial(_html_items, itempath, dict(extractors), limit, to_arrow_schema(out)), out)
    return _finish(rows, F.col("base"))


# --- X2: XML ----------------------------------------------------------------

ITEM_STEP = re.compile(r"^(?:.*/)?(?:[\w.-]+:)?([\w.-]+)((?:\[[^\]]*\])*)$")


def extract_xml(pages: DataFrame, itempath: str, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """(page_id, pos, fields, error) for XML pages (page_id, url, html).

    A page is read whole once to see that it is well formed; its items are cut
    out by the tag of the path's last step, tested against the step's
    predicates, and read with ``xpath``: the texts of all matched nodes, joined
    by a space.  If the path finds another number of items than the cut (nested
    items, other places of the tag) the page is an error row.
    """
    step = ITEM_STEP.match(itempath)
    if not step:
        return _errors(pages, f"Item path not supported: {itempath}")
    tag, tests = step.groups()
    raw = F.regexp_replace(F.col("html"), r"^\s*<\?xml[^>]*\?>", "")
    x = _dealt(pages.select("page_id", "url", raw.alias("xml"))).withColumn("bad", _malformed("xml") | F.col("xml").isNull())
    items = F.regexp_extract_all("xml", F.lit(rf"(?s)<(?:[\w.-]+:)?{tag}(?=[\s>/])[^>]*?(?:/>|>.*?</(?:[\w.-]+:)?{tag}\s*>)"), 0)
    want = F.expr(f"xpath_int(xml, 'count({_quoted(itempath)})')")
    good = x.select("page_id", "url", "bad", F.when(~F.col("bad"), want).alias("want"), F.when(~F.col("bad"), items).alias("items"))
    # a row per item, and one for a page without any
    flat = good.select("page_id", "url", "bad", "want", F.posexplode_outer("items").alias("at", "item"))
    flat = flat.withColumn("cut", F.col("item").isNotNull() & _malformed("item"))
    found = F.col("item").isNotNull() & ~F.col("cut")
    if tests:
        found = F.when(found, F.coalesce(F.expr(f"xpath_boolean(item, '/*{_quoted(tests)}')"), F.lit(False))).otherwise(F.lit(False))
    flat = flat.withColumn("found", found)
    fields = {}
    for f, p in extractors.items():
        rel = p.strip()
        rel = "" if rel in (".", "") else "/" + rel.removeprefix("./") if not rel.startswith(".//") else rel[1:]
        at = _quoted("/*" + rel)
        last = at.rsplit("/", 1)[-1]
        leaf = at if last.startswith("@") or last == "text()" else f"{at}//text()"
        fields[f] = F.expr(f"CASE WHEN xpath_int(item, 'count({at})') <= 1 THEN xpath_string(item, '{at}') "
                           f"ELSE array_join(xpath(item, '{leaf}'), ' ') END")
    # every text is parsed in this one pass; what follows reads the fields
    read = materialize_small(flat.select("page_id", "url", "bad", "want", "at", "cut", "found", F.when(F.col("found"), _map(fields)).alias("fields")))
    rows = _dealt(read.filter("found").select("page_id", "url", "at", "fields"))
    counts = read.filter("found").groupBy("page_id").agg(F.count(F.lit(1)).alias("got"))
    wrong = (read.filter("not bad and coalesce(at, 0) = 0").select("page_id", "want")
             .join(counts, "page_id", "left").filter(F.col("want") != F.coalesce("got", F.lit(0))).select("page_id"))
    wrong = wrong.union(read.filter("cut").select("page_id")).distinct()
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("pos")
    rows = rows.join(wrong, "page_id", "left_anti").select("page_id", "url", order, "fields", F.lit(None).cast("string").alias("error"))
    out = _finish(rows.filter(F.col("pos") <= limit), F.col("url"))
    return (out.unionByName(_errors(read.filter("bad"), "Malformed XML"))
            .unionByName(_errors(wrong, f"Item path not supported: {itempath}")))


def _malformed(col: str) -> Column:
    """Permissive ``from_xml``: a malformed text lands in the column for bad records."""
    probe = F.from_xml(F.col(col), "_bad string, _any string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(probe["_bad"].isNotNull(), F.lit(True))


def _quoted(path: str) -> str:
    return path.replace("\\", "\\\\").replace("'", "\\'")


# --- X3, X4: JSON -----------------------------------------------------------

STEPS = re.compile(r"^(\.?//|\.?/|)([A-Za-z_][\w.-]*(?:/[A-Za-z_][\w.-]*)*)$")
# Levels of a page that one pass walks before what is left is stored.
WALK = 12


def _steps(path: str) -> tuple[bool, list[str]] | None:
    """A path as (at any depth?, names), or none if it is not supported."""
    m = STEPS.match(path.strip())
    return (m.group(1).endswith("//"), m.group(2).split("/")) if m else None


def _members(v: Column) -> Column:
    """The named values below a JSON value, as an array of (name, v).

    A member that is an array gives one value per element, all of its name; the
    elements of an array that has no name (at the top, or in an array) are named
    ``list``.  Members come in the order of their names, elements as they stand.
    """
    def elements(name: Column, x: Column) -> Column:
        return F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda o: F.struct(name.alias("name"), o.alias("v")))

    def of(e: Column) -> Column:
        name = T.json_element_name(e["key"])
        return F.coalesce(elements(name, e["value"]), F.array(F.struct(name.alias("name"), e["value"].alias("v"))))

    below = F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), of))
    return F.coalesce(below, elements(F.lit("list"), v), F.array().cast("array<struct<name:string,v:variant>>"))


def _child_values(v: Column, names: list[str]) -> Column:
    """All values at the end of a chain of names below ``v``, as an array."""
    def named(name: str):
        return lambda x: F.transform(F.filter(_members(x), lambda m: m["name"] == F.lit(name)), lambda m: m["v"])

    values = F.array(v)
    for name in names:
        values = F.flatten(F.transform(values, named(name)))
    return values


def _text(values: Column) -> Column:
    """The scalars of an array of values as text, joined by a space; objects and arrays have no text."""
    plain = F.filter(values, lambda x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"))
    return F.array_join(F.transform(plain, lambda x: x.cast("string")), " ")


def _descend(rows: DataFrame, names: list[str]) -> DataFrame:
    """Values below ``v`` whose chain of names ends with ``names``, at any depth.

    ``rows``: some columns and ``v``; returns them with ``at`` (the places that
    lead to a value) and ``v``, one row per value.  Every level is one explode of
    the values that are left; ``WALK`` levels make one pass, after which the
    values found and left are stored, until none is left: a page is walked to
    its end, however deep.
    """
    keys = [c for c in rows.columns if c != "v"]
    want = F.array(*[F.lit(n) for n in names])
    found = lambda n: F.slice(n, F.greatest(F.size(n) - len(names) + 1, F.lit(1)), len(names)) == want
    node = rows.select(*keys, F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("at"), F.col("v").alias("v"),
                                       F.lit(True).alias("open")).alias("n"))
    none = F.array().cast("array<struct<names:array<string>,at:array<int>,v:variant,open:boolean>>")
    while True:
        for _ in range(WALK):
            n = F.col("n")
            below = F.transform(_members(n["v"]), lambda m, i: F.struct(
                F.concat(F.col("n.names"), F.array(m["name"])).alias("names"), F.concat(F.col("n.at"), F.array(i)).alias("at"), m["v"].alias("v"),
                F.lit(True).alias("open")))
            itself = F.array(F.struct(n["names"].alias("names"), n["at"].alias("at"), n["v"].alias("v"), F.lit(False).alias("open")))
            node = node.select(*keys, F.explode(F.concat(
                F.when(~n["open"] | found(n["names"]), itself).otherwise(none), F.when(n["open"], below).otherwise(none))).alias("n"))
        node = materialize_small(node)
        if node.filter("n.open").isEmpty():
            return node.select(*keys, "n.at", "n.v")


def _below(rows: DataFrame, path: tuple[bool, list[str]]) -> DataFrame:
    """Values of a path below ``v``, one row each, with their place ``at``."""
    deep, names = path
    if deep:
        return _descend(rows, names)
    keys = [c for c in rows.columns if c != "v"]
    return rows.select(*keys, F.posexplode(_child_values(F.col("v"), names)).alias("i", "v")).select(*keys, F.array("i").alias("at"), "v")


def _json_rows(items: DataFrame, extractors: dict[str, str], limit: int) -> DataFrame:
    """(page_id, url, at, v), one item each -> rows of the first ``limit`` items of a page."""
    paths = {f: _steps(p) for f, p in extractors.items()}
    order = Window.partitionBy("page_id").orderBy("at")
    rows = items.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= limit)
    deep = {f: p[1] for f, p in paths.items() if p[0]}
    if deep:
        rows = materialize_small(rows)
    fields = _map({f: F.nullif(_text(_child_values(F.col("v"), p[1])), F.lit("")) for f, p in paths.items() if not p[0]})
    out = rows.select("page_id", "url", "pos", fields.alias("fields"))
    for f, names in deep.items():
        texts = _descend(rows.select("page_id", "pos", "v"), names).groupBy("page_id", "pos").agg(
            F.array_sort(F.collect_list(F.struct("at", _text(F.array("v")).alias("t")))).alias("t"))
        text = F.array_join(F.filter(F.transform("t", lambda x: x["t"]), lambda x: x != ""), " ")
        out = out.join(texts.select("page_id", "pos", text.alias("t")), ["page_id", "pos"], "left").select(
            "page_id", "url", "pos", F.map_concat("fields", F.create_map(F.lit(f), F.col("t"))).alias("fields"))
    return out.withColumn("error", F.lit(None).cast("string"))


def _wrong_path(paths) -> str | None:
    return next((p for p in paths if _steps(p) is None), None)


def _json_page_rows(pages: DataFrame, itempath: str, extractors: dict[str, str], limit: int) -> DataFrame:
    """Rows of JSON pages with values as they stand (url as ``url``), error rows included."""
    wrong = _wrong_path([itempath, *extractors.values()])
    if wrong is not None:
        return _errors(pages, f"Path not supported: {wrong}").withColumn("url", F.lit(None).cast("string"))
    v = _dealt(pages.select("page_id", "url", "html")).select("page_id", "url", F.try_parse_json("html").alias("v"))
    items = _below(v.filter("v is not null"), _steps(itempath))
    if _steps(itempath)[0]:  # what was stored on the way lies no more by page
        items = _dealt(items)
    return _json_rows(items, extractors, limit).unionByName(
        _errors(v.filter("v is null"), "Malformed JSON").withColumn("url", F.lit(None).cast("string")))


def extract_json(pages: DataFrame, itempath: str, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """(page_id, pos, fields, error) for JSON pages (page_id, url, html).

    ``//a/b`` finds members b of members a at any depth, ``/a/b`` (or ``a/b``)
    those from the top.  Every element of an array is a value of the array's
    name, and of ``list`` where it has none.  Items come in the order of the
    page, members of one object in the order of their names.  Field paths name
    members below an item: ``./a/b``, or ``.//a`` at any depth.
    """
    return _finish(_json_page_rows(pages, itempath, extractors, limit), F.col("url"))


# A text in quotes, a brace, or a stretch without either (a quote that is never closed stands alone).
SCRIPT_TOKENS = r"(?s)\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|[{}]|[^\"{}]++|\""


def _script_objects(pages: DataFrame) -> DataFrame:
    """(page_id, url, at, text): every outermost ``{...}`` of a script whose braces balance.

    The script is cut into tokens, so braces in quoted texts do not count; the
    running sum of braces is an object's depth (a closing brace without an
    opening one is passed over), and an object reaches to where it is 0 again.
    """
    tok = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT_TOKENS), 0)).alias("i", "tok"))
    w = Window.partitionBy("page_id").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    tok = tok.withColumn("sum", F.sum(step).over(upto))
    tok = tok.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(upto), F.lit(0)))
    tok = tok.withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    tok = tok.withColumn("object", F.sum(((F.col("before") == 0) & (F.col("depth") == 1)).cast("int")).over(upto))
    inside = tok.filter((F.col("depth") > 0) | (F.col("before") > 0))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tok"))), lambda x: x["tok"]), "")
    whole = inside.groupBy("page_id", "url", "object").agg(text.alias("text"), F.min("depth").alias("low"))
    return whole.filter("low = 0").select("page_id", "url", F.array("object").alias("at"), "text")


def extract_callback(pages: DataFrame, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """JavaScript callback pages: every outermost ``{...}`` that parses is an item, others are skipped."""
    wrong = _wrong_path(extractors.values())
    if wrong is not None:
        return _errors(pages, f"Path not supported: {wrong}")
    items = _script_objects(pages).select("page_id", "url", "at", F.try_parse_json("text").alias("v")).filter("v is not null")
    return _finish(_json_rows(items, extractors, limit), F.col("url"))


# --- X5, X6: one format inside the other ---------------------------------------

def extract_json_of_html(pages: DataFrame, itempath: str, member: str, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """JSON pages whose items hold HTML in ``member``; field paths are HTML paths in it."""
    got = _json_page_rows(pages, itempath, {"html": member}, limit)
    inner = got.filter("error is null").select(F.struct("page_id", "pos").alias("id"), "url", F.try_element_at("fields", F.lit("html")).alias("html"))
    rows = extract_html(inner.withColumn("page_id", F.to_json("id")), ".", extractors, 1)
    back = inner.select(F.to_json("id").alias("page_id"), "id")
    out = rows.join(back, "page_id").select(F.col("id.page_id").alias("page_id"), F.col("id.pos").alias("pos"), "fields", "error")
    return out.unionByName(got.filter("error is not null").select(*OUT))


def extract_html_with_json(pages: DataFrame, tag: str, attribute: str, extractors: dict[str, str], limit: int = MAX_ITEMS) -> DataFrame:
    """HTML pages whose ``tag`` elements hold a JSON object in ``attribute``; field paths are its members."""
    wrong = _wrong_path(extractors.values())
    if wrong is not None:
        return _errors(pages, f"Path not supported: {wrong}")
    pattern = rf"(?is)<{tag}\b[^>]*?\b{attribute}\s*=\s*(?:'(\{{[^']*\}})'|\"(\{{[^\"]*\}})\")"
    raw = [F.regexp_extract_all("html", F.lit(pattern), k) for k in (1, 2)]
    text = F.zip_with(*raw, lambda a, b: F.regexp_replace(F.regexp_replace(F.concat(a, b), "&quot;|&#34;", "\""), "&amp;", "&"))
    items = F.filter(F.transform(text, lambda x: F.try_parse_json(x)), lambda x: x.isNotNull())
    flat = pages.select("page_id", "url", F.posexplode(items).alias("i", "v")).select("page_id", "url", F.array("i").alias("at"), "v")
    return _finish(_json_rows(flat, extractors, limit), F.col("url"))


# --- X7 ---------------------------------------------------------------------

def extract_pages(pages: DataFrame, rules: list[dict], limit: int = MAX_ITEMS, default_mimetype: str = DEFAULT_MIMETYPE) -> DataFrame:
    """(page_id, pos, fields, error): every page by the rule of its resource.

    ``pages``: (page_id, url, html, rid).  A rule: rid, mimetype, itempath,
    extractors and, if given, urltemplate (the base of relative links), tag /
    attribute (X6) and member (X5).  Without a mimetype, or with the default
    one, a page is a result page (S1, S2).  Pages of a resource without a rule,
    and rules of other mimetypes, give error rows.
    """
    out = []
    for rule in rules:
        own = pages.filter(F.col("rid") == F.lit(rule["rid"]))
        if rule.get("urltemplate"):
            own = own.withColumn("url", F.lit(rule["urltemplate"]))
        kind, path, fields = rule.get("mimetype") or default_mimetype, rule.get("itempath") or "", rule.get("extractors") or {}
        if kind == default_mimetype:
            hits = PG.normalize_hits(PG.parse_result_pages(own, "html"))
            broken = own.filter(F.try_parse_json("html").isNull())
            out.append(hits.select("page_id", "pos", "fields", F.lit(None).cast("string").alias("error")))
            out.append(_errors(broken, "Malformed JSON"))
        elif kind == "text/html":
            out.append(extract_html(own, path, fields, limit))
        elif kind == "application/xml":
            out.append(extract_xml(own, path, fields, limit))
        elif kind == "application/json":
            out.append(extract_json(own, path, fields, limit))
        elif kind == "application/x-javascript":
            out.append(extract_callback(own, fields, limit))
        elif kind == "application/html+json":
            out.append(extract_json_of_html(own, path, rule.get("member", "html"), fields, limit))
        elif kind == "application/json+html":
            out.append(extract_html_with_json(own, rule.get("tag", "div"), rule.get("attribute", "data"), fields, limit))
        else:
            out.append(_errors(own, f"MIME Type not supported: {kind}"))
    known = [r["rid"] for r in rules]
    out.append(_errors(pages.filter(F.col("rid").isNull() | ~F.col("rid").isin(known)) if known else pages, "No rule for this resource"))
    return reduce(DataFrame.unionByName, [x.select(*OUT) for x in out])
