"""Column functions on URLs, templates and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the reference's template rules.
OPTIONAL_SLOT = r"\{[0-9A-Za-z\-_]+\?\}"
ANY_SLOT = r"\{[0-9A-Za-z\-_]+\}"
JAVA_PACKAGE_PREFIX = r"java\.[a-z]+\."
LEADING_PACKAGE = r"^[A-Za-z\.]*\."
URL_IN_MESSAGE = r":? ?https?:[^ ]+"
QUERY_PART = r"\?.*$"
FORM_ENCODING = "application/x-www-form-urlencoded"
JSON_ENCODING = "application/json"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def absolute_url(base, url) -> Column:
    """resolve an extracted link against the page address.

    Unchanged when either is null or the link is http(s); ``//x`` takes the
    base's scheme; ``/x`` keeps the base up to the first ``/`` from index 10;
    otherwise the base up to its last ``/`` (when past index 10) or base + ``/``.
    """
    base, url = _c(base), _c(url)
    scheme_end = F.locate(":", base)  # 1-based; 0 = absent
    first_slash = F.locate("/", base, 11)  # first '/' at 0-based index >= 10
    last_slash = F.length(base) - F.locate("/", F.reverse(base)) + 1  # 1-based, or len+1 when absent
    has_last = F.locate("/", F.reverse(base)) > 0
    root = F.when(url.startswith("//"), F.substring(base, F.lit(1), scheme_end)).otherwise(
        F.when(first_slash > 0, F.substring(base, F.lit(1), first_slash - 1)).otherwise(base)
    )
    rel = F.when(has_last & (last_slash - 1 > 10), F.substring(base, F.lit(1), last_slash)).otherwise(F.concat(base, F.lit("/")))
    joined = F.when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(rel, url))
    keep = base.isNull() | url.isNull() | url.startswith("http://") | url.startswith("https://")
    return F.when(keep, url).otherwise(joined)


def form_encode(c) -> Column:
    """F10 (URL part): ``application/x-www-form-urlencoded`` encoding, UTF-8."""
    return F.url_encode(_c(c))


def encode_query(query, mode) -> Column:
    """F10 (body part): unset or form mode -> form encoding; JSON -> ``"`` becomes
    ``\\"``; any other mode -> raw."""
    q, m = _c(query), _c(mode)
    return (
        F.when(m.isNull() | (m == F.lit(FORM_ENCODING)), form_encode(q))
        .when(m == F.lit(JSON_ENCODING), F.replace(q, F.lit('"'), F.lit('\\"')))
        .otherwise(q)
    )


def fill_template(template, query, page, params) -> tuple[Column, Column]:
    """(filled template, error) for one request.

    Order: private parameters ``{p}``/``{p?}``; ``{searchTerms}``/``{searchTerms?}``;
    ``{q}``/``{q?}``; page given -> ``{startPage}`` and ``{startPage?}``, else
    only ``{startPage}`` = 1; other optional slots removed; a slot left over is
    the error ``Missing url parameter {name}`` (filled value null).
    Values are inserted literally (``replace``), never as regex replacements.
    """
    t, q, p, params = _c(template), _c(query), _c(page), _c(params)

    def put(acc, slot, value):
        return F.replace(F.replace(acc, F.lit("{" + slot + "}"), value), F.lit("{" + slot + "?}"), value)

    x = F.aggregate(
        F.coalesce(F.map_entries(params), F.array().cast("array<struct<key:string,value:string>>")),
        t,
        lambda acc, e: F.replace(
            F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
            F.concat(F.lit("{"), e["key"], F.lit("?}")),
            e["value"],
        ),
    )
    x = put(x, "searchTerms", q)
    x = put(x, "q", q)
    x = F.when(p.isNull(), F.replace(x, F.lit("{startPage}"), F.lit("1"))).otherwise(put(x, "startPage", p.cast("string")))
    x = F.regexp_replace(x, OPTIONAL_SLOT, "")
    bad = x.rlike(ANY_SLOT)
    err = F.when(bad, F.concat(F.lit("Missing url parameter "), F.substring_index(F.substring(x, F.locate("{", x), F.lit(1 << 30)), "}", 1), F.lit("}")))
    return F.when(~bad, x), err


def resource_url(apitemplate, own_id, rid) -> tuple[Column, Column]:
    """(url, error) of another resource's description: the last occurrence
    of ``own_id`` in the template becomes the encoded ``rid``, and the template
    is filled with an empty query (F9); no occurrence is an error."""
    t, me, r = _c(apitemplate), _c(own_id), _c(rid)
    back = F.position(F.reverse(me), F.reverse(t))  # 1-based in the reversed text; 0 = absent
    pos = F.length(t) - back - F.length(me) + 2  # 1-based start of the last match
    out = F.concat(F.substring(t, F.lit(1), pos - 1), form_encode(r), F.substring(t, pos + F.length(me), F.lit(1 << 30)))
    none = F.lit(None).cast("map<string,string>")
    url, error = fill_template(out, F.lit(""), F.lit(None).cast("int"), none)
    return F.when(back > 0, url), F.when(F.coalesce(back, F.lit(0)) > 0, error).otherwise(F.lit("Own id is not in the template"))


def redact(message, params) -> Column:
    """message safe to show: no java package prefixes, private values
    replaced by ``{name}``, no leading package path, no URLs."""
    m = F.regexp_replace(_c(message), JAVA_PACKAGE_PREFIX, "")
    m = F.aggregate(
        F.coalesce(F.map_entries(_c(params)), F.array().cast("array<struct<key:string,value:string>>")),
        m,
        lambda acc, e: F.replace(acc, e["value"], F.concat(F.lit("{"), e["key"], F.lit("}"))),
    )
    m = F.regexp_replace(m, LEADING_PACKAGE, "")
    return F.regexp_replace(m, URL_IN_MESSAGE, "")


def template_key(url) -> Column:
    """a URL without its query part."""
    return F.regexp_replace(_c(url), QUERY_PART, "")


def same_template(a, b) -> Column:
    """same template when equal without query parts (null equals null)."""
    return template_key(a).eqNullSafe(template_key(b))


def remove_file_name(uri) -> Column:
    """F14 helper: ``/name`` at the end becomes ``/``."""
    return F.regexp_replace(_c(uri), r"/[^/]+$", "/")


def normalize_template(uri, rid) -> Column:
    """a folder address gets ``rid?q={searchTerms}&page={startPage?}``; an
    address without a query slot gets ``?q={searchTerms}&page={startPage?}``."""
    u, r = _c(uri), _c(rid)
    slot = F.lit("?q={searchTerms}&page={startPage?}")
    return (
        F.when(u.endswith("/"), F.concat(u, r, slot))
        .when(~u.contains("{q") & ~u.contains("{searchTerms"), F.concat(u, slot))
        .otherwise(u)
    )


def hash_key(c) -> Column:
    """lower-case hex MD5 of the UTF-8 text."""
    return F.md5(_c(c))
