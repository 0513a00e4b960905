"""Column functions on text: tokenizers, HTML cleaning, hit identity and text.

All are Catalyst expressions (no Python per row), so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's analyzer): the English stop words
# removed by the index analyzer.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no",
    "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this",
    "to", "was", "will", "with",
]

# Patterns of the reference's cleaning rules.
SPAN_TAGS = r"(?i)</?span[^>]*>|</?b>|</?i>|</?em>|</?strong>"
ANY_TAG_OR_ENTITY = r"<[^>]+>|&#?[0-9a-zA-Z]{1,9};"
ANGLE = r"[<>]"
TAG_OR_REPLACEMENT_CHAR = "<[^>]+>|\ufffd"
SIMPLE_SPLIT = r"[^a-z0-9]+"
ELEMENT_NAME_FIX = r"[^A-Z0-9a-z\-_\.]|^([^A-Za-z_])"

# Word pattern approximating Unicode word segmentation (letters, digits and
# underscore, joined across an inner apostrophe or period).  WORD_FAST is the
# same language with possessive quantifiers (no backtracking in Java's engine).
WORD = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
WORD_FAST = r"[\p{L}\p{N}_]++(?:['.][\p{L}\p{N}_]++)*+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def tokenize(c) -> Column:
    """lower case, split on anything but ``a-z0-9``, drop empty tokens."""
    return F.filter(F.split(F.lower(_c(c)), SIMPLE_SPLIT), lambda t: t != F.lit(""))


def analyze(c) -> Column:
    """Index analyzer, lower-cased words with English stop words removed.

    Keeps repeats (query side counts a repeated word again).
    """
    words = F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_FAST), 0)
    return F.filter(words, lambda t: ~F.array_contains(stop_words(), t))


def analyze_distinct(c) -> Column:
    """R1 as a set: the distinct index terms of a text."""
    return F.array_except(F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_FAST), 0), stop_words())


def strip_html(c) -> Column:
    """remove emphasis tags, then every tag and entity, then stray angle brackets."""
    x = F.regexp_replace(_c(c), SPAN_TAGS, "")
    x = F.regexp_replace(x, ANY_TAG_OR_ENTITY, "")
    return F.regexp_replace(x, ANGLE, "")


def java_trim(c) -> Column:
    """Trim every character up to U+0020 at both ends (Java ``String.trim``)."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"^[\x00-\x20]+", ""), r"[\x00-\x20]+$", "")


def clean_extracted(c) -> Column:
    """remove emphasis tags, other tags and U+FFFD become a space, trim."""
    x = F.regexp_replace(_c(c), SPAN_TAGS, "")
    x = F.regexp_replace(x, TAG_OR_REPLACEMENT_CHAR, " ")
    return java_trim(x)


def hit_id(rid, url, title) -> Column:
    """``rid@url``; without url ``@title`` (rid unused); neither: ``@null``."""
    rid, url, title = _c(rid), _c(url), _c(title)
    return F.when(url.isNotNull(), F.concat(F.coalesce(rid, F.lit("")), F.lit("@"), url)).otherwise(
        F.concat(F.lit("@"), F.coalesce(title, F.lit("null")))
    )


def hit_text(*cols) -> Column:
    """all string values of a hit joined by a space (nulls skipped)."""
    return F.concat_ws(" ", *[_c(c) for c in cols])


def title_description(title, description) -> Column:
    """``trim(title + ' ' + description)`` with nulls as empty."""
    return java_trim(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), _c(description)))


def score_cast(c) -> Column:
    """F8: forgiving cast to a score; bad text or null gives 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


def json_element_name(c) -> Column:
    """make a JSON key usable as an element name.

    Characters outside letters, digits, ``-``, ``_`` and ``.`` become ``_``;
    a first character that is allowed but is not a letter or underscore is
    kept after a leading ``_``.
    """
    return F.regexp_replace(_c(c), ELEMENT_NAME_FIX, "_$1")


def text_overlap(text_tokens: Column, query_terms: Column, weight: float) -> Column:
    """``weight`` times the number of distinct query terms in the text."""
    return F.size(F.array_intersect(text_tokens, query_terms)) * F.lit(weight)


def seeded_key(seed: int, *cols) -> Column:
    """A uniform order key: md5 of the seed and the row's key columns.

    It does not depend on how rows are partitioned, so a retried task and any
    other engine give the same order.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(c).cast("string") for c in cols]))
