"""Text scalar functions as Column expressions (JVM-side, codegen friendly).

Java regular expressions differ from Python's in two places that matter here:
``.`` also stops at ``\\r`` unless UNIX_LINES ``(?d)`` is on, and ``\\s``/``\\w``
are ASCII-only unless UNICODE_CHARACTER_CLASS ``(?U)`` is on. The patterns
below turn those flags on to keep Python ``re`` semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the cleaning rules.
HTML_TAG = r"(?d)<.*?>"
URL = r"(?U)http\S+|www\S+"
SPECIAL_ASCII = r"(?U)[^a-zA-Z0-9\s]"
SPECIAL_KEEP_LETTERS = r"(?U)[^\p{L}\p{N}\s]"
WHITESPACE_RUN = r"(?U)\s+"
WORD_TOKEN = r"(?U)\b\w\w+\b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col, lowercase: bool = True, remove_html: bool = True, remove_urls: bool = True,
               remove_special_chars: bool = True, remove_extra_spaces: bool = True,
               normalize_unicode: bool = True, keep_unicode_letters: bool = False) -> Column:
    """The cleaning chain in fixed order; each step can be switched off.

    ``normalize_unicode`` (UTF-8 round trip dropping lone surrogates) is a no-op for
    Spark strings, which are valid UTF-8 already. ``keep_unicode_letters`` keeps
    accented letters that the default ASCII rule replaces by spaces.
    """
    c = _c(col)
    if lowercase:
        c = F.lower(c)
    if remove_html:
        c = F.regexp_replace(c, HTML_TAG, " ")
    if remove_urls:
        c = F.regexp_replace(c, URL, " ")
    if remove_special_chars:
        c = F.regexp_replace(c, SPECIAL_KEEP_LETTERS if keep_unicode_letters else SPECIAL_ASCII, " ")
    if remove_extra_spaces:
        c = F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))
    return c


def clean_text_array(col, **kw) -> Column:
    """Clean every element of an array of strings."""
    return F.transform(_c(col), lambda x: clean_text(x, **kw))


def clean_text_map(col, **kw) -> Column:
    """Clean every value of a map with string values."""
    return F.transform_values(_c(col), lambda k, v: clean_text(v, **kw))


def as_text(col) -> Column:
    """String form used by the length-based rules: a null reads as 'nan'."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))


def whitespace_tokens(col) -> Column:
    return F.filter(F.split(_c(col), WHITESPACE_RUN), lambda t: t != F.lit(""))


def text_length(col) -> Column:
    return F.length(_c(col)).cast("bigint")


def word_count(col) -> Column:
    return F.size(whitespace_tokens(col)).cast("bigint")


def unique_words(col) -> Column:
    return F.size(F.array_distinct(whitespace_tokens(col))).cast("bigint")


def uppercase_ratio(col) -> Column:
    c = _c(col)
    return F.length(F.regexp_replace(c, r"\P{Lu}", "")) / (F.length(c) + F.lit(1))


def concat_text(cols) -> Column:
    """Join several text columns with one space; a null contributes an empty string."""
    return F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def word_tokens(col) -> Column:
    """Tokens of two or more word characters (the TF-IDF token rule)."""
    return F.regexp_extract_all(_c(col), F.lit(WORD_TOKEN), 0)
