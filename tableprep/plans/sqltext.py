"""SQL text builders for the DuckDB oracle (the independent check of each query).

DuckDB's regular expressions are RE2: ``.`` stops only at ``\\n`` and ``\\s``/``\\w`` are
ASCII, which is what the Spark side reproduces with ``(?d)``/``(?U)`` on this data.
"""

from __future__ import annotations


def clean_text_sql(expr: str) -> str:
    e = f"lower({expr})"
    e = f"regexp_replace({e}, '<.*?>', ' ', 'g')"
    e = f"regexp_replace({e}, 'http\\S+|www\\S+', ' ', 'g')"
    e = f"regexp_replace({e}, '[^a-zA-Z0-9\\s]', ' ', 'g')"
    e = f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
    return e


def numeric_text_sql(expr: str) -> str:
    pat = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
    return (f"CASE WHEN regexp_full_match({expr}, '{pat}') AND NOT isnan(TRY_CAST(trim({expr}) AS DOUBLE)) "
            f"THEN TRY_CAST(trim({expr}) AS DOUBLE) END")


def tokens_sql(expr: str) -> str:
    """Whitespace tokens without empty strings."""
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda x: x <> '')"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


def tokens_re_sql(expr: str) -> str:
    """Word tokens of 2+ word characters."""
    return f"regexp_extract_all({expr}, '\\b\\w\\w+\\b')"


def terms_from_tokens_sql(col: str, ngrams: int = 2) -> str:
    """Tokens plus (for ngrams=2) adjacent pairs joined by a space, from a token-list column
    (tokenize once in an earlier CTE: a lambda would otherwise re-evaluate the extraction)."""
    if ngrams < 2:
        return col
    return f"list_concat({col}, list_transform(range(1, len({col})), lambda i: {col}[i] || ' ' || {col}[i + 1]))"


def sig10(expr: str, digits: int = 10) -> str:
    """Round to 10 (or ``digits``) significant digits (same arithmetic as the Spark side)."""
    p = f"pow(10.0, floor(log10(abs({expr}))))"
    return f"CASE WHEN ({expr}) = 0 THEN 0.0 ELSE round(({expr}) / {p}, {digits - 1}) * {p} END"
