"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words without discriminating power, least length of a term, prefix that makes two terms one.
STOPWORDS = [
    "the", "and", "for", "are", "was", "were", "our", "your", "their", "its",
    "what", "which", "who", "whom", "whose", "when", "where", "why", "how",
    "does", "did", "can", "could", "would", "should", "will", "shall",
    "have", "has", "had", "been", "being", "with", "from", "into", "that",
    "this", "these", "those", "there", "here", "any", "all", "you", "yours",
    "about", "tell", "give", "show", "list", "please", "need", "want",
    "company", "companies", "organisation", "organization", "business",
]
LEAST_TERM, SHARED_PREFIX = 3, 5
# Characters that are folded before values are compared.
DASHES, SINGLE_QUOTES, DOUBLE_QUOTES = "‐‑‒–—―−", "‘’‛′", "“”″"


_FOLDS = str.maketrans(dict.fromkeys(DASHES, "-") | dict.fromkeys(SINGLE_QUOTES, "'") | dict.fromkeys(DOUBLE_QUOTES, '"'))


def fold_value(value: str) -> str:
    """Comparison key of a value: NFKC, folded dashes, quotes and white space, casefold."""
    return " ".join(unicodedata.normalize("NFKC", value).translate(_FOLDS).split()).casefold()


@F.pandas_udf(StringType())
def normalize_value(values: pd.Series) -> pd.Series:
    """fold_value() of a column. (No built-in does NFKC.)"""
    return values.map(fold_value, na_action="ignore")


def strip(x: Column) -> Column:
    """Without the white space of any script at both ends. (trim() takes blanks alone.)"""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def normalize_name(x: Column) -> Column:
    """Lower case, one blank for white space, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(x, r"\s+", " ")))


def normalize_term(x: Column) -> Column:
    """As normalize_name, dashes and underscores being blanks."""
    return normalize_name(F.translate(x, "-_", "  "))


def slugify(name: Column) -> Column:
    """A bucket-safe file name of at most 128 characters; `file` where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(name), r"^\s+|\s+$", ""), r"\s+", "-")
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9._-]", ""), "-+", "-")
    x = F.regexp_replace(x, r"^[-._]+|[-._]+$", "")
    return F.substring(F.when(x == "", "file").otherwise(x), 1, 128)


def storage_key(origin: Column, source: Column, version: Column, leaf: Column) -> Column:
    return F.concat_ws("/", origin, source, version, slugify(leaf))


def terms(text: Column) -> Column:
    """Distinct content terms of a text, sorted."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-zA-Z]+"), lambda x: F.length(x) >= LEAST_TERM)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS))))


def singular(term: Column) -> Column:
    n = F.length(term)
    return F.when(term.endswith("ies") & (n > 4), F.concat(term.substr(F.lit(1), n - 3), F.lit("y"))).when(term.endswith("s") & (n > 3), term.substr(F.lit(1), n - 1)).otherwise(term)


def same_term(a: Column, b: Column) -> Column:
    """Equal singulars, or a common prefix of SHARED_PREFIX."""
    a, b = singular(a), singular(b)
    long = (F.length(a) >= SHARED_PREFIX) & (F.length(b) >= SHARED_PREFIX)
    return (a == b) | (long & (F.substring(a, 1, SHARED_PREFIX) == F.substring(b, 1, SHARED_PREFIX)))


def any_term_matches(query: Column, facts: Column) -> Column:
    return F.exists(query, lambda q: F.exists(facts, lambda f: same_term(q, f)))


def duration(seconds: Column) -> Column:
    """A number of seconds in words: in the largest of days, hours and minutes that divides it, else in seconds; one of a
    unit is the unit's name alone.
    """
    out = F.concat(seconds.cast("string"), F.lit(" seconds"))
    for size, name in ((60, "minute"), (3600, "hour"), (86400, "day")):
        n = F.floor(seconds / size)
        out = F.when(seconds % size == 0, F.when(n == 1, name).otherwise(F.concat(n.cast("string"), F.lit(f" {name}s")))).otherwise(out)
    return out


def capitals(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))


def strip_code_fence(x: Column) -> Column:
    """The inside of a text that begins with a fence: without its first line, and without a last line that is a fence; else
    the text itself. No white space at both ends.
    """
    strip = lambda y: F.regexp_replace(y, r"^\s+|\s+$", "")
    inside = F.regexp_replace(F.regexp_replace(strip(x), r"^```[^\n]*\n?", ""), r"(^|\n)```[^\n]*$", "")
    return F.when(strip(x).startswith("```"), strip(inside)).otherwise(strip(x))


def cooldown_seconds(message: Column) -> Column:
    """Seconds of the first `6m33.5s`, `2m` or `12.5s` in an error message."""
    found = F.regexp_extract(message, r"(?:^|[\s,])((?:\d+(?:\.\d+)?m)?\d+(?:\.\d+)?s|\d+(?:\.\d+)?m)\.?(?=[\s,]|$)", 1)
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(found, rf"(\d+(?:\.\d+)?){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(found != "", part("m") * 60 + part("s"))


# Markers of errors that repeat, and of throttling.
DETERMINISTIC_MARKERS, THROTTLED_MARKERS = ["json_validate_failed", "context_length", "too large"], ["429", "rate_limit", "rate limit"]


def error_class(message: Column) -> Column:
    """deterministic, rate_limited or other; the first wins."""
    low = F.lower(message)
    has = lambda marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))
    return F.when(has(DETERMINISTIC_MARKERS), "deterministic").when(has(THROTTLED_MARKERS), "rate_limited").otherwise("other")


def value_type(x: Column) -> Column:
    """boolean, number or string of a value given as text."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "false"), "boolean").when(low.try_cast("double").isNotNull(), "number").otherwise("string")


def confidence_tier(x: Column) -> Column:
    """HIGH, MEDIUM or LOW of a confidence that is clamped to 0..1."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(c >= 0.8, "HIGH").when(c >= 0.5, "MEDIUM").otherwise("LOW")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no slash at the end (but for the root), the query kept, the fragment dropped."""
    part = lambda p: F.coalesce(F.try_parse_url(url, F.lit(p)), F.lit(""))
    path = F.regexp_replace(part("PATH"), "/+$", "")
    query = F.when(part("QUERY") == "", "").otherwise(F.concat(F.lit("?"), part("QUERY")))
    return F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.lower(F.concat(part("HOST"))), F.when(path == "", "/").otherwise(path), query)


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of tokens: a start s beyond the first is kept if s + overlap lies before the end."""
    n = F.size(tokens)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, size))
