"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"
PII_PATTERNS = {EMAIL: "[EMAIL]", PHONE: "[PHONE]"}

# Text that every match of a pattern contains: where it is missing, a plain search
# settles the matter and the slower pattern is not tried.
PATTERN_HINTS = {EMAIL: "@"}


def redact(df: DataFrame, col: str, patterns: dict[str, str] = PII_PATTERNS) -> DataFrame:
    """Every match of every pattern replaced, in the order given, over the whole text."""
    text = F.col(col)
    for pattern, replacement in patterns.items():
        replaced = F.regexp_replace(text, pattern, replacement)
        hint = PATTERN_HINTS.get(pattern)
        text = replaced if hint is None else F.when(text.contains(hint), replaced).otherwise(text)
    return df.withColumn(col, text)


def clean_text(text: Column) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize_urls(df: DataFrame, col: str, name: str = "url_norm") -> DataFrame:
    """Scheme and host in lower case, user and password as they are; query string and fragment dropped."""
    bare = F.regexp_replace(F.col(col), r"[?#].*$", "")
    origin = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    path = F.substr(bare, F.length(origin) + 1)
    user = F.regexp_extract(origin, r"^[^/]*//([^@]*@)", 1)
    scheme = F.lower(F.regexp_extract(origin, r"^([^/]*//)", 1))
    host = F.lower(F.regexp_replace(origin, r"^[^/]*//(?:[^@]*@)?", ""))
    return df.withColumn(name, F.concat(scheme, user, host, path))
