"""Redaction and hashing of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"

# The sensitive patterns, applied in this order, ignoring case.
SENSITIVE_PATTERNS = (
    r'password["\s]*[:=]["\s]*[^"\s,}]+',
    r'api[_-]?key["\s]*[:=]["\s]*[^"\s,}]+',
    r'secret["\s]*[:=]["\s]*[^"\s,}]+',
    r'token["\s]*[:=]["\s]*[^"\s,}]+',
    r'bearer\s+[a-zA-Z0-9\-_]+',
    r'\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b',
    r'\b\d{3}-\d{2}-\d{4}\b',
)

# Name parts that mark a field as sensitive.
SENSITIVE_NAMES = ("password", "secret", "key", "token", "credential", "ssn", "credit_card")


def redact(col: Column) -> Column:
    """Mask every sensitive pattern in the whole text.

    Case, spaces, digits and word edges follow Unicode (the ``iuU`` flags). Texts
    that no pattern matches, the most, are tested once and left as they are.
    """
    whole, some = col, "(?iuU)" + "|".join(f"(?:{p})" for p in SENSITIVE_PATTERNS)
    for pattern in SENSITIVE_PATTERNS:
        col = F.regexp_replace(col, F.lit("(?iuU)" + pattern), F.lit(MASK))
    return F.when(whole.rlike(some), col).otherwise(whole)


def is_sensitive_name(name: str | Column, parts: Sequence[str] = SENSITIVE_NAMES):
    if isinstance(name, str):
        return any(p in name.lower() for p in parts)
    return F.lower(name).rlike("|".join(parts))


def shorten(col: Column, limit: int = 100) -> Column:
    """Texts over ``limit`` characters are shown as their start and three dots."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 3), F.lit("..."))).otherwise(col)


def mask_map(col: Column, parts: Sequence[str] = SENSITIVE_NAMES, limit: int = 100) -> Column:
    return F.transform_values(
        col, lambda k, v: F.when(is_sensitive_name(k, parts), MASK).otherwise(shorten(v, limit)))


def pseudonym(col: Column, salt: str) -> Column:
    return F.sha2(F.concat(col.cast("string"), F.lit(salt)), 256)


def stable_key(cols: Sequence[Column]) -> Column:
    """Key over several fields that keeps null apart from empty text."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("<null>")) for c in cols]))


def json_text(col: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(col, r'(["\\])', r"\\$1"), F.lit('"'))


def config_signature(model_type: Column, hyperparameters: Column, features: Column) -> Column:
    """First 16 hex digits of the md5 of the sorted JSON of a configuration.

    ``hyperparameters`` is a map of numbers, ``features`` an array of names.
    """
    sep = F.lit(", ")
    entries = F.array_sort(F.map_entries(hyperparameters))
    pairs = F.transform(entries, lambda e: F.concat(
        F.lit("["), json_text(e["key"]), sep, e["value"].cast("string"), F.lit("]")))
    names = F.transform(F.array_sort(features), json_text)
    text = F.concat(
        F.lit('{"feature_columns": ['), F.array_join(names, ", "),
        F.lit('], "hyperparameters": ['), F.array_join(pairs, ", "),
        F.lit('], "model_type": '), json_text(model_type), F.lit("}"))
    return F.substring(F.md5(text), 1, 16)


def hash_bucket(cols: Sequence[Column], buckets: int) -> Column:
    """Repeatable bucket 0..buckets-1 from the md5 of the key fields."""
    return F.pmod(hash60(cols), F.lit(buckets)).cast("int")


def hash60(cols: Sequence[Column]) -> Column:
    """Repeatable 60-bit number from the md5 of the key fields."""
    return F.conv(F.substring(stable_key(cols), 1, 15), 16, 10).cast("long")
