"""Text normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space of any script, trimmed from both ends of a uid.
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def plain_form(c: Column) -> Column:
    """Letters and digits (categories L and N) in lower case, all else removed. Null stays null."""
    return F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}]+", "")


def uid_form(c: Column) -> Column:
    """A uid in lower case without surrounding white space. Null stays null."""
    return F.regexp_replace(F.lower(c), _EDGE_SPACE, "")


def label_form(c: Column) -> Column:
    """Attack / Non-Attack whatever the spelling; anything else becomes null."""
    p = plain_form(c)
    return F.when(p == "attack", "Attack").when(p == "nonattack", "Non-Attack")


def record_words(c: Column) -> Column:
    """Distinct maximal runs of letters and digits, lower case, as an array. Null gives an empty array."""
    tokens = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(tokens, lambda w: w != ""))
