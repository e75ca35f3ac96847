"""The alert record: field order, information conditions, volatile fields, enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

#: The 18 fields of an alert, in shipping order.
FIELD_ORDER = (
    "attack_type", "dip", "host", "method", "rule_name", "rsp_body", "kill_chain_all", "proto", "xff", "dport",
    "rsp_status", "parameter", "sip", "rsp_header", "uri", "req_header", "req_body", "sport",
)
#: Fields that identify nothing and stay out of every content key.
VOLATILE = ("sip", "dip", "xff")
CONTENT_FIELDS = tuple(f for f in FIELD_ORDER if f not in VOLATILE)
#: Information conditions, named sets of removed columns.
CONDITIONS: dict[str, tuple[str, ...]] = {
    "a": (),
    "b": ("rule_name",),
    "c": ("rule_name", "attack_type", "kill_chain_all"),
}
ATTACK, NON_ATTACK = "Attack", "Non-Attack"
#: Rule type and label of the four sampling strata.
STRATA = ("mixed_attack", "mixed_non_attack", "single_attack", "single_non_attack")

#: Every field as text: numbers in a JSON record keep their literal text.
RECORD_AS_TEXT = T.StructType([T.StructField(f, T.StringType()) for f in FIELD_ORDER])


def fields_of(condition: str) -> list[str]:
    """Columns that a condition shows, in field order."""
    return [f for f in FIELD_ORDER if f not in CONDITIONS[condition]]
