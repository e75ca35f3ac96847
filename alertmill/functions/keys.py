"""Content keys, ids and the texts shown to models."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CONTENT_FIELDS


def serial(columns: list[str]) -> Column:
    """An injective text of several columns: length and value of each, null marked apart. A plain concat_ws would not be."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    return F.concat_ws(";", *[part(c) for c in columns])


def content_key(columns: tuple[str, ...] = CONTENT_FIELDS) -> Column:
    """sha256 of all content fields in name order; label and volatile fields stay out."""
    return F.sha2(serial(sorted(columns)), 256)


def short_uid(key: Column) -> Column:
    return F.substring(key, 1, 16)


def call_id(*parts: Column) -> Column:
    """One call: model, condition, uid, hashes of system text, user text and parameters, in the order given."""
    return F.sha2(F.concat_ws("|", *parts), 256)


@F.pandas_udf(T.StringType())
def canonical_json(record: pd.DataFrame) -> pd.Series:
    """Python's canonical JSON of a struct: sorted keys, non-ASCII kept."""
    return pd.Series([json.dumps(_plain(r), sort_keys=True, ensure_ascii=False) for r in record.astype(object).to_dict("records")])


@F.pandas_udf(T.StringType())
def indented_json(record: pd.DataFrame) -> pd.Series:
    """A struct as two-space-indented JSON in field order, as prompts show it."""
    return pd.Series([json.dumps(_plain(r), indent=2, ensure_ascii=False) for r in record.astype(object).to_dict("records")])


def _plain(record: dict) -> dict:
    """Nulls come out of Arrow as NaN beside integers that became floats."""
    out = {}
    for k, v in record.items():
        if v is None or v != v:
            out[k] = None
        elif isinstance(v, float) and v.is_integer():
            out[k] = int(v)
        else:
            out[k] = v if isinstance(v, str) else int(v)
    return out


def messages(system: str, header: str, fields: list[str]) -> Column:
    """The message list of a call: system text, then header and the shown fields as indented JSON."""
    user = F.concat(F.lit(header), indented_json(F.struct(*fields)))
    m = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(m("system", F.lit(system)), m("user", user))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def classifier_text(fields: list[str], dtypes: dict[str, str]) -> Column:
    """Fields as lines in order: null as empty, numbers as digits, composed, line ends unified, lower case. Booleans raise."""
    bad = [f for f in fields if dtypes[f] == "boolean"]
    if bad:
        raise TypeError(f"boolean fields in a record: {bad}")
    joined = F.concat_ws("\n", *[F.replace(F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")) for f in fields])
    return F.lower(nfc(joined))


_MONTHS = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATES = "|".join((
    r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}",
    rf"[0-9]{{1,2}}(st|nd|rd|th)?[ -]+{_MONTHS}[ ,-]+[0-9]{{4}}", rf"{_MONTHS} +[0-9]{{1,2}}(st|nd|rd|th)?,? +[0-9]{{4}}", "todays?", "dated?", "dates",
))
#: A date in figures or words, or a word that asks for one, that no letter or digit touches; the same text in RE2 and Java.
DATE_PATTERN = f"(?i)(^|[^a-z0-9])({_DATES})([^a-z0-9]|$)"
#: The forms of the current day that a prompt template may insert.
DATE_FORMS = ("dd MMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "MMMM dd, yyyy", "dd MMMM yyyy")


def mentions_date(c: Column) -> Column:
    """Whether a text holds a date or asks for one."""
    return c.rlike(DATE_PATTERN)


def date_texts(d: Column) -> Column:
    """A day in every form that a template may insert."""
    return F.array(*[F.date_format(d, f) for f in DATE_FORMS])


def settings_hash(settings: dict) -> str:
    """sha256 of settings (call parameters, a run's configuration) as canonical JSON: the order of the keys does not count."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
