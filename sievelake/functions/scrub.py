"""Contacts out of raw payloads: every string of a JSON document of any depth, each by itself, with the structure as it was."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.text import mask_emails, mask_phones

#: A JSON text as string literals (with the colon after a key) and what stands between them.
_PARTS = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?|[^"]++'


def without_contacts(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")) | text.rlike(r"\d[^\n]*\d"), mask_phones(mask_emails(text))).otherwise(text)


def _value(literal: Column) -> Column:
    """A string literal with its contacts masked: read, cleaned and written again, so that escaped characters don't hide any. A web address stays whole."""
    read = F.get_json_object(F.concat(F.lit("["), literal, F.lit("]")), "$[0]")
    clean = F.when(read.rlike(r"(?i)^https?://\S+$"), read).otherwise(without_contacts(read))
    return F.when(clean == read, literal).otherwise(F.regexp_replace(F.to_json(F.array(clean)), r"(?s)^\[(.*)\]$", "$1"))


def scrubbed(payload: Column) -> Column:
    """A payload without contacts: of JSON, each string value apart (keys, numbers and addresses stay, so ids are not taken for phones); else the whole text.

    The text is cut into literals once, so any depth costs the same; null stays null."""
    parts = F.regexp_extract_all(payload, F.lit(_PARTS), 0)
    is_value = lambda p: p.startswith('"') & p.endswith('"')
    clean = F.array_join(F.transform(parts, lambda p: F.when(is_value(p), F.coalesce(_value(p), p)).otherwise(p)), "")
    return F.when(F.try_parse_json(payload).isNotNull(), clean).otherwise(without_contacts(payload))
