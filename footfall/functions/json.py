"""Expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.text import is_blank


def json_text(document: Column, key: str) -> Column:
    """Top-level value as text; null if the key is missing or JSON null."""
    return F.get_json_object(document, f"$['{key}']")


def not_bot(metadata: Column) -> Column:
    """Rows whose metadata does not carry the bot flag."""
    flag = json_text(metadata, "isBot")
    return flag.isNull() | (flag != "true")


def as_text_map(document: Column) -> Column:
    """Top-level members as text, in the order of the document."""
    return F.from_json(document, "map<string,string>")


def is_object(document: Column) -> Column:
    return F.coalesce(F.ltrim(document).startswith("{"), F.lit(False))


def with_members(document: Column, members: dict[str, Column]) -> Column:
    """JSON object with some members set; a null value sets nothing.

    The members are appended to the text.  Only where the object may already
    hold one of them is it parsed to take the old value out; what else it holds
    passes through, nested values included.  Every text is referred to once, a
    second reference would make it anew.
    """
    text = F.rtrim(F.ltrim(document))
    # A name written with escapes is not found by its text, so those count too.
    clash = text.rlike('"(' + "|".join(members) + r')"|\\u')
    taken_out = F.to_json(
        F.map_filter(
            F.from_json(text, "map<string,variant>"),
            lambda key, _: ~_any([(key == name) & value.isNotNull() for name, value in members.items()]),
        )
    )
    opened = F.regexp_replace(F.when(clash, taken_out).otherwise(text), r"\s*\}$", "")
    # Null members are left out of this object; its closing brace is kept.
    added = F.substring(F.to_json(F.struct(*[value.alias(name) for name, value in members.items()])), 2, 2**31 - 1)
    joined = F.concat(opened, F.lit(","), added)
    return F.regexp_replace(F.regexp_replace(joined, r",\}$", "}"), r"^\{\s*,", "{")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def wrapped(document: Column) -> Column:
    """The document as an object: missing becomes ``{}``, a non-object goes under ``data``."""
    return (
        F.when(is_blank(document) | (F.trim(document) == "null"), F.lit("{}"))
        .when(is_object(document), document)
        .otherwise(F.concat(F.lit('{"data":'), document, F.lit("}")))
    )
