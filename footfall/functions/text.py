"""Text expressions: blanks, trimming, field checks and name clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed patterns of the accepted inputs.
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SOURCE_PATTERN = "^[A-Z0-9_-]{1,32}$"
DEFAULT_SOURCE = "APP_SETTINGS"


def is_blank(value: Column) -> Column:
    """Null, empty or white space only."""
    return value.isNull() | value.rlike(r"^\p{javaWhitespace}*$")


def none_if_blank(value: Column) -> Column:
    return F.when(~is_blank(value), value)


def strip_ends(value: Column) -> Column:
    """Remove control characters and spaces from both ends."""
    return F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def trim_to_null(value: Column) -> Column:
    return F.nullif(strip_ends(value), F.lit(""))


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(UUID_PATTERN), F.lit(False))


def project_id(value: Column) -> Column:
    """Project id without white space, space separators and format characters."""
    return F.regexp_replace(value, r"[\p{javaWhitespace}\p{javaSpaceChar}\p{Cf}]", "")


def metric_type(value: Column) -> Column:
    """Snake-case name of a metric type; empty if nothing is left.

    A capital after any letter starts a new word, so ``pageView`` becomes
    ``page_view`` and ``URL`` becomes ``u_r_l``.
    """
    words = F.regexp_replace(
        strip_ends(value),
        r"(?<=[\p{javaUpperCase}\p{javaLowerCase}\p{Lt}])(?=\p{javaUpperCase})",
        "_",
    )
    joined = F.lower(F.regexp_replace(words, "[-_ ]+", "_"))
    bare = F.regexp_replace(joined, "^_+|_+$", "")
    return F.coalesce(F.regexp_replace(bare, "^pageview$", "page_view"), F.lit(""))


def no_metric_type(value: Column) -> Column:
    """The metric type is missing or made of separators only."""
    return value.isNull() | strip_ends(value).rlike("^[-_ ]*$")


def metric_type_too_long(value: Column, size: int) -> Column:
    """Over-long after clean-up, which at most doubles the length."""
    return (F.length(value) * 2 > size) & longer_than(metric_type(value), size)


def privacy_source(value: Column) -> Column:
    """Upper-case source with its default; a malformed one gives null."""
    upper = F.upper(strip_ends(value))
    return (
        F.when(is_blank(value), F.lit(DEFAULT_SOURCE)).when(upper.rlike(SOURCE_PATTERN), upper)
    )


def longer_than(value: Column, size: int) -> Column:
    return F.coalesce(F.length(value) > size, F.lit(False))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that fails, null if all pass."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks])


def landing_checks(items: DataFrame) -> list[tuple[Column, str]]:
    """Checks of items that come from landed records; none for other items."""
    names = ("malformed_record", "empty_items", "null_item")
    return [(F.col("landed") == name, name) for name in names] if "landed" in items.columns else []
