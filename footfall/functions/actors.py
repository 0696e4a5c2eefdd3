"""Who did it: the actor of an event and ids derived from a device."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.text import is_blank


def actor(user_id: str = "user_id", device_id: str = "device_id") -> Column:
    """The user, or the device where the user is blank."""
    user = F.col(user_id)
    return F.when(is_blank(user), F.col(device_id)).otherwise(user)


def user_of_device(device_id: Column) -> Column:
    """User id of an anonymous visitor: half of the hash of the device id."""
    return F.substring(F.sha2(F.lower(device_id), 256), 1, 32)


def uuid_from(text: Column) -> Column:
    """A UUID-shaped id derived from content, so that a retry gives it again."""
    digest = F.md5(text)
    parts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in parts])


def content_id(prefix: str, at: Column, *content: Column) -> Column:
    """``<prefix>_<ms>_<8 hex>``; the tail is a hash of the content.

    A random tail would change when a lost task is run again.
    """
    body = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in content])
    tail = F.substring(F.sha2(body, 256), 1, 8)
    return F.concat_ws("_", F.lit(prefix), F.unix_millis(at.cast("timestamp")).cast("string"), tail)


def request_id(*content: Column) -> Column:
    """``prv_<32 hex>`` from the content of a privacy request."""
    body = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in content])
    return F.concat(F.lit("prv_"), F.substring(F.sha2(body, 256), 1, 32))
