"""Expressions over request headers: addresses, bots, referrers, visitors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from footfall.functions.actors import uuid_from
from footfall.functions.text import is_blank, is_uuid, none_if_blank, strip_ends

# Parts of a lower-cased user agent that mark an automated
# client.  Longer names on the usual lists contain one of these.
BOT_MARKS = ("bot", "spider", "crawler", "slurp", "sogou", "ia_archiver")


def is_bot(user_agent: Column) -> Column:
    return F.coalesce(F.lower(user_agent).rlike("|".join(BOT_MARKS)), F.lit(False))


def client_ip(forwarded_for: Column, remote_addr: Column) -> Column:
    """First forwarded address, else the peer address."""
    first = F.when(forwarded_for.startswith(","), forwarded_for).otherwise(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.when(is_blank(forwarded_for), remote_addr).otherwise(strip_ends(first))


def resolved_referrer(body: Column, header: Column) -> Column:
    """Referrer of the item, else of the request header."""
    return F.coalesce(strip_ends(none_if_blank(body)), strip_ends(none_if_blank(header)))


def visitor_id(cookie: Column, *request: Column) -> Column:
    """Device id from the visitor cookie, else one derived from the request."""
    seed = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in request])
    return F.when(is_uuid(cookie), F.lower(cookie)).otherwise(uuid_from(seed))


def mask_ip(ip: Column) -> Column:
    """Address with its host part hidden, for access logs."""
    hextets = F.filter(F.split(ip, ":"), lambda part: ~is_blank(part))
    v6 = F.when(
        F.size(hextets) >= 2,
        F.concat(F.get(hextets, F.lit(0)), F.lit(":"), F.get(hextets, F.lit(1)), F.lit(":***")),
    ).otherwise(F.lit("***"))
    octets = F.split(F.regexp_replace(ip, r"\.+$", ""), r"\.")
    v4 = F.when(
        F.size(octets) == 4,
        F.concat(F.concat_ws(".", F.slice(octets, 1, 3)), F.lit(".***")),
    ).otherwise(F.lit("***"))
    return F.when(is_blank(ip), F.lit("-")).when(ip.contains(":"), v6).otherwise(v4)
