"""Contact details and money as text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_phone(text: Column) -> Column:
    """Ten digits from 07, from any of the usual spellings; null if it is no such number."""
    bare = F.regexp_replace(text, r"[\s\-()]", "")
    local = F.when(bare.rlike(r"^\+962"), F.concat(F.lit("0"), F.substring(bare, 5, 20))).when(bare.rlike("^00962"), F.concat(F.lit("0"), F.substring(bare, 6, 20))).when(bare.rlike("^962"), F.concat(F.lit("0"), F.substring(bare, 4, 20))).otherwise(bare)
    return F.when(local.rlike("^07[0-9]{8}$"), local)


def social_url(text: Column, host: str) -> Column:
    """The address if it is https on ``host`` (or its www) with a path; else null."""
    return F.when(text.rlike(rf"^https://(www\.)?{host.replace('.', chr(92) + '.')}/[^\s]+$"), text)


def money(amount: Column, currency: str = "JOD") -> Column:
    return F.format_string(f"%.2f {currency}", amount.cast("double"))


def age_days(then: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def path_quoted(text: Column) -> Column:
    """Percent-encoded for a path: a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def path_unquoted(text: Column) -> Column:
    """Percent-decoded; a plus sign in a path is itself."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def pseudonym(text: Column, key: bytes) -> Column:
    """HMAC-SHA-256 of the text as hex: the same for the same text, and not to be undone without the key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def html_escaped(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def compact_stamp(at: Column) -> Column:
    """A time for file names, in UTC sessions."""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def stored_attributes(text: Column) -> Column:
    """The attributes column as stored: JSON text to a map; null if it is no object of texts."""
    return F.from_json(text, "map<string,string>")
