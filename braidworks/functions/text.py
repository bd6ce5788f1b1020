"""Mentions, links and shortened links of post texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of links and mentions, and the short links' prefix and length.
LINK = "(?:http://|https://)(?:[a-zA-Z0-9_!~*'().&=+$%-]+)"
MENTION = "@([a-zA-Z0-9_-]+)"
SHORT_PREFIX = "http://short-url/"
SHORT_LENGTH = 10


def links(text: Column) -> Column:
    """SN03: all links, in order. A link ends at the first slash, colon or question mark of its host part."""
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(0))


def mentions(text: Column) -> Column:
    """SN05: mentioned names without their @, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def short_link(link: Column, salt: Column) -> Column:
    """SN07: a short link made from a hash of the link and a salt, so that a test can repeat it."""
    return F.concat(F.lit(SHORT_PREFIX), F.substring(F.sha2(F.concat_ws("|", link, salt.cast("string")), 256), 1, SHORT_LENGTH))


def with_short_links(text: Column, short: Column) -> Column:
    """SN04: the i-th link replaced by the i-th short one; all other text stays."""
    parts = F.split(text, LINK, -1)
    return F.array_join(F.zip_with(parts, short, lambda part, s: F.concat(part, F.coalesce(s, F.lit("")))), "")


def media_type(filename: Column) -> Column:
    """FE06: what follows the last dot of a file's name."""
    return F.element_at(F.split(filename, "\\."), -1)


def media_id(request_id: Column) -> Column:
    """FE06: the first 15 hex digits of a request's id as a number."""
    return F.conv(F.substring(request_id, 1, 15), 16, 10).cast("long")
