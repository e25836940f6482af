"""Addresses: canonical form, host, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters of campaigns and referrers.
TRACKING = "ref ref_src fbclid gclid dclid msclkid igshid mc_cid mc_eid cmpid yclid spm".split()


def is_http(url: Column) -> Column:
    """Whether an address is absolute and of the web."""
    return F.coalesce(F.trim(url).rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host without www. and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^www\.", ""), r":(?:80|443)$", "")


def canonical_url(url: Column) -> Column:
    """https, bare host, single slashes, no trailing slash or amp, sorted parameters without campaigns and blanks, no fragment."""
    u = F.trim(url)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"/amp(?:\.html)?$", "/"), "/+$", "")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike(r"^(?:utm_[^=]*|" + "|".join(TRACKING) + ")="))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(F.lit("https://"), host_of(u), F.when(path == "", "/").otherwise(path), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def short_hash(text: Column, length: int = 16) -> Column:
    """First hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(text), 1, length)
