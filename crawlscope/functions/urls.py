"""URL columns. Split by pattern rather than by a parser, so that odd characters never lose a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscope.constants import WHITESPACE

# The generic URI syntax: scheme, authority, path, query, fragment.
URL_PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.btrim(url, F.lit(WHITESPACE)), URL_PATTERN, group)


def authority(url: Column) -> Column:
    return F.lower(_part(url, _AUTHORITY))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


# Host without www and path without parameters and trailing slashes, in one match.
_CANONICAL = (
    r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://(?:[wW]{3}\.)?([^/?#]*))?([^?#]*?)/*(?:;[^/?#]*)?(?:[?#][\s\S]*)?$"
)
_SEPARATOR = "\x01"


def _host_and_path(url: Column) -> Column:
    trimmed = F.btrim(url, F.lit(WHITESPACE))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("")).otherwise(
        F.regexp_replace(trimmed, _CANONICAL, f"$1{_SEPARATOR}$2")
    )


def _canonical(parts: Column) -> Column:
    host, path = F.substring_index(parts, _SEPARATOR, 1), F.substring_index(parts, _SEPARATOR, -1)
    joined = F.concat(F.lower(host), F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(parts == "", F.lit("")).otherwise(joined)


def canonical_url(url: Column) -> Column:
    """host/path under which one page is known to every source; '' when there is no url."""
    return _canonical(_host_and_path(url))


def canonical_urls(urls: Column) -> Column:
    """The same for a list of urls, in two steps so that each url is matched once."""
    return F.transform(F.transform(urls, _host_and_path), _canonical)


def normalize_url(url: Column) -> Column:
    """The url without fragment and without trailing slashes; scheme and query stay."""
    scheme, host, query = F.lower(_part(url, _SCHEME)), _part(url, _AUTHORITY), _part(url, _QUERY)
    path = F.regexp_replace(_part(url, _PATH), r"/+$", "")
    return F.concat(
        F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":"))),
        F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("//"), host)),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def domain_of(url: Column, keep_port: bool = False) -> Column:
    """Lower-case host without www. Listings keep a port, link sources drop it."""
    host = authority(url)
    if not keep_port:
        host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    return without_www(host)


def same_site(url: Column, other: Column) -> Column:
    return F.replace(_part(url, _AUTHORITY), F.lit("www."), F.lit("")) == F.replace(
        _part(other, _AUTHORITY), F.lit("www."), F.lit("")
    )


def top_level_domain(domain: Column) -> Column:
    return F.when(domain.contains("."), F.lower(F.substring_index(domain, ".", -1))).otherwise(F.lit(""))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)
