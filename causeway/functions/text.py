"""Text, URL and hash functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track, by name and by prefix.
TRACKING_KEYS = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src", "cmpid")
TRACKING_PREFIX = "utm_"
#: Endings that a keyword may carry.
SUFFIXES = ("", "s", "es", "er", "ar", "et", "en", "ing")
#: Unicode's space separators.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without the default port, query without tracking keys and sorted, no trailing slash but the root's, no fragment; null if it isn't a URL."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(host)
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    key = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+") & ~key(p).isin(*TRACKING_KEYS) & ~key(p).startswith(TRACKING_PREFIX))
    query = F.array_join(F.array_sort(kept), "&")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def collector_url(url: Column) -> Column:
    """As :func:`canonical_url`, but keeping ports, blank values and slashes; an empty path is ``/``."""
    part = lambda pattern: F.regexp_extract(url, pattern, 1)
    scheme, host, path = F.lower(part(r"^([A-Za-z][A-Za-z0-9+.-]*)://")), F.lower(part(r"^[^:/?#]+://([^/?#]*)")), part(r"^[^:/?#]+://[^/?#]*([^?#]*)")
    kept = F.filter(F.split(part(r"^[^?#]*\?([^#]*)"), "&"), lambda p: (p != "") & ~F.lower(p).startswith(TRACKING_PREFIX))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def host_section(url: Column) -> Column:
    """Host without ``www.`` and first path segment, joined by a slash; null if it isn't a URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1)), r"^www\.", "")
    first = F.lower(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*/([^/?#]*)", 1))
    return F.when(host != "", F.concat_ws("/", host, first))


def collapse(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def looks_like_page(text: Column) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(200)).rlike(r"(?i)<!doctype html|<html")


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\0"), F.coalesce(body, F.lit(""))), 256)


def tokens(text: Column) -> Column:
    """Runs of Unicode letters, digits and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def title_key(title: Column) -> Column:
    """Runs of a-z, å, ä, ö and digits in lower case, by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(title), F.lit("([a-zåäö0-9]+)"), F.lit(1)), " ")


def feature_hash(token: Column, bits: int = 60) -> Column:
    """The first bits of the token's SHA-256 as a non-negative bigint."""
    return F.conv(F.substring(F.sha2(token, 256), 1, bits // 4), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def parse_vector(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))


def haystack(text: Column) -> Column:
    """Lower case, other than word characters to spaces, padded."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), F.lit(" "))


def has_keyword(hay: Column, keyword: Column) -> Column:
    """A word with one of SUFFIXES; a phrase anywhere."""
    word = F.exists(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.contains(hay, F.concat(F.lit(" "), keyword, s, F.lit(" "))))
    return F.when(F.contains(keyword, F.lit(" ")), F.contains(hay, keyword)).otherwise(word)


def sentences(text: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and white space, or after their CJK forms; blank ones dropped."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|(?<=[。！？])"), lambda s: F.trim(s) != "")


def sentence_count(text: Column) -> Column:
    """One, and one for each ``.``, ``!`` or ``?`` before white space, once the spaces around the text are gone."""
    return F.lit(1) + F.regexp_count(F.trim(text, F.lit(SPACES)), F.lit(r"[.!?][ \t\n\f\r]+"))


def number_text(text: Column) -> Column:
    """Price as printed: spaces and signs dropped, a decimal comma read as a point."""
    return F.regexp_replace(F.regexp_replace(text, r"[^0-9,.\-]", ""), ",", ".").try_cast("double")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version 5 UUID of a name in a namespace of 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
