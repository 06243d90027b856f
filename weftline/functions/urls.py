"""URL columns: canonical form, host, and the path that robots rules see.  All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Query keys that only track.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "_ga"]

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
_BAD_URL = r"[\x00-\x1F\x7F]|^[^?#]*" + _BAD_ESCAPE + r"|#.*" + _BAD_ESCAPE + r"|^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[ <>\"]|^:|^[0-9+.-][A-Za-z0-9+.-]*:"
_KEPT_PATH = r"^([A-Za-z0-9_.~$&+,/:;=@!'()*\[\]-]|%[0-9A-Fa-f]{2})*$"


def query_escape(text: Column) -> Column:
    """Form encoding that keeps ``~`` and encodes ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def path_escape(text: Column) -> Column:
    """Percent-encoding of a path: reserved characters other than ``?`` stay."""
    out = query_escape(text)
    for code, char in (("+", "%20"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","), ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def path_decode(path: Column) -> Column:
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _pairs(query: Column) -> Column:
    """Decoded (key, value) pairs of a raw query; pairs that can't be decoded or hold a semicolon are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        key = F.when(at > 0, F.substring(p, F.lit(1), at - 1)).otherwise(p)
        value = F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(F.try_url_decode(key).alias("k"), F.try_url_decode(value).alias("v"))

    return F.filter(F.transform(parts, pair), lambda x: x["k"].isNotNull() & x["v"].isNotNull())


def normalize_url(url: Column) -> Column:
    """The canonical form by which results are merged; what can't be parsed stays as it is."""
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    scheme, authority, path, query = F.lower(part(1)), part(2), part(3), part(4)
    at = F.length(F.regexp_extract(authority, "^(.*@)", 1))
    authority = F.concat(F.substring(authority, F.lit(1), at), F.lower(F.substring(authority, at + 1, F.length(authority))))
    decoded = path_decode(path)
    trimmed = F.regexp_replace(decoded, "/+$", "")
    raw_kept = (trimmed == decoded) & path.rlike(_KEPT_PATH)
    new_path = F.when(trimmed == "", F.lit("/")).when(raw_kept, path).otherwise(path_escape(trimmed))
    kept = F.filter(_pairs(F.substring(query, F.lit(2), F.length(query))), lambda x: ~x["k"].isin(TRACKING_KEYS))
    # pairs with one key keep their order: sort by (bytes of the key, place)
    placed = F.transform(kept, lambda x, i: F.struct(F.hex(x["k"]).alias("h"), i.alias("i"), x["k"].alias("k"), x["v"].alias("v")))
    encoded = F.array_join(F.transform(F.array_sort(placed), lambda x: F.concat(query_escape(x["k"]), F.lit("="), query_escape(x["v"]))), "&")
    mark = F.when((encoded != "") | (query == "?"), F.concat(F.lit("?"), encoded)).otherwise(F.lit(""))
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), F.when(F.contains(url, F.lit("//")) & ((part(2) != "") | url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:///")), F.concat(F.lit("//"), authority)).otherwise(F.lit("")))
    return F.when(url.rlike(_BAD_URL) | decoded.isNull(), url).otherwise(F.concat(head, new_path, mark))


def url_host(url: Column) -> Column:
    """Host in lower case without port; empty where there is none or the URL can't be parsed."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(url.rlike(_BAD_URL), F.lit("")).otherwise(F.regexp_replace(host, r"^\[|\]$", ""))


def robots_path(url: Column) -> Column:
    """Decoded path (``/`` if empty), then ``?`` and the raw query if there is one."""
    path = F.coalesce(path_decode(F.regexp_extract(url, _PARTS, 3)), F.lit(""))
    query = F.regexp_extract(url, _PARTS, 4)
    return F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.when(F.length(query) > 1, query).otherwise(F.lit("")))


def host_matches(host: Column, patterns: list[str]) -> Column:
    """Whether the host is one of the patterns or a subdomain of one."""
    clean = [p.strip().lower() for p in patterns if p.strip()]
    if not clean:
        return F.lit(False)
    return F.exists(F.array(*[F.lit(p) for p in clean]), lambda p: (host == p) | F.endswith(host, F.concat(F.lit("."), p)))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, so that suffix rules become an equi-join."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
