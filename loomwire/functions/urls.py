"""Column functions on URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwire.config import TRACKING_KEYS, TRACKING_PREFIXES
from loomwire.functions.text import full, let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_PARTS = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_host(c: Column) -> Column:
    """The network location in lower case, port and user included; empty without one."""
    return F.lower(F.regexp_extract(F.trim(full(c)), _PARTS, 1))


def _decode(c: Column) -> Column:
    plus = F.replace(c, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(c), plus)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(c: Column, extra_strip: Column | None = None) -> Column:
    """One form for equal addresses: scheme and host in lower case, slashes of the path single and none at its end,
    no fragment, no ``;params`` of the last segment, no tracking, blank or ``extra_strip`` query keys. Empty when
    scheme or host is missing.
    """
    url = F.trim(full(c))
    scheme, host = F.regexp_extract(url, _SCHEME, 1), F.regexp_extract(url, _PARTS, 1)
    raw_path, query = F.regexp_extract(url, _PARTS, 2), F.regexp_extract(url, _PARTS, 3)
    path = F.regexp_replace(F.regexp_replace(raw_path, r";[^/]*$", ""), "/+", "/")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, "/+$", ""))
    extra = F.transform(F.coalesce(extra_strip, F.array().cast("array<string>")), lambda x: F.lower(x)) if extra_strip is not None else F.array().cast("array<string>")

    def pair(part: Column) -> Column:
        key = _decode(F.regexp_extract(part, "^([^=]*)", 1))
        return F.struct(key.alias("k"), _decode(F.regexp_extract(part, "^[^=]*=(.*)$", 1)).alias("v"), F.lower(key).alias("low"))

    def stays(p: Column) -> Column:
        tracked = p["low"].isin(*TRACKING_KEYS) | F.array_contains(extra, p["low"])
        for prefix in TRACKING_PREFIXES:
            tracked = tracked | F.startswith(p["low"], F.lit(prefix))
        return (p["v"] != "") & ~tracked

    kept = F.filter(F.transform(F.split(query, "&"), pair), stays)
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    out = let(joined, lambda q: F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
    return F.when((scheme == "") | (host == ""), "").otherwise(out)


def resolve(href: Column, base: Column) -> Column:
    """An anchor's target relative to its page; empty for targets that are no pages."""
    h = F.trim(full(href))
    scheme, host = F.regexp_extract(full(base), _SCHEME, 1), F.regexp_extract(full(base), _PARTS, 1)
    path = F.regexp_extract(full(base), _PARTS, 2)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(h.rlike(r"(?i)^(javascript|mailto|tel|data):") | (h == "") | F.startswith(h, F.lit("#")), "")
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, h))
        .when(F.startswith(h, F.lit("?")), F.concat(root, path, h))
        .otherwise(F.concat(root, folder, h))
    )


def host_allowed(host: Column, domains: Column) -> Column:
    """Is the host one of ``domains`` or below one; no domains allow every host."""
    one = F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return (host != "") & ((F.size(F.coalesce(domains, F.array().cast("array<string>"))) < 1) | F.coalesce(one, F.lit(False)))
