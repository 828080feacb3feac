"""Addresses: safety, site rules, clean-up of lists, addresses in text and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.clean import let


def is_safe(c: Column) -> Column:
    """Whether an address is plain http(s) with a host; false for null."""
    return F.coalesce(F.btrim(c).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def in_text(c: Column) -> Column:
    """All http(s) addresses in a text, without trailing punctuation, each once, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)(https?://[^\s\"'<>)\]}]+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


# Rules of sites.
NO_WWW = ["x.com", "twitter.com", "onlyfans.com", "fansly.com", "xhamster.com"]
WITH_WWW = ["instagram.com", "pornhub.com", "xvideos.com"]
ALIASES = {"twitter.com": "x.com"}
LOWER_PATH = ["onlyfans.com", "instagram.com"]
HTTP_ONLY = ["bustybuffy.com", "www.bustybuffy.com"]
PATH_PREFIXES = [("eastcoasttalents.com", "/site/talent/", "/talent/")]
PATH_SUFFIXES = [("fansly.com", "/posts")]
KEEP_SLASH = ["adultfilmdatabase.com", "www.adultfilmdatabase.com"]


def known_domains() -> list[str]:
    plain = {*NO_WWW, *WITH_WWW, *ALIASES, *LOWER_PATH, *HTTP_ONLY, *KEEP_SLASH, *(d for d, _, _ in PATH_PREFIXES), *(d for d, _ in PATH_SUFFIXES)}
    return sorted(plain | {f"www.{d}" for d in plain if not d.startswith("www.")})


def by_site_rules(url: Column) -> Column:
    """An address as its site writes it -> struct(url, domain, known); fragments go, the query stays."""
    rx = r"^(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"

    def parts(u: Column) -> Column:
        return F.struct(*[F.regexp_extract(u, rx, i).alias(n) for i, n in ((2, "host"), (3, "path"), (4, "query"))])

    def domain_of(host: Column) -> Column:
        bare = F.regexp_replace(host, r"^www\.", "")
        d = F.when(bare.isin(NO_WWW), bare).when(host.isin(WITH_WWW), F.concat(F.lit("www."), host)).otherwise(host)
        for old, new in ALIASES.items():
            d = F.when(d == old, new).otherwise(d)
        return d

    def ruled(p: Column) -> Column:
        host = F.lower(p["host"])
        return let(F.struct(host.alias("host"), domain_of(host).alias("domain"), p["path"].alias("path"), p["query"].alias("query")), finished)

    def finished(p: Column) -> Column:
        path = p["path"]
        for d, old, new in PATH_PREFIXES:
            path = F.when((p["domain"] == d) & path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 10_000))).otherwise(path)
        for d, suffix in PATH_SUFFIXES:
            path = F.when((p["domain"] == d) & path.endswith(suffix), F.regexp_replace(path, suffix + "$", "")).otherwise(path)
        path = F.when(p["domain"].isin(KEEP_SLASH), path).otherwise(F.regexp_replace(path, "/+$", ""))
        path = F.when(F.regexp_replace(p["domain"], r"^www\.", "").isin(LOWER_PATH), F.lower(path)).otherwise(path)
        scheme = F.when(p["host"].isin(HTTP_ONLY), "http").otherwise("https")
        query = F.when(p["query"] == "?", "").otherwise(p["query"])
        return F.struct(F.concat(scheme, F.lit("://"), p["domain"], path, query).alias("url"), p["domain"].alias("domain"), p["domain"].isin(known_domains()).alias("known"))

    schemed = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return let(let(schemed, parts), ruled)


def mixed_case(url: Column) -> Column:
    """Whether the path of an address has letters of both cases."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)", 1)
    return (path != F.lower(path)) & (path != F.upper(path))
