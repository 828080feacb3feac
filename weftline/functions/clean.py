"""Column expressions that bring ids, hashes and addresses to one notation.

All are built-in JVM expressions; each returns null for null, blank and stand-in input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written in place of "nothing".
STAND_INS = ["", "-", "--", "?", "0", "n/a", "na", "nil", "nan", "none", "null", "unknown", "undefined", "tba", "tbd", "n.a.", "not listed", "00000000-0000-0000-0000-000000000000", "00000000000000000000000000000000"]

# Query parameters that name the referrer, not the page.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "referrer", "referer", "aff", "affiliate", "affiliate_id", "partner", "partnerid", "nats", "ats", "utm_reader", "trk"]

BLANKS = " \t\r\n ​　﻿"


def stripped(c: Column) -> Column:
    """Without blanks of any kind at either end; null where nothing is left."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def nullish(c: Column, words: list[str] = STAND_INS) -> Column:
    return let(stripped(c), lambda s: F.when(~F.lower(s).isin(words), s))


def int_id(c: Column) -> Column:
    """Ids of digits however they are written ("#17", " 17", "17.0", "0017"); others in lower case."""

    def digits(s: Column) -> Column:
        return let(F.regexp_extract(s, r"^(?:[a-z]*[#:])?\s*0*([0-9]+)(?:\.0+)?$", 1), lambda d: F.when(d != "", F.when(d != "0", d)).otherwise(s))

    return F.when(c.rlike(r"^[1-9][0-9]*\z"), c).otherwise(let(F.lower(nullish(c)), digits))


def uuid_id(c: Column) -> Column:
    """UUIDs in any notation (case, braces, urn:uuid:, no dashes) as 32 hex digits; other ids as `int_id`."""
    bare = F.regexp_replace(F.lower(nullish(c)), r"^urn:uuid:|^uuid:|[{}\-\s]", "")
    return let(bare, lambda b: F.when(b.rlike("^[0-9a-f]{32}$"), F.when(~b.rlike("^0+$"), b)).otherwise(int_id(c)))


def hash_id(c: Column) -> Column:
    """A hex digest without prefix, blanks and case."""
    bare = F.regexp_replace(F.lower(nullish(c)), r"^[a-z0-9_\-]+[:=]|[\s\-:\"']", "")
    return let(bare, lambda b: F.when(~b.isin(STAND_INS), b))


def endpoint_id(c: Column) -> Column:
    """The box behind an endpoint address: host and port, however scheme, case, slash and /graphql are written."""
    bare = F.regexp_replace(F.lower(nullish(c)), r"^[a-z]+://(?:www\.)?|^www\.|[?#].*$", "")
    return F.nullif(F.regexp_replace(bare, r"\.?(?::443|:80)?(?:/+(?:graphql)?/*)?$", ""), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_URL = r"(?i)^(?:([a-z][a-z0-9+.\-]*)://|//)?(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# A key that is in its normal form already: nothing but a host in lower case and plain path segments.
_PLAIN_KEY = r"^(?!www\.)[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?(?:/[A-Za-z0-9._~\-]+)+\z"


def url_parts(c: Column) -> Column:
    """A struct of scheme, host, port, path and query of an address; what is absent, the scheme included, is empty."""
    names = ("scheme", "host", "port", "path", "query")
    parts = let(c, lambda s: F.struct(*[F.regexp_extract(s, _URL, i + 1).alias(n) for i, n in enumerate(names)]))
    return let(parts, lambda p: F.struct(F.lower(p["scheme"]).alias("scheme"), F.regexp_replace(F.lower(p["host"]), r"\.+$", "").alias("host"), *[p[n].alias(n) for n in names[2:]]))


def _path_key(raw: Column) -> Column:
    """A path with runs of slashes as one, without the last one, its escapes decoded and written anew."""

    def written(path: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
        quoted = F.url_encode(decoded)
        # Characters of a path that stay as they are
        for code, plain in [("+", "%20"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%21", "!"), ("%24", "$"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2B", "+"), ("%2C", ","), ("%3B", ";"), ("%3D", "="), ("%7E", "~")]:
            quoted = F.replace(quoted, F.lit(code), F.lit(plain))
        return F.when(path.rlike(r"[^A-Za-z0-9/:@!$&'()*+,;=~\-._]"), quoted).otherwise(path)

    return let(F.regexp_replace(F.regexp_replace(raw, "/{2,}", "/"), "(?<=.)/$", ""), lambda p: F.when(p == "", "/").otherwise(written(p)))


def _query_key(query: Column) -> Column:
    """`?` and the parameters in order, without those that name the referrer; empty where none is left."""
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(TRACKING_PARAMS))
    text = F.array_join(F.array_sort(F.transform(kept, lambda x: F.when(F.instr(x, "=") == 0, F.concat(x, F.lit("="))).otherwise(x))), "&")
    return F.when(query == "", "").otherwise(let(text, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def url_key(c: Column) -> Column:
    """The key under which two addresses are the same page.

    Scheme, `www.`, default port, fragment, tracking parameters and a trailing slash count for nothing, host in lower
    case, runs of slashes as one, escapes decoded and written anew, parameters in order. Path case stays.
    """

    def key(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"^www\.", "")
        default = ((p["port"] == "80") & (p["scheme"] != "https")) | ((p["port"] == "443") & (p["scheme"] != "http"))
        port = F.when((p["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), F.regexp_replace(p["port"], "^0+", "")))
        return F.when(host != "", F.concat(host, port, _path_key(p["path"]), _query_key(p["query"])))

    return F.when(c.rlike(_PLAIN_KEY) & ~F.lower(c).isin(STAND_INS), c).otherwise(let(nullish(c), lambda s: F.when(s.isNotNull(), let(url_parts(s), key))))
