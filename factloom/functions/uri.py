"""Canonical spelling of URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that never need an escape.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def _decoded(path: Column) -> Column:
    """Escapes of unreserved characters decoded; the hex digits of the others in upper case."""
    parts = F.split(path, "%", -1)
    escapes = F.create_map(*[F.lit(x) for c in UNRESERVED for x in (f"{ord(c):02X}", c)])

    def one(p: Column) -> Column:
        code, rest = F.upper(F.substring(p, 1, 2)), F.substr(p, F.lit(3))
        return F.when(F.map_contains_key(escapes, code), F.concat(F.element_at(escapes, code), rest)).when(code.rlike("^[0-9A-F]{2}$"), F.concat(F.lit("%"), code, rest)).otherwise(F.concat(F.lit("%"), p))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))


def canonical(uri: Column) -> Column:
    """Scheme in lower case; for ``file:`` also host and drive letter, and no needless escapes.

    A URI without a scheme is null.
    """
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(.*)$"
    part = lambda i: F.regexp_extract(uri, pattern, i)
    scheme = F.lower(part(1))
    drive = part(4).rlike(r"^/[A-Za-z]:")
    path = F.when(drive, F.concat(F.lower(F.substring(part(4), 1, 2)), F.substr(part(4), F.lit(3)))).otherwise(part(4))
    file = F.concat(F.lit("file:"), F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(3)))).otherwise(""), _decoded(path), part(5))
    other = F.concat(scheme, F.lit(":"), part(2), part(4), part(5))
    return F.when(scheme == "", F.lit(None)).when(scheme == "file", file).otherwise(other)


def path_of(uri: Column) -> Column:
    """The path of a local ``file:`` URI; null for others."""
    c = canonical(uri)
    host = F.regexp_extract(c, r"^file://([^/?#]*)", 1)
    return F.when(F.startswith(c, F.lit("file:")) & host.isin("", "localhost"), F.url_decode(F.replace(F.regexp_extract(c, r"^file:(?://[^/?#]*)?([^?#]*)", 1), F.lit("+"), F.lit("%2B"))))


def contained(uri: Column, root: Column) -> Column:
    """Whether a URI is the root or below it, compared by canonical spelling on whole path segments."""
    base = F.rtrim(canonical(root), F.lit("/"))
    u = canonical(uri)
    return ~u.rlike(r"/\.\.(/|$)") & ((u == base) | F.startswith(u, F.concat(base, F.lit("/"))))
