"""Urls: parts, canonical forms, list keys and checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions import text as X


def host_name(url: Column) -> Column:
    """Between "://" and the next "/", without what stands before "@"; a port is kept."""
    return F.regexp_extract(url, r"^(?:[^:/?#]*://)?(?:[^/@]*@)?([^/]*)", 1)


def strip_protocol(url: Column) -> Column:
    return F.regexp_replace(url, "^(?:http|https|ftp)://", "")


def real_path(path: Column) -> Column:
    """Resolves "." and ".." and collapses slashes; a leading and a trailing slash are kept.

    ".." at the root stays at the root. An array fold, so it never leaves the JVM.
    """
    parts = F.split(path, "/")
    up = lambda a, x: F.when((x == "") | (x == "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), up)
    body = F.array_join(kept, "/")
    lead = F.when(path.startswith("/"), "/").otherwise("")
    tail = F.when((F.size(kept) > 0) & path.rlike(r"(?:/|/\.|/\.\.)$"), "/").otherwise("")
    resolved = F.concat(lead, body, tail)
    return F.when(path.rlike(r"//|(?:^|/)\.{1,2}(?:/|$)"), resolved).otherwise(path)


def list_key(url: Column) -> Column:
    """How a url is looked up: trimmed, lower case, no protocol, login or port, path decoded and resolved, no "/" at the end."""
    u = strip_protocol(F.lower(F.btrim(url, F.lit(" \t\r\n"))))
    u = F.regexp_replace(u, "^[^/@]*@", "")
    host = F.regexp_replace(F.regexp_extract(u, "^([^/?]*)", 1), r":\d*$", "")
    host = F.regexp_replace(host, r"\.$", "")
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.substring(rest, F.length(path) + 1, 1 << 30)
    clean = F.concat(host, F.when(path == "", "").otherwise(real_path(X.percent_decode(path))), query)
    return F.regexp_replace(clean, "/+$", "")


def canonical(request_target: Column, host_header: Column, method: Column) -> Column:
    """The url of a request line: absolute form, path form with the host header, or host:port of CONNECT.

    The default port of the scheme is left out, a final dot of the host dropped, login kept.
    """
    connect = F.concat(F.lit("https://"), request_target, F.lit("/"))
    absolute = request_target.rlike("(?i)^[a-z]+://")
    u = F.when(method == "CONNECT", connect).when(absolute, request_target).otherwise(F.concat(F.lit("http://"), F.coalesce(host_header, F.lit("")), request_target))
    u = F.regexp_replace(u, r"^([a-zA-Z]+://(?:[^/@]*@)?[^/:?]*?)\.+(?=[:/?]|$)", "$1")
    u = F.regexp_replace(u, r"^(http://(?:[^/@]*@)?[^/:?]*):80(?=/|$|\?)", "$1")
    u = F.regexp_replace(u, r"^(https://(?:[^/@]*@)?[^/:?]*):443(?=/|$|\?)", "$1")
    return F.regexp_replace(u, r"^([a-zA-Z]+://[^/?]*)$", "$1/")


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first; the last label alone comes as ".tld"."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    i = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    suffix = F.transform(i, lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(host.isNotNull() & (host != ""), F.transform(suffix, lambda s: F.when(s.contains(".") | (n == 1), s).otherwise(F.concat(F.lit("."), s))))


def is_ip_host(host: Column) -> Column:
    """No letter and no "|" in it."""
    return ~host.rlike("[a-zA-Z|]")


def malformed(url: Column) -> Column:
    """Host shorter than 2, doubled or final dots, a character that hosts can't have, or an obfuscated address.

    An address is obfuscated when no label starts with a letter and some label has a leading 0 or is above 255.
    """
    full = F.regexp_extract(url, "://([^/]*)", 1)
    host = F.regexp_extract(full, "^([^:]*)", 1)
    labels = F.split(host, r"\.")
    address = host.rlike("^[0-9.xXa-fA-F]*$") & ~F.exists(labels, lambda x: x.rlike("^[A-Za-z]"))
    hidden = F.exists(labels, lambda x: x.rlike("^0.") | (F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("bigint"), F.lit(0)) > 255) | x.rlike(r"^\d{19}"))
    return (F.length(full) < 2) | host.contains("..") | host.endswith(".") | host.rlike("[^A-Za-z0-9._-]") | (address & hidden)


def extension_source(url: Column, disposition: Column, mimetype: Column) -> Column:
    """What extensions are matched against: the disposition's file name, else the url without query.

    A url with a query counts only for application/ types, by what stands before the query.
    """
    path = F.lower(F.substring_index(F.substring_index(url, "?", 1), "#", 1))
    return (
        F.when(F.length(disposition) > 1, F.lower(disposition))
        .when(~url.contains("?") | F.coalesce(F.lower(mimetype).contains("application/"), F.lit(False)), path)
    )


def extension(name: Column) -> Column:
    """Last extension of a file name or path, with its dot; null where there is none."""
    ext = F.regexp_extract(name, r"(\.[^./?]+)$", 1)
    return F.when((ext != "") & (~name.contains("://") | name.rlike("://[^/]*/")), ext)


def search_terms(url: Column, patterns: list[str]) -> Column:
    """The first pattern's first group found in a url, "+" as space, decoded, tab, comma and semicolon as spaces."""
    found = [F.when(url.rlike("(?is)" + p), F.regexp_extract(url, "(?is)" + p, 1)) for p in patterns]
    raw = F.replace(F.coalesce(*found, F.lit(None).cast("string")), F.lit("+"), F.lit(" "))
    return F.translate(X.percent_decode(raw), "\t,;", "   ")


def ip_number(ip: Column) -> Column:
    """IPv4 in dotted form as a number; null for another form."""
    parts = F.split(ip, r"\.")
    octet = lambda k: F.get(parts, k).try_cast("bigint")
    n = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    return F.when(ip.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & (F.array_max(F.transform(parts, lambda x: x.try_cast("int"))) <= 255), n)
