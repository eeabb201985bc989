"""Requests and bodies: header lines, multipart and url-encoded posts, compressed bodies."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions import text as X
from sieveline.operators.plugins import register

#: Encodings that a scanner can read. Fixed values.
READABLE = ("identity", "gzip", "deflate", "pack200-gzip")


def header_lines(block: Column) -> Column:
    """A header block as ARRAY<STRUCT<name, value>>; order and repeats are kept, a request line has a null name."""
    rows = F.filter(F.split(F.replace(block, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: x != "")
    named = lambda x: x.rlike(r"^[^\s:]+:")
    return F.transform(
        rows,
        lambda x: F.struct(
            F.when(named(x), F.substring_index(x, ":", 1)).alias("name"),
            F.when(named(x), F.trim(X.after(x, ":"))).otherwise(x).alias("value"),
        ),
    )


def header(headers: Column, name: str) -> Column:
    """Value of the first header of a name, without regard to case; null if absent."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


def content_type(headers: Column) -> Column:
    """Mime type in lower case without parameters, "-" if unknown."""
    v = F.lower(F.trim(F.substring_index(header(headers, "content-type"), ";", 1)))
    return F.when(v != "", v).otherwise(F.lit("-"))


def content_length(headers: Column) -> Column:
    """Length, -1 if unknown."""
    return F.coalesce(header(headers, "content-length").try_cast("bigint"), F.lit(-1))


def file_name(headers: Column) -> Column:
    """File name of the disposition, null if there is none."""
    v = F.regexp_extract(header(headers, "content-disposition"), r"(?i)filename\s*=\s*\"?([^\";]+)\"?", 1)
    return F.when(v != "", F.trim(v))


def boundary(headers: Column) -> Column:
    """Multipart boundary, without quotes and what follows ";"."""
    v = F.regexp_extract(header(headers, "content-type"), r"(?i)boundary\s*=\s*\"?([^\";]+)\"?", 1)
    return F.when(v != "", F.trim(v))


def cookie(headers: Column, name: str) -> Column:
    """Value of a cookie, null if absent."""
    v = F.regexp_extract(F.concat(F.lit("; "), header(headers, "cookie")), rf";\s*{name}=([^;]*)", 1)
    return F.when(v != "", v)


@register("auth", "proxy-basic")
def basic_user(headers: Column) -> Column:
    """User of basic proxy authorisation, null if there is none."""
    coded = F.regexp_extract(header(headers, "proxy-authorization"), r"(?i)^basic\s+([A-Za-z0-9+/=]+)", 1)
    v = F.substring_index(F.decode(F.try_to_binary(F.when(coded != "", coded), F.lit("base64")), "UTF-8"), ":", 1)
    return F.when(v != "", v)


@register("auth", "proxy-digest")
def digest_user(headers: Column) -> Column:
    v = F.regexp_extract(header(headers, "proxy-authorization"), r"(?i)^digest\s.*?username\s*=\s*\"([^\"]*)\"", 1)
    return F.when(v != "", v)


@register("auth", "proxy-ntlm")
def ntlm_user(headers: Column) -> Column:
    """User of the last message of an NTLM exchange, null for any other; names are in the message's own encoding."""
    coded = F.regexp_extract(header(headers, "proxy-authorization"), r"(?i)^ntlm\s+([A-Za-z0-9+/=]+)", 1)
    h = F.hex(F.try_to_binary(F.when(coded != "", coded), F.lit("base64")))
    byte = lambda k: F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("int")
    number = lambda k: byte(k) + byte(k + 1) * 256
    raw = F.try_to_binary(F.substring(h, (number(40) * 2 + 1), number(36) * 2), F.lit("hex"))
    wide = byte(60).bitwiseAND(F.lit(1)) == 1
    user = F.when(wide, F.try_validate_utf8(F.decode(raw, "UTF-16LE"))).otherwise(F.decode(raw, "ISO-8859-1"))
    # signature, message of the third kind
    return F.when(h.startswith("4E544C4D535350000300") & (user != ""), user)


@register("auth", "ident")
def ident_user(reply: Column) -> Column:
    """User of a recorded ident reply `ports : USERID : system : user`, null for any other."""
    v = F.btrim(F.regexp_extract(reply, r"^[^:]*:\s*USERID\s*:[^:]*:(.*)$", 1), F.lit(" \t\r\n"))
    return F.when(v != "", v)


def is_redirection(code: Column) -> Column:
    return (code >= 300) & (code < 400) & (code != 304)


def auth_required(code: Column) -> Column:
    return code.isin(401, 407)


def readable_encodings(accept: Column) -> Column:
    """Accept-Encoding cut to those that can be scanned; "identity" if none is left."""
    offered = F.transform(F.split(F.lower(accept), ","), lambda x: F.trim(F.substring_index(x, ";", 1)))
    kept = F.array_intersect(offered, F.array(*[F.lit(x) for x in READABLE]))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", ")).otherwise(F.lit("identity"))


def one_host(headers: Column) -> Column:
    """Repeated Host headers get another name but for the first, and HTTP/1.1 in a request line becomes 1.0."""
    first = F.array_position(F.transform(headers, lambda h: F.coalesce(F.lower(h["name"]) == "host", F.lit(False))), True)
    return F.transform(
        headers,
        lambda h, i: F.struct(
            F.when((F.lower(h["name"]) == "host") & (i + 1 != first), F.lit("X-Ignored-Host")).otherwise(h["name"]).alias("name"),
            F.when(h["name"].isNull(), F.regexp_replace(h["value"], "HTTP/1\\.1$", "HTTP/1.0")).otherwise(h["value"]).alias("value"),
        ),
    )


def multipart(body: Column, mark: Column) -> Column:
    """Parts of a multipart body as ARRAY<STRUCT<mimetype, filename, size, bodyoffset, content>>.

    A part begins after the boundary and its line end and goes on to the line end before the next boundary;
    what precedes the first and follows the closing one is no part. Without boundary there are none.
    bodyoffset: characters of the part's own header. Sizes are in bytes.
    """
    sections = F.split(body, F.concat(F.lit("(?:^|\r\n)--\\Q"), mark, F.lit("\\E")))
    # sections: preamble, parts that begin with a line end, epilogue that begins with "--"
    real = F.filter(F.slice(sections, 2, F.greatest(F.size(sections), F.lit(1))), lambda x: x.startswith("\r\n"))

    def part(x: Column) -> Column:
        own = F.substring(x, 3, 1 << 30)
        head = F.substring_index(own, "\r\n\r\n", 1)
        content = F.when(own.contains("\r\n\r\n"), F.substring(own, F.length(head) + 5, 1 << 30)).otherwise(F.lit(""))
        grab = lambda p: F.regexp_extract(head, p, 1)
        kind, name = grab(r"(?i)content-type:\s*([^;\r\n]+)"), grab(r"(?i)filename=\"([^\"]*)\"")
        return F.struct(
            F.when(kind != "", F.lower(F.trim(kind))).otherwise(F.lit("text/plain")).alias("mimetype"),
            F.when(name != "", name).alias("filename"),
            F.octet_length(content).cast("long").alias("size"),
            (F.length(head) + 4).cast("long").alias("bodyoffset"),
            content.alias("content"),
        )

    return F.when(mark.isNotNull() & body.isNotNull(), F.transform(real, part))


def form_values(body: Column) -> Column:
    """Values of a url-encoded body: names dropped, padded with spaces, "+" as space, %XX decoded."""
    values = F.transform(F.split(body, "&"), lambda x: F.when(x.contains("="), X.after(x, "=")).otherwise(x))
    joined = F.concat(F.lit(" "), F.array_join(values, " "), F.lit(" "))
    return X.percent_decode(F.translate(joined, "+", " "))


@F.pandas_udf(T.BinaryType())
def inflate(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
    """Bodies of gzip, zlib and raw deflate encoding in plain; others as they are, null where they are broken."""

    def plain(body, encoding):
        if body is None or encoding not in ("gzip", "x-gzip", "deflate"):
            return body
        for bits in ((31,) if "gzip" in encoding else (15, -15)):
            try:
                return zlib.decompress(body, bits)
            except zlib.error:
                continue
        return None

    return pd.Series([plain(b, (e or "").strip().lower()) for b, e in zip(bodies, encodings)], dtype=object)
