"""How the values of log fields are read: Column functions only, no UDF.

Null and blank texts and "-" are no value in any field; each function gives null for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind (the code points with Unicode's White_Space property). Fixed values.
WHITE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trim_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def has_value(c: Column) -> Column:
    """False for null, blank and "-"; never null."""
    return F.coalesce(~trim_white(c).isin("", "-"), F.lit(False))


def raw_value(c: Column) -> Column:
    """The text exactly as it stands where it is a value, else null."""
    return F.when(has_value(c), c)


def user_key(c: Column) -> Column:
    """User without outer white space, in lower case, without a domain before a backslash."""
    v = trim_white(F.substring_index(F.lower(trim_white(c)), "\\", -1))
    return F.when(~v.isin("", "-"), v)


def ip_key(c: Column) -> Column:
    """The IPv4 address in dotted form; IPv6-mapped notation is the same address; 0.0.0.0 is none."""
    v = F.regexp_replace(F.lower(trim_white(c)), "^::ffff:", "")
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(v.rlike(f"^{octet}(?:\\.{octet}){{3}}$") & (v != "0.0.0.0"), v)


def site_key(c: Column) -> Column:
    """Host of a url in lower case, without login, port and final dot."""
    v = F.lower(trim_white(c))
    host = F.regexp_extract(v, r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def epoch_seconds(c: Column) -> Column:
    """Whole UTC seconds of a logged time: "Y.M.D H:MM:SS", an epoch with fraction, both, or ISO with T and Z.

    The fraction is dropped. A text of another form, or with an impossible date or time, gives null. The
    session's time zone plays no part.
    """
    v = trim_white(c)
    stamp = r"^\d{4}[.\-]\d{1,2}[.\-]\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}(?:$|\D)"
    parts = F.split(F.translate(v, "-T: Z", "...."), r"\.")
    day = F.unix_date(F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).try_cast("date"))
    h, m, s = (F.get(parts, F.lit(k)).try_cast("int") for k in (3, 4, 5))
    fits = v.rlike(stamp) & (h <= 23) & (m <= 59) & (s <= 60)
    dated = F.when(fits, day.cast("long") * 86400 + h * 3600 + m * 60 + s)
    epoch = F.regexp_extract(v, r"^(\d{1,12})(?:\.\d*)?$", 1).try_cast("long")
    return F.coalesce(dated, epoch)


def log_day(seconds: Column) -> Column:
    """yyyy-mm-dd of epoch seconds, in UTC."""
    return F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
