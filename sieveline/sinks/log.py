"""The access log as text: four formats, marks on entries, admission, and pages and urls of denial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as X

_MARKS = ("is_naughty", "is_exception", "infected", "scanned", "content_mod", "url_mod", "header_mod")


def decorated(what: Column, naughty_type: Column, exception_hits: int = 2, **flags: Column) -> Column:
    """The reason with its marks in front; the last of the chain stands first.

    flags: is_naughty, is_exception, infected, scanned, content_mod, url_mod, header_mod; nulls count as false.
    """
    f = {k: F.coalesce(flags.get(k, F.lit(False)), F.lit(False)) for k in _MARKS}
    part = F.when(naughty_type == 1, "-POST").when(naughty_type == 2, "-PARAMS").otherwise("")
    first = F.when(f["is_naughty"], F.concat(F.lit("*DENIED"), part, F.lit("* ")))
    if exception_hits == 2:
        first = first.when(f["is_exception"], "*EXCEPTION* ")
    scan = F.when(f["infected"], F.concat(F.lit("*INFECTED"), part, F.lit("* "))).when(f["scanned"], "*SCANNED* ").otherwise("")
    mods = [F.when(f[k], m).otherwise("") for k, m in (("header_mod", "*HEADERMOD* "), ("url_mod", "*URLMOD* "), ("content_mod", "*CONTENTMOD* "))]
    return F.concat(*mods, scan, first.otherwise(""), F.coalesce(what, F.lit("")))


def with_port(url: Column, port: Column) -> Column:
    """The url with its port after the host, unless that is 80, null or there already."""
    host = r"^([a-zA-Z]+://(?:[^/@]*@)?[^/:?]+)(?=[/?]|$)"
    odd = port.isNotNull() & (port != 80) & (port != 0)
    # the replacement is a column, so the port's digits are put behind a mark that can't be read as a group
    marked = F.regexp_replace(url, host, "$1\x01")
    return F.when(odd, F.replace(marked, F.lit("\x01"), F.concat(F.lit(":"), port.cast("string")))).otherwise(url)


def admitted(level: int, is_naughty: Column, is_exception: Column, category: Column, mimetype: Column, log_ads: bool = False, exception_hits: int = 2) -> Column:
    """Whether an entry is logged: level 0 none, 1 denied ones, 2 texts too, 3 all; advertising and exceptions by choice."""
    naughty, exception = F.coalesce(is_naughty, F.lit(False)), F.coalesce(is_exception, F.lit(False))
    ads = F.lit(False) if log_ads else F.coalesce(category.contains("ADs"), F.lit(False))
    hidden = exception if exception_hits == 0 else F.lit(False)
    text = F.coalesce(F.lower(mimetype).startswith("text"), F.lit(False))
    by_level = {0: F.lit(False), 1: naughty, 2: naughty | text, 3: F.lit(True)}[level]
    return by_level & ~ads & ~hidden


def squid_code(code: Column, cache_hit: Column) -> Column:
    return F.when(code == 403, "TCP_DENIED/403").otherwise(F.concat(F.when(cache_hit, "TCP_HIT/").otherwise("TCP_MISS/"), code.cast("string")))


def squid_duration(ms: Column) -> Column:
    """Milliseconds, padded to six places with blanks; longer ones stand whole."""
    t = ms.cast("string")
    return F.when(F.length(t) < 6, F.lpad(t, 6, " ")).otherwise(t)


def log_time(ts: Column) -> Column:
    """Y.M.D H:MM:SS, month, day and hour without padding."""
    return F.date_format(ts, "yyyy.M.d H:mm:ss")


def post_column(parts: Column) -> Column:
    """Posted parts as mimetype,filename,size,blocked,stored,offset; each, with , ; tab and blank as _ in names."""
    safe = lambda c: F.translate(F.coalesce(c, F.lit("")), ",;\t ", "____")
    one = lambda p: F.concat(safe(p["mimetype"]), F.lit(","), safe(p["filename"]), F.lit(","), p["size"].cast("string"), F.lit(","), F.when(p["blocked"], "1").otherwise("0"), F.lit(","), safe(p["storedname"]), F.lit(","), p["bodyoffset"].cast("string"), F.lit(";"))
    return F.array_join(F.transform(parts, one), "")


def params_column(terms: Column) -> Column:
    """Search terms as the log has them."""
    return F.when(terms.isNotNull() & (terms != ""), F.concat(F.lit("0="), terms, F.lit(";"))).otherwise("")


def anonymised(df: DataFrame) -> DataFrame:
    """Without user and client host, the address as 0.0.0.0."""
    return df.withColumns({"user_name": F.lit(""), "ip": F.lit("0.0.0.0"), "client_host": F.lit("")})


def log_lines(df: DataFrame, fmt: int = 1, limit: int = 0, group_name: str = "", proxy_ip: str = "127.0.0.1", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, line) of every log row.

    fmt: 1 blanks, 2 quoted and separated by commas (quotes aren't escaped), 3 proxy style, 4 tabs. limit cuts
    category, reason and url to so many characters, 0 leaves them whole. Nulls come out as empty texts, an
    unknown user or type as "-".
    """
    if fmt not in (1, 2, 3, 4):
        raise ValueError("fmt must be 1 to 4")
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d))
    cut = lambda c: F.left(c, F.lit(limit)) if limit else c
    flags = {k: F.col(k) for k in _MARKS}
    where = cut(with_port(text("url"), F.col("port")))
    what = cut(decorated(F.col("what"), F.col("naughty_type"), **flags))
    when = log_time(F.col("start_ts"))
    if fmt == 3:
        micros = F.unix_micros(F.col("start_ts").cast("timestamp"))
        end = F.unix_micros(F.col("recv_ts").cast("timestamp"))
        stamp = F.concat(F.floor(end / 1_000_000).cast("string"), F.lit("."), F.lpad((F.floor(end / 1000) % 1000).cast("string"), 3, "0"))
        client = F.when(F.length("client_host") > 0, F.col("client_host")).otherwise(text("ip"))
        hit = squid_code(F.col("code"), F.col("cache_hit"))
        line = F.concat_ws(" ", stamp, squid_duration(F.floor(end / 1000) - F.floor(micros / 1000)), client, hit, text("size"), text("how"), where, text("user_name", "-"), F.lit(f"DEFAULT_PARENT/{proxy_ip}"), text("mimetype", "-"))
        return df.select(*(keep or []), line.alias("line"))
    fields = [
        F.coalesce(when, F.lit("")), text("user_name", "-"), text("ip"), where, what, text("how"), text("size", "0"), text("weight", "0"), cut(text("category")),
        (F.col("filter_group") + 1).cast("string"), text("code"), text("mimetype", "-"), text("client_host"), F.lit(group_name), text("user_agent"), text("params"), F.lit(""), F.lit(""), text("post"),
    ]
    fields = [F.coalesce(f, F.lit("")) for f in fields]
    if fmt == 2:
        line = F.concat(F.lit('"'), F.concat_ws('","', *fields), F.lit('"'))
    else:
        line = F.concat_ws("\t" if fmt == 4 else " ", *fields)
    return df.select(*(keep or []), line.alias("line"))


def write_log(df: DataFrame, path: str, fmt: int = 1, **options) -> None:
    """Writes log lines as text files, one a partition."""
    log_lines(df, fmt, **options).write.mode("append").text(path)


def block_page(template: str, **values: Column) -> Column:
    """A template with its -NAME- places filled, values of markup characters made safe; SHORTURL from URL."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if "URL" in values:
        values.setdefault("SHORTURL", X.display_url(values["URL"]))
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"-{name}-"), safe(value))
    return out


def redirect_url(address: str, url: Column, ip: Column, user: Column, categories: Column, reason: Column, host: Column | None = None, hashed: Column | None = None, custom: bool = False) -> Column:
    """The deny address with its parameters encoded; custom delimiters are :: between and == in place of &, =."""
    pairs = [("DENIEDURL", url), ("IP", ip), ("USER", user), ("HOST", host), ("CATEGORIES", categories), ("HASH", hashed), ("REASON", reason)]
    if custom:
        parts = [F.concat(F.lit(k + "=="), X.mini_url_encode(F.coalesce(v, F.lit("")))) for k, v in pairs if v is not None]
        return F.concat(F.lit(address + "?"), F.concat_ws("::", *parts))
    parts = [F.concat(F.lit(k + "="), X.mini_url_encode(v)) for k, v in pairs if v is not None]
    return F.concat(F.lit(address + "?"), F.concat_ws("&", *parts))


def denial(level: int, mimetype: Column, page: Column, redirect: Column, plain: str = "Access Denied") -> Column:
    """What a denied client is sent by reporting level: -1 the page after all, 0 plain words, 1 and 2 a redirection, 3 the page.

    Images and movies get a replacement at level 3.
    """
    if level == -1:
        return F.struct(F.lit("pass").alias("action"), F.lit(None).cast("string").alias("content"))
    kind = F.lower(mimetype)
    if level == 0:
        return F.struct(F.lit("text").alias("action"), F.lit(plain).alias("content"))
    if level in (1, 2):
        return F.struct(F.lit("redirect").alias("action"), redirect.alias("content"))
    action = F.when(kind.startswith("image/"), "image").when(kind == "application/x-shockwave-flash", "movie").otherwise("page")
    return F.struct(action.alias("action"), F.when(action == "page", page).alias("content"))


def store_blocked(df: DataFrame, path: str, by: str = "category") -> None:
    """Writes blocked rows as Parquet, partitioned."""
    df.write.mode("append").partitionBy(by).parquet(path)
