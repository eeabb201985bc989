"""Content scanners: a registry, verdicts of outside scanners' results, and the chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.operators import plugins

#: Results of a scanner. Fixed values.
CLEAN, INFECTED, WARNING, BLOCKED, ERROR = 0, 1, 3, 4, -1

Scanner = Callable[..., Column]


def register(name: str) -> Callable[[Scanner], Scanner]:
    """Adds a scanner under a name: a function that gives a struct of code and name."""
    return plugins.register("scanner", name)


def scanner(name: str) -> Scanner:
    return plugins.plugin("scanner", name)


def _result(code: Column, name: Column) -> Column:
    return F.struct(code.cast("int").alias("code"), name.cast("string").alias("name"))


@register("signature")
def signature_scan(body: Column, signatures: tuple[tuple[str, str], ...] = (("TESTVIRUS", "Test.Signature"),)) -> Column:
    """Infected with the name of the first signature that a text has."""
    name = F.coalesce(*[F.when(body.contains(s), F.lit(n)) for s, n in signatures], F.lit(None).cast("string"))
    return _result(F.when(name.isNotNull(), INFECTED).otherwise(CLEAN), name)


@register("command line")
def command_line_result(output: Column, code: Column, virus_regex: str | None = None, clean: tuple[int, ...] = (), infected: tuple[int, ...] = (), default: str = "infected") -> Column:
    """A scanner program's recorded output and return code: the expression first, then the codes, then the default."""
    name = F.regexp_extract(output, virus_regex, 1) if virus_regex else F.lit("")
    last = {"clean": CLEAN, "infected": INFECTED, "error": ERROR}[default]
    result = F.when(name != "", INFECTED).when(code.isin(*clean) if clean else F.lit(False), CLEAN).when(code.isin(*infected) if infected else F.lit(False), INFECTED).otherwise(last)
    return _result(result, F.when(name != "", name))


@register("icap")
def icap_result(status: Column, found_header: Column) -> Column:
    """A scan server's recorded answer: 204 is clean, 200 infected if it names something, else clean; others are errors."""
    name = F.regexp_extract(found_header, r"(?i)threat=([^;]+)", 1)
    named = F.when(name != "", name).otherwise(found_header)
    return _result(F.when(status == 204, CLEAN).when((status == 200) & found_header.isNotNull(), INFECTED).when(status == 200, CLEAN).otherwise(ERROR), F.when(status == 200, named))


@register("clamd")
def clamd_result(reply: Column, archive_warn: bool = False) -> Column:
    """A daemon's recorded reply `path: NAME FOUND`, `... ERROR`, else clean; with archive_warn limits of archives only warn."""
    v = F.btrim(reply, F.lit(" \t\r\n"))
    name = F.regexp_extract(v, r"^.*?: (.*?) FOUND$", 1)
    found = v.endswith("FOUND")
    warns = F.lit(archive_warn) & (name.contains(".Exceeded") | name.contains(".Encrypted"))
    return _result(F.when(reply.isNull() | v.endswith("ERROR"), ERROR).when(found & warns, WARNING).when(found, INFECTED).otherwise(CLEAN), F.when(found, name))


@register("avastd")
def avastd_result(reply: Column) -> Column:
    """A daemon's recorded lines of path, [status] and name: "+" is clean, "L" infected, another status warns.

    A line of another form is an error, and so is a reply without its last, empty line. Names are joined by blanks.
    """
    lines = F.split(reply, "\r\n")
    rows = F.slice(lines, 1, F.greatest(F.size(lines) - 2, F.lit(0)))
    ends = reply.endswith("\r\n\r\n") | (reply == "\r\n")
    status = lambda x: F.regexp_extract(x, r"^[^\t]*\t\[(.)\](?:\t.*)?$", 1)
    rows = F.filter(rows, lambda x: x != "")
    bad = ~F.coalesce(ends, F.lit(False)) | F.exists(rows, lambda x: status(x) == "")
    infected, odd = F.exists(rows, lambda x: status(x) == "L"), F.exists(rows, lambda x: ~status(x).isin("+", "L"))
    names = F.transform(F.filter(rows, lambda x: status(x) != "+"), lambda x: F.when(status(x) == "L", F.regexp_extract(x, r"\]\t(.*)$", 1)).otherwise(F.lit("Encrypted")))
    return _result(F.when(F.coalesce(bad, F.lit(True)), ERROR).when(infected, INFECTED).when(odd, WARNING).otherwise(CLEAN), F.when(~bad & (infected | odd), F.array_join(names, " ")))


@register("kavd")
def kavd_result(reply: Column) -> Column:
    """A daemon's recorded lines: 2xx is clean, 322-NAME lines up to the next 2xx are infected, others are errors."""
    lines = F.split(F.regexp_replace(reply, "\r", ""), "\n")
    names = F.regexp_extract_all(reply, F.lit(r"(?m)^322-(\S+)"), F.lit(1))
    head = F.get(lines, F.lit(0))
    return _result(F.when(head.startswith("2"), CLEAN).when(head.startswith("322"), INFECTED).otherwise(ERROR), F.when(head.startswith("322"), F.array_join(names, " ")))


def wants_scan(site_listed: Column, url_listed: Column, type_listed: Column, extension_listed: Column) -> Column:
    """A page is scanned unless its site, url, type or extension is on an exception list."""
    off = [F.coalesce(c, F.lit(False)) for c in (site_listed, url_listed, type_listed, extension_listed)]
    return ~(off[0] | off[1] | off[2] | off[3])


def chain(results: list[Column]) -> Column:
    """The scanners' results in order as one: the first infected, blocked or failed one ends it.

    code and name of that one, else clean; scanned is false if a scanner warned before.
    """
    stops = lambda r: r["code"].isin(INFECTED, BLOCKED, ERROR)
    each = F.array(*results)
    at = F.coalesce(F.array_position(F.transform(each, stops), True), F.lit(0))
    seen = F.when(at > 0, F.slice(each, 1, at.cast("int"))).otherwise(each)
    stop = F.when(at > 0, F.get(each, (at - 1).cast("int")))
    return F.struct(
        F.coalesce(stop["code"], F.lit(CLEAN)).alias("code"), stop["name"].alias("name"), (~F.exists(seen, lambda r: r["code"] == WARNING)).alias("scanned")
    )
