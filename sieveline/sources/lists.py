"""List files: items, phrases, regular expressions, addresses, groups, rooms, messages and labels.

Item lists can be large and are parsed where they lie; the other files are small by nature and are read on
the driver as whole texts, up to DRIVER_BYTES. Where a path is a folder, its files are one list in order of their
names. Included files are read relative to the file that names them. Nothing is left out in silence: what is
beyond a bound raises ListError, and only a path that doesn't exist counts as missing.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXCEPTION, BANNED, WEIGHTED = -1, 0, 1
COMBI = 10

#: Type of a time limit.
LIMIT = "struct<sth:int,stm:int,enh:int,enm:int,days:string>"
ITEM_SCHEMA = f"list string, item string, category string, tl {LIMIT}"
#: Lines of a list that stand for everything of a kind. Fixed values.
FLAGS = ("**", "*ip", "**s", "*ips")
#: A phrase has at most so many characters.
LONGEST = 126
#: Bytes that a list read on the driver may have; a longer one raises ListError.
DRIVER_BYTES = 64 << 20
#: Marker lines (categories, time limits, includes, flags) that an item list may have; more raise ListError.
MARKS = 100_000


class ListError(ValueError):
    """A list file that can't be read as one."""


class MissingList(ListError):
    """A path that doesn't exist."""


def _texts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(path, text) of the small files at a path, by name; from any file system that Spark reads."""
    try:
        found = spark.read.format("binaryFile").load(path)
        # the lengths are read first, without the contents
        total = sum(r[0] for r in found.select("length").collect())
        if total > DRIVER_BYTES:
            raise ListError(f"{path} has {total} bytes, more than the {DRIVER_BYTES} that are read on the driver")
        rows = found.select("path", "content").collect()
    except AnalysisException as e:
        raise (MissingList if "PATH_NOT_FOUND" in str(e) else ListError)(f"{path} can't be read: {e}") from e
    return sorted((r[0], bytes(r[1]).decode("utf-8", errors="replace").replace("\r\n", "\n")) for r in rows)


def lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small list: of one file, or of all files of a folder in order of their names.

    A path that doesn't exist raises MissingList, more than DRIVER_BYTES raise ListError.
    """
    return [line for _, text in _texts(spark, path) for line in text.removesuffix("\n").split("\n")]


def _beside(path: str, name: str) -> str:
    return name if name.startswith("/") or "://" in name else os.path.join(os.path.dirname(path), name)


def time_limit(text: str) -> tuple[int, int, int, int, str] | None:
    """`h m h m days` as (start hour, minute, end hour, minute, days), days 0 for Monday to 6; null if it is none."""
    m = re.match(r"\s*(\d{1,2}) (\d{1,2}) (\d{1,2}) (\d{1,2}) ([0-6]+)\s*$", text)
    if not m:
        return None
    sth, stm, enh, enm = map(int, m.groups()[:4])
    return (sth, stm, enh, enm, m[5]) if sth < 24 and enh < 24 and stm < 60 and enm < 60 else None


def in_time(tl: Column, ts: Column) -> Column:
    """Whether a row's own time lies in a limit, both ends included; no limit is always in time, no time never in one."""
    now = F.hour(ts) * 60 + F.minute(ts)
    within = (now >= tl["sth"] * 60 + tl["stm"]) & (now <= tl["enh"] * 60 + tl["enm"])
    day = F.instr(tl["days"], F.weekday(ts).cast("string")) > 0
    return tl.isNull() | F.coalesce(within & day, F.lit(False))


_CATEGORY = re.compile(r'#listcategory:\s*"([^"]*)"')


def read_items(spark: SparkSession, path: str, name: str, strip_port: bool = False, keep_case: bool = False, ignore_missing: bool = False) -> tuple[DataFrame, list[str]]:
    """An item list with its includes as (list, item, category, tl), and its flags.

    Lines under two characters and comments are skipped; what follows " #" or "#" is a comment but for "(?#".
    A final "/" and a leading ftp:// are dropped, items are lowered unless keep_case (regular expressions).
    An included list keeps its own category and time limit. A blank category is null. Missing files raise
    MissingList unless ignore_missing; more than MARKS marker lines raise ListError.
    """
    try:
        text = spark.read.text(path)
        marks = [r[0] for r in text.filter(F.col("value").rlike(r"^(?:#listcategory:|#time:|\.Include<)") | F.trim("value").isin(*FLAGS)).limit(MARKS + 1).collect()]
    except AnalysisException as e:
        missing = "PATH_NOT_FOUND" in str(e)
        if ignore_missing and missing:
            return spark.createDataFrame([], ITEM_SCHEMA), []
        raise (MissingList if missing else ListError)(f"{path} can't be read: {e}") from e
    if len(marks) > MARKS:
        raise ListError(f"{path} has more than {MARKS} marker lines")
    category, limit, flags, includes = None, None, [], []
    for line in marks:
        if m := _CATEGORY.match(line):
            category = m[1].strip() or None
        elif line.startswith("#time:"):
            limit = time_limit(line[6:])
        elif line.startswith(".Include<"):
            includes.append(_beside(path, line[9:].split(">")[0]))
        else:
            flags.append(line.strip())
    v = F.col("value")
    item = F.regexp_replace(v, r"(?<!\(\?)(?<!^)\s*#.*$", "") if keep_case else F.regexp_replace(v, r"\s*#.*$", "")
    item = F.rtrim(F.regexp_replace(item, "\r$", ""))
    if not keep_case:
        item = F.regexp_replace(F.lower(F.trim(item)), "^(?:ftp|https?)://", "")
        item = F.regexp_replace(item, "/+$", "")
    if strip_port:
        item = F.regexp_replace(item, r":\d+", "")
    tl = F.struct(*[F.lit(x).alias(n) for x, n in zip(limit, ("sth", "stm", "enh", "enm", "days"))]) if limit else F.lit(None)
    own = (
        text.filter(~v.startswith("#") & ~v.startswith(".Include<") & ~F.trim(v).isin(*FLAGS))
        .select(F.lit(name).alias("list"), item.alias("item"), F.lit(category).cast("string").alias("category"), tl.cast(LIMIT).alias("tl"))
        .filter(F.length("item") >= 2)
    )
    for path in includes:
        more, more_flags = read_items(spark, path, name, strip_port, keep_case, ignore_missing)
        own, flags = own.unionByName(more), flags + more_flags
    return own, flags


@dataclass(frozen=True)
class Phrase:
    """One phrase, or a combination of parts; kind is EXCEPTION, BANNED or WEIGHTED."""

    parts: tuple[str, ...]
    kind: int
    weight: int = 0
    category: str | None = None
    tl: tuple | None = None
    order: int = 0


@dataclass
class PhraseBase:
    phrases: list[Phrase] = field(default_factory=list)

    def single(self) -> list[Phrase]:
        """One phrase of each text: exceptions beat banned ones, these weighted ones, higher weights lower ones.

        A phrase that a combination uses too stays a single one here, and still counts for the combination.
        """
        best: dict[str, Phrase] = {}
        for p in self.phrases:
            if len(p.parts) == 1:
                old = best.get(p.parts[0])
                if old is None or (p.kind, -p.weight, p.order) < (old.kind, -old.weight, old.order):
                    best[p.parts[0]] = p
        return sorted(best.values(), key=lambda p: p.order)

    def combined(self) -> list[Phrase]:
        """Combinations; of those with equal parts the first."""
        best: dict[tuple[str, ...], Phrase] = {}
        for p in self.phrases:
            if len(p.parts) > 1:
                best.setdefault(tuple(sorted(p.parts)), p)
        return list(best.values())

    def needles(self) -> list[str]:
        """Every text to search for."""
        return sorted({x for p in self.phrases for x in p.parts})


def parse_phrase(line: str, exception: bool, category: str | None = None, tl: tuple | None = None, order: int = 0) -> Phrase | None:
    """`<p>`, `<p><w>`, `<a>,<b>`, `<a>,<b><w>`: a weight makes it weighted, else the file makes it banned or an exception.

    Phrases longer than LONGEST are cut, empty ones dropped; null for a line without any.
    """
    m = re.match(r"\s*((?:<[^>]*>\s*,\s*)*<[^>]*>)(?:<\s*([+-]?\d+)\s*>)?", line)
    if not m:
        return None
    parts, weight = re.findall(r"<([^>]*)>", m[1]), m[2]
    if weight is None and len(parts) > 1 and re.match(r"\s*<[^>]*>\s*<", line):
        parts, weight = parts[:1], None
    parts = [x[:LONGEST] for x in parts if x]
    if not parts:
        return None
    w = int(weight or 0)
    return Phrase(tuple(parts), WEIGHTED if w else EXCEPTION if exception else BANNED, w, category, tl, order)


def read_phrases(spark: SparkSession, path: str, exception: bool = False, category: str | None = None, tl: tuple | None = None, base: PhraseBase | None = None, ignore_missing: bool = False) -> PhraseBase:
    """A phrase list added to a base. Included files inherit category and time limit and may set their own.

    Lines are lowered up to a #noconvert. Missing files raise MissingList unless ignore_missing. A list beyond
    DRIVER_BYTES raises ListError: phrases are searched by an automaton that each worker holds.
    """
    base = PhraseBase() if base is None else base
    try:
        rows = lines(spark, path)
    except MissingList:
        if ignore_missing:
            return base
        raise
    lower = True
    for line in rows:
        if m := _CATEGORY.match(line):
            category = m[1].strip() or None
        elif line.startswith("#noconvert"):
            lower = False
        elif line.startswith("#time:"):
            tl = time_limit(line[6:])
        elif line.startswith(".Include<"):
            read_phrases(spark, _beside(path, line[9:].split(">")[0]), exception, category, tl, base, ignore_missing)
        elif line.startswith("<") and (p := parse_phrase(line.lower() if lower else line, exception, category, tl, len(base.phrases))):
            base.phrases.append(p)
    return base


def read_phrase_base(spark: SparkSession, exceptions: str | None, banned: str | None, weighted: str | None, ignore_missing: bool = False) -> PhraseBase:
    """One base from the three files, in this order."""
    base = PhraseBase()
    for path, exception in ((exceptions, True), (banned, False), (weighted, False)):
        if path:
            read_phrases(spark, path, exception, base=base, ignore_missing=ignore_missing)
    return base


@dataclass(frozen=True)
class Regex:
    """One regular expression in its place, with a replacement in replacement lists."""

    ord: int
    pattern: str
    replacement: str | None = None
    category: str | None = None
    tl: tuple | None = None


def read_regexes(spark: SparkSession, path: str, replacements: bool = False, start: int = 0) -> list[Regex]:
    """Patterns in order, those of included files before the file's own; lines that don't compile raise ListError.

    Replacement lists have "pattern"->"replacement", with an empty replacement allowed.
    """
    out: list[Regex] = []
    category, tl, own = None, None, []
    for line in lines(spark, path):
        if m := _CATEGORY.match(line):
            category = m[1].strip() or None
        elif line.startswith("#time:"):
            tl = time_limit(line[6:])
        elif line.startswith(".Include<"):
            out += read_regexes(spark, _beside(path, line[9:].split(">")[0]), replacements, start + len(out))
        elif len(line) >= 2 and not line.startswith("#"):
            own.append(line)
    for line in own:
        if replacements:
            m = re.match(r'"(.*)"->"(.*)"\s*$', line)
            if not m:
                raise ListError(f"{path}: no replacement rule: {line[:80]}")
            out.append(Regex(start + len(out), m[1], m[2], category, tl))
        else:
            out.append(Regex(start + len(out), line.strip(), None, category, tl))
    return out


def ip_to_int(ip: str) -> int | None:
    parts = ip.split(".")
    if len(parts) != 4 or not all(p.isdigit() and len(p) <= 3 and int(p) < 256 for p in parts):
        return None
    return int.from_bytes(bytes(map(int, parts)), "big")


def parse_ip(text: str) -> tuple[str, int | None, int | None, int | None, str | None]:
    """(kind, lo, hi, mask, host) of an address, address/mask, address/bits, address-address, or else a host name."""
    text = text.strip()
    if (n := ip_to_int(text)) is not None:
        return "ip", n, n, None, None
    a, _, b = text.partition("/")
    if b and (n := ip_to_int(a)) is not None:
        bits = int(b) if b.isdigit() and int(b) <= 32 else None
        mask = ((1 << 32) - (1 << (32 - bits))) if bits is not None else ip_to_int(b)
        if mask is not None:
            return "subnet", n & mask, (n & mask) | (0xFFFFFFFF ^ mask), mask, None
    a, _, b = text.partition("-")
    if b and (lo := ip_to_int(a.strip())) is not None and (hi := ip_to_int(b.strip())) is not None:
        return "range", lo, hi, None, None
    return "host", None, None, None, text.lower()


IP_SCHEMA = "list_name string, kind string, lo long, hi long, mask long, host string, grp int, room string"


def _ip_lines(rows: list[str]) -> list[str]:
    return [x for line in rows if (x := line.split("#")[0].strip())]


def read_ips(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An address list as rules."""
    return spark.createDataFrame([(name, *parse_ip(x), None, None) for x in _ip_lines(lines(spark, path))], IP_SCHEMA)


def read_ip_groups(spark: SparkSession, path: str) -> DataFrame:
    """`address, subnet or range = filterN` as rules with group N."""
    found = [re.match(r"(.+?)\s*=\s*filter(\d+)\s*$", x) for x in _ip_lines(lines(spark, path))]
    return spark.createDataFrame([("ipgroups", *parse_ip(m[1]), int(m[2]), None) for m in found if m], IP_SCHEMA)


def read_user_groups(spark: SparkSession, path: str) -> DataFrame:
    """`user=filterN` as (user_name, grp), users in lower case."""
    found = [re.match(r"\s*([^#=]+?)\s*=\s*filter(\d+)\s*$", x) for x in lines(spark, path)]
    return spark.createDataFrame([(m[1].lower(), int(m[2])) for m in found if m], "user_name string, grp int")


def read_rooms(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a folder: its first line is #name, the rest an address list. Files in order of their names."""
    rows = []
    for _, text in _texts(spark, folder):
        first, *rest = text.split("\n")
        if first.startswith("#"):
            rows += [("rooms", *parse_ip(x), None, first[1:].strip()) for x in _ip_lines(rest)]
    return spark.createDataFrame(rows, IP_SCHEMA)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """`"key","text"` as (key, text)."""
    found = [re.match(r'"(-?\d+)"\s*,\s*"(.*)"\s*$', x) for x in lines(spark, path)]
    return spark.createDataFrame([(int(m[1]), m[2]) for m in found if m], "key int, text string")


def read_label_limits(spark: SparkSession, path: str) -> dict[str, int]:
    """`NAME = int` with comments; the first line of a name holds."""
    out: dict[str, int] = {}
    for line in lines(spark, path):
        if m := re.match(r"\s*(\w+)\s*=\s*'?(-?\d+)'?", line):
            out.setdefault(m[1], int(m[2]))
    return out


def phrase_frame(spark: SparkSession, base: PhraseBase) -> DataFrame:
    """The single phrases of a base as (phrase, type, weight, category, ord)."""
    return spark.createDataFrame([(p.parts[0], p.kind, p.weight, p.category, p.order) for p in base.single()], "phrase string, type int, weight int, category string, ord int")


def combi_frame(spark: SparkSession, base: PhraseBase) -> DataFrame:
    """The combinations of a base as (combi_id, parts, type, weight, category)."""
    return spark.createDataFrame(
        [(i, list(p.parts), COMBI + 1 + p.kind, p.weight, p.category) for i, p in enumerate(base.combined())], "combi_id int, parts array<string>, type int, weight int, category string"
    )


def cached_items(spark: SparkSession, items: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """Writes a list of at least `least` items as Parquet and reads it back; smaller ones are returned as they are."""
    if items.limit(least).count() < least:
        return items
    items.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parse_list_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Phrase lines of many list files held as rows: (id, line, parts, weight, kind, category).

    kind as for files of weighted and banned phrases; a category holds for the lines after it. Lines that are no
    phrase lines give no rows; null texts neither. Lines count from 1 and end at LF or CR LF. Everything stays
    in the JVM; the only shuffle brings the lines of a file together.
    """
    from pyspark.sql import Window

    v = F.col("__v")
    rows = df.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("__pos", "__v"))
    marked = rows.filter(v.startswith("<") | v.startswith("#listcategory:")).withColumn("__c", F.when(v.startswith("#"), F.regexp_extract("__v", r'^#listcategory:\s*"([^"]*)"', 1)))
    w = Window.partitionBy(id_col).orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.withColumn("category", F.nullif(F.trim(F.last("__c", ignorenulls=True).over(w)), F.lit(""))).filter(v.startswith("<"))
    line = r"^((?:<[^>]*>\s*,\s*)*<[^>]*>)(?:<\s*([+-]?\d+)\s*>)?"
    parts = F.filter(F.regexp_extract_all(F.lower(F.regexp_extract("__v", line, 1)), F.lit("<([^>]*)>"), F.lit(1)), lambda x: x != "")
    weight = F.coalesce(F.regexp_extract("__v", line, 2).try_cast("int"), F.lit(0))
    out = placed.select(id_col, (F.col("__pos") + 1).alias("line"), F.transform(parts, lambda x: F.left(x, F.lit(LONGEST))).alias("parts"), weight.alias("weight"), F.when(weight == 0, BANNED).otherwise(WEIGHTED).alias("kind"), "category")
    return out.filter(F.size("parts") > 0)
