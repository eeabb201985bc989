"""Options: the main file, the group files and plugin files, with their range checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from sieveline.sources.lists import lines


class ConfigError(ValueError):
    """An option out of its range."""


def parse_options(rows: list[str]) -> list[tuple[str, str]]:
    """`key = 'value'` lines in order, comments and quotes dropped."""
    out = []
    for row in rows:
        if m := re.match(r"\s*([A-Za-z0-9_]+)\s*=\s*(?:'([^']*)'|([^#]*))", row):
            out.append((m[1].lower(), m[2] if m[2] is not None else m[3].strip()))
    return out


def first(options: list[tuple[str, str]], key: str, default: str = "") -> str:
    """The value of the first line with a key."""
    return next((v for k, v in options if k == key), default)


def every(options: list[tuple[str, str]], key: str) -> list[str]:
    """The values of all lines with a key."""
    return [v for k, v in options if k == key]


@dataclass(frozen=True)
class MainOptions:
    """Options for all groups. Defaults and ranges are fixed values."""

    reportinglevel: int = 3
    loglevel: int = 3
    logexceptionhits: int = 2
    logfileformat: int = 1
    maxlogitemlength: int = 400
    weightedphrasemode: int = 2
    phrasefiltermode: int = 2
    preservecase: int = 0
    hexdecodecontent: int = 0
    showweightedfound: int = 1
    filtergroups: int = 1
    urlcachenumber: int = 1000
    urlcacheage: int = 900
    maxcontentfiltersize: int = 256
    maxcontentramcachescansize: int = 2000
    maxcontentfilecachescansize: int = 20000
    maxuploadsize: int = -1
    maxips: int = 0
    anonymizelogs: int = 0
    logtimestamp: int = 0


_MAIN_RANGES = {
    "reportinglevel": (-1, 3), "loglevel": (0, 3), "logexceptionhits": (0, 2), "logfileformat": (1, 4), "maxlogitemlength": (0, 10_000),
    "weightedphrasemode": (0, 2), "phrasefiltermode": (0, 3), "preservecase": (0, 2), "filtergroups": (1, 99), "urlcachenumber": (0, 1_000_000),
    "maxuploadsize": (-1, 1 << 30), "maxips": (0, 1 << 30),
}


@dataclass(frozen=True)
class GroupOptions:
    """Options of one filter group. Defaults and ranges are fixed values."""

    groupmode: int = 1
    groupname: str = ""
    naughtynesslimit: int = 50
    searchtermlimit: int = 0
    categorydisplaythreshold: int = 0
    embeddedurlweight: int = 0
    enablepics: int = 0
    blockdownloads: int = 0
    bypass: int = 0
    infectionbypass: int = 0
    deepurlanalysis: int = 0
    bannedregexwithblanketblock: int = 0
    violations: int = 0
    threshold: int = 0
    byuser: int = 0
    reportinglevel: int = 3
    weightedphrasemode: int = 2


_GROUP_RANGES = {
    "groupmode": (0, 2), "naughtynesslimit": (1, 1 << 30), "searchtermlimit": (0, 1 << 30), "reportinglevel": (-1, 3), "weightedphrasemode": (0, 2), "embeddedurlweight": (0, 1 << 30),
}

_SWITCH = {"on": "1", "off": "0", "yes": "1", "no": "0"}


def _fill(kind: type, ranges: dict, options: list[tuple[str, str]]):
    values = {}
    for f in fields(kind):
        text = first(options, f.name)
        if text == "":
            continue
        if f.type == "str":
            values[f.name] = text
            continue
        text = _SWITCH.get(text.lower(), text)
        if not re.fullmatch(r"-?\d+", text):
            raise ConfigError(f"{f.name} must be a number, not {text!r}")
        low, high = ranges.get(f.name, (-(1 << 31), 1 << 31))
        if not low <= int(text) <= high:
            raise ConfigError(f"{f.name} must lie in {low} to {high}, not {text}")
        values[f.name] = int(text)
    return kind(**values)


def read_main(spark: SparkSession, path: str) -> MainOptions:
    return _fill(MainOptions, _MAIN_RANGES, parse_options(lines(spark, path)))


def read_group(spark: SparkSession, path: str) -> GroupOptions:
    return _fill(GroupOptions, _GROUP_RANGES, parse_options(lines(spark, path)))


def parse_plugin(rows: list[str], delimiter: str = "=") -> dict[str, str]:
    """A plugin's options: key and value at the first delimiter, quotes dropped, the last line of a key holds."""
    out = {}
    for row in rows:
        key, mark, value = row.partition(delimiter)
        if mark and not row.lstrip().startswith("#") and key.strip():
            out[key.strip()] = value.strip().strip("'\"")
    return out
