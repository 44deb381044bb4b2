"""Versioned zone transition tables: when a region's offset from UTC changes, and to what.

Two versions exist. ``tzdb-<release>`` is read from the public time zone database as installed (the ``tzdata`` package, else
the system's files): every region, its whole history, and the rule that its file ends with, carried on to ``LAST_YEAR``.
``eu-1996`` needs no files: the regions under the European rule from 1996 on and some of one offset. A version's name is
part of every plan, and a worker whose database has another release refuses it, so results can be tied to rules.
"""

from __future__ import annotations

import re
import struct
from datetime import date, timedelta
from functools import lru_cache
from importlib import resources
from pathlib import Path

import numpy as np

LAST_YEAR = 2100
#: A time long before every table.
NEVER = -(1 << 60)
SYSTEM = Path("/usr/share/zoneinfo")
Zone = tuple[np.ndarray, np.ndarray]

# Hours of regions with one offset, and standard hours of regions under the European rule.
FIXED_REGIONS = {
    "ETC/UTC": 0, "ATLANTIC/REYKJAVIK": 0, "ASIA/DUBAI": 4, "ASIA/KOLKATA": 5.5, "ASIA/BANGKOK": 7, "ASIA/JAKARTA": 7, "ASIA/SHANGHAI": 8, "ASIA/HONG_KONG": 8,
    "ASIA/MACAU": 8, "ASIA/SINGAPORE": 8, "ASIA/TAIPEI": 8, "ASIA/MANILA": 8, "ASIA/TOKYO": 9, "ASIA/SEOUL": 9, "AUSTRALIA/BRISBANE": 10,
}
EU_REGIONS = {
    "EUROPE/LONDON": 0, "EUROPE/DUBLIN": 0, "EUROPE/LISBON": 0, "ATLANTIC/CANARY": 0, "EUROPE/BERLIN": 1, "EUROPE/PARIS": 1, "EUROPE/MADRID": 1, "EUROPE/ROME": 1,
    "EUROPE/AMSTERDAM": 1, "EUROPE/BRUSSELS": 1, "EUROPE/VIENNA": 1, "EUROPE/ZURICH": 1, "EUROPE/STOCKHOLM": 1, "EUROPE/OSLO": 1, "EUROPE/COPENHAGEN": 1,
    "EUROPE/PRAGUE": 1, "EUROPE/WARSAW": 1, "EUROPE/BUDAPEST": 1, "EUROPE/BELGRADE": 1, "EUROPE/ZAGREB": 1, "EUROPE/LUXEMBOURG": 1, "EUROPE/ATHENS": 2,
    "EUROPE/HELSINKI": 2, "EUROPE/BUCHAREST": 2, "EUROPE/SOFIA": 2, "EUROPE/KYIV": 2, "EUROPE/KIEV": 2, "EUROPE/RIGA": 2, "EUROPE/TALLINN": 2, "EUROPE/VILNIUS": 2,
}
EU_SINCE = 1996


def _seconds(day: date, clock: int) -> int:
    return (day - date(1970, 1, 1)).days * 86400 + clock


def _eu(standard: float) -> Zone:
    """Last Sundays of March and October at 01:00 UTC."""
    at, offset = [NEVER], [int(standard * 3600)]
    for year in range(EU_SINCE, LAST_YEAR):
        for month, add in ((3, 3600), (10, 0)):
            last = date(year, month, 31)
            at.append(_seconds(last - timedelta(days=(last.weekday() + 1) % 7), 3600))
            offset.append(int(standard * 3600) + add)
    return np.array(at, np.int64), np.array(offset, np.int64)


_CLOCK = r"([+-]?\d+(?::\d+){0,2})"
_NAME = r"(?:<[^>]+>|[A-Za-z]+)"
_DAY = r"(M\d+\.\d\.\d|J?\d+)(?:/" + _CLOCK + ")?"
_RULE = re.compile(rf"{_NAME}{_CLOCK}(?:{_NAME}{_CLOCK}?,{_DAY},{_DAY})?")


def _clock(text: str) -> int:
    sign = -1 if text.startswith("-") else 1
    parts = [int(x) for x in text.lstrip("+-").split(":")]
    return sign * sum(x * w for x, w in zip(parts, (3600, 60, 1), strict=False))


def _day(spec: str, year: int) -> date:
    if spec[0] == "M":
        month, week, weekday = (int(x) for x in spec[1:].split("."))
        first = date(year, month, 1)
        day = first + timedelta(days=(weekday - (first.weekday() + 1)) % 7 + 7 * (week - 1))
        return day if day.month == month else day - timedelta(days=7)
    leap = date(year, 12, 31).timetuple().tm_yday == 366
    n = int(spec.lstrip("J"))
    return date(year, 1, 1) + timedelta(days=n - 1 + (leap and n >= 60) if spec[0] == "J" else n)


def _carried_on(rule: str, since: int) -> tuple[list[int], list[int]]:
    """The transitions of a file's closing rule after ``since``."""
    m = _RULE.fullmatch(rule)
    if m is None or m[3] is None:
        return [], []
    standard = -_clock(m[1])
    summer = -_clock(m[2]) if m[2] else standard + 3600
    made = []
    for year in range(1970, LAST_YEAR):
        made.append((_seconds(_day(m[3], year), _clock(m[4] or "2")) - standard, summer))
        made.append((_seconds(_day(m[5], year), _clock(m[6] or "2")) - summer, standard))
    made = sorted(x for x in made if x[0] > since)
    return [t for t, _ in made], [o for _, o in made]


def read_tzif(data: bytes) -> Zone:
    """The transitions of a compiled zone file (RFC 8536, version 2 or later)."""

    def header(at: int) -> tuple[int, ...]:
        if data[at : at + 4] != b"TZif" or data[at + 4 : at + 5] < b"2":
            raise ValueError("not a zone file of version 2 or later")
        return struct.unpack(">6l", data[at + 20 : at + 44])

    utc, std, leap, times, types, chars = header(0)
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc
    utc, std, leap, times, types, chars = header(at)
    at += 44
    when = np.frombuffer(data, ">i8", times, at).astype(np.int64)
    kind = np.frombuffer(data, np.uint8, times, at + 8 * times)
    offsets = np.array([struct.unpack(">lBB", data[at + 9 * times + 6 * i : at + 9 * times + 6 * i + 6])[0] for i in range(types)], np.int64)
    rule = data[at + 9 * times + 6 * types + chars + 12 * leap + std + utc :].strip(b"\n").decode()
    more, after = _carried_on(rule, int(when[-1]) if times else NEVER)
    at_all, offset = np.r_[np.int64(NEVER), when, np.array(more, np.int64)], np.r_[offsets[0], offsets[kind], np.array(after, np.int64)]
    change = np.r_[True, np.diff(offset) != 0]
    return at_all[change], offset[change]


@lru_cache
def installed() -> str | None:
    """The release of the installed database, None if there is none."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        source = SYSTEM / "tzdata.zi"
        m = re.match(r"# version (\S+)", source.read_text()[:100]) if source.exists() else None
        return m[1] if m else None


def current_version() -> str:
    return f"tzdb-{installed()}" if installed() else "eu-1996"


@lru_cache
def _names() -> dict[str, str]:
    try:
        listed = (resources.files("tzdata") / "zones").read_text().split()
    except (ImportError, FileNotFoundError):
        listed = [str(p.relative_to(SYSTEM)) for p in SYSTEM.rglob("*") if p.is_file() and p.relative_to(SYSTEM).parts[0] not in ("right", "posix")]
    return {n.upper(): n for n in listed if "/" in n}


class Zones:
    """The tables of a version: ``get`` gives a region's (upper-case) transitions, ``since`` from when they hold."""

    def __init__(self, version: str):
        self.tzdb = version.startswith("tzdb-")
        if version != "eu-1996" and version != f"tzdb-{installed()}":
            raise ValueError(f"no zone tables of version {version!r}; installed is {installed()}")
        self.get = lru_cache(maxsize=1024)(self._get)

    def _get(self, region: str) -> Zone | None:
        if self.tzdb:
            name = _names().get(region)
            if name is None:
                return None
            try:
                return read_tzif(resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes())
            except (ImportError, FileNotFoundError):
                return read_tzif((SYSTEM / name).read_bytes())
        if region in FIXED_REGIONS:
            return np.array([NEVER]), np.array([int(FIXED_REGIONS[region] * 3600)])
        return _eu(EU_REGIONS[region]) if region in EU_REGIONS else None

    def since(self, region: str) -> int:
        return _seconds(date(EU_SINCE, 1, 1), 0) if not self.tzdb and region in EU_REGIONS else NEVER


@lru_cache
def zones(version: str) -> Zones:
    return Zones(version)


#: One past the last second that the tables cover.
UNTIL = _seconds(date(LAST_YEAR, 1, 1), 0)
