"""Mixed timestamp spellings to one UTC instant.

Each text is turned into its shape mask: digits become ``9``, letters are upper-cased, all else stays, so a mask has the
text's own length. Distinct masks are few; each is compiled once per worker into a ``Parser`` (which byte columns hold
which field, which zone or letter words it names), and all texts of a mask are converted together as numpy columns. Zones
convert through the versioned transition tables of ``zones``.

Results per text: a status and epoch seconds. ``OK``; ``AMBIGUOUS``, a wall time that occurred twice; ``NONEXISTENT``, one
that was skipped; ``UNREADABLE``; NULL in, NULL out. Fractions are dropped. Reading rules:

* without a zone: site time (``site_offset``); bare numbers of 9 to 17 digits: seconds, milliseconds or microseconds from
  1970 by their length; the script form ``2024,08-1,22,11,00,00`` is UTC and its month is the number before ``-1``;
* letter codes are fixed offsets, region names follow the region's own transitions, an explicit offset wins over a region;
* year-less: the given year, of site time; without one, the latest year (of site time) whose instant is not after
  ``created``; 29 February looks only at leap years; without either, unreadable;
* blanks around a text are ignored, and so is how many there are within it and how many digits a fraction has: what is then
  still longer than ``LONGEST`` bytes is longer than every form with the longest region name, and no time;
* a wall time of a region outside the years of its table (``zones``) cannot be told and is unreadable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidegrid.operators.zones import UNTIL, Zones, current_version, zones

OK, AMBIGUOUS, NONEXISTENT, UNREADABLE = 0, 1, 2, 3
WORDS = {AMBIGUOUS: "AMBIGUOUS", NONEXISTENT: "NONEXISTENT", UNREADABLE: "UNREADABLE"}
SITE_OFFSET = 8 * 3600
#: Bytes of most texts; the few longer ones are cleaned and laid out with LONGEST bytes.
WIDTH, LONGEST = 56, 128
#: Texts converted at once.
ROWS = 1 << 16

# Offsets in hours of letter codes.
CODES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "HKT": 8, "SGT": 8,
    "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "AEST": 10, "AEDT": 11, "BRT": -3, "ART": -3, "EST": -5, "EDT": -4, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
MONTHS = {m: i + 1 for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split())}


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 of proleptic Gregorian dates."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * ((m + 9) % 12) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def days_in_month(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)


def wall_to_utc(wall: np.ndarray, zone: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Epoch seconds of wall-clock seconds in a zone, and their status."""
    at, offset = zone
    before = np.r_[offset[0], offset[:-1]]
    first, second = at + np.minimum(before, offset), at + np.maximum(before, offset)
    i = np.searchsorted(first[1:], wall, "right")
    within = (i > 0) & (wall < second[i])
    status = np.where(within, np.where(offset[i] > before[i], NONEXISTENT, AMBIGUOUS), OK)
    return wall - offset[i], status.astype(np.int8)


_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,]9+)?)?"
_MONTH = "(?P<b>" + "|".join(MONTHS) + ")[A-Z]*[.]?"
_HALF = r"(?:\s*(?P<p>[AP])[.]?M(?![A-Z])[.]?)?"
_FORMS = [
    re.compile(p)
    for p in (
        rf"(?P<Y>9999)([-/.])(?P<m>99?)\2(?P<d>99?)(?:T|\s+){_CLOCK}{_HALF}(?P<z>.*)",
        r"(?P<Y>9999)(?P<m>99)(?P<d>99)T?(?P<H>99)(?P<M>99)(?P<S>99)?(?:[.,]9+)?(?P<z>\D.*|)",
        rf"(?P<d>99?)[.](?P<m>99?)[.](?P<Y>9999),?\s+{_CLOCK}(?P<z>.*)",
        rf"{_MONTH}\s+(?P<d>99?),?\s+(?P<Y>9999),?\s+{_CLOCK}{_HALF}(?P<z>.*)",
        rf"(?P<d>99?)\s+{_MONTH}\s+(?P<Y>9999),?\s+{_CLOCK}{_HALF}(?P<z>.*)",
        r"(?P<Y>9999),(?P<m>99?)-(?P<one>9),(?P<d>99?),(?P<H>99?),(?P<M>99?),(?P<S>99?)(?P<z>)",
        rf"(?P<m>99?)[-/](?P<d>99?)\s+{_CLOCK}(?P<z>.*)",
    )
]
_EPOCH = re.compile(r"(?P<E>9{9,17})(?:[.]9*)?")
_ZONE = re.compile(r"(?:(?P<base>UTC|GMT)\s*)?(?P<sign>[+-])(?P<h>99?)(?::?(?P<mi>99))?\s*(?:[\[(]?[A-Z_]+/[A-Z_/-]+[\])]?)?|(?P<name>[A-Z][A-Z_/-]*)|")


@dataclass(frozen=True)
class Parser:
    """What a mask means: the byte columns of each field; a constant month, half of day, zone or offset."""

    spans: dict
    month: int | None = None
    pm: int | None = None
    script: bool = False
    epoch: bool = False
    offset: int | None = None
    signed: int = 0
    region: str | None = None


@lru_cache(maxsize=1 << 16)
def compile_mask(mask: str) -> Parser | None:
    if m := _EPOCH.fullmatch(mask):
        return Parser({"E": m.span("E")}, epoch=True)
    for form in _FORMS:
        if not (m := form.fullmatch(mask)):
            continue
        spans = {k: m.span(k) for k in m.groupdict() if k in "YmdHMS" and m[k]}
        if "one" in m.groupdict():
            return Parser(spans | {"one": m.span("one")}, script=True, offset=0)
        text, at = m["z"], m.start("z")
        lead = len(text) - len(text.lstrip())
        inner = text.strip()
        if inner[:1] in ("[", "(") and inner[-1:] in ("]", ")"):
            inner, lead = inner[1:-1].rstrip(), lead + 1
            lead += len(inner) - len(inner.lstrip())
            inner = inner.lstrip()
        z = _ZONE.fullmatch(inner)
        if z is None or (inner == "" and text.strip()):
            return None
        own = {"month": MONTHS[m["b"]] if "b" in m.groupdict() else None, "pm": {"A": 0, "P": 1}[m["p"]] if m.groupdict().get("p") else None}
        if z["sign"]:
            spans |= {k: (z.start(k) + at + lead, z.end(k) + at + lead) for k in ("h", "mi") if z[k]}
            return Parser(spans, signed=1 if z["sign"] == "+" else -1, **own)
        if z["name"] is None:
            return Parser(spans, offset=SITE_OFFSET, **own)
        if z["name"] in CODES:
            return Parser(spans, offset=int(CODES[z["name"]] * 3600), **own)
        return Parser(spans, region=z["name"], **own)
    return None


def _number(cells: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(cells), np.int64)
    for c in range(*span):
        out = out * 10 + cells[:, c].astype(np.int64) - 48
    return out


def _run(p: Parser, cells: np.ndarray, year: np.ndarray, created: np.ndarray, tables: Zones, site: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(cells)
    if p.epoch:
        digits = p.spans["E"][1] - p.spans["E"][0]
        return _number(cells, p.spans["E"]) // (1 if digits <= 11 else 1000 if digits <= 14 else 1_000_000), np.zeros(n, np.int8)
    get = {k: _number(cells, s) for k, s in p.spans.items()}
    m = np.full(n, p.month) if p.month else get["m"]
    d, H, M, S = get["d"], get["H"], get["M"], get.get("S", np.zeros(n, np.int64))
    bad = (m < 1) | (m > 12) | (M > 59) | (S > 59)
    if p.pm is None:
        bad |= H > 23
    else:
        bad |= (H < 1) | (H > 12)
        H = H % 12 + 12 * p.pm
    if p.script:
        bad |= get["one"] != 1
    offset = np.full(n, site if p.offset == SITE_OFFSET and not p.script and p.region is None and not p.signed else p.offset or 0)
    if p.signed:
        mi = get.get("mi", np.zeros(n, np.int64))
        bad |= (get["h"] > 18) | (mi > 59)
        offset = p.signed * (get["h"] * 3600 + mi * 60)
    zone = None
    if p.region:
        zone = tables.get(p.region)
        if zone is None:
            return np.zeros(n, np.int64), np.full(n, UNREADABLE, np.int8)
    clock = H * 3600 + M * 60 + S
    if "Y" in p.spans:
        y = get["Y"]
    else:
        y = year.copy()
        open_ = y < 0
        bad |= open_ & (created == NO_TIME)
        local = np.where(open_ & (created != NO_TIME), created, 0) + site
        guess = 1970 + (local // 86400 * 400) // 146097 + 1
        for _ in range(12):  # 29 February is at most eight years apart
            wall = days_from_civil(guess, np.clip(m, 1, 12), d) * 86400 + clock
            utc = wall - offset if zone is None else wall_to_utc(wall, zone)[0]
            late = open_ & ~bad & ((utc + site > local) | (d > days_in_month(guess, m)))
            if not late.any():
                break
            guess = guess - late
        y = np.where(open_, guess, y)
    bad |= (d < 1) | (d > days_in_month(y, m)) | (y < 1)
    wall = days_from_civil(y, np.clip(m, 1, 12), d) * 86400 + clock
    if zone is None:
        utc, status = wall - offset, np.zeros(n, np.int8)
    else:
        utc, status = wall_to_utc(wall, zone)
        bad |= (wall < tables.since(p.region)) | (wall >= UNTIL)
    return utc, np.where(bad, UNREADABLE, status).astype(np.int8)


NO_TIME = np.int64(-(1 << 62))
_MASK = np.arange(256, dtype=np.uint8)
_MASK[48:58] = 57
_MASK[97:123] -= 32


def _cells(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text, padded with 0 to ``width``, and its length."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(1, np.uint8)
    length = np.diff(off)
    at = off[:-1, None] + np.arange(width)
    return np.where(np.arange(width) < length[:, None], data[np.minimum(at, len(data) - 1)], 0), length


def _groups(masks: np.ndarray) -> list[np.ndarray]:
    """Rows by equal mask: by a hash of the mask's words, confirmed byte by byte."""
    words = masks.view(np.uint64)
    h = np.zeros(len(masks), np.uint64)
    for c in range(words.shape[1]):
        h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    cut = np.flatnonzero(np.diff(h[order])) + 1
    out = []
    for rows in np.split(order, cut):
        if (masks[rows] == masks[rows[0]]).all():
            out.append(rows)
        else:
            _, inv = np.unique(masks[rows], axis=0, return_inverse=True)
            out += [rows[inv.ravel() == k] for k in range(inv.max() + 1)]
    return out


def _converted(
    cells: np.ndarray, length: np.ndarray, year: np.ndarray, created: np.ndarray, tables: Zones, site: int, form: re.Pattern | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status, epoch seconds and whether the mask is the plain form, mask by mask."""
    k = len(cells)
    masks = np.ascontiguousarray(_MASK[cells])
    s, e, plain = np.full(k, UNREADABLE, np.int8), np.zeros(k, np.int64), np.zeros(k, bool)
    for rows in _groups(masks):
        rows = rows[(length[rows] <= cells.shape[1]) & (length[rows] > 0)]
        parser = compile_mask(masks[rows[0]].tobytes().rstrip(b"\0").decode("latin-1")) if len(rows) else None
        if parser is not None:
            e[rows], s[rows] = _run(parser, cells[rows], year[rows], created[rows], tables, site)
            if form is not None and form.fullmatch(masks[rows[0]].tobytes().rstrip(b"\0").decode("latin-1")):
                plain[rows] = s[rows] == OK
    return s, e, plain


def parse_times(
    texts: pa.Array, years: pa.Array | None = None, created_us: np.ndarray | None = None, plain: str | None = None, version: str | None = None, site: int = SITE_OFFSET
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status (-1 for NULL), epoch seconds, and whether the text is a real date in the plain form.

    ``plain`` is a regular expression that a mask must match fully. ``created_us``: microseconds, ``NO_TIME`` for NULL.
    ``version``: of the zone tables, by default what is installed; plans name it (``zones.current_version``).
    """
    n, tables = len(texts), zones(version or current_version())
    status, epoch, is_plain = np.full(n, -1, np.int8), np.zeros(n, np.int64), np.zeros(n, bool)
    form = re.compile(plain) if plain else None
    for lo in range(0, n, ROWS):
        part = texts.slice(lo, ROWS)
        null = np.asarray(part.is_null())
        raw = part.fill_null("")
        trimmed = pc.utf8_trim_whitespace(raw)
        cut = np.asarray(pc.not_equal(trimmed, raw))
        cells, length = _cells(trimmed)
        k = len(part)
        year = np.full(k, -1, np.int64)
        if years is not None:
            y = pc.utf8_trim_whitespace(years.slice(lo, ROWS).fill_null(""))
            ycells, ylen = _cells(y, 4)
            good = (ylen == 4) & ((ycells >= 48) & (ycells <= 57)).all(axis=1)
            year = np.where(good, _number(ycells, (0, 4)), -1)
        made = np.full(k, NO_TIME) if created_us is None else np.asarray(created_us[lo : lo + k])
        created = np.where(made == NO_TIME, NO_TIME, made // 1_000_000)
        s, e, pl = _converted(cells, length, year, created, tables, site, form)
        long = np.flatnonzero(length > WIDTH)
        if len(long):
            bare = pc.replace_substring_regex(pc.replace_substring_regex(trimmed.take(pa.array(long)), r"\s+", " "), r"([.,]\d)\d+", r"\1")
            s[long], e[long], _ = _converted(*_cells(bare, LONGEST), year[long], created[long], tables, site, None)
        status[lo : lo + k], epoch[lo : lo + k], is_plain[lo : lo + k] = np.where(null, -1, s), e, pl & ~cut
    return status, epoch, is_plain


#: The plain form of each field, as a pattern of masks.
PLAIN_FULL, PLAIN_SHORT, PLAIN_LOOSE = r"9999-99-99 99:99", r"99-99 99:99", r"99?-99? 99:99"


def instants(status: np.ndarray, epoch: np.ndarray) -> pa.Array:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, or the word for the status; NULL for NULL."""
    seconds = pa.array(np.where(status == OK, epoch, 0)).cast(pa.timestamp("s"))
    out = pc.strftime(seconds, "%Y-%m-%d %H:%M:%S")
    for code, word in WORDS.items():
        hit = status == code
        if hit.any():
            out = pc.if_else(pa.array(hit), word, out)
    return pc.if_else(pa.array(status < 0), pa.scalar(None, pa.string()), out)


def created_microseconds(column: pa.Array) -> np.ndarray:
    """A timestamp column as microseconds, ``NO_TIME`` for NULL."""
    return np.asarray(column.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(int(NO_TIME)))
