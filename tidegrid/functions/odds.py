"""Scalar functions over scores, prices, lines and texts of matches, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def goals(score: Column, strict: bool = True) -> tuple[Column, Column]:
    """Home and away goals of ``H-A``; NULL where malformed."""
    parts = F.split(score, "-")
    ok = F.size(parts) == 2 if strict else F.size(parts) >= 2
    return F.when(ok, F.get(parts, F.lit(0)).try_cast("int")), F.when(ok, F.get(parts, F.lit(1)).try_cast("int"))


def outcome(score: Column, labels: tuple[str, str, str] = ("home", "draw", "away"), malformed: str | None = None, missing: str | None = None, strict: bool = True) -> Column:
    """The result of a score; what a malformed or missing score gives is said by the caller (by default NULL)."""
    h, a = goals(score, strict)
    home, draw, away = labels
    made = F.when(h > a, home).when(h < a, away).when(h == a, draw)
    return F.when(score.isNull(), F.lit(missing)).otherwise(F.coalesce(made, F.lit(malformed)))


# Bookmakers that are loaded, keys of the handicap tables with the name the other tables use, and typed aliases.
WHITELIST = ["William Hill", "Bet 365", "Easybets", "Lottery Official", "Macauslot"]
CANONICAL = {"bet365": "Bet 365", "easybets": "Easybets"}
ALIASES = {"bet365": "Bet 365", "bet 365": "Bet 365", "36*": "Bet 365", "easybets": "Easybets", "yi": "Easybets"}
# How a page's masked bookmaker starts, in the summary table and in the history's header.
MASKED = {"bet365": ("36*", "36*"), "easybets": ("易*", "易胜*"), "macau": ("澳*", "澳*")}


def renamed(name: Column, table: dict[str, str]) -> Column:
    """The name's entry in the table, else the name."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), name)


def canonical_bookmaker(key: Column) -> Column:
    return renamed(key, CANONICAL)


def bookmaker_alias(name: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), F.lower(name)), name)


def masked_bookmaker(text: Column, history: bool = False) -> Column:
    """The key of a masked bookmaker by how its text starts, NULL for others."""
    return F.coalesce(*[F.when(F.startswith(F.trim(text), F.lit(p[history])), F.lit(k)) for k, p in MASKED.items()])


def slug(name: Column) -> Column:
    return F.translate(F.lower(name), " /", "__")


def any_code(*codes: Column) -> Column:
    """At least one code is neither NULL nor empty."""
    return F.concat_ws("", *codes) != ""


def team_name(name: Column, team: Column) -> Column:
    return F.coalesce(name, F.format_string("Unknown (%s)", team.cast("string")))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    """``12.34%``; ``N/A`` of nothing."""
    return F.when(whole == 0, "N/A").otherwise(F.format_string("%.2f%%", F.round(100.0 * part / whole, 2)))


def leading_number(text: Column) -> Column:
    """The number a text starts with; NULL for none and for 0."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def implied(price: Column) -> Column:
    return F.when(price > 0, 1 / price).otherwise(F.lit(0.0))


def margin_free(h: Column, d: Column, a: Column) -> list[Column]:
    """Three probabilities that add up to 1; zeros where a price is missing or not positive."""
    ok = (h > 0) & (d > 0) & (a > 0)
    s = 1 / h + 1 / d + 1 / a
    return [F.when(ok, (1 / x) / s).otherwise(F.lit(0.0)) for x in (h, d, a)]


def two_way(h: Column, a: Column) -> list[Column]:
    """Home and away probability without the draw; NULL where a price is missing or not positive."""
    ok = (h > 0) & (a > 0)
    return [F.when(ok, (1 / x) / (1 / h + 1 / a)) for x in (h, a)]


def overround(h: Column, d: Column, a: Column) -> Column:
    return F.when((h > 0) & (d > 0) & (a > 0), 1 / h + 1 / d + 1 / a)


# The words of handicap lines and their goals (receiving lines are the same words after 受), and those that are receiving only.
LINE_WORDS = {
    "平手": 0.0, "平手/半球": 0.25, "平/半": 0.25, "半球": 0.5, "半球/一球": 0.75, "半/一": 0.75, "一球": 1.0, "一球/球半": 1.25, "一/球半": 1.25, "球半": 1.5, "球半/两球": 1.75, "球半/两": 1.75,
    "两球": 2.0, "两球/两球半": 2.25, "两球半": 2.5, "两球半/三球": 2.75, "三球": 3.0, "三球/三球半": 3.25, "三球半": 3.5,
}
RECEIVING_WORDS = {"三球半/四球": 3.75, "四球": 4.0, "四球半": 4.5, "四球半/五球": 4.75, "五球": 5.0}


def line_value(word: Column, default: float | None = None) -> Column:
    """Goals of a line's word: 受让 and 受 turn the sign, 二 is 两, blanks around it do not count; ``default`` for an unknown word."""
    text = F.replace(F.replace(F.trim(word), F.lit("受让"), F.lit("受")), F.lit("二"), F.lit("两"))
    receiving = F.startswith(text, F.lit("受"))

    def value(words: dict[str, float], w: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), w)

    given = F.when(receiving, -value(LINE_WORDS | RECEIVING_WORDS, F.substring(text, 2, 100))).otherwise(value(LINE_WORDS, text))
    return F.coalesce(given, F.lit(default).cast("double"))


def cover(h: Column, a: Column, line: Column) -> Column:
    """1 where the home side covers the line, 0 where not (a push is not), -1 where a value is missing."""
    return F.when(h.isNull() | a.isNull() | line.isNull(), F.lit(-1)).when(h - a - line > 0, F.lit(1)).otherwise(F.lit(0))


def line_move(first: Column, last: Column) -> Column:
    """1 where the line went up, -1 down, else 0; an unknown line does not move."""
    return F.coalesce(F.signum(last - first).cast("int"), F.lit(0))


def water_change(first: Column, last: Column) -> Column:
    """Change of the home price; 0 where one is missing or 0."""
    return F.when((first != 0) & (last != 0), last - first).otherwise(F.lit(0.0))


# Labels of the rule, its bounds, and its reasons.
HOME, NOT_HOME = "主胜", "主队不胜"
WATER, RATE = 0.1, 0.45
REASONS = {"up": "升盘", "down": "降盘", "falls": "降水", "rises": "升水", "rate": "相似比赛主胜率%.0f%%", "none": "无明显特征"}


def rule_prediction(direction: Column, water: Column, rate: Column) -> Column:
    """By the line's move, else the water's, else the neighbours' home rate (missing: not home)."""
    signs = [(direction > 0, HOME), (direction < 0, NOT_HOME), (water < -WATER, HOME), (water > WATER, NOT_HOME), (rate > RATE, HOME)]
    said = F.lit(NOT_HOME)
    for sign, label in reversed(signs):
        said = F.when(sign, F.lit(label)).otherwise(said)
    return said


def rule_reasons(direction: Column, water: Column, rate: Column) -> Column:
    """What speaks for the prediction, joined by a comma."""
    moves = F.when(direction > 0, REASONS["up"]).when(direction < 0, REASONS["down"])
    waters = F.when(water < -WATER, REASONS["falls"]).when(water > WATER, REASONS["rises"])
    rates = F.when(rate.isNotNull(), F.format_string(REASONS["rate"], F.round(rate * 100, 0)))
    return F.coalesce(F.nullif(F.concat_ws(", ", moves, waters, rates), F.lit("")), F.lit(REASONS["none"]))


def support_threshold(n: Column) -> Column:
    return F.when(n >= 50, 0.60).when(n >= 20, 0.65).when(n >= 10, 0.70).otherwise(0.75)


def within(item: Column, target: Column, pct: float) -> Column:
    """Inclusive relative band; a missing or zero price is never within."""
    return (item > 0) & (target > 0) & (F.abs(item - target) <= target * F.lit(pct / 100))
