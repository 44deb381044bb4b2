"""Free-entered values to the entries of a reference list.

The reference entries and their alias paths are one trie. A value is folded (compatibility forms, case, blanks, decoration)
and searched with a Levenshtein automaton: its states are the rows of edit costs, advanced along the trie's edges and
dropped once no cell is within the distance that the value's length allows. An edge is also taken by a character that is
declared confusable with its own (homophones, variant characters), at no cost. Letters may be edited freely. Of ideographs
only one that has no meaning in the list (``Trie.meaning``) may be taken for another or be left over: a numeral or a word
of the list in its place is another value. All entries within the distance come out (``candidates``); the value means the
nearest one, and none if two are equally near.

Values are searched once per distinct value and worker (``functools.lru_cache``), so a hot value costs a dictionary look-up
and no shuffle. The trie is broadcast if its pickled size is at most ``BROADCAST_BYTES``; a longer reference list is cut into
shards with a trie each, and the distinct values, in salted parts, meet every shard (``shard_candidates``).
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Largest pickled matcher that is broadcast to the workers.
BROADCAST_BYTES = 64 << 20


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z"


def _is_ideograph(c: str) -> bool:
    return "\u3400" <= c <= "\u9fff"


def allowed_edits(text: str) -> tuple[int, int]:
    """Edits allowed by length: of letters a-z none up to three, one up to seven, else two; of ideographs none up to two,
    one up to five, else two."""
    letters, ideographs = sum(map(_is_letter, text)), sum(map(_is_ideograph, text))
    return 0 if letters <= 3 else 1 if letters <= 7 else 2, 0 if ideographs <= 2 else 1 if ideographs <= 5 else 2


def allowed_distance(text: str) -> int:
    return max(allowed_edits(text))


@dataclass
class Trie:
    """Nodes are dictionaries from character to node; the entries that end at a node are under the key ``None``.

    ``confusable``: characters and what each stands for; ``meaning``: ideographs that are never a slip for another one.
    """

    confusable: dict[str, str] = field(default_factory=dict)
    meaning: frozenset[str] = frozenset()
    root: dict = field(default_factory=dict)
    longest: int = 0

    def add(self, spelling: str, entry: int) -> None:
        node = self.root
        for c in spelling:
            node = node.setdefault(self.confusable.get(c, c), {})
        node.setdefault(None, set()).add(entry)
        self.longest = max(self.longest, len(spelling))

    def search(self, text: str, most: int, letters: bool = True, ideographs: bool = True) -> dict[int, int]:
        """All entries within ``most`` edits and the least distance of each; what may be edited is said by kind."""
        text = "".join(self.confusable.get(c, c) for c in text)
        far, found = most + 1, {}
        if len(text) > self.longest + most:
            return found
        letter = [letters and _is_letter(c) for c in text]
        slip = [ideographs and _is_ideograph(c) and c not in self.meaning for c in text]
        start = [0]
        for a, b in zip(letter, slip, strict=True):
            start.append(min(start[-1] + 1, far) if a or b else far)
        stack = [(self.root, start)]
        while stack:
            node, row = stack.pop()
            if None in node and row[-1] <= most:
                for e in node[None]:
                    found[e] = min(found.get(e, far), row[-1])
            for c, child in node.items():
                if c is None:
                    continue
                word, sign = letters and _is_letter(c), _is_ideograph(c)
                out = [row[0] + 1 if word else far]
                for j, t in enumerate(text):
                    cost = row[j] + (0 if c == t else 1 if (word and letter[j]) or (sign and slip[j]) else far)
                    if word:
                        cost = min(cost, row[j + 1] + 1)
                    if letter[j] or slip[j]:
                        cost = min(cost, out[j] + 1)
                    out.append(min(cost, far))
                if min(out) <= most:
                    stack.append((child, out))
        return found


def nearest(found: dict[int, int], unlisted: int = -1) -> int:
    """The only nearest entry, else ``unlisted``."""
    best = min(found.values(), default=0)
    near = [e for e, d in found.items() if d == best]
    return near[0] if len(near) == 1 else unlisted


class Matcher:
    """A trie with the folding of values: ``entry(value)`` is the entry it means or ``unlisted``."""

    def __init__(self, trie: Trie, fold: Callable[[str], str], unlisted: int = -1):
        self.trie, self.fold, self.unlisted = trie, fold, unlisted
        self.candidates = lru_cache(maxsize=1 << 18)(self._candidates)

    def __reduce__(self):
        return Matcher, (self.trie, self.fold, self.unlisted)

    def _candidates(self, value: str) -> dict[int, int]:
        text = self.fold(value)
        letters, ideographs = allowed_edits(text)
        return self.trie.search(text, max(letters, ideographs), letters > 0, ideographs > 0) if text else {}

    def entry(self, value: str) -> int:
        return nearest(self.candidates(value), self.unlisted)


# ---- handicap lines as a reference list

# Homophones and variant characters, each with the character it stands for.
CONFUSABLE = {
    **dict.fromkeys("办伴拌扮绊瓣辦", "半"), **dict.fromkeys("求秋毬囚邱丘裘", "球"), **dict.fromkeys("评坪苹萍瓶屏凭評", "平"), **dict.fromkeys("守首", "手"),
    **dict.fromkeys("授兽售寿瘦", "受"), **dict.fromkeys("壹衣伊医弌", "一"), **dict.fromkeys("二俩辆兩贰貳倆", "两"), **dict.fromkeys("叁參仨弎", "三"), **dict.fromkeys("讓", "让"), **dict.fromkeys("隊", "队"),
    **dict.fromkeys("盤", "盘"), **dict.fromkeys("\\、|～~,;:+＋", "/"),
}
# The words of a line's half, other spellings of each, and what may stand around a line.
SEGMENTS = {
    "平手": ["平", "pingshou", "level"], "半球": ["半", "0.5球", "banqiu", "half"], "一球": ["一", "1球", "yiqiu", "one"], "球半": ["一球半", "1球半", "1.5球", "qiuban", "oneandahalf"],
    "两球": ["两", "2球", "liangqiu", "two"], "两球半": ["两半", "2球半", "2.5球", "liangqiuban", "twoandahalf"], "三球": ["三", "3球", "sanqiu", "three"], "三球半": ["三半", "3球半", "3.5球", "sanqiuban", "threeandahalf"],
}
GIVING = ["", "让", "主让", "主队让", "客受让", "客队受让", "客受", "客队受", "giving"]
RECEIVING = ["受", "受让", "客让", "客队让", "主受让", "主队受让", "主受", "主队受", "让受", "receiving", "shou", "shourang"]
_TAG = re.compile(r"\[[^\]]*\]|\([^)]*\)|【[^】]*】")
_LABEL = re.compile(r"^(?:盘口|盘|初盘|终盘|即时|初|终|即|handicap|line)[:：]")
_TAIL = re.compile(r"(?:盘|升|降|初|终|即|balls?|goals?)$")
_EDGE = "*。！!.．;；:：'\"`·#•"
# Ideographs that mean something in a line, so that none of them is a slip for another.
MEANING = frozenset("平手半球一两三受让主客队零〇二四五六七八九十百大小上下单双全场升降盘初终即注赢输")


def fold_line(value: str) -> str:
    """Compatibility forms, lower case, no blanks, no tags, labels or decoration; a dash between words is a separator."""
    text = unicodedata.normalize("NFKC", value).casefold()
    text = re.sub(r"\s+", "", _TAG.sub("", text).replace("盤", "盘"))
    bare = None
    while bare != text:  # labels, tails and decoration in any number of layers
        bare, text = text, _TAIL.sub("", _LABEL.sub("", text.strip(_EDGE)))
    sign, rest = (text[:1], text[1:]) if text[:1] in ("+", "-", "−") else ("", text)
    return sign.replace("−", "-") + re.sub(r"[-–—−/\\、|～~]+", "/", rest)


def _numerals(value: float) -> list[str]:
    """Spellings of a number of quarter goals: 1, 1.0, 1.00; 0.5, 0.50, .5."""
    short = f"{value:g}"
    out = {short, f"{value:.2f}"} | ({f"{value:.1f}"} if round(value * 4) % 2 == 0 else set())
    return sorted(out | {x[1:] for x in out if x.startswith("0.")})


def line_trie(lines: Iterable[tuple[int, str, float, str | None]]) -> Trie:
    """The trie of (line_id, name, value, English name): the names and, as alias paths, every mix of spellings of their
    segments with every prefix of their side, with and without separator, and the number forms of the value."""
    trie = Trie(dict(CONFUSABLE), MEANING)
    for line, name, value, english in lines:
        receiving = name.startswith("受")
        parts = (name[1:] if receiving else name).split("/")
        kinds = [[[p, *SEGMENTS.get(p, [])[: -2 or None]], [SEGMENTS.get(p, ["", ""])[-2]], [SEGMENTS.get(p, ["", ""])[-1]]] for p in parts]
        for style in zip(*kinds, strict=True):
            if any("" in words for words in style):
                continue
            for words in product(*style):
                if len(parts) == 1 and words[0] in ("平", "半", "一", "两", "三", "两半", "三半"):
                    continue
                for prefix in RECEIVING if receiving else GIVING:
                    trie.add(prefix + "/".join(words), line)
                    trie.add(prefix + "".join(words), line)
        for word in [english] if english else []:
            trie.add(fold_line(word), line)
        halves = [abs(value)] if round(abs(value) * 4) % 2 == 0 else [abs(value) - 0.25, abs(value) + 0.25]
        # a negative value is a receiving line; level has either sign
        for sign in ("-",) if value < 0 else ("", "+", "-") if value == 0 else ("", "+"):
            for number in _numerals(abs(value)):
                trie.add(sign + number, line)
            if len(halves) == 2:
                for a, b in product(*map(_numerals, halves)):
                    trie.add(f"{sign}{a}/{b}", line)
                    if sign:
                        trie.add(f"{sign}{a}/{sign}{b}", line)
    return trie


def line_matcher(lines: Iterable[tuple[int, str, float, str | None]]) -> Matcher:
    return Matcher(line_trie(lines), fold_line)


# ---- the operator


def _values(df: DataFrame, id_column: str, columns: list[str], exact: frozenset[str], fields: list[T.StructField], judge: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows (id, field, value, ...) with what ``judge`` says of each value; its rows are made once per batch and value."""
    source = df.select(df[id_column].alias("id"), *[df[c].alias(f"f{i}") for i, c in enumerate(columns)])
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("field", T.StringType()), T.StructField("value", T.StringType()), *fields])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(columns):
                coded = batch[f"f{i}"].dictionary_encode()
                said = [[] if not v.strip() or v in exact else judge(v) for v in coded.dictionary.to_pylist()]
                rows = [(k, r) for k, c in enumerate(coded.indices.to_pylist()) if c is not None for r in said[c]]
                at = pa.array([k for k, _ in rows], pa.int64())
                made = [pa.array([r[j] for _, r in rows], f.type) for j, f in enumerate(list(schema)[3:])]
                yield pa.RecordBatch.from_arrays([batch["id"].take(at), pa.array([name] * len(rows), pa.string()), batch[f"f{i}"].take(at).cast(pa.string()), *made], schema=schema)

    return source.mapInArrow(run, out)


_LINE = T.StructField("line_id", T.IntegerType())
_DISTANCE = T.StructField("distance", T.IntegerType())


def _shared(df: DataFrame, matcher: Matcher):
    """The matcher as a broadcast of checked size; None if it is too large for one."""
    if len(pickle.dumps(matcher, protocol=pickle.HIGHEST_PROTOCOL)) > BROADCAST_BYTES:
        return None
    return df.sparkSession.sparkContext.broadcast(matcher)


def map_values(df: DataFrame, id_column: str, columns: list[str], matcher: Matcher, exact: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (``id``, ``field``, ``value``, ``line_id``) for each value of ``columns`` that is not NULL, blank or in ``exact``.

    No shuffle. Defined results: NULL and blank values give no row; a value longer than any entry and its edits and a value
    equally near to two entries are unlisted (-1); repeated rows stay; other columns are not read; an empty table gives none.
    """
    if (shared := _shared(df, matcher)) is None:
        raise ValueError("the reference list is too long for a broadcast: use shard_candidates")
    return _values(df, id_column, columns, exact, [_LINE], lambda v: [(shared.value.entry(v),)])


def map_candidates(df: DataFrame, id_column: str, columns: list[str], matcher: Matcher, exact: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (id, field, value, line_id, distance) of all entries within a value's distance; a value without any has one row
    with line_id -1 and a NULL distance."""
    if (shared := _shared(df, matcher)) is None:
        raise ValueError("the reference list is too long for a broadcast: use shard_candidates")
    return _values(df, id_column, columns, exact, [_LINE, _DISTANCE], lambda v: sorted(shared.value.candidates(v).items()) or [(-1, None)])


def shard_candidates(values: DataFrame, reference: DataFrame, build: Callable[[list[tuple]], Matcher], shards: int, salts: int) -> DataFrame:
    """(value, entry, distance) of all entries within the distance of each distinct ``value``, for a reference list of any length.

    ``build`` makes the matcher of some rows of ``reference``, whose first column is the entry's number. Every part of the
    values meets every shard of the list, so a task holds 1 / ``shards`` of the list and 1 / ``salts`` of the distinct values.
    """
    entry = reference.columns[0]
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    typed = values.select("value").where("value is not null").distinct()
    typed = typed.select("value", F.pmod(F.xxhash64("value"), F.lit(salts)).cast("int").alias("salt"), every(shards, "shard"))
    listed = reference.select("*", F.pmod(F.xxhash64(entry), F.lit(shards)).cast("int").alias("shard"), every(salts, "salt"))
    columns = reference.columns

    def meet(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        matcher = build([tuple(r) for r in right[columns].itertuples(index=False)])
        found = [(v, e, d) for v in left["value"] for e, d in matcher.candidates(v).items()]
        return pd.DataFrame(found, columns=["value", "entry", "distance"])

    return typed.groupBy("shard", "salt").cogroup(listed.groupBy("shard", "salt")).applyInPandas(meet, "value string, entry int, distance int")


def nearest_entries(candidates: DataFrame, unlisted: int = -1) -> DataFrame:
    """(value, entry) of each value with candidates: its only nearest entry, else ``unlisted``."""
    best = candidates.groupBy("value", "distance").agg(F.count(F.lit(1)).alias("n"), F.min("entry").alias("entry")).groupBy("value").agg(F.min_by(F.struct("n", "entry"), "distance").alias("b"))
    return best.select("value", F.when(F.col("b.n") == 1, F.col("b.entry")).otherwise(F.lit(unlisted)).alias("entry"))
