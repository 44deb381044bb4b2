"""Deeply nested JSON text to flat, linked tables, by vectorised structural indexing.

A chunk of texts is laid out in one byte buffer. From it come, without a loop over characters:

* the quote bitmap (quotes not escaped by an odd run of backslashes) and, by its running count, which bytes lie inside strings;
* the bracket, colon and comma positions outside strings, and by a prefix sum over brackets the depth of each;
* the containers (open/close pairs, their parents) and members (key span, value span), by searches within one depth.

``NestedTable`` says which containers are the records of a table; ``flatten`` emits one row per record with its link
columns. A link is the source row's own columns plus the ordinal of each ancestor, so tables join back without ids that
would need a shuffle.

Defined results: a NULL, blank, scalar or cut-off text gives no row. Text that holds JSON text inside a JSON string (any
number of times) is unwrapped. Of a repeated key the last value counts. A missing or null field is NULL; a string field is
its decoded text, any other value its JSON text. Elements that are not objects are no records but keep their ordinal.
Whole texts are read, whatever their length; a text longer than the chunk size is a chunk of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of JSON text indexed at once: bounds a worker's memory at about twenty times as much.
CHUNK_BYTES = 3 << 20

_OPEN, _CLOSE, _COLON, _COMMA = 1, 2, 3, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[[123, 91]] = _OPEN
_CLASS[[125, 93]] = _CLOSE
_CLASS[58] = _COLON
_CLASS[44] = _COMMA
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True


def unwrapped(text: str | None) -> bytes | None:
    """UTF-8 of the JSON container in ``text``, unpacked from JSON strings; None if there is none."""
    if text is None:
        return None
    text = text.strip(" \t\r\n")
    while text[:1] == '"':
        try:
            inner = json.loads(text)
        except ValueError:
            return None
        if not isinstance(inner, str):
            return None
        text = inner.strip(" \t\r\n")
    return text.encode("utf-8", "surrogatepass") if text[:1] in ("{", "[") else None


def spans_to_strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray, null: np.ndarray) -> pa.Array:
    """A string array of the given byte spans."""
    length = np.where(null, 0, np.maximum(end - start, 0))
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    data = buf[at]
    valid = pa.array(~null).buffers()[1] if null.any() else None
    big = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)), valid)
    return big.cast(pa.string())


class JsonIndex:
    """The structural index of many JSON containers in one buffer. ``ok[i]`` tells whether text i is whole."""

    def __init__(self, texts: list[bytes | None], keys: list[str]):
        n = len(texts)
        self.keys = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, n)
        self.start = np.zeros(n, np.int64)
        np.cumsum(sizes[:-1] + 1, out=self.start[1:])
        self.end = self.start + sizes
        buf = self.buf = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n" * 9, np.uint8)
        quote = buf == 34
        slash = np.flatnonzero(buf == 92)
        self.slashes = None
        if len(slash):
            first = np.r_[True, np.diff(slash) != 1]
            run = slash[np.flatnonzero(first)][np.cumsum(first) - 1]
            quote[slash[(slash - run) % 2 == 0] + 1] = False
            self.slashes = np.zeros(len(buf) + 1, np.int32)
            np.cumsum(buf == 92, out=self.slashes[1:])
        before = np.cumsum(quote, dtype=np.int32)
        at = lambda p: np.where(p > 0, before[np.maximum(p, 1) - 1], 0)
        odd = (at(self.end) - at(self.start)) % 2 == 1
        if odd.any():  # an open string would turn all later texts inside out: close it at the separator
            quote[self.end[odd]] = True
            before = np.cumsum(quote, dtype=np.int32)
        self.quotes, self.rank = np.flatnonzero(quote), before
        kind = _CLASS[buf]
        kind[(before & 1).astype(bool)] = 0
        s = self.s = np.flatnonzero(kind)
        kind = self.kind = kind[s]
        doc = self.doc = np.repeat(np.arange(n), np.diff(np.r_[np.searchsorted(s, self.start), len(s)]))
        step = (kind == _OPEN).astype(np.int32) - (kind == _CLOSE)
        depth = np.cumsum(step)
        head = np.searchsorted(doc, np.arange(n))
        base = np.where(head > 0, depth[np.maximum(head, 1) - 1], 0) if len(s) else np.zeros(n, int)
        depth = depth - base[doc]
        some = np.diff(np.r_[head, len(s)]) > 0
        tail = np.r_[head[1:], len(s)] - 1
        ok = some & ~odd
        if len(s):
            low = np.full(n, -1)
            low[some] = np.minimum.reduceat(depth, head[some])
            zero = np.bincount(doc[depth == 0], minlength=n)
            h, t = np.minimum(head, len(s) - 1), np.maximum(tail, 0)
            ok &= (low == 0) & (zero == 1) & (depth[t] == 0) & (s[h] == self.start) & (s[t] == self.end - 1) & (kind[h] == _OPEN)
        keep = ok[doc]
        self.s, self.kind, self.doc = s[keep], kind[keep], doc[keep]
        level = (depth + (kind == _CLOSE))[keep]
        self._containers(level)
        bad = np.unique(self.c_doc[self.buf[self.c_close] != self.buf[self.c_open] + 2])
        ok[bad] = False
        self.ok = ok
        self._members(level)

    def _containers(self, level: np.ndarray) -> None:
        brackets = np.flatnonzero(self.kind <= _CLOSE)
        order = brackets[np.argsort(level[brackets], kind="stable")]
        opens, closes = order[0::2], order[1::2]
        back = np.argsort(opens, kind="stable")
        opens, closes = opens[back], closes[back]
        self.c_open, self.c_close, self.c_doc, self.c_level = self.s[opens], self.s[closes], self.doc[opens], level[opens]
        self.c_array = self.buf[self.c_open] == 91
        self.c_parent = np.full(len(opens), -1)
        self._at, self._of = {}, {}
        for d in range(1, int(self.c_level.max(initial=0)) + 1):
            own = np.flatnonzero(self.c_level == d)
            self._of[d], self._at[d] = own, self.c_open[own]
            if d > 1:
                self.c_parent[own] = self._of[d - 1][np.searchsorted(self._at[d - 1], self.c_open[own]) - 1]
        comma = np.flatnonzero(self.kind == _COMMA)
        self.c_ordinal = np.zeros(len(opens), np.int64)
        for d in range(1, int(self.c_level.max(initial=0))):
            own = self._of[d + 1]
            here = self.s[comma[level[comma] == d]]
            if len(own) and len(here):
                self.c_ordinal[own] = np.searchsorted(here, self.c_open[own]) - np.searchsorted(here, self.c_open[self.c_parent[own]])
        self._struct_open = opens

    def _members(self, level: np.ndarray) -> None:
        colon = np.flatnonzero(self.kind == _COLON)
        p = self.s[colon]
        owner = np.full(len(colon), -1)
        for d, own in self._of.items():
            here = level[colon] == d
            owner[here] = own[np.searchsorted(self._at[d], p[here]) - 1]
        last = self.rank[p] - 1
        known = last >= 1
        close, start = self.quotes[np.maximum(last, 0)], self.quotes[np.maximum(last - 1, 0)] + 1
        kid = self._key_ids(start, close)
        use = known & (kid >= 0) & (owner >= 0)
        self.m_owner, self.m_key = owner[use], kid[use]
        value, after = p[use] + 1, self.s[np.minimum(colon[use] + 1, len(self.s) - 1)] if len(self.s) else p[use]
        while True:
            space = _SPACE[self.buf[value]] & (value < after)
            if not space.any():
                break
            value = value + space
        next_at = np.minimum(colon[use] + 1, max(len(self.s) - 1, 0))
        child = np.full(len(value), -1)
        opens = (self.kind[next_at] == _OPEN) & (after == value) if len(self.s) else np.zeros(0, bool)
        where = np.searchsorted(self._struct_open, next_at[opens]) if opens.any() else np.zeros(0, int)
        child[opens] = where
        self.m_child = child
        end = after.copy()
        end[opens] = self.c_close[where] + 1
        while True:
            space = _SPACE[self.buf[np.maximum(end - 1, 0)]] & (end > value)
            if not space.any():
                break
            end = end - space
        self.m_start, self.m_end = value, end

    def _key_ids(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length, out = end - start, np.full(len(start), -1)
        words = np.ndarray(len(self.buf) - 7, "<u8", self.buf, 0, (1,)) if len(start) else None
        for key, i in self.keys.items():
            raw = key.encode()
            hit = np.flatnonzero(length == len(raw))
            if not len(hit):
                continue
            for k in [*range(0, len(raw) - 7, 8), max(len(raw) - 8, 0)]:
                part = raw[k : k + 8]
                mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - 8 * len(part)) if part else np.uint64(0)
                hit = hit[(words[start[hit] + k] & mask) == np.uint64(int.from_bytes(part, "little"))]
            out[hit] = i
        if self.slashes is not None:
            for j in np.flatnonzero((self.slashes[np.maximum(end, 0)] - self.slashes[start]) * (length > 0)):
                try:
                    out[j] = self.keys.get(json.loads(b'"' + self.buf[start[j] : end[j]].tobytes() + b'"'), -1)
                except ValueError:
                    pass
        return out

    # -- navigation: sets of containers are arrays of container numbers; row numbers point into the set asked about

    def roots(self) -> np.ndarray:
        return np.flatnonzero((self.c_level == 1) & self.ok[self.c_doc])

    def _row_of(self, boxes: np.ndarray) -> np.ndarray:
        row = np.full(len(self.c_open) + 1, -1)
        row[boxes] = np.arange(len(boxes))
        return row

    def by_key(self, boxes: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
        """Containers that are the value of ``key`` in ``boxes``, and the row of the box of each."""
        row = self._row_of(boxes)
        hit = np.flatnonzero((self.m_key == self.keys[key]) & (self.m_child >= 0))
        of = row[self.m_owner[hit]]
        hit, of = hit[of >= 0], of[of >= 0]
        last = np.full(len(boxes), -1)
        last[of] = self.m_child[hit]
        rows = np.flatnonzero(last >= 0)
        return last[rows], rows

    def inside(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All containers directly in ``boxes``, their box's row and their ordinal in it."""
        row = self._row_of(boxes)
        of = row[self.c_parent]
        of[self.c_parent < 0] = -1
        hit = np.flatnonzero(of >= 0)
        return hit, of[hit], self.c_ordinal[hit]

    def has(self, boxes: np.ndarray, key: str) -> np.ndarray:
        of = self._row_of(boxes)[self.m_owner[self.m_key == self.keys[key]]]
        out = np.zeros(len(boxes), bool)
        out[of[of >= 0]] = True
        return out

    def text(self, boxes: np.ndarray, path: tuple[str, ...]) -> pa.Array:
        """The value at ``path`` in each box, as text."""
        n, rows = len(boxes), np.arange(len(boxes))
        for key in path[:-1]:
            boxes, sub = self.by_key(boxes, key)
            rows = rows[sub]
        row = self._row_of(boxes)
        hit = np.flatnonzero(self.m_key == self.keys[path[-1]])
        of = row[self.m_owner[hit]]
        hit, of = hit[of >= 0], of[of >= 0]
        member = np.full(n, -1)
        member[rows[of]] = hit
        null = member < 0
        start, end = np.where(null, 0, self.m_start[member] if len(self.m_start) else 0), np.where(null, 0, self.m_end[member] if len(self.m_end) else 0)
        string = ~null & (self.buf[start] == 34) & (end - start >= 2)
        null = null | (~string & (end - start == 4) & (self.buf[start] == 110)) | (end <= start)
        start, end = start + string, end - string
        out = spans_to_strings(self.buf, start, end, null)
        if self.slashes is not None:
            coded = np.flatnonzero(string & (self.slashes[end] > self.slashes[start]))
            if len(coded):
                values = out.to_pylist()
                for j in coded:
                    try:
                        values[j] = json.loads('"' + values[j] + '"', strict=False).encode("utf-8", "replace").decode()
                    except ValueError:
                        pass
                out = pa.array(values, pa.string())
        return out


@dataclass(frozen=True)
class Way:
    """A way from a parent record to records: keys, or ``*`` for every object directly inside. Only from containers that are
    arrays (``array`` True) or objects (False), lack the key ``without`` and have one of the keys ``having``."""

    steps: tuple[str, ...]
    array: bool | None = None
    without: str | None = None
    having: tuple[str, ...] = ()


@dataclass(frozen=True)
class Level:
    """A level of records: the name of its ordinal column, ways to it, and its text fields (column -> key path).
    ``counts`` adds columns with the number of records that ways from here lead to."""

    ordinal: str | None
    ways: tuple[Way, ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    counts: tuple[tuple[str, tuple[Way, ...]], ...] = ()


@dataclass(frozen=True)
class NestedTable:
    """A flat table of the records of the last level, with ordinals and fields of the levels above."""

    levels: tuple[Level, ...]
    keys: list[str] = field(default_factory=list, hash=False, compare=False)

    def __post_init__(self) -> None:
        for level in self.levels:
            for way in [*level.ways, *(w for _, ws in level.counts for w in ws)]:
                self.keys.extend(k for k in (*way.steps, way.without, *way.having) if k and k != "*")
            for _, path in level.fields:
                self.keys.extend(path)

    def schema(self) -> list[T.StructField]:
        out = []
        for level in self.levels:
            out += [T.StructField(level.ordinal, T.IntegerType())] if level.ordinal else []
            out += [T.StructField(c, T.StringType()) for c, _ in level.fields] + [T.StructField(c, T.IntegerType()) for c, _ in level.counts]
        return out


def _go(ix: JsonIndex, boxes: np.ndarray, ways: tuple[Way, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    for way in ways:
        use = np.ones(len(boxes), bool)
        if way.array is not None:
            use &= ix.c_array[boxes] == way.array
        if way.without:
            use &= ~ix.has(boxes, way.without)
        if way.having:
            use &= np.any([ix.has(boxes, k) for k in way.having], axis=0)
        rows = np.flatnonzero(use)
        at, ordinal = boxes[rows], np.zeros(len(rows), np.int64)
        for step in way.steps:
            if step == "*":
                at, sub, ordinal = ix.inside(at)
            else:
                at, sub = ix.by_key(at, step)
                ordinal = ordinal[sub]
            rows = rows[sub]
        thing = ~ix.c_array[at] if way.steps else np.ones(len(at), bool)
        found.append((at[thing], rows[thing], ordinal[thing]))
    at, rows, ordinal = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((ordinal, rows))
    return at[order], rows[order], ordinal[order]


def extract(texts: list[str | None], spec: NestedTable) -> tuple[np.ndarray, list[pa.Array]]:
    """The records of ``spec`` in ``texts``: the text number of each and its columns."""
    ix = JsonIndex([unwrapped(t) for t in texts], spec.keys)
    boxes = ix.roots()
    columns: list[pa.Array] = []
    for level in spec.levels:
        boxes, rows, ordinal = _go(ix, boxes, level.ways)
        columns = [c.take(pa.array(rows)) for c in columns]
        if level.ordinal:
            columns.append(pa.array(ordinal.astype(np.int32)))
        columns += [ix.text(boxes, path) for _, path in level.fields]
        for _, ways in level.counts:
            columns.append(pa.array(np.bincount(_go(ix, boxes, ways)[1], minlength=len(boxes)).astype(np.int32)))
    return ix.c_doc[boxes], columns


@dataclass(frozen=True)
class Stage:
    """A batch-wise step fused behind ``flatten``: its output fields and its function from batch to batch."""

    fields: tuple[T.StructField, ...]
    run: Callable[[pa.RecordBatch], pa.RecordBatch]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most ``limit`` bytes in ``column``, a longer text alone."""
    size = np.asarray(pa.compute.binary_length(batch[column]).fill_null(0)).astype(np.int64) + 64
    total, at = np.cumsum(size), 0
    while at < len(size):
        done = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, done + limit, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def flatten(df: DataFrame, json_column: str, spec: NestedTable, carry: list[str], stage: Stage | None = None) -> DataFrame:
    """One row per record of ``spec`` in ``df[json_column]``, with the columns ``carry`` of its row. No shuffle.

    Only the named columns are read, so other columns of any name do no harm. ``stage`` is applied to the records of each
    chunk in the same pass, before they leave the worker; all records of a text are in one chunk, in order.
    """
    source = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(carry)], df[json_column].cast("string").alias("j"))
    fields = [T.StructField(c, df.schema[c].dataType) for c in carry] + spec.schema()
    inner = to_arrow_schema(T.StructType(fields))
    out = T.StructType(list(stage.fields)) if stage else T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "j"):
                doc, columns = extract(batch["j"].to_pylist(), spec)
                taken = [batch[f"c{i}"].take(pa.array(doc)) for i in range(len(carry))]
                made = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(taken + columns, inner, strict=True)], schema=inner)
                made = stage.run(made) if stage else made
                if made.num_rows:
                    yield made

    return source.mapInArrow(run, out)


__all__ = ["JsonIndex", "Level", "NestedTable", "Stage", "Way", "chunks", "extract", "flatten"]
