"""Nested readings as one row per stored list, with array columns: no shuffle, since a text's readings lie together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.operators.nested import NestedTable, Stage, flatten
from tidegrid.operators.spikes import numbers
from tidegrid.operators.timestamps import NO_TIME, OK, created_microseconds, parse_times
from tidegrid.operators.zones import current_version


def reading_lists(df: DataFrame, json_column: str, spec: NestedTable, carry: list[str], prices: list[str], text: str | None = None, kickoff: str | None = None) -> DataFrame:
    """``carry``, ``bookmaker`` and ``records``, an array of structs (t: epoch seconds or NULL, the prices, ``line``), per list.

    ``df`` has created_at, for times without a year. With ``kickoff``, a text column of ``df``, its epoch seconds are added, or
    where it is no instant the last reading's plus 15 minutes. A price that is no number is NULL. Texts without readings give no row.
    """
    own = [c for c in carry if c != "bookmaker"]
    wanted = dict.fromkeys([*(c for c in carry if c in df.columns), "created_at", json_column, *([kickoff] if kickoff else [])])
    source = df.select(*wanted, F.monotonically_increasing_id().alias("row"))
    record = T.StructType([T.StructField("t", T.DoubleType()), *[T.StructField(p, T.DoubleType()) for p in prices], *([T.StructField("line", T.StringType())] if text else [])])
    fields = [*[df.schema[c] for c in own], T.StructField("bookmaker", T.StringType()), *([T.StructField("kickoff", T.DoubleType())] if kickoff else []), T.StructField("records", T.ArrayType(record))]
    schema, version = to_arrow_schema(T.StructType(fields)), current_version()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, names = b.num_rows, b.schema.names
        row, seq = np.asarray(b["row"]), np.asarray(b["seq"])
        entry = np.asarray(b["entry_no"]) if "entry_no" in names else np.zeros(n, np.int64)
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (entry[1:] != entry[:-1]) | (seq[1:] <= seq[:-1])]) if n else np.zeros(0, np.int64)
        offsets = np.r_[head, n] if n else np.zeros(1, np.int64)
        created = created_microseconds(b["created_at"])
        status, epoch, _ = parse_times(b["time"], b["year"] if "year" in names else None, created, version=version)
        columns = [pa.array(epoch.astype(np.float64), mask=status != OK)]
        columns += [pa.array(x, mask=np.isnan(x)) for x in (numbers(b[p]) for p in prices)] + ([b[text].cast(pa.string())] if text else [])
        records = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, schema.field("records").type.value_type, strict=True)], fields=list(schema.field("records").type.value_type))
        at = pa.array(head)
        out = [*[b[c].take(at) for c in own], b["bookmaker"].take(at)]
        if kickoff:
            s, e, _ = parse_times(b[kickoff].take(at), None, created[head], version=version)
            last = np.maximum.reduceat(np.where(status == OK, epoch, NO_TIME), head) if n else np.zeros(0)
            out.append(pa.array(np.where(s == OK, e, last + 900).astype(np.float64), mask=(s != OK) & (last == NO_TIME)))
        made = [*out, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), records)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return flatten(source, json_column, spec, [c for c in source.columns if c != json_column], Stage(tuple(fields), run))
