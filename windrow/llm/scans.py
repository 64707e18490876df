"""Running folds of an associative operation along ordered groups of any size.

Rows are range partitioned and sorted by (group, order), so that a group may lie in many tasks.  Every task folds its own rows; of each
task only the totals of its first and last group, the only ones a neighbour may share, go to the driver (at most two rows a task), which
folds them into one carry a task.  Rows of a task's first group then take the carry in front.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from windrow.llm.common import stored


@dataclass(frozen=True)
class Fold:
    """An associative operation: ``lift`` makes a state of the values of ``inputs``, ``combine`` joins an earlier and a later state,
    ``encode`` gives a state's output values (None: the identity), ``decode`` reads them back; ``fields`` are their names and types."""

    inputs: tuple[str, ...]
    fields: tuple[tuple[str, str], ...]
    lift: Callable[..., Any]
    combine: Callable[[Any, Any], Any]
    encode: Callable[[Any], tuple]
    decode: Callable[[tuple], Any]
    identity: Any


#: running number of rows: 1, 2, ...
COUNT = Fold((), (("position", "long"),), lambda: 1, lambda a, b: a + b, lambda s: (s,), lambda t: t[0], 0)

_ROW, _FIRST, _LAST = 0, 1, 2


def running(df: DataFrame, group: str, order: Sequence[str], fold: Fold, name: str, descending: bool = False) -> DataFrame:
    """``df`` with ``<field>`` (the fold up to and with the row) and ``<field>_before`` (up to the row before) for every field.

    Groups are the values of ``group`` (null is a group), rows are ordered by the columns ``order``, which must decide the order of
    rows that differ.  The result is stored.  Empty input gives an empty result.
    """
    fields = [f for f, _ in fold.fields]
    before = [f + "_before" for f in fields]
    extra = ", ".join([*(f"{f} {t}" for f, t in fold.fields), *(f"{f}_before {t}" for f, t in fold.fields)])
    own = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema.fields], *T.StructType.fromDDL(extra).fields])
    schema = T.StructType([*own.fields, *T.StructType.fromDDL("_pid int, _opening boolean, _kind int").fields])
    arrow = to_arrow_schema(schema)
    width, columns = len(df.columns), df.columns

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        first: Any = None
        current: Any = None
        opening, state = True, fold.identity
        seen, opening_total = False, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            groups = batch.column(columns.index(group)).to_pylist()
            inputs = [batch.column(columns.index(c)).to_pylist() for c in fold.inputs]
            rows = list(zip(*inputs)) if inputs else [()] * len(groups)
            upto, ahead, opens = [], [], []
            for g, values in zip(groups, rows):
                if not seen:
                    seen, first, current = True, g, g
                elif g != current:
                    if opening:
                        opening, opening_total = False, state
                    current, state = g, fold.identity
                ahead.append(fold.encode(state))
                state = fold.combine(state, fold.lift(*values))
                upto.append(fold.encode(state))
                opens.append(opening)
            n = len(groups)
            arrays = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.columns)]
            arrays += [pa.array(list(v), arrow.field(width + i).type) for i, v in enumerate(zip(*[u + a for u, a in zip(upto, ahead)]))]
            arrays += [pa.array([pid] * n, pa.int32()), pa.array(opens, pa.bool_()), pa.array([_ROW] * n, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        if seen:
            ends = [(_FIRST, first, state if opening else opening_total)] + ([] if opening else [(_LAST, current, state)])
            empty = dict.fromkeys(arrow.names)
            yield pa.RecordBatch.from_pylist([empty | {group: g, "_pid": pid, "_opening": kind == _FIRST, "_kind": kind} | dict(zip(fields, fold.encode(s)))
                                              for kind, g, s in ends], schema=arrow)

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc() for c in order]
    dealt = df.repartitionByRange(parts, F.col(f"`{group}`"), *keys).sortWithinPartitions(F.col(f"`{group}`"), *keys)
    kept = stored(dealt.mapInArrow(local, schema), name)
    carry: dict[int, Any] = {}
    held: tuple | None = None
    ends = kept.where(F.col("_kind") > _ROW).select("_pid", "_kind", F.col(f"`{group}`").alias("_group"), *fields)  # two rows a task at most
    for row in sorted(ends.collect(), key=lambda r: (r["_pid"], r["_kind"])):
        state = fold.decode(tuple(row[f] for f in fields))
        if row["_kind"] == _FIRST and held is not None and held[0] == row["_group"]:
            carry[row["_pid"]] = held[1]
            state = fold.combine(held[1], state)
        held = (row["_group"], state)
    rows = kept.where(F.col("_kind") == _ROW)
    if not carry:
        return rows.select(*[f"`{f.name}`" for f in own])
    names = [f.name for f in own]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            front = [carry[p] for p in batch.column(len(names)).to_pylist()]
            out = {}
            for group_of in (fields, before):
                held = zip(*[batch.column(names.index(f)).to_pylist() for f in group_of])
                states = [fold.encode(fold.combine(c, fold.decode(t))) for c, t in zip(front, held)]
                out |= dict(zip(group_of, zip(*states))) if states else dict.fromkeys(group_of, ())
            arrays = [pa.array(list(out[f]), arrow.field(i).type) if f in out else batch.column(i).cast(arrow.field(i).type) for i, f in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([arrow.field(i) for i in range(len(names))]))

    cut = F.col("_opening") & F.col("_pid").isin(list(carry))
    moved = rows.where(cut).select(*[f"`{n}`" for n in names], "_pid").mapInArrow(carried, own)
    return rows.where(~cut).select(*[f"`{n}`" for n in names]).union(moved)
