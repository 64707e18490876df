"""Harmonic packing of token streams into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class j holds lengths in (C / (j + 1), C / j], and each of its bins takes exactly j
pieces.  Long documents are cut where that fills bins exactly: whole capacities, then halves, quarters, eighths and so on; what is
left, below the smallest such cut, goes to its class as it is.  Every task cuts and numbers its own pieces; the counts of each task
and class then give every task its place in the class, so bins fill across tasks without a piece being moved or ordered anew.  Only
the last bin of a class can lack pieces; those, at most a fixed number whatever the input, are packed by first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.common import slices, stored, whole_text

CAPACITY, SMALLEST_CUT = 1024, 64
PIECE = "shard int, class int, place long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def cuts(total: int, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities, then at most one half, quarter, ... down to ``smallest``,
    then the rest."""
    out = [(s, capacity) for s in range(0, total - capacity + 1, capacity)]
    at, size = len(out) * capacity, capacity // 2
    while size >= smallest and at < total:
        if total - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    if at < total:
        out.append((at, total - at))
    return out


def pieces(docs: DataFrame, tokens: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int, capacity: int, smallest: int, id_column: str, text_column: str) -> DataFrame:
    """One row per piece with its task (shard), class and place among the task's pieces of that class.

    ``tokens()`` is called once in a task and returns a function from texts to arrays of ids; ``end_id`` follows every document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), tokens()
        used = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "_t", 2 << 20):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column("_t").to_pylist()), strict=True):
                data = np.append(ids, end_id).astype("<u4")
                for start, length in cuts(len(data), capacity, smallest):
                    j = capacity // length
                    rows.append((shard, j, int(used[j]), doc, start, length, zlib.crc32(data[start:start + length]), len(data)))
                    used[j] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in PIECE.split(", ")])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("_t")).mapInArrow(run, PIECE)


def first_fit(rows: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Bins of the pieces no full bin took, longest first, each into the first bin with room; ``place`` becomes the order."""
    table = pa.Table.from_batches(list(rows))
    if not table.num_rows:
        return
    table = table.sort_by([("length", "descending"), ("class", "ascending"), ("place", "ascending")])
    room, bins = [], []
    for length in table.column("length").to_pylist():
        b = next((i for i, r in enumerate(room) if r >= length), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= length
        bins.append(b)
    table = table.append_column("bin", pa.array(bins, pa.int64())).set_column(table.schema.get_field_index("place"), "place", pa.array(range(len(bins)), pa.int64()))
    yield from table.to_batches()


def pack(docs: DataFrame, tokens: Callable[[], Callable[[list[str]], list[np.ndarray]]], end_id: int = 0, capacity: int = CAPACITY, smallest: int = SMALLEST_CUT, id_column: str = "doc_id",
         text_column: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document, its end id included, lies in exactly one piece, and the pieces of a sequence stand without a gap from
    offset 0.  A null or empty text is a document of the end id alone.  Null ids and repeated rows are documents of their own.
    An empty table gives no piece.  Class j has sequence ids bin * (capacity + 1) + j; the first-fit bins are class 0.  The packing
    is lossless but its order follows the input's partitions.
    """
    own = stored(pieces(docs, tokens, end_id, capacity, smallest, id_column, text_column), "pieces")
    counts = stored(own.groupBy("class", "shard").agg(F.count(F.lit(1)).alias("n")), "piece-counts")  # a row per task and class
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))  # at most one row per class, capacity rows
    placed = own.join(bases, ["class", "shard"]).join(F.broadcast(totals), "class").withColumn("place", F.col("base") + F.col("place")).withColumn("bin", F.expr("place div class"))
    full = F.expr("bin < total div class")
    columns = ["class", "place", "bin", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    open_bins = placed.where(~full).select(*columns[:2], *columns[3:])
    kind = "class int, place long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, bin long"
    rest = open_bins.repartition(1).mapInArrow(lambda rows: first_fit(rows, capacity), kind).withColumn("class", F.lit(0))
    together = placed.where(full).select(*columns).unionByName(rest.select(*columns)).withColumn("sequence_id", F.col("bin") * (capacity + 1) + F.col("class"))
    in_order = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity pieces
    return together.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id",
                           F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long").alias("offset"))


def byte_bpe_tokens(vocabulary: bytes, ranks: dict[bytes, int] | None, pattern: str) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Ids by a tokenizers file given as its bytes.

    ``ranks``, if given, is the same vocabulary as a rank table: texts of ASCII and Latin letters that hold none of the file's added tokens, on
    which both libraries split alike, then go through the quicker rank encoder and all others through the tokenizers file.
    """

    def start() -> Callable[[list[str]], list[np.ndarray]]:
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        full = Tokenizer.from_str(vocabulary.decode())
        added = [re.escape(t["content"]) for t in json.loads(vocabulary).get("added_tokens") or []]
        other = re.compile("|".join(["[^\x00-\x1b\x20-\x7fÀ-ɏ]", *added])).search
        if ranks is None:
            return lambda texts: [np.array(e.ids, np.uint32) for e in full.encode_batch(texts, add_special_tokens=False)]
        import tiktoken

        quick = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.array(full.encode(t, add_special_tokens=False).ids, np.uint32) if other(t) else quick.encode_to_numpy(t, disallowed_special=()) for t in texts]

    return start
