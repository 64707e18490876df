"""Helpers the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.session import scratch_folder

#: the six ASCII white-space characters every contract names, as a regular-expression class body
BLANK = r"\x20\x09-\x0D"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to the shared folder and read it back: later steps neither recompute it nor depend on executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_column: str, text: Column) -> list[Column]:
    """Columns that tell rows apart: the id and a digest of the text (rows equal in both get equal results)."""
    return [F.col(id_column), F.xxhash64(text).alias("_h")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``budget`` bytes of ``column`` (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)
