"""Content manifests: size and digest per file, declared records in nested documents, classification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.functions.exprs import ColumnLike, col
from windrow.session import checkpoint, spread

#: stores whose files are read as streams; files of others come as one binary value each, of at most this size
STREAMED, MAX_BINARY_BYTES = ("", "file", "hdfs", "s3", "s3a", "gs"), 2_000_000_000
CHUNK_BYTES = 8 << 20


def stream_digest(path: str, chunk: int = CHUNK_BYTES) -> str:
    """SHA-256 of a file of any size, a chunk at a time.  ``path`` as Spark lists it: a scheme and the plain, unquoted path."""
    if path.startswith("file:") or "://" not in path:
        store, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    else:
        scheme, _, rest = path.partition("://")
        store, place = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{quote(rest)}")
    digest = hashlib.sha256()
    with store.open_input_stream(place, compression=None) as stream:
        while data := stream.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def describe_files(spark: SparkSession, paths: Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, size_bytes, modified, sha256) of all files below ``paths``.

    Spark lists the files.  Their content passes a digest as a stream inside the task that holds the path, so no file is a value and none is too
    large.  Only in stores that cannot be opened as streams a file is read as one binary value, and one above MAX_BINARY_BYTES has no digest.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(list(paths))
    own = ["path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified")]
    if not all(urlsplit(p).scheme in STREAMED for p in paths):
        small, large = F.col("length") <= MAX_BINARY_BYTES, F.col("length") > MAX_BINARY_BYTES
        return files.where(small).select(*own, F.sha2("content", 256).alias("sha256")).unionByName(files.where(large).select(*own, F.lit(None).cast("string").alias("sha256")))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row a file: what is read is never held
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([stream_digest(one.column(0)[0].as_py())])], names=["path", "size_bytes", "modified", "sha256"])

    listed = files.select(*own)
    return spread(listed, "path").mapInArrow(digests, T.StructType([*listed.schema.fields]).add("sha256", "string"))


def describe_texts(docs: DataFrame, path: Column, text: str) -> DataFrame:
    """(path, size_bytes, sha256) of texts held in a table, by their UTF-8 bytes; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return docs.select(path.alias("path"), F.octet_length(whole).cast("long").alias("size_bytes"), F.sha2(whole, 256).alias("sha256"))


def verify_manifest(declared: DataFrame, actual: DataFrame, path: str = "path") -> DataFrame:
    """Declared rows against found files: FOUND_HASH_MATCH, FOUND_HASH_MISMATCH, FOUND_UNDIGESTED (same size, no digest to compare),
    MISSING or UNDECLARED."""
    d = declared.select(F.col(path).alias("path"), F.col("size_bytes").alias("declared_size"), F.lower("sha256").alias("declared_sha256"), F.lit(True).alias("_d"))
    a = actual.select("path", "size_bytes", "sha256", F.lit(True).alias("_a"))
    out = d.join(a, "path", "full")
    same = (F.col("declared_size") == F.col("size_bytes")) & (F.col("declared_sha256") == F.col("sha256"))
    status = F.when(F.col("_a").isNull(), "MISSING").when(F.col("_d").isNull(), "UNDECLARED").when(
        F.col("sha256").isNull() & F.col("declared_size").eqNullSafe(F.col("size_bytes")), "FOUND_UNDIGESTED").when(F.coalesce(same, F.lit(False)), "FOUND_HASH_MATCH").otherwise("FOUND_HASH_MISMATCH")
    return out.withColumn("status", status).drop("_d", "_a")


def declared_records(documents: DataFrame, text: str, source: str) -> DataFrame:
    """(source, path, sha256, size) of every object with a path and a digest, at any depth of JSON documents.

    Documents are parsed to the variant type and unfolded level by level; a level only carries the containers that are
    left, so the work ends with the deepest document.
    """
    level = documents.select(F.col(source).alias("source"), F.try_parse_json(col(text)).alias("node"))
    level = level.where(F.col("node").isNotNull())
    found = None
    while True:
        hit = level.select(
            "source", F.expr("try_variant_get(node, '$.path', 'string')").alias("path"), F.lower(F.expr("try_variant_get(node, '$.sha256', 'string')")).alias("sha256"),
            F.expr("coalesce(try_variant_get(node, '$.size_bytes', 'bigint'), try_variant_get(node, '$.bytes', 'bigint'))").alias("size_bytes"))
        hit = hit.where(F.col("path").isNotNull() & F.col("sha256").isNotNull())
        found = hit if found is None else found.unionByName(hit)
        inner = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("node").outer())).select("source", F.col("value").alias("node"))
        inner = checkpoint(inner.where(F.expr("schema_of_variant(node)").rlike("^(OBJECT|ARRAY)<")))  # or each level would unfold all before it
        if inner.isEmpty():
            return found
        level = inner


def classify(files: DataFrame, registrations: DataFrame) -> DataFrame:
    """Status of found files by what any manifest says about them, and who registered them."""
    per = registrations.groupBy("path").agg(F.collect_set(F.struct("sha256", "size_bytes")).alias("_r"), F.sort_array(F.collect_set("source")).alias("registered_by"))  # manifests of one file
    out = files.join(per, "path", "left")
    match = F.exists("_r", lambda r: (r["sha256"] == F.col("sha256")) & (r["size_bytes"].isNull() | (r["size_bytes"] == F.col("size_bytes"))))
    status = F.when(F.col("_r").isNull(), "FOUND_UNREGISTERED").when(F.col("sha256").isNull(), "FOUND_UNDIGESTED").when(match, "FOUND_HASH_MATCH").otherwise("FOUND_HASH_MISMATCH")
    return out.withColumn("status", status).drop("_r")


def file_name(path: ColumnLike) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)
