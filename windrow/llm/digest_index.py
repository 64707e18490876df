"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a table of one row per digest.  New data is reduced to one candidate per digest, the digests the index already
holds are removed by a sort-merge anti-join, and the rest is appended.  Index and candidates are both bucketed and sorted by
digest, so the join moves no row of the index.  Texts are read once and never shuffled; only 32-byte digests are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import BLANK, stored, whole_text
from windrow.session import scratch_folder

SCHEMA = "digest binary, doc_id long, n_points long, batch string"


def normalised(text: Column) -> Column:
    """The text without the six ASCII white-space characters."""
    return F.regexp_replace(text, f"[{BLANK}]+", "")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, code points of the original text, SHA-256 of the normalised text as 32 bytes."""
    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_points"),
                       F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


def best(points: str = "n_points", doc_id: str = "doc_id") -> Column:
    """Aggregate: of a digest's rows the one with most code points, then the smallest id (null ids last)."""
    return F.min(F.struct((-F.col(points)).alias("_p"), F.col(doc_id).isNull().alias("_n"), F.col(doc_id).alias("_d")))


@dataclass(frozen=True)
class DigestIndex:
    """A bucketed, sorted Parquet table of digests that outlives the session.

    ``path`` lies in a folder all executors share.  Each ``append`` adds one file per bucket; ``compact`` returns to one file
    per bucket, which lets scans skip the sort as well as the shuffle.
    """

    spark: SparkSession
    path: str
    name: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """Attach to the index at ``path`` (made on first use).  The bucket count is part of an index and must stay the same."""
        path = path or scratch_folder(spark, "digest-index")
        buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS")
        return cls(spark, path, name, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option(
            "path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows whose digest the index does not hold: a sort-merge anti-join on the bucketing key."""
        return rows.join(self.rows().hint("merge").select("digest"), "digest", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add the best row of every digest that is new.  ``rows`` is the output of :func:`digests`.

        Digests present are left as they are: the document that came in an earlier batch stays.
        """
        candidates = rows.groupBy("digest").agg(best().alias("b")).select(
            "digest", F.col("b._d").alias("doc_id"), (-F.col("b._p")).alias("n_points"), F.lit(batch).alias("batch"))
        self._write(self.unseen(candidates), "append")

    def compact(self) -> DigestIndex:
        """Rewrite to one file per bucket at a new path (the old files stay until the caller removes them)."""
        other = DigestIndex.open(self.spark, scratch_folder(self.spark, "digest-index"), self.buckets)
        other._write(self.rows(), "append")
        return other

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """Each row with the document that stays for its digest, the size of its group within ``rows``, and whether it stays.

        Of rows that repeat the id of the one that stays all are marked kept when their lengths agree too, for nothing tells
        them apart.
        """
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        # stored, so that a digest with many rows meets it in a join whose large partitions Spark splits
        keep = stored(sizes.join(self.rows().select("digest", F.col("doc_id").alias("keep_id"), F.col("n_points").alias("_kp")), "digest"), "kept-digests")
        return rows.join(keep, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("_kp"))).drop("_kp")


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deduplicate ``docs`` against ``index`` and append what is new.

    Returns one row per input row: doc_id, keep_id, group_size (rows of this batch with the same normalised text), kept,
    text_sha256.  Null texts count as empty, and empty texts form one group.  Null ids lose against others and are reported
    as null.  An empty table gives an empty result and leaves the index unchanged.  Other columns are not read.
    """
    rows = stored(digests(docs, id_column, text_column), "digests")
    index.append(rows, batch)
    return index.verdicts(rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB's form over ``documents``
SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
