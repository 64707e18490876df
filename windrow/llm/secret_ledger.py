"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its content.  The ledger holds which (blob, rule, version) pairs were
scanned and what they gave.  An update reads digests only, takes the pairs the ledger lacks, fetches one text for each such blob,
scans it under the rules it lacks and appends; findings are joined back to all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import fresh, slices, stored, whole_text
from windrow.session import scratch_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches are leftmost and do not overlap; one whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1


#: fixed values: the base kinds in their order, then the kinds the ledger adds
BASE = (
    Rule("assign", r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE + ADDED

#: what a text must hold for a pattern to match; RE2 looks for it over a whole Arrow batch before a rule visits single texts
HINTS = dict(zip((r.pattern for r in RULES), (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}", r"-----BEGIN ", r"gh[pousr]_", r"xox[abprs]-", r"eyJ", r"://"), strict=True))


def spans(rule: Rule, text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the rule's findings, in code points."""
    if rule.pattern == BASE[2].pattern:  # whole runs of the class: short ones need not be visited
        found = re.finditer(r"[0-9a-f]{%d,}" % rule.least, text)
    else:
        found = re.finditer(rule.pattern, text)
    for m in found:
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def scan(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, kinds, text) to (blob, rule, version, findings): one row for each rule named in ``kinds``, findings as start, end.

    Rows of one blob within a task are scanned once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            fresh_rows = [i for i, b in enumerate(batch.column("blob").to_pylist()) if not (b in seen or seen.add(b))]
            batch = batch if len(fresh_rows) == batch.num_rows else batch.take(pa.array(fresh_rows, pa.int64()))
            blobs, kinds, text = batch.column("blob"), batch.column("kinds"), batch.column("text")
            wanted = [set(k) for k in kinds.to_pylist()]
            for rule in rules:
                hint = HINTS.get(rule.pattern)
                maybe = pc.match_substring_regex(text, hint).to_pylist() if hint else [True] * len(wanted)
                own = [i for i, k in enumerate(wanted) if rule.kind in k]
                found = [[{"start": a, "end": b} for a, b in spans(rule, text[i].as_py())] if maybe[i] else [] for i in own]
                yield pa.RecordBatch.from_arrays(
                    [blobs.take(pa.array(own, pa.int64())), pa.array([rule.kind] * len(own), pa.string()), pa.array([rule.version] * len(own), pa.int32()),
                     pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["blob", "rule", "version", "findings"])

    return texts.select("blob", "kinds", "text").mapInArrow(run, "blob binary, rule string, version int, findings array<struct<start:long,end:long>>")


@dataclass(frozen=True)
class BlobLedger:
    """Append-only Parquet table (blob, rule, version, findings) in a folder all executors share."""

    spark: SparkSession
    path: str

    SCHEMA = "blob binary, rule string, version int, findings array<struct<start:long,end:long>>"

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> BlobLedger:
        ledger = cls(spark, path or scratch_folder(spark, "blob-ledger"))
        spark.createDataFrame([], cls.SCHEMA).write.mode("append").parquet(ledger.path)
        return ledger

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    @staticmethod
    def address(docs: DataFrame, path_column: str, text_column: str) -> DataFrame:
        """(path, blob) for every row: all versions, copies and repeated rows."""
        return docs.select(F.col(path_column).alias("path"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("blob"))

    def update(self, docs: DataFrame, addresses: DataFrame, rules: Sequence[Rule], path_column: str, text_column: str) -> None:
        """Scan each blob of ``docs`` under the rules whose present version it has not been scanned under, and append.

        One row stands for a blob: its smallest path.  Rows that agree in path and blob meet in one task and are scanned once.
        """
        current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
        done = self.rows().groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
        blobs = addresses.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left")
        missing = F.when(F.col("done").isNull(), current).otherwise(F.array_except(current, "done"))
        todo = blobs.select("path", "blob", F.transform(missing, lambda x: x["rule"]).alias("kinds")).where(F.size("kinds") > 0)
        texts = docs.select(F.col(path_column).alias("_p"), F.unhex(F.sha2(whole_text(text_column), 256)).alias("_b"), whole_text(text_column).alias("text"))
        met = texts.join(todo.hint("shuffle_hash"), F.col("_p").eqNullSafe(F.col("path")) & (F.col("_b") == F.col("blob")))
        scan(met, rules).write.mode("append").parquet(self.path)

    def findings(self, rules: Sequence[Rule]) -> DataFrame:
        """(blob, spans) of blobs with a finding under the present version of a rule; spans hold start, order, kind, end, sorted."""
        versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        hits = self.rows().where((F.size("findings") > 0) & (versions[F.col("rule")] == F.col("version")))
        one = hits.select("blob", F.explode("findings").alias("f"), "rule").select("blob", F.struct("f.start", order[F.col("rule")].alias("order"), F.col("rule").alias("kind"), "f.end").alias("s"))
        return one.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def secret_scan(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, path_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Bring the ledger up to date with ``docs`` and return (path, blob, spans) for every row of it.

    spans: array of (start, order, kind, end), sorted; code points, end exclusive; empty if nothing was found.  Null texts count
    as empty.  Null and repeated paths keep their rows.  Texts are scanned whole.  An empty table leaves the ledger as it is.
    """
    addresses = stored(BlobLedger.address(docs, path_column, text_column), "blob-addresses")
    ledger.update(docs, addresses, rules, path_column, text_column)
    found = addresses.join(ledger.findings(rules), "blob", "left")
    return found.select("path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")).alias("spans"))


def listed(spans_column: str, kinds: Sequence[str] | None = None):
    """kind:start:end of the spans, comma-joined."""
    own = F.col(spans_column) if kinds is None else F.filter(spans_column, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: BlobLedger, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; overlapping findings become one.  Rows without findings are unchanged.

    Findings are joined to rows by blob, so all copies and versions are treated alike.
    """
    addresses = stored(BlobLedger.address(docs, id_column, text_column), "blob-addresses")
    ledger.update(docs, addresses, rules, id_column, text_column)
    own, other, found = fresh(docs, "_blob", "_other", "_spans")
    hits = ledger.findings(rules).select(F.col("blob").alias(other), F.col("spans").alias(found))
    keyed = docs.withColumn(own, F.unhex(F.sha2(whole_text(text_column), 256)))
    joined = keyed.join(hits.hint("shuffle_hash"), F.col(own) == F.col(other), "left")
    # walk the sorted spans with the text built so far and the place reached
    text = F.col(text_column)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    step = F.aggregate(found, start, lambda a, s: F.struct(
        F.concat(a["done"], F.when(s["start"] < a["at"], "").otherwise(F.concat(text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))).alias("done"),
        F.greatest(a["at"], s["end"]).alias("at")), lambda a: F.concat(a["done"], text.substr((a["at"] + 1).cast("int"), F.length(text))))
    return joined.select(*[F.when(F.col(found).isNull(), text).otherwise(step).alias(c) if c == text_column else F.col(c) for c in docs.columns])
