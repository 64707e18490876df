"""Registered queries of the text operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm import byte_bpe, digest_index, harmonic_packing, kd_search, license_rules, line_templates, nb_linear, prefix_trie, secret_ledger, simhash_anchors, turn_repair, url_rules, warc
from windrow.llm.common import stored, table
from windrow.session import scratch_folder


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), exact=True)


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.read_ranks(ranks_path or tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(ids, ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kd_search.top_products(vectors, vectors.where("vec_id % 50 = 0"))


def op4_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), secret_ledger.BlobLedger.open(spark))
    kinds = [r.kind for r in secret_ledger.BASE]
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), *[number(k).alias(f"n_{k}") for k in kinds], F.sha2(secret_ledger.listed("spans", kinds), 256).alias("base_sha256"),
                        secret_ledger.listed("spans").alias("spans"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "confidence")


def op6_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(tokenizer_file("byte_bpe_50k.json"), "rb") as f:
        vocabulary = f.read()
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    return harmonic_packing.pack(docs, harmonic_packing.byte_bpe_tokens(vocabulary, ranks, public_tokenizers.PATTERN), end_id=0)


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nb_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nb_linear.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return model.score(docs).select("doc_id", nb_linear.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchors.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_index.exact_dedup(docs, digest_index.DigestIndex.open(spark), "documents")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    rebuilt, lengths = prefix_trie.shared_starts(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
    return prefix_trie.trie(rebuilt, lengths).drop("node", "parent")


def op12_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = stored(warc.read_archives(spark, path, payloads=False), "warc-records")
    captures = stored(warc.assemble(records), "warc-captures")
    page = captures.where("response is not null").select(
        "capture", F.regexp_extract(F.col("metadata")[0]["head"], r"page-id: (\d+|-\d+)", 1).try_cast("long").alias("page_id"), "response.kind", "response.payload_bytes", "response.payload_sha256")
    first = page.where("kind = 'response'").select(F.col("capture").alias("original"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_sha256").alias("digest"))
    again = page.where("kind = 'revisit'").join(warc.originals(captures), "capture").join(first, "original", "left").select("page_id", "bytes", "digest", F.lit("revisit"), "refers_to")
    whole = page.where("kind = 'response'").select("page_id", F.col("payload_bytes"), F.col("payload_sha256").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return whole.union(again)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn")).cast("binary")) % 20
    return turn_repair.repair(turn_repair.damaged(conversations, kind), conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_templates, op2_byte_bpe, op3_kd_trees, op4_blob_ledger, op5_url_rules, op6_harmonic, op7_license_rules, op8_nb_linear, op9_anchor_simhash, op10_digest_index, op11_prefix_trie, op12_warc_captures, op13_turn_repair)}

ORACLE_SQL: dict[str, str] = {
    "op1_line_templates": line_templates.SQL,
    "op3_kd_trees": kd_search.SQL,
    "op7_license_rules": license_rules.SQL,
    "op10_digest_index": digest_index.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_warc_captures": warc.SQL,
    "op13_turn_repair": turn_repair.SQL,
}
