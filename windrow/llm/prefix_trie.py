"""Trie of conversations by shared prefixes, its subtree totals by parallel tree contraction.

A prefix is addressed by a polynomial digest of its turns.  The digest is associative, so one conversation may be cut over many tasks
(see :mod:`windrow.llm.scans`); equal digests meet in a grouped count, which combines before its shuffle.

Subtree totals (:func:`subtree_sums`) alternate two steps until nothing is left: *compress* replaces every unary chain by one edge that
carries the chain's sum, found by pointer doubling in join rounds, and *rake* adds all leaves to their parents.  Contracted nodes are then
expanded again, the latest round first: a chain node's total is its sum down to the chain's end plus the end's total.  Each round leaves at
most half the nodes, so rounds grow with the logarithm of the table, whatever its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import stored
from windrow.llm.scans import COUNT, Fold, running

#: modulus (a Mersenne prime) and multiplier of the prefix digest
PRIME, FACTOR = 2**127 - 1, 0x5851F42D4C957F2D14057B7EF767814F % (2**127 - 1)
ROOT = bytes(16)
#: conversation ids a row of a joined id list holds
ID_CHUNK = 4096


def _chain() -> Fold:
    prime, factor = PRIME, FACTOR

    def combine(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return a[0] + b[0], (a[1] * pow(factor, b[0], prime) + b[1]) % prime

    return Fold(("digest",), (("depth", "long"), ("node", "binary")), lambda d: (1, 1 + int.from_bytes(d[:16], "big") % (prime - 1)), combine,
                lambda s: (s[0], s[1].to_bytes(16, "big")), lambda t: (t[0], int.from_bytes(t[1], "big")), (0, 0))


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that name a turn: the SHA-256 of the role's length, the role and the text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position from 1, digest, chars) of every row with a conv_id: by turn, null first, rows of one turn by digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.length(text).cast("long").alias("chars"))
    return running(rows, "conv_id", ["turn", "digest"], COUNT, "trie-turns").select("conv_id", "position", "digest", "chars")


def shared_starts(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as the first ``taken`` turns of conversation ``base`` and their own turns after their first ``taken``.

    Returns the rebuilt turns (conv_id, segment, position, digest, chars), to be ordered by segment and position, and (conv_id, depth) of every
    conversation, turnless ones included.  ``base`` and ``taken`` are expressions of conv_id; ``taken`` must be small.
    """
    convs = stored(turns.groupBy("conv_id").agg(F.max("position").alias("turns")).select("conv_id", "turns", base.alias("base"), taken.cast("long").alias("taken")), "trie-convs")
    most = convs.agg(F.max("taken")).first()[0] or 0
    heads = turns.where(F.col("position") <= most).select(F.col("conv_id").alias("base"), "position", "digest", "chars")
    borrowed = convs.join(heads, "base").where("position <= taken").select("conv_id", F.lit(0).alias("segment"), "position", "digest", "chars")
    own = turns.where(F.col("position") > taken).select("conv_id", F.lit(1).alias("segment"), "position", "digest", "chars")
    given = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("there"))
    depth = F.least("taken", F.coalesce("there", F.lit(0))) + F.greatest(F.col("turns") - F.col("taken"), F.lit(0))
    return borrowed.unionByName(own), convs.join(given, "base", "left").select("conv_id", depth.alias("depth"))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, from the empty root.

    ``turns``: conv_id, segment, position, digest, chars, ordered in a conversation by segment and position; ``lengths``: conv_id and depth (number
    of turns) of every conversation.  Returns node, parent (null for the root), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.  Empty input: no rows.  Digests stand for texts, so long texts cost no more than short ones.
    """
    path = running(turns, "conv_id", ["segment", "position"], _chain(), "trie-path")
    lengths = stored(lengths, "trie-lengths")
    grouped = path.groupBy("node", F.col("node_before").alias("parent"), "depth", "chars").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    top = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    first = stored(grouped.unionByName(top), "trie-nodes")
    children = first.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(first.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "trie-children")
    weights = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_sums(weights, "node", "parent", ["n_leaves", "saved_tokens"])
    at_end = path.select("conv_id", "depth", "node").join(lengths, ["conv_id", "depth"]).select("node", "conv_id")
    turnless = lengths.where("depth = 0").select(F.lit(ROOT).alias("node"), "conv_id")
    ends = listed_digest(at_end.union(turnless), "node", "conv_id")
    label = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    whole = nodes.join(totals, "node").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("sha256", F.lit(nothing)))
    return whole.join(label, "parent", "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def listed_digest(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, sha256): lower-case SHA-256 of a key's items (longs), ascending, in decimal, joined by commas.

    Items are joined in pieces of thousands where they lie after a range partition by (key, item); a key's pieces then pass one digest
    as a stream, so no list is ever held whole.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(key, pa.binary()), ("start", pa.int64()), ("piece", pa.string())])
        held: list[int] = []
        current = None
        out: list[tuple] = []

        def flush() -> None:
            if held:
                out.append((current, held[0], ",".join(map(str, held))))
                held.clear()

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != current or len(held) >= ID_CHUNK:
                    flush()
                    current = k
                held.append(i)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(rows.select(key, item), "trie-ends")
    cut = kept.repartitionByRange(parts, key, item).sortWithinPartitions(key, item).mapInArrow(pieces, f"{key} binary, start long, piece string")
    return cut.repartition(parts, key).sortWithinPartitions(key, "start").mapInArrow(stream_digest(","), "node binary, sha256 string").withColumnRenamed("node", key)


def stream_digest(separator: str):
    """Kernel over (key, order, piece) rows sorted by key and order: one SHA-256 per key of its pieces joined by ``separator``."""
    between = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            keys, found = [], []
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(2)):
                if digest is not None and k == current:
                    digest.update(between)
                else:
                    if digest is not None:
                        keys.append(current)
                        found.append(digest.hexdigest())
                    current, digest = k, hashlib.sha256()
                digest.update(piece.as_buffer())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(found, pa.string())], names=["node", "sha256"])
            kind = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()], pa.string())], names=["node", "sha256"])

    return run


def subtree_sums(nodes: DataFrame, id_column: str, parent_column: str, values: Sequence[str]) -> DataFrame:
    """(id, values): every value summed over the node's whole subtree, the node included.

    ``parent_column`` must give a forest (null: a root); a parent that is no node counts as none.  Works in join rounds on stored tables.
    """
    alive = nodes.select(F.col(id_column).alias("id"), F.col(parent_column).alias("up"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)], *[F.lit(0).cast("long").alias(f"e{k}") for k in range(len(values))])
    vs, es = [f"v{k}" for k in range(len(values))], [f"e{k}" for k in range(len(values))]
    raked: list[DataFrame] = []
    chains: list[DataFrame] = []
    # e: what the edge to the parent carries besides the node's total, the sum of the chain nodes it stands for
    kids = alive.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("kids"), F.min("id").alias("child"), *[F.sum(e).alias(f"c{e}") for e in es])
    state = stored(alive.join(kids, "id", "left"), "trie-state")
    while not state.isEmpty():
        unary = state.where("kids = 1")
        links = _compress(unary.select("id", F.col("child").alias("end"), *[(F.col(v) + F.col(f"c{e}")).alias(v) for v, e in zip(vs, es)]), vs)
        chains.append(links)
        below = unary.select(F.col("child").alias("id"))  # an only child is no top of a chain
        tops = unary.join(below, "id", "left_anti").select("id", F.col("up").alias("new_up"), *es).join(links, "id").select(
            F.col("end").alias("id"), "new_up", F.lit(True).alias("moved"), *[(F.col(e) + F.col(v)).alias(f"n{e}") for v, e in zip(vs, es)])
        branching = state.where("kids is null or kids > 1").select("id", "up", F.col("kids").isNull().alias("leaf"), *vs, *es).join(tops, "id", "left")
        contracted = stored(branching.select("id", F.when(F.col("moved"), F.col("new_up")).otherwise(F.col("up")).alias("up"), "leaf", *vs,
                                             *[F.when(F.col("moved"), F.col(f"n{e}")).otherwise(F.col(e)).alias(e) for e in es]), "trie-contracted")
        raked.append(contracted.where("leaf").select("id", *vs))
        # in one grouped pass over the children: the leaves' sums, and what the next round asks of the others
        given = contracted.where("up is not null").groupBy(F.col("up").alias("id")).agg(
            *[F.sum(F.when(F.col("leaf"), F.col(v) + F.col(e))).alias(f"g{v}") for v, e in zip(vs, es)], F.nullif(F.count_if(~F.col("leaf")), F.lit(0)).alias("kids"),
            F.min(F.when(~F.col("leaf"), F.col("id"))).alias("child"), *[F.sum(F.when(~F.col("leaf"), F.col(e))).alias(f"c{e}") for e in es])
        state = stored(contracted.where("not leaf").drop("leaf").join(given, "id", "left").select(
            "id", "up", *[(F.col(v) + F.coalesce(f"g{v}", F.lit(0))).alias(v) for v in vs], *es, "kids", "child", *[f"c{e}" for e in es]), "trie-state")
    totals = raked
    for links in reversed(chains):
        known = reduce(DataFrame.union, totals).select(F.col("id").alias("end"), *[F.col(v).alias(f"t{v}") for v in vs])
        totals = [*totals, stored(links.join(known, "end").select("id", *[(F.col(v) + F.col(f"t{v}")).alias(v) for v in vs]), "trie-expanded")]
    if not totals:
        return nodes.select(F.col(id_column), *[F.col(v) for v in values])
    return reduce(DataFrame.union, totals).select(F.col("id").alias(id_column), *[F.col(f"v{k}").alias(v) for k, v in enumerate(values)])


def _compress(links: DataFrame, sums: Sequence[str]) -> DataFrame:
    """(id, end, sums) of unary nodes: pointers to the only child, doubled until every one points at its chain's end.

    A pointer that has reached a node outside ``links`` is final; only the others are joined again, each against a different node.
    """
    final: list[DataFrame] = []
    open_ = links.withColumn("done", F.lit(False))
    while not open_.isEmpty():
        known = reduce(DataFrame.union, [*final, open_])
        target = known.select(F.col("id").alias("end"), F.col("end").alias("next"), F.col("done").alias("ended"), *[F.col(s).alias(f"n{s}") for s in sums])
        step = stored(open_.drop("done").join(target, "end", "left").select(
            "id", F.coalesce("next", "end").alias("end"), *[(F.col(s) + F.coalesce(f"n{s}", F.lit(0))).alias(s) for s in sums], F.coalesce("ended", F.lit(True)).alias("done")), "trie-links")
        final.append(step.where("done"))
        open_ = step.where("not done")
    return reduce(DataFrame.union, final).drop("done") if final else links


_CRC = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ord(c)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end, 4294967295::bigint), 4294967295::bigint)"""

SQL = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
         sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
  from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 100 as base, {_CRC.format("conv_id::varchar")} % 6 as h from (select distinct conv_id from turns)),
parts as (
  select c.conv_id, 0 as segment, t.pos, t.digest, t.chars from convs c join turns t on t.conv_id = c.base and t.pos <= c.h
  union all
  select c.conv_id, 1, t.pos, t.digest, t.chars from convs c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
paths as (
  select conv_id, row_number() over w as depth, string_agg(digest, ',') over w as node, chars from parts window w as (partition by conv_id order by segment, pos)),
steps as (select conv_id, 0 as depth, '' as node, 0 as chars from convs union all select conv_id, depth, node, chars from paths),
nodes as (select node, depth, max(chars) as chars, count(*) as n_convs, min(conv_id) as conv_id from steps group by node, depth),
lengths as (select conv_id, max(depth) as depth from steps group by conv_id),
ends as (select s.node, sha256(string_agg(s.conv_id::varchar, ',' order by s.conv_id)) as listed from steps s join lengths l on s.conv_id = l.conv_id and s.depth = l.depth group by s.node),
links as (select n.node, p.node as parent, p.conv_id as parent_conv_id from nodes n join steps s on s.conv_id = n.conv_id and s.depth = n.depth - 1 join nodes p on p.node = s.node),
children as (select parent as node, count(*) as n_children from links group by parent),
full_nodes as (select n.*, l.parent_conv_id, coalesce(c.n_children, 0) as n_children from nodes n left join links l on l.node = n.node left join children c on c.node = n.node),
sums as (select a.node, count(*) filter (b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.chars) as saved_tokens
         from full_nodes b join steps a on a.conv_id = b.conv_id and a.depth <= b.depth group by a.node)
select n.conv_id, n.depth::bigint as depth, n.parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.listed, sha256('')) as ends_sha256
from full_nodes n join sums s on s.node = n.node left join ends e on e.node = n.node"""
