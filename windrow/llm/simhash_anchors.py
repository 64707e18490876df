"""SimHash near-duplicates by anchor-point covering.

Two blocks of 31 bits of the 64-bit fingerprint carry the perfect [31, 26] Hamming code as anchors: every block value lies within
covering radius 1 of a code word.  Of three differing bits one block holds at most one (two bits belong to no block), so the
threshold within a block is 1, and a fingerprint is replicated to every code word within radius + threshold = 2 of its block: 1 or
16 anchors a block.  Linked fingerprints then meet at an anchor.  Exact copies are merged before: anchors see distinct
fingerprints only.  At an anchor only a spanning forest of the links is emitted, never the pairs, and anchors with many
fingerprints are cut in cells, each comparing two bounded chunks.  Components come from star contraction, all in tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import fresh, slices, stored, whole_text
from windrow.session import spread

BLOCK_BITS, BLOCK_RADIUS = 31, 1
SEED = 42
CHUNK = 4096

#: near copies: fingerprints a document (two blocks each), least similarity they are laid out for, cells up to this size compare all pairs at once
FINGERPRINTS, LEAST_SIMILARITY, ALL_PAIRS = 6, 0.8, 32
FINGERPRINT_NAMES, LEAST_NAMES = [f"f{k}" for k in range(FINGERPRINTS)], [f"m{k}" for k in range(2 * FINGERPRINTS)]


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint (a signed long holding 64 bits) of the word shingles of whole texts, A-Z lower-cased.

    A bit is 1 if it is set in over half the shingles' XXH64 values; repeats count.  Fewer words than a shingle: the whole
    sequence; no word: zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from functools import partial

        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=SEED)
        weights = (np.uint64(1) << np.arange(64, dtype=np.uint64))
        for batch in slices(batches, "_t"):
            out = np.zeros(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column("_t").cast(pa.binary())):
                own = text.as_py().lower().split()
                if not own:
                    continue
                votes, total = np.zeros(64, np.int64), max(1, len(own) - words + 1)
                for at in range(0, total, 1 << 16):  # very long texts in blocks
                    block = own[at:at + (1 << 16) + words - 1]
                    n = max(1, len(block) - words + 1)
                    parts = map(b" ".join, zip(*(block[k:] for k in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
                    h = np.fromiter(map(digest, parts), np.uint64, n)
                    votes += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
                out[i] = np.bitwise_or.reduce(weights[votes * 2 > total], initial=np.uint64(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("_t")).mapInArrow(run, "doc_id long, fp long")


def code_word_offsets() -> list[np.ndarray]:
    """For every syndrome the bit patterns that lead from a value to the code words within distance 2.

    Position p (1 to 31) contributes p to the syndrome.  Syndrome 0: the value itself; syndrome s: the flip of s and the 15
    pairs of positions whose exclusive or is s.
    """
    out = [np.zeros(1, np.uint64)]
    for s in range(1, 1 << 5):
        pairs = [(1 << (a - 1)) | (1 << ((a ^ s) - 1)) for a in range(1, 32) if a < a ^ s]
        out.append(np.array([1 << (s - 1), *pairs], np.uint64))
    return out


def anchors_of(fps: np.ndarray, blocks: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Row number and anchor (block number above 31 code-word bits) of every replica of the fingerprints."""
    offsets, rows, found = code_word_offsets(), [], []
    masks = [np.uint64(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)) for k in range(5)]
    for block in range(blocks):
        x = (fps >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
        syndrome = np.zeros(len(x), np.int64)
        for k, mask in enumerate(masks):
            syndrome |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
        for s in range(32):
            at = np.flatnonzero(syndrome == s)
            if len(at):
                rows.append(np.repeat(at, len(offsets[s])))
                found.append(((x[at, None] ^ offsets[s][None, :]) | np.uint64(block << BLOCK_BITS)).ravel())
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def forest(fps: np.ndarray, threshold: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the link graph of distinct fingerprints: (member, root) for every member that is not a root."""
    members, roots = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root])
        while len(frontier) and len(left):
            near = (np.bitwise_count(fps[left][None, :] ^ fps[frontier[:block]][:, None]) <= threshold).any(axis=0)
            members.append(left[near])
            roots.append(np.full(near.sum(), root))
            frontier = np.concatenate([frontier[block:], left[near]])
            left = left[~near]
    if not members:
        return np.zeros(0, fps.dtype), np.zeros(0, fps.dtype)
    return fps[np.concatenate(members)], fps[np.concatenate(roots)]


def links(distinct: DataFrame, threshold: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``distinct.fp`` within ``threshold`` (at most 3) bits."""
    if not 0 <= threshold <= 2 * BLOCK_RADIUS + 1:
        raise ValueError("the two blocks cover thresholds up to 3")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fps = batch.column("fp").slice(at, 1 << 14).to_numpy().view(np.uint64)
                rows, anchor = anchors_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fps[rows].view(np.int64))], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(cell: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
            ends = np.r_[starts[1:], len(cell)]
            two = starts[ends - starts == 2]  # most cells: compared side by side
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= threshold]
            a, b = [fps[near]], [fps[near + 1]]
            for i, j in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                member, root = forest(fps[i:j], threshold)
                a.append(member)
                b.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        cell, fps = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)  # the last cell, which may go on in the next batch
        for batch in batches:
            cell = np.concatenate([cell, np.column_stack([batch.column(c).to_numpy() for c in ("anchor", "lo", "hi")])])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if len(cell):
                last = int(np.flatnonzero((cell != cell[-1]).any(axis=1)).max(initial=-1)) + 1
                if last:
                    yield from edges(cell[:last], fps[:last])
                cell, fps = cell[last:], fps[last:]
        if len(cell):
            yield from edges(cell, fps)

    replicas = distinct.select("fp").mapInArrow(replicate, "anchor long, fp long")
    sizes = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    # the plan takes the replicas, up to 32 a fingerprint, for no larger than the fingerprints: neither side may be broadcast on its word
    met = replicas.hint("merge").join(sizes, "anchor").withColumns({"c": parts, "mine": F.pmod(F.xxhash64("fp", "anchor"), parts).cast("int")})
    cells = met.select("anchor", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other")).select(
        "anchor", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp").select(*[F.col(c).cast("long") for c in ("anchor", "lo", "hi", "fp")])
    dealt = cells.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi", "fp")
    return dealt.mapInArrow(compare, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root): the smallest node each node of the graph reaches, by alternating large-star and small-star steps.

    Every step is a grouped minimum, written to the shared folder, and a join with it: both sides of the join are then plain
    shuffles, so a hub's neighbours are split like any skewed key.  Ends when a round changes nothing.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the smallest doc_id reachable by links, its own included).

    Null and empty texts have fingerprint zero and are linked like any other.  Null ids are kept as rows and are never a
    component's name unless all its ids are null.  Repeated rows give repeated results.  Other columns are not read.
    """
    marks = stored(fingerprints(docs, words, id_column, text_column), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct, threshold, chunk))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(named.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id names a component: one document of each group stays.

    Rows that share an id are one document.  Rows without an id stay only where no linked row has one.
    """
    found = near_duplicates(docs, words, threshold, id_column, text_column)
    [key] = fresh(docs, "_k")
    names = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(names.hint("shuffle_hash"), F.col(id_column).cast("long").eqNullSafe(F.col(key)), "left_semi")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles, A-Z lower-cased.  Fewer words than a shingle: the whole sequence; no word: none."""
    from functools import partial

    import xxhash

    own = text.lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    digest, found = partial(xxhash.xxh64_intdigest, seed=SEED), []
    for at in range(0, max(1, len(own) - words + 1), 1 << 16):  # very long texts in blocks
        block = own[at:at + (1 << 16) + words - 1]
        parts = map(b" ".join, zip(*(block[k:] for k in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
        found.append(np.unique(np.fromiter(map(digest, parts), np.uint64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def min_hash_bits(hashes: np.ndarray, multipliers: np.ndarray, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """FINGERPRINTS values of 62 bits, and for each of their blocks of 31 bits the least value its first bit comes from.

    Bit k is the parity of the least of hashes * multipliers[k], so two sets differ in it with chance (1 - similarity) / 2.
    """
    if not len(hashes):
        return np.zeros(FINGERPRINTS, np.uint64), np.zeros(2 * FINGERPRINTS, np.uint64)
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), tile):
        np.minimum(least, (multipliers[:, None] * hashes[None, at:at + tile]).min(axis=1), out=least)
    bits = (np.bitwise_count(least) & 1).astype(np.uint64).reshape(FINGERPRINTS, 2 * BLOCK_BITS)
    return np.bitwise_or.reduce(bits << np.arange(2 * BLOCK_BITS, dtype=np.uint64), axis=1), least[::BLOCK_BITS]


def set_sketches(docs: DataFrame, words: int, id_column: str, text_column: str) -> DataFrame:
    """Per row doc_id, h (digest of the text), s (digest of the set of shingles), the fingerprints f0, f1, ... and the blocks' least values m0, m1, ..."""
    names = [*FINGERPRINT_NAMES, *LEAST_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        multipliers = np.random.default_rng(SEED).integers(0, 1 << 63, FINGERPRINTS * 2 * BLOCK_BITS, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches, "_t"):
            n = batch.num_rows
            sets, out, least = np.zeros(n, np.uint64), np.zeros((n, FINGERPRINTS), np.uint64), np.zeros((n, 2 * FINGERPRINTS), np.uint64)
            for i, text in enumerate(batch.column("_t").cast(pa.binary())):
                hashes = shingle_hashes(text.as_py(), words)
                sets[i] = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                out[i], least[i] = min_hash_bits(hashes, multipliers)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(sets.view(np.int64)), *[pa.array(x.copy().view(np.int64)) for x in (*out.T, *least.T)]],
                                             names=["doc_id", "h", "s", *names])

    text = whole_text(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("_t")).mapInArrow(
        run, "doc_id long, h long, s long, " + ", ".join(f"{n} long" for n in names))


def near_pairs(fps: np.ndarray, limit: int, all_pairs: int = ALL_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of rows within ``limit`` bits: every pair of a small cell, the edges of a minimum spanning tree of a large one.

    The tree's path between two near rows has no step longer than the two rows are apart, so it joins them at every limit of bits.
    """
    n = len(fps)
    if n <= all_pairs:
        apart = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2, dtype=np.int64)
        return np.nonzero(np.triu(apart <= limit, 1))
    best, parent, left, at, found = np.full(n, 1 << 30), np.zeros(n, np.int64), np.arange(1, n), 0, []
    while len(left):
        apart = np.bitwise_count(fps[left] ^ fps[at]).sum(axis=1, dtype=np.int64)
        closer = apart < best[left]
        best[left[closer]], parent[left[closer]] = apart[closer], at
        k = int(np.argmin(best[left]))
        at, left = left[k], np.delete(left, k)
        if best[at] <= limit:
            found.append(at)
    return parent[found], np.array(found, np.int64)


def foreign_pairs(fps: np.ndarray, labels: np.ndarray, limit: int, tile: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of rows of different labels within ``limit`` bits, a tile of rows at a time."""
    for at in range(0, len(fps), tile):
        apart = np.bitwise_count(fps[at:at + tile, None] ^ fps[None, at:]).sum(axis=2, dtype=np.int64)
        one, other = np.nonzero((apart <= limit) & (labels[at:at + tile, None] != labels[None, at:]))
        ahead = one < other
        yield one[ahead] + at, other[ahead] + at


def cell_members(distinct: DataFrame, chunk: int) -> DataFrame:
    """(anchor, n, part, s): the sets of ``distinct`` at every anchor that more than one of them has, in parts of about ``chunk``.

    An anchor is a block of a fingerprint, a code word near it and the block's least value.  Least values are matched first: only sets that
    share one with another set are replicated to code words at all, so meetings by chance do not grow with the square of the sets.
    """
    mask = F.lit((1 << BLOCK_BITS) - 1)
    own = [F.struct(F.xxhash64(F.lit(k), m).alias("g"), F.shiftright(f"f{k // 2}", k % 2 * BLOCK_BITS).bitwiseAND(mask).alias("x")) for k, m in enumerate(LEAST_NAMES)]
    blocks = stored(distinct.select("s", F.explode(F.array(*own)).alias("block")).select("s", "block.*"), "set-blocks")
    shared = blocks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    met = blocks.join(shared, "g")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                g, s = (part.column(c).to_numpy() for c in ("g", "s"))
                rows, anchor = anchors_of(part.column("x").to_numpy().view(np.uint64), 1)
                yield pa.RecordBatch.from_arrays([pa.array(g[rows]), pa.array(anchor.view(np.int64)), pa.array(s[rows])], names=["g", "word", "s"])

    replicas = stored(spread(met).mapInArrow(replicate, "g long, word long, s long").select(F.xxhash64("g", "word").alias("anchor"), "s"), "set-anchors")
    sizes = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    return replicas.join(sizes, "anchor").select("anchor", "n", F.pmod(F.xxhash64("s", "anchor"), parts).cast("int").alias("part"), "s")


def in_cells(cells: DataFrame, keys: list[str], distinct: DataFrame, pairs: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], labels: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of ``s`` that ``pairs(fingerprints, labels)`` gives for the sets of each cell, named by the columns ``keys``."""
    names = FINGERPRINT_NAMES
    known = distinct.select("s", *names)
    known = known.withColumn("label", F.lit(0).cast("long")) if labels is None else known.join(labels, "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: np.ndarray, s: np.ndarray, label: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(axis=1)])
            a, b, held = [], [], 0
            for i, j in zip(starts, np.r_[starts[1:], len(cell)], strict=True):
                if j - i < 2:
                    continue
                for one, other in pairs(fps[i:j], label[i:j]):
                    a.append(s[i:j][one])
                    b.append(s[i:j][other])
                    held += len(one)
                    if held > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])
                        a, b, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        width = len(keys)
        held = np.zeros((0, width + 2 + FINGERPRINTS), np.int64)  # the last cell may go on in the next batch
        for batch in batches:
            held = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in (*keys, "s", "label", *names)])])
            if len(held):
                last = int(np.flatnonzero((held[:, :width] != held[-1, :width]).any(axis=1)).max(initial=-1)) + 1
                if last:
                    yield from found(held[:last, :width], held[:last, width], held[:last, width + 1], held[:last, width + 2:].view(np.uint64))
                held = held[last:]
        if len(held):
            yield from found(held[:, :width], held[:, width], held[:, width + 1], held[:, width + 2:].view(np.uint64))

    dealt = cells.join(known, "s").select(*[F.col(k).cast("long").alias(k) for k in keys], "s", "label", *names).repartition(*keys).sortWithinPartitions(*keys, "s")
    return dealt.mapInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_pairs(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, similarity: float, text_column: str) -> DataFrame:
    """The pairs whose sets of shingles, built anew from the texts, have Jaccard similarity ``similarity`` or more."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            sets = [shingle_hashes(x.as_py(), words).tobytes() for x in batch.column("_t").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(sets, pa.binary())], names=["s", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= similarity * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    asked = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    wanted = stored(distinct.join(asked, "s", "left_semi").select("h", "s"), "near-copy-texts")
    text = whole_text(text_column)
    found = docs.select(F.xxhash64(text).alias("h"), text.alias("_t")).join(wanted, "h").groupBy("s").agg(F.min("_t").alias("_t"))
    sets = stored(found.mapInArrow(build, "s long, hashes binary"), "near-copy-sets")
    one = pairs.join(sets.select(F.col("s").alias("a"), F.col("hashes").alias("x")), "a")
    return one.join(sets.select(F.col("s").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id reached over pairs of that Jaccard similarity of word shingles).

    Candidates come from anchor covering: six fingerprints of one-bit minima, so twelve blocks, each with the least value of its first minimum.  A
    pair meets in a block if the least values are equal and the block differs in two bits, in three at times: at similarity 0.8 with
    chance 0.36, in any of twelve with chance 0.995, from 0.85 up with over 0.9999.  Every candidate is then checked on the sets themselves, so
    none below ``similarity`` is linked.  Equal sets are one; texts without a word are equal.

    Two passes give the components of all candidates without forming all pairs of a large cell.  The first checks all pairs of small cells and
    a spanning tree of each part of a large one.  The second checks, in the large cells, all pairs that the first has left in different
    components; cells whose sets are one component by then, as those of many copies are, need none.
    """
    if not LEAST_SIMILARITY <= similarity <= 1:
        raise ValueError(f"the blocks cover similarities from {LEAST_SIMILARITY}")
    n, p = FINGERPRINTS * 2 * BLOCK_BITS, (1 - similarity) / 2
    limit = int(np.ceil(n * p + 5 * np.sqrt(n * p * (1 - p))))  # five standard deviations above the bits such a pair differs in
    marks = stored(set_sketches(docs, words, id_column, text_column), "set-sketches")
    distinct = stored(marks.groupBy("s").agg(F.min("doc_id").alias("first"), F.min("h").alias("h"), *[F.min(c).alias(c) for c in (*FINGERPRINT_NAMES, *LEAST_NAMES)]), "distinct-sets")
    cells = stored(cell_members(distinct, chunk), "set-cells")
    pairs = stored(in_cells(cells, ["anchor", "part"], distinct, lambda fps, _: iter([near_pairs(fps, limit)])), "candidate-pairs")
    similar = stored(similar_pairs(pairs, distinct, docs, words, similarity, text_column), "similar-pairs")
    roots = components(similar)
    root_of = lambda roots: distinct.join(roots, distinct.s == roots.node, "left").select("s", F.coalesce("root", "s").alias("label"))
    labels = stored(root_of(roots), "set-labels")
    large = cells.where(F.col("n") > ALL_PAIRS)
    mixed = large.join(labels, "s").groupBy("anchor").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("anchor")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    wide = large.join(mixed, "anchor").select("anchor", "s", F.col("part").alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select(
        "anchor", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "s")
    more = stored(in_cells(wide, ["anchor", "lo", "hi"], distinct, lambda fps, label: foreign_pairs(fps, label, limit), labels).join(pairs, ["a", "b"], "left_anti"), "foreign-pairs")
    if not more.isEmpty():
        roots = components(similar.union(similar_pairs(more, distinct, docs, words, similarity, text_column)))
    named = root_of(roots).join(distinct.select("s", "first"), "s")
    groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return marks.select("doc_id", "s").join(named.join(groups, "label").select("s", "component_id"), "s").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id names a component of near copies: one document of each group stays.

    Rows that share an id are one document.  Rows without an id stay only where no linked row has one.
    """
    found = near_copies(docs, words, similarity, id_column, text_column)
    [key] = fresh(docs, "_k")
    names = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(names.hint("shuffle_hash"), F.col(id_column).cast("long").eqNullSafe(F.col(key)), "left_semi")
