"""Byte-level BPE by corpus-level merge replay.

A task takes its share of the texts, finds their distinct words and encodes these together: an inverted index leads from each token
pair (by the rank of the token it makes) to the word positions that hold it, and the merges are replayed in rank order over all
words at once, each updating only the neighbours it touches.  Texts then look their words up.  Nothing is shuffled; the ranks are
a file of fixed size that travels with the task.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import slices, whole_text

NONE = np.int32(2**31 - 1)
#: bytes of text whose new words are encoded together, and words kept from one such share to the next
SHARE_BYTES, KEPT_WORDS = 4 << 20, 100_000

#: fixed values: Unicode's white space, as a class body for engines whose own class differs
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def word_splitter(pattern: str):
    """A function from a text to its words, as the pattern's matches with Unicode classes.

    Texts of ASCII and Latin letters go through the standard library with the classes spelled for it where the pattern allows,
    all others through an engine with full Unicode properties.
    """
    import regex

    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)", rf"[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])").replace(r"|\s+", rf"|[{WHITE_SPACE}]+")
    full = regex.compile(spelled).findall
    simple = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if r"\p" in simple:
        return full
    quick, other = re.compile(simple).findall, re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ]").search
    return lambda text: full(text) if other(text) else quick(text)


class PairTable:
    """Rank of the token that two tokens make, for arrays of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        self.shift = max(1, int(size - 1).bit_length())
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << self.shift | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(2**62))
        self.values = np.append(np.array(values, np.int32)[order], NONE)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << self.shift | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)


def plain_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word at a time, lowest rank first, leftmost first: for words whose merges the replay cannot order."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        low = [ranks.get(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
        i = min(range(len(low)), key=low.__getitem__)
        if low[i] == NONE:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words one after the other, and how many each word has.

    Symbols of all words stand in one array with links to the next and previous symbol.  ``index`` leads from a rank to the
    positions whose pair makes that token; ranks are taken from a heap.  Of overlapping positions the leftmost merges.  Should a
    merge create a pair of a rank not above the present one, its word is encoded by :func:`plain_merges`.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    n, ends = len(data), np.cumsum(lengths)
    token = pairs.bytes[data]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    filled = ends[lengths > 0]
    nxt[filled - 1] = -1
    prv[(filled - lengths[lengths > 0])] = -1
    rank = np.full(n, NONE, np.int32)
    joint = np.flatnonzero(nxt >= 0)
    rank[joint] = pairs(token[joint], token[joint + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, fresh: np.ndarray) -> None:
        """Put positions under their rank."""
        order = np.argsort(fresh, kind="stable")
        at, fresh = at[order], fresh[order]
        cuts = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
        for key, own in zip(fresh[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if key in index:
                index[key].append(own)
            else:
                index[key] = [own]
                heapq.heappush(heap, key)

    first = np.flatnonzero(rank != NONE)
    if len(first):
        enter(first.astype(np.int32), rank[first])
    disorder = []
    while heap:
        r = heapq.heappop(heap)
        at = np.unique(np.concatenate(index.pop(r)))
        at = at[rank[at] == r]  # positions that an earlier merge has changed are stale
        if not len(at):
            continue
        follows = nxt[at[:-1]] == at[1:]
        if follows.any():  # runs of overlapping pairs: every second one merges
            start = np.r_[True, ~follows]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        token[at], token[gone], rank[gone], nxt[at] = r, -1, NONE, after
        more = after >= 0
        prv[after[more]] = at[more]
        before = prv[at]
        right = np.full(len(at), NONE, np.int32)
        right[more] = pairs(token[at[more]], token[after[more]])
        rank[at] = right
        less = before >= 0
        touched = before[less]
        rank[touched] = pairs(token[touched], token[nxt[touched]])
        near = np.concatenate([at, touched])
        fresh = rank[near]
        near, fresh = near[fresh != NONE], fresh[fresh != NONE]
        if len(near):
            early = fresh <= r
            if early.any():
                disorder.append(near[early])
            enter(near, fresh)
    alive = token >= 0
    ids = token[alive]
    counts = np.add.reduceat(np.r_[alive, False].astype(np.int64), np.r_[0, ends[:-1]]) if n else np.zeros(len(words), np.int64)
    counts[lengths == 0] = 0
    # a word that is itself a token has no merges to replay; words out of order are encoded alone
    alone = {int(i) for i in np.unique(np.searchsorted(ends, np.concatenate(disorder), side="right"))} if disorder else set()
    whole = [i for i, w in enumerate(words) if counts[i] != 1 and w in ranks]
    if alone or whole:
        pieces = np.split(ids, np.cumsum(counts)[:-1])
        for i in alone:
            pieces[i] = np.array(plain_merges(words[i], ranks), np.int32)
        for i in whole:
            pieces[i] = np.array([ranks[words[i]]], np.int32)
        ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
    return ids, counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices that read stretch after stretch of a flat array."""
    total = np.cumsum(counts)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - counts), counts)


class Words(dict):
    """Word to number, new words numbered as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class ShareEncoder:
    """Encodes shares of texts; words are kept between shares up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT_WORDS):
        self.ranks, self.pairs, self.split, self.kept = ranks, PairTable(ranks), word_splitter(pattern), kept
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.starts, self.counts = Words(), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends."""
        if len(self.words) > self.kept:
            self.forget()
        known, number = len(self.words), self.words.__getitem__
        codes = [np.fromiter(map(number, own), np.int32, len(own)) for own in map(self.split, texts)]
        new = [w.encode() for w in list(self.words)[known:]]
        if new:
            ids, counts = replay(new, self.ranks, self.pairs)
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
            self.ids, self.counts = np.r_[self.ids, ids], np.r_[self.counts, counts]
        sizes = np.fromiter((int(self.counts[c].sum()) for c in codes), np.int64, len(codes))
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        return self.ids[ragged(self.starts[flat], self.counts[flat])], np.cumsum(sizes)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text, each match of ``pattern`` encoded separately, without special tokens.

    Null and empty texts give an empty array; repeated rows repeated results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ShareEncoder(ranks, pattern)
        for share in slices(batches, "_t", SHARE_BYTES):
            flat, ends = encoder(share.column("_t").to_pylist())
            # hand on in parts of bounded size
            start = 0
            while start < share.num_rows:
                base = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + (1 << 21), side="right")))
                offsets = np.r_[0, ends[start:stop] - base].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[base:int(ends[stop - 1])]))
                yield pa.RecordBatch.from_arrays([share.column(0).slice(start, stop - start), ids], names=[id_column, "ids"])
                start = stop

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), whole_text(text_column).alias("_t")).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_column: str = "ids", output: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of each row's ids; null stays null.  An id outside the vocabulary is an error."""
    size = max(ranks.values()) + 1
    vocabulary: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        vocabulary[rank] = token

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            at = batch.schema.get_field_index(ids_column)
            lists = batch.column(at)
            ids = lists.flatten()
            ends_of_range = pa.compute.min_max(ids)
            if ids.null_count or len(ids) and (ends_of_range["min"].as_py() < 0 or ends_of_range["max"].as_py() >= size):
                raise ValueError("an id is not in the vocabulary")
            flat = known.take(ids)
            if flat.null_count:
                raise ValueError("an id is not in the vocabulary")
            # the taken tokens lie one after the other, so a row's bytes are a stretch of their buffer
            ends = np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            places = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
            bounds = places[np.r_[0, ends]]
            body = np.frombuffer(flat.buffers()[2] or b"", np.uint8) if len(flat) else np.zeros(0, np.uint8)
            gone = lists.is_null().to_numpy(zero_copy_only=False)
            rows = pa.array([None if gone[i] else body[bounds[i]:bounds[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, output])

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(output, BinaryType()))
