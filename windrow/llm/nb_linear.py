"""Toxicity by a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed character n-grams.  Their log-count ratios between the classes come from all labelled training
rows; a logistic model over the ratio-scaled features is fitted on a bounded sample of them.  A text's score is the model's
probability over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import fresh, slices, stored, whole_text

BITS, ORDERS, LEAST_ROWS = 20, (4, 7, 10), 4
#: documented bounds of the fit: rows of each class, and the length above which a text is left out of the sample (it still counts
#: in the ratios and is scored whole)
FIT_ROWS, FIT_BYTES = 2000, 200_000
#: bytes of gram numbers of one class that the fit's one task holds at most; rows come in the order of a hash of their ids
FIT_HELD = 128 << 20
#: bits of the table of label ids that texts are held against before they are shuffled: a fixed size, 8 MB
ID_BITS = 26
STEPS, RATE, PENALTY, SMOOTHING = 80, 0.05, 1e-4, 10.0
HASH = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z, other ASCII characters than letters and digits to blanks, bytes of other characters as they are
FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


class Grams:
    """Distinct n-gram buckets of a text; the scratch array saves sorting.

    Grams lie within words: a word has a blank on either side, and a gram holds no blank but at its ends; a word with its blanks is
    a gram too if it is at most ``longest`` bytes.  A-Z are lower-cased, ASCII characters other than letters and digits are blanks.
    A gram's hash is a polynomial in 64-bit values of its bytes, taken from running sums, so any order costs the same.
    """

    longest = 20

    def __init__(self, bits: int = BITS, orders: tuple[int, ...] = ORDERS, block: int = 1 << 16):
        self.shift, self.orders, self.block = np.uint64(64 - bits), orders, block
        self.seen = np.zeros(1 << bits, np.int32)
        self.values = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)
        # powers of an odd number and of its inverse modulo 2^64
        n = block + max(*orders, self.longest) + 1
        self.power = np.cumprod(np.full(n, HASH, np.uint64))
        self.inverse = np.cumprod(np.full(n, np.uint64(pow(int(HASH), -1, 1 << 64)), np.uint64))

    def buckets(self, data: bytes) -> np.ndarray:
        """``data`` is folded: every run of blanks is one, with one at either end."""
        b = np.frombuffer(data, np.uint8)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.power[:len(b)], out=sums[1:])
        blanks = np.flatnonzero(b == 32)
        # the end of the word each place lies in: the next blank after it
        reach = np.repeat(np.r_[blanks, len(b)], np.diff(np.r_[-1, blanks, len(b)]))[:len(b)]
        reach = np.r_[reach[1:], len(b)]
        starts, sizes = [], []
        for n in self.orders:
            at = np.flatnonzero(reach >= np.arange(n - 1, len(b) + n - 1))
            at = at[at + n <= len(b)]
            starts.append(at)
            sizes.append(np.full(len(at), n))
        word = np.diff(blanks) + 1
        short = (word <= self.longest) & ~np.isin(word, self.orders)
        starts.append(blanks[:-1][short])
        sizes.append(word[short])
        at, n = np.concatenate(starts), np.concatenate(sizes)
        return ((((sums[at + n] - sums[at]) * self.inverse[at] + n.astype(np.uint64)) * HASH) >> self.shift).astype(np.int64)

    def distinct(self, all_of: np.ndarray) -> np.ndarray:
        number = np.arange(len(all_of), dtype=np.int32)
        self.seen[all_of] = number
        return all_of[self.seen[all_of] == number]

    def __call__(self, text: bytes) -> np.ndarray:
        data = b" " + b" ".join(text.translate(FOLD).split()) + b" "
        found, at = np.zeros(0, np.int64), 0
        while at < len(data) - 1:  # long texts in blocks that end at a blank; a word longer than a block is cut with an overlap
            stop = min(len(data), at + self.block)
            cut = data.rfind(b" ", at + 1, stop) + 1 if stop < len(data) else stop
            whole = cut > at + 1
            found = self.distinct(np.concatenate([found, self.buckets(data[at:cut if whole else stop])]))
            at = cut - 1 if whole else stop - self.longest
        return found


def held_out(id_column: str) -> Column:
    """crc32 of the id as text leaves remainder 0 by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def read_rows(labelled: DataFrame, share: dict[int, float], bits: int, orders: tuple[int, ...], fit_bytes: int) -> DataFrame:
    """One pass over (h, y, _t): per task and bucket the rows of each class that hold it, and the sampled rows' buckets.

    Rows of kind 0 are counts (bucket, ones, zeros), with bucket -1 for the rows themselves; rows of kind 1 are sampled texts (bucket: their order).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, count, rows = Grams(bits, orders), np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        names = ["kind", "bucket", "ones", "zeros", "grams"]
        for batch in slices(batches, "_t"):
            picked, label, order = [], [], []
            for text, y, h in zip(batch.column("_t").cast(pa.binary()), batch.column("y").to_pylist(), batch.column("h").to_pylist(), strict=True):
                data = text.as_py()
                own = grams(data)
                count[y, own] += 1
                rows[y] += 1
                if (h % 2**32) / 2**32 < share[y] and len(data) <= fit_bytes:
                    picked.append(own.astype(np.int32).tobytes())
                    label.append(y)
                    order.append(h >> 33)
            n = len(label)
            ones = pa.array(label, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array(order, pa.int32()), ones, pa.nulls(n, pa.int64()), pa.array(picked, pa.binary())], names=names)
        at = np.flatnonzero(count.sum(axis=0))
        bucket, ones, zeros = (np.append(x, last) for x, last in ((at, -1), (count[1, at], rows[1]), (count[0, at], rows[0])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(bucket), np.int32)), pa.array(bucket.astype(np.int32)), pa.array(ones), pa.array(zeros), pa.nulls(len(bucket), pa.binary())], names=names)

    return labelled.select("h", "y", "_t").mapInArrow(run, "kind int, bucket int, ones long, zeros long, grams binary")


def fit_weights(samples: list[tuple[np.ndarray, int]], ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias: logistic loss over ratio-scaled presence, classes weighted to their share, Adam steps."""
    y = np.array([s[1] for s in samples], np.float64)
    cut = [s[0][ratio[s[0]] != 0] for s in samples]
    columns, owner = np.unique(np.concatenate(cut), return_inverse=True)
    sizes = np.array([len(c) for c in cut])
    row = np.repeat(np.arange(len(cut)), sizes)
    r = ratio[columns]
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    # the ratio-scaled model starts at naive Bayes in direction, at a scale that keeps its sums moderate
    v, bias = np.zeros(len(columns)), np.log(prior / (1 - prior))
    m, s, mb, sb = np.zeros(len(v)), np.zeros(len(v)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights=(v * r)[owner], minlength=len(cut)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(owner, weights=error[row], minlength=len(v)) * r + PENALTY * v
        gb = error.sum()
        m, s, mb, sb = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        v -= RATE * (m / fix) / (np.sqrt(s / fix2) + 1e-8)
        bias -= RATE * (mb / fix) / (np.sqrt(sb / fix2) + 1e-8)
    out = np.zeros(len(ratio))
    out[columns] = v * r
    return out, float(bias)


@dataclass(frozen=True)
class Model:
    """A weight for each bucket and a bias: a fixed size whatever the corpus."""

    weights: np.ndarray
    bias: float
    bits: int = BITS
    orders: tuple[int, ...] = ORDERS

    def score(self, docs: DataFrame, text_column: str = "text", output: str = "score") -> DataFrame:
        """``docs`` with the probability of class 1 of each whole text; null counts as empty; a column named ``output`` is replaced."""
        docs = docs.drop(output)
        weights, bias, bits, orders = self.weights.astype(np.float32), self.bias, self.bits, self.orders
        [text] = fresh(docs, "_t")
        from pyspark.sql.types import DoubleType, StructType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams = Grams(bits, orders)
            for batch in slices(batches, text):
                z = np.array([weights[grams(t.as_py())].sum(dtype=np.float64) for t in batch.column(text).cast(pa.binary())]) + bias
                at = batch.schema.get_field_index(text)
                score = pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [score], names=[n for n in batch.schema.names if n != text] + [output])

        return docs.withColumn(text, whole_text(text_column)).mapInArrow(run, StructType([*docs.schema.fields]).add(output, DoubleType()))


def maybe_in(rows: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The rows whose key may be among ``ids``: none of those is lost, of the others few stay while there are fewer ids than bits.

    One bit an id in a bitmap of 2^ID_BITS bits, in pieces that Spark's bitmap aggregate makes; their size does not grow with the ids.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << ID_BITS))
    [bucket, at, bits] = fresh(rows, "_bucket", "_at", "_bits")
    marks = ids.select(place(id_column).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    found = rows.withColumns({bucket: F.bitmap_bucket_number(place(key)), at: F.bitmap_bit_position(place(key))}).join(F.broadcast(marks), bucket)
    byte = f"cast(conv(hex(substring({bits}, cast({at} div 8 + 1 as int), 1)), 16, 10) as int)"
    return found.where(F.expr(f"shiftright({byte}, cast({at} % 8 as int)) & 1 = 1")).select(*rows.columns)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, orders: tuple[int, ...] = ORDERS,
          fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit on the labelled documents that are not held out.

    Ratios count every such document.  The linear fit sees about ``fit_rows`` of each class, chosen by a hash of the id, of at most
    ``fit_bytes`` bytes each, and of a class no more than fill FIT_HELD bytes.  Rows without a label, and labels without a document, take no part; an id labelled more than once has
    its largest label.  With no row of one class the model answers with the share of class 1 (0 if there are no rows at all).
    """
    own = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y"))
    own = stored(own.where("y IN (0, 1)"), "labels")
    sizes = {r.y: r.n for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, fit_rows / max(1, sizes.get(y, 0))) for y in (0, 1)}
    texts = docs.select(F.col(id_column).alias("_d"), whole_text(text_column).alias("_t"))
    labelled = maybe_in(texts, "_d", own, "_id").join(own.hint("shuffle_hash"), F.col("_d") == F.col("_id")).select(F.xxhash64("_id").alias("h"), "y", "_t")
    read = stored(read_rows(labelled, share, bits, orders, fit_bytes), "gram-counts")
    # one row per bucket at most: a fixed number
    sums = read.where("kind = 0").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()
    bucket, ones, zeros = (sums.column(c).to_numpy() for c in ("bucket", "ones", "zeros"))
    total = (int(zeros[bucket == -1].sum()), int(ones[bucket == -1].sum()))
    if not total[0] or not total[1]:
        return Model(np.zeros(1 << bits), 30.0 if total[1] else -30.0, bits, orders)
    # smoothing in proportion to the classes: a gram that neither class has shown is neutral
    some = bucket >= 0
    ratio, a = np.zeros(1 << bits), SMOOTHING
    p = (ones[some] + a * total[1] / sum(total)) / total[1]
    q = (zeros[some] + a * total[0] / sum(total)) / total[0]
    ratio[bucket[some]] = np.where(ones[some] + zeros[some] >= LEAST_ROWS, np.log(p / q), 0.0)
    prior = total[1] / sum(total)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], [0, 0]
        for b in batches:
            for g, y in zip(b.column("grams").to_pylist(), b.column("ones").to_pylist(), strict=True):
                if held[y] + len(g) <= FIT_HELD:
                    held[y] += len(g)
                    samples.append((np.frombuffer(g, np.int32), y))
        if len({y for _, y in samples}) < 2:
            w, bias = np.zeros(len(ratio)), float(np.log(prior / (1 - prior)))
        else:
            w, bias = fit_weights(samples, ratio, prior)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    row = read.where("kind = 1").select("bucket", "grams", "ones").repartition(1).sortWithinPartitions("bucket", "grams").select("grams", "ones").mapInArrow(fit, "w binary, bias double").first()
    return Model(np.frombuffer(row.w, "<f8"), row.bias, bits, orders) if row else Model(np.zeros(1 << bits), float(np.log(prior / (1 - prior))), bits, orders)
