"""Quality of texts by supervised subword embeddings.

A text's features are hashed: each word (a run of non-blank characters), each pair of neighbouring words, and the n-grams
of 1 to LONGEST characters of a word between its marks of start and end. A word after itself is one feature whichever
word it is, for repetition is what tells. Each of BUCKETS features has a learned vector of DIM numbers; a text is
the mean of its features' vectors, and a softmax layer scores it. Vectors and layer are trained together by
stochastic gradient descent in numpy, a text at a time, at a falling rate.

It learns from a bounded sample: of each label the PER_LABEL rows of lowest hash of id and text among the rows that may be
learned from. Tasks hash the sample's whole texts; only counts of features come to the driver, BUCKETS of a text at
most. A word's vectors meet the layer in a few numbers, so a text is scored by adding up remembered numbers of its words.

Defined results: a text that is null or empty, or blank, has no features and gets the score of the layer's bias alone; with
no row to learn from, or one label only, all texts get the score 0.5, or 0 or 1; null labels teach nothing, of several labels of
an id the mean counts, from one half as 1; rows and ids may repeat, and equal texts get equal scores; ids may be null;
texts of any length are taken whole; an empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, kept, small_batches, texts_udf

#: Rows of each label that are learned from, at most.
PER_LABEL = 1500
BITS, DIM, LONGEST = 16, 8, 4
BUCKETS = 1 << BITS
EPOCHS, RATE = 8, 0.5
#: Words that a worker remembers before it begins anew.
REMEMBERED = 300_000
THRESHOLD = 0.7
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
BEFORE, AFTER = "\x02", "\x03"


def hashed(h: np.ndarray) -> np.ndarray:
    """Features of hashes: their best mixed bits."""
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(31))) * ODD >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A hash of each word; pairs of arrays (number of the word, feature), which together hold all features of the words."""
    long = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((BEFORE + (AFTER + BEFORE).join(words) + AFTER).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    start = np.cumsum(long) - long
    word = np.repeat(np.arange(len(words)), long)
    place = np.arange(len(codes)) - start[word]
    left = long[word] - place
    with np.errstate(over="ignore"):
        # A word's hash is the sum of its characters' hashes by place, for words of any length.
        each = (codes * MIX ^ (place.astype(np.uint64) + np.uint64(1)) * ODD) * MIX
        whole = np.add.reduceat(each ^ (each >> np.uint64(29)), start) * ODD
        found = [(np.arange(len(words)), hashed(whole))]
        h = codes * MIX
        for n in range(1, LONGEST + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(32))) * MIX + codes[n - 1 :]
            fits = left[: len(h)] >= n
            if n == 1:  # the marks by themselves tell nothing
                fits &= (place > 0) & (left > 1)
            found.append((word[: len(h)][fits], hashed(h[fits] + np.uint64(n))))
    return whole, found


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """The feature of each word but the first, with the one before it."""
    before, after = hashes[:-1], hashes[1:]
    with np.errstate(over="ignore"):
        found = hashed((before ^ (before >> np.uint64(32))) * MIX + after)
    found[before == after] = 0
    return found


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text, rising, and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    hashes, found = word_features(list(number))
    times = np.bincount(at, minlength=len(number))
    counts = np.bincount(pair_features(hashes[at]), minlength=BUCKETS)
    for word, feature in found:
        counts += np.bincount(feature, times[word], BUCKETS).astype(np.int64)
    have = np.flatnonzero(counts)
    return have, counts[have]


@dataclass
class Quality:
    """What was learned: a number of each feature, which is its vector times the layer's difference, and the bias."""

    weight: np.ndarray
    bias: float
    key: str

    def __post_init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.hashes, self.sums, self.many = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def learn(self) -> None:
        """Adds the numbers of words that are new."""
        new = list(self.number)[len(self.hashes) :]
        hashes, sums, many = [self.hashes], [self.sums], [self.many]
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            h, found = word_features(some)
            hashes.append(h)
            sums.append(sum(np.bincount(word, self.weight[feature], len(some)) for word, feature in found))
            many.append(sum(np.bincount(word, minlength=len(some)) for word, _ in found).astype(np.float64))
        self.hashes, self.sums, self.many = np.concatenate(hashes), np.concatenate(sums), np.concatenate(many)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1."""
        if len(self.number) > REMEMBERED:
            self.forget()
        number, at = self.number, []
        for text in texts:
            at.append([number.setdefault(w, len(number)) for w in (text or "").split()])
        self.learn()
        of = np.repeat(np.arange(len(texts)), [len(a) for a in at])
        at = np.fromiter(chain.from_iterable(at), np.int64, len(of))
        sums, many = np.bincount(of, self.sums[at], len(texts)), np.bincount(of, self.many[at], len(texts))
        if len(at) > 1:
            same = np.flatnonzero(of[1:] == of[:-1])
            sums += np.bincount(of[same], self.weight[pair_features(self.hashes[at])[same]], len(texts))
            many += np.bincount(of[same], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + sums / np.maximum(many, 1), -500, 500)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Quality:
    """Trains vectors and layer on (features, counts) of texts."""
    if not len(labels) or labels.min() == labels.max():
        return Quality(np.zeros(BUCKETS), 0.0 if not len(labels) else 500.0 * (2 * int(labels[0]) - 1), uuid.uuid4().hex)
    r = np.random.default_rng(seed)
    vectors = r.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = [(c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32) for _, c in rows]
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for k in r.permutation(len(rows)):
            now = rate * (1 - step / steps)
            step += 1
            have = rows[k][0]
            own = vectors[have]
            mean = share[k] @ own
            out = layer @ mean + bias
            p = np.exp(out - out.max())
            slope = p / p.sum()
            slope[labels[k]] -= 1
            back = layer.T @ slope
            layer -= now * np.outer(slope, mean)
            bias -= now * slope
            # A rare feature learns as a frequent one does: by its share of the text, scaled to the text's number of features.
            vectors[have] = own - (now * share[k] * len(have) ** 0.5)[:, None] * back
    return Quality((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]), uuid.uuid4().hex)


def trainable(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) != 2


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int) -> DataFrame:
    """label, text of at most per_label rows of each label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    known = known.where(trainable("id")).join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    lowest = lambda d, by: [d.where(F.col("label") == x).orderBy(*by).limit(per_label) for x in (0, 1)]
    zero, one = lowest(known, [F.xxhash64("id"), "id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(zero.union(one)), "id")
    zero, one = lowest(rows, [F.xxhash64("id", "text"), "id", "text"])
    return zero.union(one).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Quality:
    """Learns from a bounded sample of the rows that may be learned from; ids whose checksum modulo 4 is 2 never are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch["label"].to_pylist(), batch["text"], strict=True):
                have, counts = features(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([have.astype(np.uint16).tobytes()]), pa.array([np.minimum(counts, 1 << 30).astype(np.uint32).tobytes()])], ["label", "have", "counts"])

    found = sample(docs, labels, id_col, text_col, label_col, per_label).mapInArrow(run, "label int, have binary, counts binary").toArrow()
    rows = sorted(zip(found["label"].to_pylist(), found["have"].to_pylist(), found["counts"].to_pylist(), strict=True))
    return fitted([(np.frombuffer(h, np.uint16).astype(np.int64), np.frombuffer(c, np.uint32)) for _, h, c in rows], np.array([r[0] for r in rows], np.int64))


def scorer(model: Quality) -> Callable[[Column], Column]:
    """A function of a text column: the probability of label 1."""
    sent, key = SparkSession.active().sparkContext.broadcast((model.weight, model.bias)), model.key
    get = lambda: kept(key, lambda: Quality(*sent.value, key))
    return texts_udf(lambda texts: pa.array(get().scores(texts), pa.float64()), "double")


def op12_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    score = scorer(train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.select("doc_id", (~trainable("doc_id")).alias("held_out"), score(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
