"""Alignment of two tokenizers' tokens by diagonal run skipping, with corpus-wide counts of linked id pairs.

Both tokenizers spell the same bytes, so a text is two rising lists of byte offsets at which tokens end. Where both end, a
group ends. Most groups are one token each, for a stretch: then both lists go on alike at a constant shift between
their indexes. Such a stretch is not walked: probes of doubling length compare slices of both lists at the current shift,
as strings of the tokens' sizes, and the first difference of two strings is where it ends. The irregular group there is
resolved token by token, and the shift goes on changed. Groups of a text are two arrays of token counts.

A text's distinct id pairs, with how often each is linked, are written once. Spark counts the texts that hold each pair
(partial counts in every task) and marks those that are their first id's best. Pairs held by the most texts, as many as
SENT of them at most, are sent to all executors; the others go through a join, in which no pair has more rows than the
rarest pair that was sent. So no key is hot.

A group of p and q tokens links p * q pairs; its pairs are made from its distinct ids, CHUNK at a time.

Defined results: a text that is null or empty, or whose tokens do not spell a space and the text, has no tokens, no
groups and no links, and its digest is ''; rows and ids may repeat and ids may be null: each row is a text of its own in
the counts; texts of any length are taken whole; an empty table gives no rows; further columns, whatever their names,
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, given_back, kept, lists, slices, small_batches, workspace, written

MARK = "▁"
#: Pairs that are sent to every executor, at most (some 40 bytes each).
SENT = 1 << 18
#: Links that are made at once.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Encodes whole texts, with the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    bytes: list[bytes]


def byte_level(path: str, pattern: str) -> Vocabulary:
    """A byte-level BPE vocabulary of ranks, whose text is a space and the text; strings of special tokens are plain text."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    spelled = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    return Vocabulary(lambda texts: [own.encode_ordinary(" " + t) for t in texts], spelled)


def pieces(path: str) -> Vocabulary:
    """A SentencePiece vocabulary, which adds the space itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), spelled)


def aligned(a: Sequence[int], b: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a's and b's tokens in each group, from the offsets at which tokens end; both end at the same.

    Where both lists have ended alike, the next ends agree as long as the tokens' sizes do. These are strings of bytes; of
    two slices of them the highest bit of their difference, as numbers, tells how far they agree.
    """
    long_a, long_b = (np.diff(np.asarray(x, np.int64), prepend=0) for x in (a, b))
    n = len(long_a)
    wide = 1 if max(long_a.max(initial=0), long_b.max(initial=0)) < 256 else 8
    raw_a, raw_b = (x.astype(f">u{wide}").tobytes() for x in (long_a, long_b))
    size_a, size_b = (raw_a, raw_b) if wide == 1 else (long_a.tolist(), long_b.tolist())
    # The 8 bytes from each token on, for the first probe; what follows the last token differs.
    next_a, next_b = (memoryview(np.ndarray((len(raw) // wide,), ">u8", raw + end * 8, strides=(wide,)).astype(np.uint64)) for raw, end in ((raw_a, b"\0"), (raw_b, b"\1")))
    i = j = 0
    ones, more_a, more_b = [], [], []  # a stretch of single tokens, and the irregular group after it
    while i < n:
        run, step = (64 - (next_a[i] ^ next_b[j]).bit_length() >> 3) // wide, 16
        more = run * wide == 8
        while more:
            x = raw_a[(i + run) * wide : (i + run + step) * wide]
            y = raw_b[(j + run) * wide : (j + run + step) * wide]
            least = min(len(x), len(y))
            odd = 0 if x == y else (int.from_bytes(x[:least]) ^ int.from_bytes(y[:least])).bit_length()
            run += (least - (odd + 7) // 8) // wide
            more = odd == 0 and least == step * wide
            step *= 2
        i, j = i + run, j + run
        ones.append(run)
        if i == n:
            break
        p, q = i, j
        end_a, end_b = size_a[p], size_b[q]
        while end_a != end_b:
            if end_a < end_b:
                p += 1
                end_a += size_a[p]
            else:
                q += 1
                end_b += size_b[q]
        more_a.append(p + 1 - i)
        more_b.append(q + 1 - j)
        i, j = p + 1, q + 1
    total = sum(ones) + len(more_a)
    out_a, out_b = np.ones(total, np.int64), np.ones(total, np.int64)
    at = np.cumsum(ones[: len(more_a)], dtype=np.int64) + np.arange(len(more_a))
    out_a[at], out_b[at] = more_a, more_b
    return out_a, out_b


def linked(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (a's id shifted by 32 bits, with b's id), rising, and how often each is linked."""
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    size, keys, counts = in_a * in_b, [], []
    small = np.flatnonzero(size <= CHUNK)
    upto = np.cumsum(size[small])
    start = 0
    while start < len(small):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + CHUNK, side="right")))
        g = small[start:stop]
        k = np.repeat(np.arange(len(g)), size[g])
        inside = np.arange(len(k)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
        wide = in_b[g][k]
        key, count = np.unique(a[at_a[g][k] + inside // wide] << 32 | b[at_b[g][k] + inside % wide], return_counts=True)
        keys.append(key)
        counts.append(count)
        start = stop
    for g in np.flatnonzero(size > CHUNK):
        of_a, n_a = np.unique(a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
        of_b, n_b = np.unique(b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
        rows = max(1, CHUNK // len(of_b))
        for k in range(0, len(of_a), rows):
            keys.append((of_a[k : k + rows, None] << 32 | of_b).ravel())
            counts.append((n_a[k : k + rows, None] * n_b).ravel())
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)


class Aligner:
    """Two vocabularies, with what their ids are written as."""

    def __init__(self, first: Vocabulary, second: Vocabulary):
        self.both = (first, second)
        self.long = [np.array([len(x) for x in v.bytes], np.int64) for v in self.both]
        n = max(len(v.bytes) for v in self.both)
        if n > 10**7:
            raise ValueError("ids of more than 7 digits")
        # The digits of an id are the lower bytes of one number, with room for a mark after them.
        self.digits = np.array([str(i) for i in range(n)], "S8").view("<u8")
        self.above = np.array([8 * len(str(i)) for i in range(n)], "<u8")

    def written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3`: ids by group."""
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), "<u8")
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        ids[np.arange(len(a)) + np.repeat(end_b - in_b, in_a)] = a
        ids[np.arange(len(b)) + np.repeat(end_a, in_b)] = b
        mark[end_a + end_b - in_b - 1] = ord("|")
        mark[end_a + end_b - 1] = ord(";")
        out, every = [], 1 << 18
        for k in range(0, len(ids), every):
            part = ids[k : k + every]
            out.append((self.digits[part] | mark[k : k + every] << self.above[part]).tobytes().translate(None, b"\0"))
        return b"".join(out)[:-1]

    def align(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of both, groups, links, digest; pairs and how often they are linked."""
        none = np.zeros(0, np.int64)
        said = b" " + text.encode()
        if not text or any(b"".join(itemgetter(*ids, 0)(v.bytes)[:-1]) != said for v, ids in zip(self.both, (a, b), strict=True)):
            return 0, 0, 0, 0, "", none, none
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        in_a, in_b = aligned(np.cumsum(self.long[0][a]), np.cumsum(self.long[1][b]))
        keys, counts = linked(a, b, in_a, in_b)
        return len(a), len(b), len(in_a), int(in_a @ in_b), hashlib.sha256(self.written(a, b, in_a, in_b)).hexdigest(), keys, counts


#: Characters that are encoded before their tokens are aligned.
AT_ONCE = 1 << 18
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
MADE = "id long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs array<long>, times array<long>"


def groups(docs: DataFrame, aligner: Callable[[], Aligner], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, numbers of tokens, groups and links, digest, and the distinct linked pairs of each text with their numbers of links."""
    small_batches(docs.sparkSession)

    def of(own: Aligner, texts: list[str]) -> Iterator[tuple]:
        start = 0
        while start < len(texts):
            stop, n = start, 0
            while stop < len(texts) and (n == 0 or n + len(texts[stop]) <= AT_ONCE):
                n, stop = n + len(texts[stop]), stop + 1
            some = texts[start:stop]
            for x in zip(some, own.both[0].encode(some), own.both[1].encode(some), strict=True):
                yield own.align(*x)
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner()
        try:
            for batch in batches:
                for k, n in slices(batch["text"]):
                    found = list(zip(*of(own, [t or "" for t in batch["text"].slice(k, n).to_pylist()]), strict=True))
                    columns = [batch["id"].slice(k, n), *[pa.array(x, pa.int64()) for x in found[:4]], pa.array(found[4], pa.string()), lists(found[5], pa.int64()), lists(found[6], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", *NUMBERS, "digest", "pairs", "times"])
        finally:
            given_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MADE)


def counted(made: DataFrame) -> DataFrame:
    """pair, held (texts that hold it), best: whether no other pair of its first id is held by more."""
    held = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
    return held.withColumn("a", F.shiftright("pair", 32).cast("int"))


def frequent(pairs: DataFrame, most: int = SENT) -> int:
    """The least power of two that no more than `most` pairs are held by as many texts as."""
    by = pairs.groupBy(F.expr("length(bin(held))").alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, bits = 0, 63
    for b, n in sorted(((r.bits, r.n) for r in by), reverse=True):
        if total + n > most:
            break
        total, bits = total + n, b
    return 1 << (bits - 1)


def align(docs: DataFrame, aligner: Callable[[], Aligner], id_col: str = "doc_id", text_col: str = "text", most: int = SENT) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best (links of pairs that are their first id's best), count_sum (over links, of the
    texts that hold the pair), digest."""
    where = workspace(docs.sparkSession, "alignment")
    made = written(groups(docs, aligner, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), f"{where}/made")
    held = written(counted(made), f"{where}/held")
    # At most as many rows as the first vocabulary has ids.
    top = held.groupBy("a").agg(F.max("held").alias("top"))
    pairs = written(held.join(F.broadcast(top), "a").select("pair", "held", (F.col("held") == F.col("top")).alias("best")), f"{where}/pairs")
    limit = frequent(pairs, most)
    links = made.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums: tuple[Column, ...] = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("held") * F.col("times")).alias("count_sum"))
    tried = links.join(F.broadcast(pairs.where(F.col("held") >= limit)), "pair", "left")
    found = tried.where("held is not null").groupBy("row").agg(*sums)
    rest = tried.where("held is null").select("pair", "row", "times").join(pairs.where(F.col("held") < limit), "pair").groupBy("row").agg(*sums)
    both = found.union(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return made.drop("pairs", "times").join(both, "row", "left").select("id", *NUMBERS, zero("n_best"), zero("count_sum"), "digest")


def aligner_of(first: str, second: str, pattern: str) -> Callable[[], Aligner]:
    """An aligner of two vocabulary files, made once in a worker process."""
    return lambda: kept(f"aligner {first} {second}", lambda: Aligner(byte_level(first, pattern), pieces(second)))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks are those of byte_bpe_50k.json, which encodes each code point alike and much slower."""
    import public_tokenizers

    aligner = aligner_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    found = align(documents(spark, sf_dir), aligner)
    return found.select(F.col("id").alias("doc_id"), *NUMBERS, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
