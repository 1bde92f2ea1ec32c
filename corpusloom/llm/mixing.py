"""Mixing sources to target weights.

The words of each source, its documents in a fixed pseudorandom order, are one stream that is cut into blocks of
BLOCK words. Output shards of SLOTS slots each draw how many slots every source gets; the k-th slot of a source takes
block pi(k mod N) of it, pi being a pseudorandom permutation (a Feistel network that walks its cycle) of its own for
each round through the N blocks. Slots then join the blocks by index.

Each shard's counts are a multinomial draw, under the condition that the sums over all shards are what the targets ask for.
Free draws would leave a source of 47 blocks some 15 % off. The sums are the whole parts of the expected slots, and a
multinomial draw of the rests, at most one slot a source; so a source is within a block or two of its target at any number of
shards, and one of three rounds gets them whole. Draws under that condition are hypergeometric: a range of shards with given
sums is halved, and the first half's sums are drawn without replacement from the whole's, down to single shards. (Ranges of
more than EXACT slots are halved in proportion, for the sums of so many draws hardly vary.) A shard's draw depends on its
number only, so shards are drawn apart. No block is used in more than three rounds.

Defined results: null text or a text without words has size 0 and takes part with nothing; texts of any length are cut where
their words fall; a null source is a source, last in order; rows that agree in all of id, source and text share one
place in the order; an empty table gives no rows; further columns, whatever their names, come back as they were, but
for `n_chars`, which follows the text. There may be MOST_SOURCES sources, whose rows may be in any proportion.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, documents, map_frames, texts_udf, with_running_sum, workspace, written

BLOCK = 64
SLOTS = 4096
ROUNDS = 3
SEED = 20240607
#: Slots of a range of shards that are dealt by an exact draw; sources whose sums the driver may hold.
EXACT, MOST_SOURCES = 500_000_000, 100_000


def targets(sizes: Sequence[int], weights: Sequence[int]) -> list[float]:
    """Shares of the sum of sizes by weight, none above ROUNDS times its size; what is above is shared again."""
    left, out, free = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > ROUNDS * sizes[i]]
        for i in over or free:
            out[i] = Fraction(ROUNDS * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return [float(x) for x in out]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0 .. n - 1 takes each index."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, half = np.uint64((1 << half) - 1), np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            mixed = (right + np.uint64((key * 4 + r + 1) & 0x7FFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= n).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def key_of(source: int, round_: int) -> int:
    """The permutation's key of a source's round, the same in all versions of Python."""
    return int.from_bytes(hashlib.blake2b(f"{SEED} {source} {round_}".encode(), digest_size=7).digest())


def stream(docs: DataFrame, id_col: str, text_col: str, source_col: str, where: str) -> tuple[DataFrame, list[dict]]:
    """(id, source, crc, size, place, src): each document's place in its source's words; and the sources in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.crc32(text).alias("crc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sizes = written(sizes, f"{where}/sizes")
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = [{"src": i, "source": r["source"], "size": r["size"], "rows": r["rows"]} for i, r in enumerate(sorted(rows, key=lambda r: (r["source"] is None, r["source"] or "")))]
    wanted = targets([x["size"] for x in found], [1 + x["src"] % 3 for x in found])
    for x, t in zip(found, wanted, strict=True):
        x |= {"target": t, "blocks": -(-x["size"] // BLOCK)}
    placed = with_running_sum(sizes, ["source"], ["id", "crc", "size"], F.col("size"), "place", max([x["rows"] for x in found], default=0))
    return placed, found


def drawn(whole: np.ndarray, rest: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    """The whole parts, and what is left drawn by multinomial in proportion to the rests, one more a source at most."""
    n, rest, rng = whole.astype(np.int64), rest.astype(float), np.random.default_rng([SEED, *seed])
    while left > 0:
        more = np.minimum(rng.multinomial(left, rest / rest.sum()), 1)  # what goes past one is drawn again
        n, left = n + more, left - int(more.sum())
        rest[more > 0] = 0
    return n


def given(expected: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The slots of each source in the mix: its expected ones, rounded up or down."""
    whole = np.minimum(np.floor(expected + 1e-6), most)
    rest = np.where(whole < most, np.maximum(expected - whole, 0), 0)
    rest[rest < 1e-6] = 0
    return drawn(whole, rest, round(rest.sum()), [])


def dealt(numbers: Sequence[int], every: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot of each source, slots of each source) of some shards of the mix of `every` slots."""
    total = int(every.sum())
    path = [(0, max(1, -(-total // SLOTS)), np.zeros(len(every), np.int64), every)]
    for s in map(int, numbers):
        while not path[-1][0] <= s < path[-1][1]:
            path.pop()
        while path[-1][1] - path[-1][0] > 1:
            low, high, start, n = path[-1]
            middle = (low + high) // 2
            part, of = (middle - low) * SLOTS, min(high * SLOTS, total) - low * SLOTS
            if of <= EXACT:
                half = np.random.default_rng([SEED, low, high]).multivariate_hypergeometric(n, part, method="marginals")
            else:
                share = [divmod(int(x) * part, of) for x in n]
                half = drawn(np.array([w for w, _ in share]), np.array([r / of for _, r in share]), part - sum(w for w, _ in share), [low, high])
            path.append((low, middle, start, half) if s < middle else (middle, high, start + half, n - half))
        yield s, path[-1][2], path[-1][3]


def slots(spark: SparkSession, found: list[dict]) -> DataFrame:
    """(shard, slot, source, block): which block of which source each slot of the mix takes."""
    live = [x for x in found if x["target"] > 0]
    schema = "shard long, slot long, source string, block long"
    if not live:
        return spark.createDataFrame([], schema)
    names, blocks = [x["source"] for x in live], [x["blocks"] for x in live]
    every = given(np.array([x["target"] / (x["size"] / x["blocks"]) for x in live]), ROUNDS * np.array(blocks))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, start, n in dealt(frame["id"], every):
                out = []
                for src in np.flatnonzero(n):
                    k = np.arange(start[src], start[src] + n[src])
                    rounds, block = k // blocks[src], np.empty(len(k), np.int64)
                    for e in np.unique(rounds):
                        own = rounds == e
                        block[own] = permuted(k[own] % blocks[src], blocks[src], key_of(int(src), int(e)))
                    out.append(block)
                source = np.repeat(np.array(names, dtype=object), n)
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(source)), "source": source, "block": np.concatenate(out)})

    shards = max(1, -(-int(every.sum()) // SLOTS))
    return map_frames(spark.range(0, shards, 1, min(shards, 8 * spark.sparkContext.defaultParallelism)), place, schema)


def uses(placed: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, source, crc, size, place, block, low, high, n): the blocks of each document, its words in it, the times used."""
    used = taken.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"place div {BLOCK}"), F.expr(f"(place + size - 1) div {BLOCK}"))))
    cut = cut.withColumn("low", F.greatest(F.col("block") * BLOCK - F.col("place"), F.lit(0))).withColumn("high", F.least((F.col("block") + 1) * BLOCK - F.col("place"), F.col("size")))
    # Spark takes what is made of a range of shard numbers for small, and would broadcast it.
    used = used.hint("merge")
    return cut.join(used, cut["source"].eqNullSafe(used["s"]) & (cut["block"] == used["b"]), "left").drop("s", "b").fillna(0, ["n"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = workspace(spark, "mix")
    placed, found = stream(documents(spark, sf_dir), "doc_id", "text", "source", where)
    placed = written(placed, f"{where}/placed")
    used = uses(placed, slots(spark, found)).groupBy("id", "source", "crc", "size", "place").agg(F.sum(F.expr("(high - low) * n")).alias("taken"))
    every = used.select("id", "source", "size", "taken").union(placed.where("size = 0").select("id", "source", "size", F.lit(0).cast("long")))
    sources = spark.createDataFrame([(x["source"], x["size"], x["target"]) for x in found], "s string, source_size long, target double")
    return every.join(F.broadcast(sources), every["source"].eqNullSafe(sources["s"])).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows of docs: a row for each round a document's words are taken in, its text those words.

    A round that takes a whole document has its text as it is; else the taken runs of words, joined by a blank.
    """
    import re

    spark, word, names = docs.sparkSession, re.compile(WORD), docs.columns
    where = workspace(spark, "mix")
    placed, found = stream(docs, id_col, text_col, source_col, where)
    placed = written(placed, f"{where}/placed")
    cuts = uses(placed, slots(spark, found)).where("n > 0").groupBy("id", "source", "crc", "size", "place").agg(F.array_sort(F.collect_list(F.struct("low", "high", "n"))).alias("cuts"))
    cuts = cuts.groupBy(F.col("id").alias("i"), F.col("source").alias("s"), F.col("crc").alias("c"), F.col("size").alias("z")).agg(F.min_by("cuts", "place").alias("cuts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.crc32(text).alias("crc"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    same = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("crc") == F.col("c")) & (F.col("size") == F.col("z"))
    rounds = F.filter(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda e: F.exists("cuts", lambda c: c["n"] >= e))

    def taken(texts: list[str], sizes: list[int], cuts: list[list[dict]], round_: list[int]) -> pa.Array:
        out = []
        for t, n, c, r in zip(texts, sizes, cuts, round_, strict=True):
            runs: list[list[int]] = []
            for x in c:
                if x["n"] >= r:
                    if runs and runs[-1][1] == x["low"]:
                        runs[-1][1] = x["high"]
                    else:
                        runs.append([x["low"], x["high"]])
            if runs == [[0, n]]:
                out.append(t)
            else:
                at = [m.span() for m in word.finditer(t)]
                out.append(" ".join(t[at[a][0] : at[b - 1][1]] for a, b in runs))
        return pa.array(out, pa.string())

    used = rows.join(cuts, same).withColumn("round", F.explode(rounds))
    used = used.withColumn("new", texts_udf(taken, "string", 3)(F.col("row")[text_col], "size", "cuts", "round"))
    new = {text_col: F.col("new")}
    if "n_chars" in names:
        new["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return used.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
