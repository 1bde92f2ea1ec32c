"""Removing repeated byte strings by backward extension on a Burrows-Wheeler transform.

A byte is removed if a string of LENGTH bytes that covers it starts at two places of the corpus at least.

1. Each text is read once. Its anchors are the places of the smallest hash of GRAM bytes in any LENGTH bytes, so equal
   strings of LENGTH bytes have equal grams at equal places in them, whatever stands around them. Texts are
   indexed once however many copies there are (all of a copied text of LENGTH bytes or more goes).
2. Grams that occur once are dropped. All texts with others give, for each of their anchors, the bytes before and
   from it.
3. The anchors of a gram are an interval of the suffix array of all texts: sorted by the bytes that follow, with the
   bytes before as the column of the transform. Breadth first, all intervals are extended backward byte by byte:
   an interval splits by the byte before, stably, and its common prefixes follow as range minima. After j steps a
   string of LENGTH bytes that starts j before the anchor is repeated if a neighbour in the interval has LENGTH - j
   bytes in common; intervals of one are done, and after LENGTH - GRAM steps all are.
4. The found runs of starts are laid over each text.

Why this is the expansion that the transform of all texts would give: the suffixes that begin with one gram are one interval
of the whole suffix array, and sorting them by what follows gives their ranks and, as minima over ranks, all common prefixes
inside. A backward step by a byte takes an interval to the suffixes that begin one place earlier with that byte, in the same
order, and makes every common prefix one longer; so values come in increasing order, one for each step, all intervals of a
value before the next. It stops where prefixes reach LENGTH, or an interval has one suffix, and never needs intervals of
strings that hold no anchor, as each string of LENGTH bytes holds one.

An interval of more than HOT places is not sent to one task: equal surroundings are counted first, where they are
found; the rest falls apart by the bytes around the anchor into groups of STEP offsets, each with LENGTH - STEP bytes
in common, where windows are cut to the bytes that these offsets reach and equal ones are counted again. What is left of
more than HOT different windows - the rows differ within STEP bytes - is not gathered at all: its strings of LENGTH bytes
are counted offset by offset. Bytes are compared as they are, so hashes never decide what goes.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; texts of any length are read whole, in
pieces of CHUNK bytes that overlap; ids may be null or repeat (the result has a row for each row); an empty table gives no
rows; columns of other names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, map_frames, map_texts, maybe_wanted, shuffle_partitions, workspace, written

LENGTH, GRAM = 200, 32
LEFT = LENGTH - GRAM
HOT, STEP = 50_000, 24
#: Windows that are extended at once, and positions hashed at once.
TOGETHER, CHUNK = 10_000, 1 << 20

_table = np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_odd = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_low = np.uint64(CHUNK - 1)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a text."""
    found, hashes = [], []
    data, width = np.frombuffer(raw, np.uint8), LENGTH - GRAM + 1
    for start in range(0, max(0, len(raw) - LENGTH + 1), CHUNK - LENGTH):
        h, size = _table[data[start : start + CHUNK]], 1
        for odd in _odd:
            h = h[:-size] * odd + h[size:]
            size *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least, size = (h & ~_low) | np.arange(len(h), dtype=np.uint64), 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        at = (least[np.r_[True, least[1:] != least[:-1]]] & _low).astype(np.int64)
        found.append(at + start)
        hashes.append(h[at].view(np.int64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def indexed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_bytes, digest, and the anchors of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame["text"]:
                raw = (t or "").encode("utf-8", "surrogatepass")
                at, h = anchors(raw)
                rows.append((len(raw), hashlib.sha256(raw).digest(), at.astype(np.int32), h))
            out = pd.DataFrame(rows, columns=["n_bytes", "digest", "at", "hash"])
            out["id"] = frame["id"].astype("Int64")
            yield out[["id", "n_bytes", "digest", "at", "hash"]]

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(texts, run, "id long, n_bytes long, digest binary, at array<int>, hash array<long>")


def reaches(at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and from each anchor belong to strings of LENGTH bytes that it is the anchor of.

    Of such a string the anchor is the first smallest gram, so it holds no gram of a neighbour that is smaller.
    """
    h, low = hashes.view(np.uint64) & ~_low, np.full(len(at), LEFT)
    high = np.full(len(at), LENGTH)
    gap = np.diff(at)
    first = h[:-1] <= h[1:]
    low[1:] = np.where(first, np.minimum(LEFT, gap - 1), low[1:])
    high[:-1] = np.where(~first, np.minimum(LENGTH, gap + GRAM - 1), high[:-1])
    return low, high


def windows(texts: DataFrame) -> DataFrame:
    """For each anchor (of `found`: at, hash, hot): the bytes before it, nearest first, and from it on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for digest, t, found in zip(frame["digest"], frame["text"], frame["found"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                every, hashes = anchors(raw)
                low, high = reaches(every, hashes)
                place = dict(zip(every.tolist(), zip(low.tolist(), high.tolist(), strict=True), strict=True))
                for x in found:
                    at = x["at"]
                    left, right = place[at]
                    rows.append((x["hash"], x["hot"], digest, at, raw[max(0, at - left) : at][::-1], raw[at : at + right]))
                if len(rows) > 4000:
                    yield pd.DataFrame(rows, columns=["hash", "hot", "digest", "at", "before", "after"])
                    rows = []
            yield pd.DataFrame(rows, columns=["hash", "hot", "digest", "at", "before", "after"])

    return map_texts(texts, run, "hash long, hot boolean, digest binary, at int, before binary, after binary")


def extended(group: np.ndarray, before: list[bytes], after: list[bytes], copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (window, j, k): strings of LENGTH bytes that start j to k bytes before the window's anchor are repeated.

    group: the interval of each window. copies: how often it occurs, if equal windows were counted.
    """
    m = len(group)
    n_left = np.array([len(b) for b in before])
    n_right = np.array([len(a) for a in after])
    right = np.frombuffer(b"".join([a.ljust(LENGTH, b"\xff") for a in after]), np.uint8).reshape(m, LENGTH)
    left = np.frombuffer(b"".join([b.ljust(LEFT, b"\xff") for b in before]), np.uint8).reshape(m, LEFT)
    key = np.concatenate([(group.astype(np.int64) ^ np.int64(-(2**63))).view(np.uint64).astype(">u8").view(np.uint8).reshape(m, 8), right], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{8 + LENGTH}").ravel(), kind="stable")
    interval = np.cumsum(np.r_[0, group[order][1:] != group[order][:-1]])
    differ = right[order[1:]] != right[order[:-1]]
    common = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)]
    common[np.r_[True, interval[1:] != interval[:-1]]] = -1  # with the place before, -1 at an interval's start
    many = np.zeros(m, bool) if copies is None else copies > 1
    open_ = np.full(m, -1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(LEFT + 1):
        nearest = np.maximum(common, np.r_[common[1:], -1])
        nearest = np.where(many[order], LENGTH, nearest)
        hit = np.minimum(nearest, n_right[order]) >= LENGTH - j
        now = np.zeros(m, bool)
        now[order[hit]] = True
        starts, ends = now & (open_ < 0), (open_ >= 0) & ~now
        if ends.any():
            w = np.flatnonzero(ends)
            out.append((w, open_[w], np.full(len(w), j - 1)))
            open_[w] = -1
        open_[starts] = j
        # extend: drop what has no byte before, split each interval by it, drop intervals of one
        keep = np.flatnonzero(n_left[order] > j)
        if not len(keep) or j == LEFT:
            order = order[:0]
        else:
            byte = left[order[keep], j].astype(np.int64)
            split = np.argsort(interval[keep] * 256 + byte, kind="stable")
            place, code = keep[split], (interval[keep] * 256 + byte)[split]
            same = np.r_[False, code[1:] == code[:-1]]
            alone = ~same & ~np.r_[same[1:], False] & ~many[order[place]]
            place, same, code = place[~alone], same[~alone], code[~alone]
            if len(place):
                least = np.full(len(place), -1)
                s = np.flatnonzero(same)
                if len(s):
                    bounds = np.empty(2 * len(s), np.int64)
                    bounds[0::2], bounds[1::2] = place[s - 1] + 1, place[s] + 1
                    least[s] = np.minimum.reduceat(np.r_[common, -1], bounds)[0::2]
                common, order = least, order[place]
                interval = np.cumsum(~same)
            else:
                order = order[:0]
        if not len(order):
            common = interval = order
            break
    w = np.flatnonzero(open_ >= 0)
    if len(w):
        out.append((w, open_[w], np.minimum(j, n_left[w])))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the batches of a task, sorted by key, into frames of whole groups."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += len(frame)
        if size >= TOGETHER:
            every = pd.concat(held, ignore_index=True)
            last = int(np.searchsorted(every["key"].to_numpy(), every["key"].iloc[-1]))
            if last:
                yield every.iloc[:last]
            held = [every.iloc[last:]]
            size = len(held[0])
    if held:
        yield pd.concat(held, ignore_index=True)


def runs_of_places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in in_groups(frames):
        w, j, k = extended(f["key"].to_numpy(), list(f["before"]), list(f["after"]))
        at = f["at"].to_numpy()[w]
        yield pd.DataFrame({"digest": f["digest"].to_numpy()[w], "low": at - k, "high": at - j + LENGTH})


def runs_of_windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in in_groups(frames):
        w, j, k = extended(f["key"].to_numpy(), list(f["before"]), list(f["after"]), f["copies"].to_numpy())
        first, last = f["first"].to_numpy()[w], f["last"].to_numpy()[w]
        j, k = np.maximum(j, first), np.minimum(k, last)
        ok = j <= k
        yield pd.DataFrame({"hash": f["hash"].to_numpy()[w][ok], "window": f["window"].to_numpy()[w][ok], "j": j[ok], "k": k[ok]})


def hot_runs(hot: DataFrame, where: str) -> DataFrame:
    """The runs of places whose interval is hot: equal windows are counted, then dealt by offsets and surroundings."""
    spark = hot.sparkSession
    name = F.sha2(F.concat(F.lpad(F.octet_length("before").cast("string"), 4, "0").cast("binary"), "before", "after"), 256)
    marked = hot.withColumn("window", name)
    counts = written(marked.groupBy("hash", "window", "before", "after").agg(F.count(F.lit(1)).alias("copies")), f"{where}/hot-windows")
    steps = [(a, min(a + STEP - 1, LEFT)) for a in range(0, LEFT + 1, STEP)]
    part = lambda c, n: F.substr(c, F.lit(1), F.lit(n))
    route = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.xxhash64("hash", F.lit(a), part("before", a), part("after", LENGTH - b)).alias("key"), part("before", b).alias("before"), part("after", LENGTH - a).alias("after")) for a, b in steps]))
    # Each window's cuts: what the offsets of a step can reach of it.
    cuts = counts.withColumn("r", route).select("hash", F.col("window").alias("whole"), "copies", "r.*").where("octet_length(before) >= first").withColumn("window", name)
    dealt = written(cuts.groupBy("key", "first", "last", "hash", "window", "before", "after").agg(F.sum("copies").alias("copies")), f"{where}/hot-cuts")
    large = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"), f"{where}/hot-keys")
    sent = dealt.join(F.broadcast(large), "key", "left_anti").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = map_frames(sent, runs_of_windows, "hash long, window string, j int, k int").withColumn("first", F.expr(f"int(j div {STEP}) * {STEP}"))
    found = found.unionByName(counted_strings(dealt.join(F.broadcast(large), "key", "left_semi"), where))
    found = cuts.select("hash", "whole", "first", "window").join(found, ["hash", "first", "window"])
    found = found.groupBy("hash", F.col("whole").alias("window")).agg(F.collect_list(F.struct("j", "k")).alias("runs"))
    places = marked.select("hash", "window", "digest", "at").join(found, ["hash", "window"]).withColumn("r", F.explode("runs")).select("digest", "at", "r.j", "r.k")
    return places.select("digest", (F.col("at") - F.col("k")).alias("low"), (F.col("at") - F.col("j") + LENGTH).alias("high"))


def counted_strings(cuts: DataFrame, where: str) -> DataFrame:
    """The runs (hash, first, window, j, k = j) of cut windows, by counting each offset's string of LENGTH bytes."""
    own = cuts.withColumn("j", F.explode(F.sequence("first", "last"))).where(f"octet_length(before) >= j and octet_length(after) >= {LENGTH} - j")
    own = own.select("hash", "first", "window", "copies", "j", F.concat(F.substr("before", F.lit(1), F.col("j")), F.substr("after", F.lit(1), F.lit(LENGTH) - F.col("j"))).alias("string"))
    on = ["hash", "j", "string"]
    twice = written(own.groupBy(*on).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 1"), f"{where}/hot-strings")
    # Strings of very many windows are few, and sent to where the windows are.
    many, few = (twice.where(c).select(*on) for c in (F.col("n") > HOT, F.col("n") <= HOT))
    found = own.join(F.broadcast(many), on, "left_semi").unionByName(own.join(F.broadcast(many), on, "left_anti").join(few, on, "left_semi"))
    return found.select("hash", "first", "window", F.col("j").cast("int").alias("j"), F.col("j").cast("int").alias("k"))


def laid_over(texts: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, spans) of texts with their runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for digest, t, runs in zip(frame["digest"], frame["text"], frame["runs"], strict=True):
                raw, merged = t.encode("utf-8", "surrogatepass"), []
                for low, high in sorted((r["low"], r["high"]) for r in runs):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                kept, at = hashlib.sha256(), 0
                for low, high in merged:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                rows.append((digest, sum(b - a for a, b in merged), len(merged), kept.hexdigest(), merged))
            yield pd.DataFrame(rows, columns=["digest", "n_removed", "n_spans", "kept_sha256", "spans"])

    return map_texts(texts, run, "digest binary, n_removed long, n_spans long, kept_sha256 string, spans array<array<int>>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets) of each row."""
    spark = docs.sparkSession
    where = workspace(spark, "repeats")
    index = written(indexed(docs, id_col, text_col), f"{where}/index")
    groups = index.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n_bytes").alias("n_bytes"))
    groups = written(groups, f"{where}/groups")
    more = groups.where("copies > 1")
    others = index.join(more.select("digest", F.col("id").alias("_first")), "digest").where("not (id <=> _first)").select("id", "digest")
    others = written(others.distinct(), f"{where}/others")
    # Anchors are many bytes: only rows that may be one of the others go through the join.
    long, row, one = index.where(f"n_bytes >= {LENGTH}").select("id", "digest", "at", "hash"), F.xxhash64("id", "digest"), ["id", "digest"]
    once = maybe_wanted(long, row, others, row, others=True).unionByName(maybe_wanted(long, row, others, row).join(others, one, "left_anti"))

    # Rows that repeat with their id are left in: places are told apart by text and offset, not by row.
    flat = once.select("digest", F.explode(F.arrays_zip("hash", "at")).alias("x")).select("digest", "x.hash", "x.at")
    shared = flat.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", (F.col("n") > HOT).alias("hot"))
    shared = written(shared, f"{where}/shared")
    found = maybe_wanted(flat, F.col("hash"), shared, F.col("hash")).join(shared, "hash").groupBy("digest").agg(F.collect_set(F.struct("at", "hash", "hot")).alias("found"))
    found = written(found.join(groups.select("digest", "id", (F.col("copies") > 1).alias("whole")), "digest"), f"{where}/found")
    text = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    texts = maybe_wanted(text, F.coalesce("_id", F.lit(-1)), found, F.coalesce("id", F.lit(-1))).join(found.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id"))).where(F.unhex(F.sha2("text", 256)) == F.col("digest")).select("digest", "text", "found", "whole")
    texts = written(texts.dropDuplicates(["digest"]) if not _unique(index) else texts, f"{where}/texts")

    every = windows(texts)
    hot = shared.where("hot").limit(1).count() > 0
    cool = every.where("not hot") if hot else every
    sent = cool.select(F.col("hash").alias("key"), "digest", "at", "before", "after").repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    runs = map_frames(sent, runs_of_places, "digest binary, low int, high int")
    if hot:
        runs = runs.unionByName(hot_runs(every.where("hot"), where))
    runs = written(runs, f"{where}/runs")
    # Texts without a run stay as they are, copied ones go wholly: only the rest is shuffled again.
    some = written(runs.select("digest").distinct(), f"{where}/some")
    cut = maybe_wanted(texts.where("not whole").select("digest", "text"), F.col("digest"), some, F.col("digest"))
    runs = runs.groupBy("digest").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    partly = written(laid_over(cut.join(runs, "digest")), f"{where}/partly")

    whole = groups.select("digest", ((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).alias("whole"))
    told = whole.join(partly, "digest", "left").where("whole or n_removed is not null")
    out = index.select("id", "n_bytes", "digest").join(told, "digest", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return out.select(
        "id", "n_bytes",
        F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("whole"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(F.col("whole"), F.array(F.array(F.lit(0), F.col("n_bytes").cast("int")))).otherwise(F.coalesce("spans", F.array().cast("array<array<int>>"))).alias("spans"),
    )


def _unique(index: DataFrame) -> bool:
    """Whether no (id, text) occurs twice."""
    return index.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
