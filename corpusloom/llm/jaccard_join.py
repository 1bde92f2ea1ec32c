"""Self-join of documents by the Jaccard similarity of their word n-grams, and the components of its links.

1. Each text becomes the set of the 64-bit hashes of its shingles; equal sets are joined once, however many copies
   there are. GROUPS groups of hashes are counted: the set's count vector.
2. Two sets at or over the threshold share one of the first n - ceil(t n) + 1 hashes of any order of all hashes. The
   order puts hashes that a bounded sample shows to be common last. Hashes that two sets have there make candidates.
3. First, each set of a hash's group is compared with the group's smallest id, and where that leaves more components,
   with CENTRES others; what is linked so far is one component. Then an R-tree over the count vectors of a group finds the pairs of different components whose overlap
   can suffice: the sum over groups of the smaller count - at a node, of the query's count and the node's largest -
   is no less than the overlap; a hash too far behind in a set to be the pair's first common one is passed over, as the
   first one finds the pair. Links inside a component need no search, so a group of near copies makes about as
   many pairs as it has members, and no link between components is missed.
4. Surviving pairs are verified on the whole sets. Words are hashed by XXH3 to 64 bits, and shingles by mixing their words'.

A hash's group of more than BLOCK members is not gathered: its members are dealt to blocks by a hash of their ids, and each
pair of blocks is searched in a group of its own.

Defined results: null text or text without words has an empty set, no links, and is its own component; with fewer than
`words` words the whole sequence is the one shingle; texts of any length give all their shingles; rows that share an id
are one document; rows without an id take part, and their component is the smallest id reached, or null; an empty table
gives no rows. Other columns, whatever their names, are not looked at, and come back as they were from keep_one. Ids
below -2^62 are kept for rows without one, and are an error.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from corpusloom.llm.common import components, documents, lists, map_frames, map_texts, maybe_wanted, sampled, shuffle_partitions, texts_udf, workspace, written

GROUPS = 64
#: Groups of the vector that a pair is bounded by once more before its sets are fetched.
FINE = 512
#: Rows of the sample that shows which hashes are common, and in how many of them a common one is.
SAMPLE_DOCS, COMMON = 20_000, 8
#: Further members of a hash's group that members of other components are compared with before the search.
CENTRES = 4
LEAF, FANOUT = 32, 8
#: Pairs of tree nodes, or of points, that are bounded at once.
TOGETHER = 100_000

#: Members of a hash's group that are searched together; ids below this stand for rows without one.
BLOCK = 1000
NO_ID = -(1 << 62)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; ASCII letters count as lower case."""
    every = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not every:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(xxh3_64_intdigest, every), np.uint64, len(every))
    k = min(words, len(word))
    out = np.zeros(len(word) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + word[i : len(word) - k + 1 + i])
    if len(word) < words:
        out = _mix(out + np.uint64(len(word)))
    return np.unique(out)


def needed(n: np.ndarray | int, percent: int):
    """Overlap that a pair needs whose larger set has n members, at least."""
    return -(-n * percent // 100)


def enough(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that sets of these sizes need: their union is both sizes less the overlap."""
    return -(-(n + m) * percent // (100 + percent))


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """id, n, digest of the set, its first hashes, and its count vectors (8 bits a group, 255 for more); mark: of rows
    without id, the text's digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame["text"]:
                h = shingles(t, words)
                n = len(h)
                if not n:
                    rows.append((0, None, None, None, None))
                    continue
                late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h if len(common) else np.zeros(n, bool)
                first = np.concatenate([h[~late], h[late]])[: n - needed(n, percent) + 1]
                counted = [np.minimum(np.bincount(h % np.uint64(g), minlength=g), 255).astype(np.uint8).tobytes() for g in (GROUPS, FINE)]
                rows.append((n, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), first.view(np.int64), *counted))
            out = pd.DataFrame(rows, columns=["n", "digest", "first", "vector", "fine"])
            yield out.assign(id=frame["id"].astype("Int64").array, mark=frame["mark"].array)

    return map_texts(keyed(docs, id_col, text_col), run, "id long, n long, digest binary, first array<long>, vector binary, fine binary, mark string")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, mark."""
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(id_.alias("id"), text.alias("text"), F.when(id_.isNull(), F.sha2(F.coalesce(text, F.lit("")), 256)).alias("mark"))


def common_hashes(docs: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """Hashes found in COMMON rows of the sample, or more: at most its shingles over COMMON."""
    some = sampled(docs, SAMPLE_DOCS, id_col, text_col).select(F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame["text"]:
                yield pd.DataFrame({"h": shingles(t, words).view(np.int64)})

    found = map_texts(some, run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    return np.sort(found.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def vectors(raw) -> np.ndarray:
    raw = list(raw)
    v = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1).astype(np.int32)
    v[v == 255] = 1 << 20  # a count that did not fit bounds nothing
    return v


def can(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


class RTree:
    """Count vectors in an R-tree: packed in order of set size, each node with its largest counts, sizes and parts."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, parts: np.ndarray):
        self.levels = [(points, sizes, sizes, parts, parts)]
        width = LEAF
        while len(self.levels[-1][0]) > width:
            top, low, high, first, last = self.levels[-1]
            at = np.arange(0, len(top), width)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))
            width = FANOUT

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of different parts whose overlap can suffice: pairs of nodes from the root down."""
        k = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[k][0]), 1 if k == 0 else 0)
        found, todo = [(i[:0], j[:0])], [(k, i, j)]
        while todo:  # depth first, a bounded number of pairs at once
            k, i, j = todo.pop()
            i, j = self._kept(k, i, j, percent)
            if k == 0:
                found.append((i, j))
                continue
            width, below = (LEAF if k == 1 else FANOUT), len(self.levels[k - 1][0])
            a, b = np.divmod(np.arange(width * width), width)
            step = max(1, TOGETHER // (width * width))
            if len(i) > step:
                todo += [(k, i[s : s + step], j[s : s + step]) for s in range(0, len(i), step)]
                continue
            i, j = (i[:, None] * width + a).ravel(), (j[:, None] * width + b).ravel()
            ok = (i < below) & (j < below) & ((i < j) if k == 1 else (i <= j))
            todo.append((k - 1, i[ok], j[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _kept(self, k: int, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        top, low, high, first, last = self.levels[k]
        ok = (low[i] * percent <= high[j] * 100) & (low[j] * percent <= high[i] * 100)
        ok &= ~((first[i] == last[i]) & (first[j] == last[j]) & (first[i] == first[j]))
        i, j = i[ok], j[ok]
        ok = np.minimum(top[i], top[j]).sum(axis=1) >= enough(low[i], low[j], percent)
        return i[ok], j[ok]


def across(percent: int):
    """Pairs of a hash's group, of different components, that the R-tree leaves; equal pairs of a batch once.

    Groups of a leaf or less are bounded together, each against those behind it in its group.
    """

    def batch(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        h, ids, sizes, parts, places = (f[c].to_numpy() for c in ("key", "id", "n", "part", "pos"))
        order = np.lexsort((sizes, h))
        h, ids, sizes, parts, places = h[order], ids[order], sizes[order], parts[order], places[order]
        points = vectors(f["vector"])[order]
        edges = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
        large = np.flatnonzero(np.diff(edges) > LEAF)
        a, b = [], []
        for g in large:
            s = slice(edges[g], edges[g + 1])
            i, j = RTree(points[s], sizes[s], parts[s]).pairs(percent)
            ok = early(sizes[s], places[s], i, j)
            a.append(ids[s][i[ok]])
            b.append(ids[s][j[ok]])
            if sum(map(len, a)) > 4 * TOGETHER:
                yield told(a, b)
                a, b = [], []
        small = np.repeat(np.diff(edges) <= LEAF, np.diff(edges))
        for k in range(1, LEAF):
            i = np.flatnonzero(small[: len(h) - k] & (h[: len(h) - k] == h[k:]))
            if not len(i):
                break
            i = i[can(sizes[i], sizes[i + k], percent) & (parts[i] != parts[i + k]) & early(sizes, places, i, i + k)]
            for s in range(0, len(i), TOGETHER):
                x = i[s : s + TOGETHER]
                ok = np.minimum(points[x], points[x + k]).sum(axis=1) >= enough(sizes[x], sizes[x + k], percent)
                a.append(ids[x[ok]])
                b.append(ids[x[ok] + k])
        yield told(a, b)

    def early(n: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the hash can be the first that both sets have: what is before it in either is not in the other."""
        least = enough(n[i], n[j], percent)
        return (place[i] <= n[i] - least) & (place[j] <= n[j] - least)

    def told(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= 20_000:
                every = pd.concat(held, ignore_index=True)
                last = int(np.searchsorted(every["key"].to_numpy(), every["key"].iloc[-1]))
                if last:
                    yield from batch(every.iloc[:last])
                held, size = [every.iloc[last:]], len(every) - last
        if size:
            yield from batch(pd.concat(held, ignore_index=True))

    return run


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    one = whole.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = whole.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("i") >= percent * (F.size("set_a") + F.size("set_b") - F.col("i"))).select("a", "b")


def clusters(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, digest, mark) of each row, and (digest, component) of each set: the smallest id that it reaches, or for
    sets that no id is reached from, a number below NO_ID."""
    spark = docs.sparkSession
    where = workspace(spark, "jaccard")
    sent = spark.sparkContext.broadcast(common_hashes(docs, id_col, text_col, words)).value
    index = written(sets(docs, id_col, text_col, words, percent, sent), f"{where}/index")
    if not index.where(F.col("id") < NO_ID).isEmpty():
        raise ValueError(f"ids below {NO_ID} are kept for rows without one")
    # One member for each distinct set; copies shrink where they are read. A set that no row with an id has gets a number.
    number = F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1)) - F.lit(1 << 62) - F.lit((1 << 62) - 1)
    groups = index.where("n > 0").groupBy("digest").agg(F.min("id").alias("real"), F.max("n").alias("n"), F.first("vector").alias("vector"), F.first("fine").alias("fine"), F.min("mark").alias("mark"))
    groups = written(groups.withColumn("id", F.coalesce("real", number)), f"{where}/groups")
    own = groups.select("digest", F.col("id").alias("own"))
    first = groups.select("digest", F.col("id").alias("own"), "real", F.col("mark").alias("m"))
    chosen = index.where("n > 0").join(first, "digest").where("id <=> real and (real is not null or mark <=> m)")
    once = chosen.select(F.col("own").alias("id"), F.posexplode("first").alias("pos", "h"))

    shared = written(once.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre"), F.max("id").alias("other")).where("centre <> other").select("h", "centre"), f"{where}/shared")
    posts = written(maybe_wanted(once, F.col("h"), shared, F.col("h")).join(shared, "h").distinct(), f"{where}/posts")
    members = groups.select("id", "n", "vector")

    stars = posts.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(bounded(stars, members, percent), f"{where}/stars")
    fine = groups.select("id", "n", F.col("fine").alias("vector"))
    near = written(bounded(stars, fine, percent), f"{where}/near1")
    # Texts by the number of their set's member: the id, or what stands for it.
    text = keyed(docs, id_col, text_col)
    nameless = written(groups.where("real is null").select(F.col("mark").alias("m"), F.col("id").alias("number")), f"{where}/nameless")
    some = not nameless.isEmpty()

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        wanted = written(pairs.select(F.col("a").alias("w")).union(pairs.select(F.col("b").alias("w"))).distinct(), f"{where}/{name}-wanted")
        full = texts_udf(lambda texts: lists([shingles(t, words).view(np.int64) for t in texts], pa.int64()), "array<long>")
        mine = maybe_wanted(text.where("id is not null").select("id", "text"), F.col("id"), wanted, F.col("w"))
        if some:
            mine = mine.union(text.where("id is null").join(nameless, F.col("mark") == F.col("m")).select(F.col("number").alias("id"), "text"))
        rows = mine.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("w")).select("id", full("text").alias("set"))
        return written(rows, f"{where}/{name}")

    links = written(verified(near, sets_of(near, "sets1"), percent), f"{where}/links1")
    parts = written(components(links, f"{where}/parts1"), f"{where}/parts")

    def open_groups(parts: DataFrame, name: str) -> DataFrame:
        """(id, h, pos, part) of the groups that members of more than one component are in."""
        tagged = posts.select("id", "h", "pos").join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "id")).select("id", "h", "pos", "part")
        split = tagged.groupBy("h").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("h")
        return written(tagged.join(split, "h", "left_semi"), f"{where}/{name}")

    # Members that are far from the smallest id may be near to others: a few more, by a hash, as centres.
    opened = open_groups(parts, "open1")
    centres = opened.groupBy("h").agg(*[F.min_by(F.struct("id", "part"), F.xxhash64(F.lit(k), "id")).alias(f"c{k}") for k in range(CENTRES)])
    beside = written(opened.join(centres, "h"), f"{where}/beside")
    near = [beside.where(F.col("part") != F.col(f"c{k}.part")).select(F.least("id", f"c{k}.id").alias("a"), F.greatest("id", f"c{k}.id").alias("b")) for k in range(CENTRES)]
    near = functools.reduce(DataFrame.union, near).distinct().join(stars, ["a", "b"], "left_anti")
    near = written(bounded(near, members, percent), f"{where}/near2-coarse")
    more = written(bounded(near, fine, percent), f"{where}/near2")
    if not more.isEmpty():
        links = written(links.union(verified(more, sets_of(more, "sets2"), percent)), f"{where}/links2")
        parts = written(components(links, f"{where}/parts2"), f"{where}/parts-2")
        opened = open_groups(parts, "open2")

    open_ = opened.join(members, "id").select("h", "id", "pos", "part", "n", "vector")
    large = written(opened.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("h", F.expr(f"int((m + {BLOCK - 1}) div {BLOCK})").alias("blocks")), f"{where}/large")
    sent = open_.withColumn("key", F.col("h"))
    if not large.isEmpty():
        dealt = open_.join(large, "h").withColumn("block", F.expr("int(pmod(xxhash64(id), blocks))")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumn("key", F.xxhash64("h", F.least("block", "other"), F.greatest("block", "other")))
        sent = sent.join(large, "h", "left_anti").unionByName(dealt.select(*sent.columns))
    found = map_frames(sent.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key"), across(percent), "a long, b long").distinct()
    found = written(found.join(stars, ["a", "b"], "left_anti"), f"{where}/found")
    found = written(bounded(found, fine, percent), f"{where}/near3")
    if not found.isEmpty():
        links = links.union(verified(found, sets_of(found, "sets3"), percent))
        parts = written(components(links, f"{where}/parts3"), f"{where}/all")

    found = own.join(parts, F.col("own") == F.col("node"), "left").select("digest", F.coalesce("component", "own").alias("component"))
    if some:  # numbers that stand for ids are the smallest: where there is an id, it is the component's
        ends = found.where(F.col("component") < NO_ID).join(groups.select("digest", "real"), "digest").groupBy(F.col("component").alias("c")).agg(F.min("real").alias("least")).where("least is not null")
        found = found.join(ends, F.col("component") == F.col("c"), "left").select("digest", F.coalesce("least", "component").alias("component"))
    return index.select("id", "n", "digest", "mark"), written(found, f"{where}/components")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component_id of each row."""
    index, found = clusters(docs, id_col, text_col, words, percent)
    out = index.join(found, "digest", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("component") >= NO_ID, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def bounded(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sum of smaller counts leaves."""
    one = members.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("vector").alias("v_a"))
    two = members.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("vector").alias("v_b"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                n, m = f["n_a"].to_numpy(), f["n_b"].to_numpy()
                most = np.minimum(vectors(f["v_a"]), vectors(f["v_b"])).sum(axis=1)
                ok = (most >= enough(n, m, percent)) & can(n, m, percent)
                yield f.loc[ok, ["a", "b"]]

    return map_frames(pairs.join(one, "a").join(two, "b"), run, "a long, b long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A document of each component: the one whose id is the smallest, or of those without ids, one text."""
    index, found = clusters(docs, id_col, text_col, words, percent)
    where = workspace(docs.sparkSession, "jaccard-keep")
    drop = written(index.join(found, "digest").where("id <> component").select(F.col("id").alias("i")).distinct(), f"{where}/drop")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("text"))
    out = row.where("id is not null").join(drop, F.col("id") == F.col("i"), "left_anti")
    nameless = row.where("id is null")
    if not nameless.isEmpty():
        texts = index.where("id is null").join(found, "digest", "left").groupBy(F.coalesce("component", F.xxhash64("mark")).alias("c"), F.col("component").isNull().alias("empty")).agg(F.min("mark").alias("m"))
        stay = texts.where((F.col("c") < NO_ID) | F.col("empty")).select("m").distinct()
        out = out.unionByName(nameless.join(stay, F.col("text") == F.col("m"), "left_semi").dropDuplicates(["text"]))
    return out.select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir), words=4, percent=85).withColumnRenamed("id", "doc_id")
