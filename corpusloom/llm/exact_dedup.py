"""Exact deduplication by stateful streams.

A batch pass reads each text once and puts (digest, id, length, locator) as a run into an inbox in the shared folder. A
Structured Streaming query folds the inbox, file group by file group, into keyed state that lives on disk (RocksDB) and
never expires: for each digest the number of rows and the locator of its content. It emits the digests that it has had
before, in this run or in earlier ones: the hits. Their full bytes are checked: those of this run by the smallest and largest
body of each digest, those of earlier runs by the content that is read from where the locators say. Texts that only
share a digest are told apart by a variant number beside it. A second stream over the checked rows then keeps, for each
digest and variant, the number of rows and the stable identifier of the row that stays. Later runs over the same
folder go on from both states.

A run is admitted to an inbox by one rename of a folder that was written before, under a name that follows from its rows (or
is given): a job that dies anywhere and is run again adds its rows once. What was written and is in no state is not
looked at. Runs that others follow write the content of each new digest once, to a folder of the run, which is the locator.

Defined results: null text counts as empty; texts of any length are compared whole; a null id loses to every other; rows with
the same id and equal text are copies of which one stays; an empty table gives an empty result; other columns, whatever
their names, are not looked at, and come back as they were from keep_first.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, maybe_wanted, settings, squeezed, workspace, written

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Files of the inbox that one micro-batch takes.
FILES_PER_BATCH = 64


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def prepared(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).cast("long").alias("points"), F.input_file_name().alias("locator"), squeezed(text).alias("body")).withColumn("digest", digest(F.col("body")))


KEY = ["digest", "variant"]


def there(spark: SparkSession, path: str):
    """The store of a path, the path, and whether it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, place, store.exists(place)


def admit(spark: SparkSession, df: DataFrame, inbox: str, run: str) -> None:
    """Puts rows into an inbox as one run, unless they are there: they are written beside it, and moved by one rename."""
    store, place, known = there(spark, f"{inbox}/{run}")
    if known:
        return
    beside = f"{inbox}-beside/{run}"
    df.write.mode("overwrite").parquet(beside)
    store.mkdirs(place.getParent())
    if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), place):
        raise OSError(f"{beside} could not be moved to {inbox}")


def run_name(spark: SparkSession, index: DataFrame, home: str, run: str | None) -> str:
    """The name of a run: that of an earlier try, if there was one, else a new one that sorts behind all others."""
    if run is None:
        found = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id", "digest", "points").cast("decimal(38,0)")).alias("h")).first()
        run = hashlib.sha256(f"{found.n} {found.h}".encode()).hexdigest()[:24]
    store, place, known = there(spark, f"{home}/runs")
    names = [f.getPath().getName() for f in store.listStatus(place)] if known else []
    for name in names:
        if name.partition("-")[2] == run:
            return name
    name = f"{time.time_ns():020d}-{run}"
    store.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/runs/{name}"))
    return name


def state(spark: SparkSession, folder: str, names: tuple[str, ...]) -> DataFrame | None:
    """The keys and values, by these names, of what has been folded; None before the first fold has ended."""
    store, place, known = there(spark, f"{folder}/commits")
    if not known or not any(f.getPath().getName().isdigit() for f in store.listStatus(place)):
        return None
    value = spark.read.format("statestore").load(folder)
    fields = value.schema["value"].dataType.fieldNames()
    return value.select("key.*", *[F.col(f"value.{f}").alias(c) for f, c in zip(fields, names, strict=False)])


def folded(spark: SparkSession, inbox: str, schema, keys: list[str], values: list[Column], folder: str, emit: Callable[[DataFrame, int], None] | None = None) -> None:
    """Runs a stream over what is new in an inbox, into state by keys. emit: gets what each micro-batch has changed."""
    with settings(spark, STATE_STORE):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).option("recursiveFileLookup", "true").parquet(inbox)
        stream = rows.groupBy(*keys).agg(*values).writeStream.outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True)
        (stream.foreachBatch(emit) if emit else stream.format("noop")).start().awaitTermination()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, folder: str | None = None, run: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest, variant.

    folder: where inboxes, states and contents are kept, for runs that add to earlier ones; the result then tells about the
    rows of docs, with the groups of all runs. run: a name by which a run that is tried again is known; without one, the
    same rows are the same run.
    """
    spark = docs.sparkSession
    own, home = workspace(spark, "dedup"), folder or workspace(spark, "dedup-state")
    rows = prepared(docs, id_col, text_col, digest)
    index = written(rows.drop("body"), f"{own}/index")
    name = run_name(spark, index, home, run) if folder else "0"
    place = f"{home}/contents/{name}"
    if folder:
        index = index.withColumn("locator", F.lit(place))

    # The first state: which digests were there before, and where their content is. It tells the hits.
    hits_at = f"{home}/hits"

    def emit(changed: DataFrame, batch: int) -> None:
        changed.where("n > 1").select("digest", "locator").write.mode("overwrite").parquet(f"{hits_at}/{batch}")

    admit(spark, index.select("digest", "locator"), f"{home}/arrivals", name)
    folded(spark, f"{home}/arrivals", index.select("digest", "locator").schema, ["digest"], [F.count(F.lit(1)).alias("n"), F.min("locator").alias("locator")], f"{home}/seen", emit)
    hits = spark.read.schema("digest binary, locator string").option("recursiveFileLookup", "true").parquet(hits_at)
    if folder:  # of this run only; hits of other runs stay for their tries
        hits = hits.join(index.select("digest").distinct(), "digest", "left_semi")
    hits = written(hits.groupBy("digest").agg(F.min("locator").alias("locator")), f"{own}/hits")

    # Full bytes of the hits: equal smallest and largest body means that all are equal. Groups shrink before the shuffle.
    seen = contents(spark, home, hits, own, name) if folder else None
    # Which rows are hits is known where they are read, so other bodies are not shuffled, whatever join follows.
    bodies = maybe_wanted(rows.select("digest", "body"), F.col("digest"), hits, F.col("digest"))
    bodies = bodies.join(hits.select("digest"), "digest", "left_semi").select("digest", "body")
    bodies = bodies if seen is None else bodies.union(seen.select("digest", "body"))
    clashing = written(bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("digest"), f"{own}/clashing")
    variants, index = None, index.withColumn("variant", F.lit(0))
    if not clashing.isEmpty():
        apart = rows.join(clashing, "digest", "left_semi")
        variants = written(numbered_variants(apart, None if seen is None else seen.join(clashing, "digest", "left_semi")), f"{own}/variants")
        mine = apart.join(variants, ["digest", "body"]).select("id", "points", *[F.lit(place).alias("locator") if folder else F.col("locator")], *KEY)
        index = index.join(clashing, "digest", "left_anti").unionByName(mine)
        if folder:
            there(spark, f"{home}/clashed")[0].mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/clashed/{name}"))
    if folder and not there(spark, f"{home}/inbox/{name}")[2]:
        fresh = rows.withColumn("variant", F.lit(0)).select(*KEY, "body") if variants is None else rows.join(clashing, "digest", "left_anti").select("digest", F.lit(0).alias("variant"), "body").union(variants.select(*KEY, "body"))
        fresh = fresh if seen is None else fresh.join(seen.select(*KEY), KEY, "left_anti")
        fresh.groupBy(*KEY).agg(F.min("body").alias("body")).write.mode("overwrite").parquet(place)

    # The second state: rows by digest and variant, and the one that stays.
    index = written(index.select("id", "points", *KEY), f"{own}/checked")
    admit(spark, index, f"{home}/inbox", name)
    keep = F.max(F.struct("points", (-F.col("id")).alias("turned"))).alias("keep")
    folded(spark, f"{home}/inbox", index.schema, KEY, [F.count(F.lit(1)).alias("n"), keep], f"{home}/state")
    states = written(state(spark, f"{home}/state", ("n", "keep")), f"{own}/states")
    groups = states.select(*KEY, F.col("n").alias("group_size"), (-F.col("keep.turned")).alias("keep_id"), F.col("keep.points").alias("keep_points"))
    # No window over this join, so that a digest with a great share of the rows may be split among tasks.
    best = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    found = written(index.join(groups, KEY).select("id", "keep_id", "group_size", best.alias("kept"), *KEY), f"{own}/found")
    again = written(found.where("kept").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), f"{own}/again")
    if again.isEmpty():
        return found
    # Rows that agree in id, text and length: one of them stays.
    same = found.where("kept").join(again, KEY, "left_semi")
    one = same.dropDuplicates(KEY)
    rest = same.groupBy(*same.columns).agg((F.count(F.lit(1)) - 1).cast("int").alias("times")).withColumn("kept", F.explode(F.array_repeat(F.lit(False), F.col("times")))).select(*found.columns)
    return found.where("not kept").unionByName(found.where("kept").join(again, KEY, "left_anti")).unionByName(one).unionByName(rest)


def contents(spark: SparkSession, home: str, hits: DataFrame, where: str, name: str) -> DataFrame | None:
    """digest, variant, body of what the folder has of the hits. Only runs that are in the inbox count, this one too if it is run again.

    Where all locators name such runs, only these are read, and those that had to tell variants apart; else all runs are.
    """
    listed = lambda folder: {f.getPath().getName() for f in x[0].listStatus(x[1])} if (x := there(spark, folder))[2] else set()
    admitted = listed(f"{home}/inbox")
    at = {r[0].rpartition("/")[2] for r in hits.select("locator").distinct().collect()} - ({name} - admitted)  # one for each run
    read = sorted(at | (listed(f"{home}/clashed") & admitted) | ({name} & admitted) if at <= admitted else admitted)
    if not read:
        return None
    found = spark.read.schema("digest binary, variant int, body string").parquet(*[f"{home}/contents/{n}" for n in read])
    return written(found.join(hits.select("digest"), "digest", "left_semi").dropDuplicates(KEY), f"{where}/earlier")


def numbered_variants(apart: DataFrame, known: DataFrame | None) -> DataFrame:
    """digest, body, variant: the numbers that bodies have, and the next ones for new bodies."""
    bodies = apart.select("digest", "body").distinct()
    if known is None:
        new = bodies.withColumn("base", F.lit(0))
    else:
        base = known.groupBy("digest").agg((F.max("variant") + 1).alias("base"))
        new = bodies.join(known.select("digest", "body"), ["digest", "body"], "left_anti").join(base, "digest", "left").withColumn("base", F.coalesce("base", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("digest").orderBy("body")) - 1
    new = new.withColumn("variant", (F.col("base") + place).cast("int")).select("digest", "body", "variant")
    return new if known is None else new.unionByName(known.select("digest", "body", "variant"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    own = workspace(docs.sparkSession, "dedup-keep")
    found = written(deduplicate(docs, id_col, text_col), f"{own}/found")
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.length(text_col).alias("points"), F.col(text_col).alias("text"), sha256(squeezed(F.col(text_col))).alias("digest"))
    drop = found.where("not kept").select(F.col("id").alias("i"), F.col("digest").alias("d")).distinct()
    drop = written(drop, f"{own}/drop")
    kept = found.where("kept").select(F.col("id").alias("i"), F.col("digest").alias("d"))
    twice = written(kept.join(drop, (kept["d"] == drop["d"]) & kept["i"].eqNullSafe(drop["i"]), "left_semi"), f"{own}/twice")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d"))
    out = row.join(drop, same, "left_anti")
    if not twice.isEmpty():  # rows of one id and equal texts, of which one stays
        first = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.col("points").desc(), "text"))
        out = out.unionByName(row.join(twice, same, "left_semi").withColumn("first", first).where("first = 1").drop("first"))
    return out.select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), r AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
"""
