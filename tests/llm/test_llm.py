"""The training-data operators against brute force, round trips and held-out accuracy, and on odd input."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, common, exact_dedup, jaccard_join, kd_sharding, language_id, mixing, mpeg_audio, personal_data, repeated_spans, sentencepieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, body string, part string, digest string, size string"


def table(spark, rows):
    """Documents with null metadata and further columns whose names clash with the operators' own."""
    full = [(*r, *[None] * (5 - len(r)), "x", 1, "b", "p", "d", "s") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


WORDS = {
    "en": "the of and that with this from house river mountain water which their would there people little".split(),
    "de": "der die und das nicht mit eine haus fluss berg wasser welche würde leute schön über straße kleine".split(),
}


def prose(r, n, lang="en"):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    base = [prose(r, r.choice([3, 40, 120, 300])) for _ in range(40)]
    shared = prose(r, 70)
    rows = []
    for i in range(120):
        t = r.choice(base) if i % 3 == 0 else prose(r, r.choice([1, 5, 60, 150]))
        words = t.split(" ")
        if i % 6 == 0 and len(words) > 50:
            words[r.randrange(len(words))] = "changed"
        if i % 5 == 0:
            words += shared.split(" ")
        rows.append((i, (" " if i % 4 else "  ").join(words), "en", f"s{i % 3}" if i % 10 else None))
    rows += [(120, None, None, None), (121, "", "en", "s1"), (122, " \t\n ", "en", "s1"), (123, "é" * 3000, "de", "s2"), (124, "a b " * 4000, "en", "s0"), (125, "a b " * 4000, "en", "s0"), (None, "no id here", None, None), (126, "the very same row", "en", "s0"), (126, "the very same row", "en", "s0")]
    return rows


EMPTY = []


# 2


def expected_dedup(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d))
    return groups


def test_exact_dedup_equals_brute_force(spark, corpus):
    out = exact_dedup.deduplicate(table(spark, corpus)).collect()
    groups = expected_dedup(corpus)
    assert len(out) == len(corpus)
    assert sum(r["kept"] for r in out) == len(groups)
    by = {hashlib.sha256(k.encode()).digest(): (min(v)[2], len(v)) for k, v in groups.items()}
    assert all((r["keep_id"], r["group_size"]) == by[bytes(r["digest"])] for r in out)
    kept = exact_dedup.keep_first(table(spark, corpus))
    assert kept.count() == len(groups)
    assert kept.columns == table(spark, []).columns


def test_equal_digests_of_other_texts_are_told_apart(spark, corpus):
    weak = lambda body: F.encode((F.length(body) % 2).cast("string"), "UTF-8")
    out = exact_dedup.deduplicate(table(spark, corpus), digest=weak).collect()
    assert sum(r["kept"] for r in out) == len(expected_dedup(corpus))


def test_dedup_state_goes_on(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    exact_dedup.deduplicate(table(spark, [(5, "a b"), (6, "c")]), folder=folder).collect()
    out = exact_dedup.deduplicate(table(spark, [(1, "ab"), (2, "d")]), folder=folder).collect()
    assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(1, 5, 2, False), (2, 2, 1, True)}


# 5


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_kd_shards_are_near_equal(spark, corpus, shards):
    out = kd_sharding.shard(table(spark, corpus), shards=shards).collect()
    assert len(out) == len(corpus)
    sizes, slots = Counter(), {}
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 3 * max(r["size"] for r in out)


def test_kd_sharding_cuts_a_hot_group(spark):
    rows = [(i, "the same text " * 20, "en", "hot") for i in range(900)] + [(i, f"text {i} " * 20, "en", f"s{i % 5}") for i in range(900, 1800)]
    out = kd_sharding.shard(table(spark, rows), shards=8)
    sizes = [r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8
    assert max(sizes) <= 1.03 * min(sizes)
    assert out.sparkSession.createDataFrame(out.limit(0).collect(), out.schema).count() == 0
    assert kd_sharding.shard(table(spark, rows), target_bytes=100_000).select("shard").distinct().count() > 1


# 7


def test_media_round_trip(spark, corpus):
    docs = table(spark, corpus)
    out = mpeg_audio.with_media(docs, F.col("text")).select("text", mpeg_audio.read_media("media").alias("m")).select("text", "m.*").collect()
    for r in out:
        raw = (r["text"] or "").encode()
        assert r["payload"] == raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["bad_checksums"] == r["skipped_bytes"] == 0


def test_mpeg_reader_resynchronises_and_checks():
    media = mpeg_audio.encode(bytes(range(250)) * 40)
    seen = mpeg_audio.parse(media)
    assert seen["vbr"]["frames"] == len(seen["frames"]) == 8
    assert seen["seconds"] == mpeg_audio.Fraction(8 * 1152, 32000)
    assert seen["vbr"]["bytes"] == len(media) - seen["frames"][0][0] + 216
    at = seen["frames"][3][0]
    broken = bytearray(media)
    broken[at + 8] ^= 1
    assert mpeg_audio.parse(bytes(broken))["bad"] == 1
    junk = media[:at] + b"junk\xff\xfbjunk" + media[at:]
    again = mpeg_audio.parse(junk)
    assert again["skipped"] == 10
    assert len(again["frames"]) == 8
    tagged = media + b"TAG" + b"title".ljust(125, b"\0")
    assert mpeg_audio.parse(tagged)["tags"]["ID3v1"] == b"title"
    assert mpeg_audio.parse(b"")["frames"] == []
    assert mpeg_audio.header(b"\xff\xfb\x90\x00")["size"] == 417
    assert mpeg_audio.header(b"\xff\xf3\x40\xc0")["version"] == "2"


# 8


def test_mix_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([1000, 10, 10], [1, 2, 3]) == [960, 30, 30]
    assert mixing.targets([], []) == []


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_mix_takes_near_the_target(spark, corpus):
    docs = table(spark, corpus)
    where = common.workspace(spark, "test")
    placed, found = mixing.stream(docs, "doc_id", "text", "source", where)
    used = mixing.uses(placed, mixing.slots(spark, found))
    taken = Counter()
    for r in used.collect():
        taken[r["source"]] += (r["high"] - r["low"]) * r["n"]
        assert r["n"] <= 3
    for x in found:
        assert abs(taken[x["source"]] - x["target"]) <= 3 * mixing.BLOCK
    assert [x["source"] for x in found] == ["s0", "s1", "s2", None]
    out = mixing.mixed(docs)
    words = lambda t: len(re.findall(common.WORD, t))
    assert abs(sum(words(r["text"]) for r in out.collect()) - sum(taken.values())) <= 10
    assert out.columns == docs.columns


def test_many_shards_stay_near_the_target(spark):
    sizes = {"a": 26_000_000, "b": 1, "c": 64, "d": 64 * 47, "e": 64 * 900 + 5, "f": 30_000_000, None: 64 * 12}
    found = [{"src": i, "source": s, "size": n, "blocks": -(-n // mixing.BLOCK)} for i, (s, n) in enumerate(sizes.items())]
    # Targets below, at and between whole blocks, and at the stop of three rounds.
    for x, t in zip(found, (25_000_000, 3, 192, 64 * 46.5, 3 * (64 * 900 + 5), 31_000_000, 64 * 8), strict=True):
        x["target"] = float(t)
    rows = mixing.slots(spark, found).groupBy("source", "block").count().toPandas()
    shards = mixing.slots(spark, found).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("m"), F.max("slot").alias("last")).collect()
    assert len(shards) > 200 and all(r["n"] == r["m"] == r["last"] + 1 for r in shards) and sum(r["n"] < mixing.SLOTS for r in shards) <= 1
    for x in found:
        own = rows[rows["source"].isna() if x["source"] is None else rows["source"] == x["source"]]
        assert own["count"].max() <= 3 and own["block"].between(0, x["blocks"] - 1).all()
        taken = (np.minimum(mixing.BLOCK, x["size"] - own["block"] * mixing.BLOCK) * own["count"]).sum()
        assert abs(taken - x["target"]) <= 2 * mixing.BLOCK, (x, taken)
        if x["target"] == 3 * x["size"]:
            assert taken == x["target"]


def test_a_shard_is_drawn_alike_alone():
    every = np.array([5_000_000, 3, 0, 47, 1])
    whole = list(mixing.dealt(range(1221), every))
    assert (sum(n for *_, n in whole) == every).all()
    for s in (0, 7, 700, 1220):
        ((_, start, n),) = mixing.dealt([s], every)
        assert (start == whole[s][1]).all() and (n == whole[s][2]).all()


# 4


def test_encoding_equals_the_library(spark, corpus):
    import sentencepiece

    path = sentencepieces.model_path()
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Encoder(sentencepieces.vocabulary(path))
    r = random.Random(3)
    bits = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "日", "😀", "ing", "12", ".", "\x00", "<s>", "    ", "�"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert own.encode(t) == model.encode(t), repr(t)
        assert own.decode(own.encode(t)) == model.decode(model.encode(t)), repr(t)
    assert own.decode([0x0A + 3, 200, 195 + 3]) == model.decode([0x0A + 3, 200, 195 + 3])
    out = sentencepieces.token_digests(table(spark, corpus), path).collect()
    text = {d: t or "" for d, t, *_ in corpus}
    for x in out:
        ids = model.encode(text[x["doc_id"]])
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    both = sentencepieces.decoded(sentencepieces.encoded(table(spark, corpus), path).withColumnRenamed("text", "old"), path)
    assert both.where("text <> coalesce(old, '')").count() == 0


# 6


def brute_spans(rows):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for (d, *_), b in zip(rows, raw, strict=True):
        cover = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                cover[i : i + 200] = True
        runs = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover[:-1]])
        out.append((d, len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats_equal_brute_force(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(repeated_spans, "HOT", hot)
    rows = [*corpus, (200, "x\x00" * 300), (201, "y" + "x\x00" * 150), (202, "é" * 150 + "end")]
    out = repeated_spans.repeats(table(spark, rows))
    assert Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()) == brute_spans(rows)


def test_only_texts_that_are_cut_go_to_the_cutting(spark, monkeypatch):
    """Copied texts go wholly and texts without a run stay whole; neither is laid out again."""
    r = random.Random(11)
    passage = prose(r, 60)
    copied = f"{prose(r, 40)} {passage} {prose(r, 40)}"
    rows = [(1, copied), (2, copied), (3, f"{prose(r, 30)} {passage}"), (4, prose(r, 80)), (None, f"{passage} {prose(r, 20)}"), (5, None)]
    seen = []

    def noted(texts, run=repeated_spans.laid_over):
        seen.extend(x["text"] for x in texts.select("text").collect())
        return run(texts)

    monkeypatch.setattr(repeated_spans, "laid_over", noted)
    out = repeated_spans.repeats(table(spark, rows))
    assert Counter((x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out.collect()) == brute_spans(rows)
    assert sorted(seen) == sorted([rows[2][1], rows[4][1]])


@pytest.mark.parametrize("mapped", [1 << 24, 0])
def test_wanted_rows_and_surely_unwanted_ones_are_all_rows(spark, monkeypatch, mapped):
    monkeypatch.setattr(common, "MAPPED", mapped)
    rows = spark.createDataFrame([(i, f"x{i}") for i in range(500)] + [(None, "none")], "k long, v string")
    wanted = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "w long")
    key = F.xxhash64("k", F.lit(1)), wanted, F.xxhash64("w", F.lit(1))
    maybe, no = common.maybe_wanted(rows, *key).collect(), common.maybe_wanted(rows, *key, others=True).collect()
    assert Counter(map(tuple, maybe + no)) == Counter(map(tuple, rows.collect()))
    assert not {x["k"] for x in no} & {None, *range(0, 500, 7)}
    assert len(no) > 400 or not mapped


def test_a_passage_of_all_rows_is_not_gathered(spark, monkeypatch, tmp_path):
    """Every row has the passage, and other bytes around it: no task extends more than the bound of one group."""
    monkeypatch.setattr(repeated_spans, "HOT", 20)
    r = random.Random(4)
    passage = prose(r, 60)
    rows = [(i, f"{prose(r, 8)} {i} {passage} {i} {prose(r, 50)}") for i in range(80)]
    seen = tmp_path / "sizes"

    def noted(frames, run=repeated_spans.runs_of_windows):
        def told():
            for f in frames:
                with open(seen, "a") as out:
                    out.writelines(f"{n}\n" for n in f["key"].value_counts())
                yield f
        return run(told())

    monkeypatch.setattr(repeated_spans, "runs_of_windows", noted)
    out = repeated_spans.repeats(table(spark, rows))
    assert Counter((x["id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out.collect()) == brute_spans(rows)
    assert max(map(int, seen.read_text().split())) <= 20


# 9


def brute_links(rows, words, percent):
    """(id, set size, smallest id reached) of each row; rows of one id are one document, rows without one their own."""
    sets = []
    for k, (d, t, *_) in enumerate(rows):
        w = re.findall(common.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, k if d is None else -1, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    parent = {(d, k): (d, k) for d, k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, j, s) in enumerate(sets):
        for b, k, z in sets[:i]:
            if s and z and 100 * len(s & z) >= percent * len(s | z):
                x, y = sorted((root((a, j)), root((b, k))), key=lambda n: (n[0] is None, n))
                parent[y] = x
    return Counter((d, len(s), root((d, k))[0]) for d, k, s in sets)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_links_equal_brute_force(spark, corpus, words, percent):
    rows = [*corpus, (300, "One two THREE"), (301, "one two three")]
    out = jaccard_join.linked(table(spark, rows), words=words, percent=percent).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in out) == brute_links(rows, words, percent)
    kept = jaccard_join.keep_one(table(spark, rows), words=words, percent=percent)
    assert kept.where("doc_id is not null").select("doc_id").distinct().count() == len({c for d, _, c in brute_links(rows, words, percent) if d is not None})


def test_rtree_loses_no_pair():
    r = np.random.default_rng(1)
    for m in (2, 40, 400):
        points = r.integers(0, 6, (m, jaccard_join.GROUPS)).astype(np.int32)
        points[m // 2 :] = points[: m - m // 2] + (r.random((m - m // 2, jaccard_join.GROUPS)) < 0.05)
        sizes, parts = points.sum(axis=1), np.arange(m) // 2
        order = np.argsort(sizes, kind="stable")
        points, sizes, parts = points[order], sizes[order], parts[order]
        i, j = jaccard_join.RTree(points, sizes, parts).pairs(85)
        a, b = np.triu_indices(m, 1)
        ok = jaccard_join.can(sizes[a], sizes[b], 85) & (parts[a] != parts[b]) & (np.minimum(points[a], points[b]).sum(axis=1) >= jaccard_join.enough(sizes[a], sizes[b], 85))
        assert set(zip(a[ok], b[ok], strict=True)) <= set(zip(i, j, strict=True))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)], "a long, b long")
    out = dict(common.components(links, common.workspace(spark, "test")).collect())
    assert {out[k] for k in range(1, 41)} == {0}
    assert {out[k] for k in range(101, 160)} == {100}


def test_rounds_of_components_collect_nothing(spark, monkeypatch):
    plans, write = [], common.written

    def seen(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(common, "written", seen)
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 120)], "a long, b long")
    out = dict(common.components(links, common.workspace(spark, "test")).collect())
    assert out == {k: 0 for k in range(1, 21)} | {k: 100 for k in range(101, 120)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)



def test_maybe_wanted_keeps_what_is_wanted(spark):
    df, wanted = spark.range(5000), spark.range(0, 5000, 7).withColumnRenamed("id", "w")
    out = {r[0] for r in common.maybe_wanted(df, F.col("id"), wanted, F.col("w")).collect()}
    assert {r[0] for r in wanted.collect()} <= out
    assert len(out) < 800


def test_what_operators_wrote_can_be_cleared(spark, tmp_path):
    path = common.workspace(spark, "clear-me")
    common.written(spark.range(3), f"{path}/x")
    folder = path.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)


# 10


def test_languages_are_told_apart(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 40, lang), lang) for i in range(400) for lang in [("en", "de")[i % 2]]] + [(900, None, "en"), (901, "12 34 !! ² Ⅷ", "de"), (902, "日本語" * 20, None), (None, prose(r, 30), None)]
    docs = table(spark, rows)
    models = language_id.train(docs)
    out = docs.select("doc_id", "lang", (~language_id.trainable("doc_id")).alias("held_out"), language_id.predictor(models)("text").alias("f")).select("doc_id", "lang", "held_out", "f.*").collect()
    real = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 400 and x[2]]
    assert len(real) > 50
    assert all(x["held_out"] for x in real)
    picked = {x["doc_id"]: x for x in out}
    assert all(x[3] == x[1] for x in real)
    assert picked[900][3] == picked[901][3] == "und"
    kept = {x["doc_id"] for x in language_id.accepted(docs).collect()}
    assert set(range(400)) <= kept
    assert not {900, 901, 902} & kept


def test_no_language_to_learn(spark):
    docs = table(spark, [(1, "some text", None), (2, None, None)])
    models = language_id.train(docs)
    assert [x[0] for x in docs.select(language_id.predictor(models)("text")["lang"]).collect()] == ["und", "und"]


# 3


def test_base_patterns_equal_the_plain_ones():
    r = random.Random(4)
    bits = [*"ab1234567890..@@-- +()é", "a.b@c.d", "192.168.0.1", "4111 1111 1111 1111", "+1 (555) 123-4567"]
    for _ in range(5000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 25)))
        plain = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        plain += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        plain += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))]
        plain += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
        assert personal_data.base_spans(t) == plain, repr(t)


def test_long_runs_stay_linear():
    assert personal_data.base_spans("1" * 200_000 + "@") == []
    assert personal_data.base_spans("a" * 200_000) == []


def test_repeats_of_personal_data_are_found(spark):
    rows = [(i, f"call +1 555 0{i % 10}3-45{i % 10}7 or write to name.{i}@mail.example.com, then again 4111 1111 1111 1111. " + "word " * 5) for i in range(200)]
    text = "write to jane.doe.smith@mail.example.com soon. " + "word " * 300 + " as jane.doe.smith said"
    docs = table(spark, [*rows, (500, text), (501, None), (502, ""), (503, "clean text 12 and 3.0")])
    field = personal_data.train(docs)
    out = {r["doc_id"]: r for r in personal_data.annotated(docs, field).collect()}
    assert {tuple(s) for r in out.values() for s in r["base"]} <= {tuple(s) for r in out.values() for s in r["spans"]}
    found = [text[s["start"] : s["end"]] for s in out[500]["spans"]]
    assert found == ["jane.doe.smith@mail.example.com", "jane.doe.smith"]
    assert [out[k]["spans"] for k in (501, 502, 503)] == [[], [], []]


def repeat_field():
    """A field of 400 repeated addresses in 2,000 texts, and clean tokens of other shapes."""
    address = lambda i: f"write to name.{i}@mail.example.com or name.{i}@mail.example.com by 12 and 3.0"
    return personal_data.Field(personal_data.counted([address(i) for i in range(400)] + ["plain words, 7 of them"] * 1600))


@pytest.mark.parametrize("mentions", [1, 2, 5, 50])
@pytest.mark.parametrize("ahead", [False, True])
def test_each_of_many_repeats_is_found(mentions, ahead):
    start, said = "write to jane.doe.smith@mail.example.com soon. ", "".join(f"{'word ' * (k % 3 + 1)}as jane.doe.smith said. " for k in range(mentions))
    text = said + start if ahead else start + said
    ((base, every),) = repeat_field().find([text])
    assert len(base) == 1
    assert [text[a:b] for _, a, b in every if (0, a, b) not in base] == ["jane.doe.smith"] * mentions
    assert {k for k, *_ in every} == {0}


def test_labels_do_not_depend_on_the_other_texts():
    r = random.Random(3)
    texts = [" ".join(r.choice(["name.7", "name.7@mail.example.com", "+1 555 010 4477", "5550104477", "4111 1111 1111 1111", "1111", "word"]) for _ in range(60)) for _ in range(20)]
    field = repeat_field()
    assert field.find(texts) == [field.find([t])[0] for t in texts]


# 1


def test_snapshots_collapse(spark):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    rows = [(1, k, *t) for k, t in enumerate(turns[:2])] + [(2, k, *t) for k, t in enumerate(turns)] + [(3, k, *t) for k, t in enumerate(turns)] + [(4, 0, "user", "a"), (4, 1, "assistant", "x"), (5, 0, None, None), (None, 0, "user", "q"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv"]: (r["n_turns"], r["copies"], r["chat"]) for r in chat_format.rendered(df).collect()}
    assert out[2] == (4, 2, "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns))
    assert set(out) == {2, 4, 5, None}
    assert out[5][2] == "<|unknown|>\n<|end|>\n"
    assert chat_format.rendered(df.limit(0)).count() == 0


# Empty tables


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.deduplicate(d), lambda d: exact_dedup.keep_first(d), lambda d: kd_sharding.shard(d, shards=4), lambda d: jaccard_join.linked(d), lambda d: jaccard_join.keep_one(d), lambda d: mixing.mixed(d),
    lambda d: repeated_spans.repeats(d), lambda d: language_id.accepted(d), lambda d: personal_data.annotated(d, personal_data.train(d)), lambda d: sentencepieces.token_digests(d, sentencepieces.model_path()), lambda d: mpeg_audio.with_media(d, F.col("text")),
])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0
