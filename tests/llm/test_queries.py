"""Each opN query on a small folder of tables, every contract column against its SQL or a brute-force version."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, exact_dedup, jaccard_join, kd_sharding, language_id, mixing, mpeg_audio, personal_data, queries, repeated_spans, sentencepieces
from tests.llm.test_llm import brute_links, brute_spans, corpus, expected_dedup, prose, table  # noqa: F401


@pytest.fixture(scope="module")
def rows(corpus):  # noqa: F811
    """The corpus, personal data, and texts of over 1 MiB that share a passage over the seam of the first."""
    r = random.Random(11)
    long = prose(r, 210_000)
    seam = long[(1 << 20) - 400 : (1 << 20) + 300]
    more = [(130, long, "en", "s0"), (131, "short start " + seam + " " + prose(r, 30), "en", "s1"), (132, "mail a.b@mail.example.com, 10.0.0.1 or 4111 1111 1111 1111, +1 (555) 010-4477.", "en", "s2"), (133, "again a.b@mail.example.com é 10.0.0.1", "de", "s2")]
    assert len(long) > 1 << 20
    return [(*x, *[None] * (4 - len(x))) for x in [*corpus, *more]]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), (None, None)]
    chats = [(i, k, *turns[k]) for i, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 2)) for k in range(n)] + [(6, 0, "user", "x"), (6, 0, "user", "x"), (None, 0, "user", "a"), (None, 1, "user", "z"), (None, 1, "user", "z"), (7, None, "system", "s"), (7, 0, "user", "a")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(f"file://{path}/conversations.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def out(spark, folder):
    """Rows of a query, run once."""
    made = {}

    def run(name):
        if name not in made:
            made[name] = queries.QUERIES[name](spark, folder).collect()
        return made[name]

    return run


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, folder, out, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder.removeprefix('file://')}/{t}.parquet/*.parquet'")
    theirs = c.execute(queries.ORACLE[name])
    columns = [d[0] for d in theirs.description]
    ours = Counter(tuple(r[k] for k in columns) for r in out(name))
    theirs = Counter(theirs.fetchall())
    if name == "op2_exact_dedup":  # SQL keeps each of rows that agree in id and text
        drop = columns.index("kept")
        pick = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None and k[0] != 126})
        assert sum(r["kept"] for r in out(name) if r["doc_id"] == 126) == 1
        assert {k[:drop] for k in ours} == {k[:drop] for k in theirs}
        ours, theirs = pick(ours), pick(theirs)
    assert ours == theirs


def test_op2(rows, out):
    groups = expected_dedup(rows)
    got = out("op2_exact_dedup")
    assert len(got) == len(rows)
    by = {sha(k): (min(v)[2], len(v)) for k, v in groups.items()}
    assert all(by[r["text_sha256"]] == (r["keep_id"], r["group_size"]) for r in got)
    assert sum(r["kept"] for r in got) == len(groups)


def test_op3(rows, out):
    texts = Counter()
    for d, t, *_ in rows:
        t = t or ""
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        found = [[m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]]
        found.append([m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))])
        found.append([m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))])
        found.append([m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])
        joined = ",".join(f"{kind}:{a}:{b}" for kind, spans in zip(("email", "ip", "card", "phone"), found, strict=True) for a, b in spans)
        texts[(d, *map(len, found), sha(joined), joined)] += 1
    got = out("op3_personal_data")
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == Counter(k[:-1] for k in texts.elements())
    base = {k[5]: k[6] for k in texts}
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(filter(None, base[r["base_sha256"]].split(","))) <= set(spans)
        key = [(("email", "ip", "card", "phone").index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert key == sorted(key)


def test_op4(rows, out):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    expected = Counter()
    for d, t, *_ in rows:
        ids = model.encode(t or "")
        expected[(d, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out("op4_sentencepiece")) == expected


def kd(points, first, k):
    """The shard of each point, by recursion: the widest dimension, cut where the bytes come nearest to their share."""
    if k == 1 or not points:
        return {p["at"]: first for p in points}
    dims = kd_sharding.DIMS
    width = [max(p[d] >> 32 for p in points) - min(p[d] >> 32 for p in points) for d in dims]
    d = dims[width.index(max(width))]
    goal, total, cut = sum(p["size"] for p in points) * (k // 2) / k, 0, None
    for key in sorted({p[d] for p in points}):
        size = sum(p["size"] for p in points if p[d] == key)
        if total + size >= goal:
            cut = key + 1 if total + size - goal <= goal - total else key
            break
        total += size
    left = kd([p for p in points if p[d] < cut], first, k // 2)
    return left | kd([p for p in points if p[d] >= cut], first + k // 2, k - k // 2)


def test_op5(spark, folder, rows, out):
    got = out("op5_kd_sharding")
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, size(t), crc(t)) for d, t, *_ in rows)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    points = [r.asDict() | {"at": k} for k, r in enumerate(kd_sharding.points(common.documents(spark, folder), "doc_id", "text", ("lang", "source")).collect())]
    shards = kd(points, 0, 40)
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in got) == Counter((p["id"], p["crc"], shards[p["at"]]) for p in points)


def test_op6(rows, out):
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out("op6_repeated_spans")) == brute_spans(rows)
    assert {r["doc_id"]: r["n_removed"] for r in out("op6_repeated_spans")}[130] >= 700  # over the seam


def test_op7(rows, out):
    expected = Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = mpeg_audio.encode(payload)
        frames = math.ceil(len(payload) / mpeg_audio.ROOM)
        expected[(d, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(media), sha(media), f"frames={frames};samples={frames * 1152};seconds={Fraction(frames * 1152, 32000).numerator}/{Fraction(frames * 1152, 32000).denominator}")] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], ";".join(r["feature"].split(";")[:3])) for r in out("op7_mpeg_audio"))
    assert got == expected


def brute_targets(sizes, weights):
    """Shares by weight under caps, by bisection of the water level."""
    total, low, high = sum(sizes), 0.0, 3.0 * sum(sizes)
    for _ in range(200):
        unit = (low + high) / 2
        low, high = (unit, high) if sum(min(3 * s, unit * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, unit)
    return [min(3 * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def test_op8(rows, out):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, _, s in rows:
        by[s] += words(t)
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    target = dict(zip(sources, brute_targets([by[s] for s in sources], [1 + k % 3 for k in range(len(sources))]), strict=True))
    source = {d: s for d, _, _, s in rows}
    got = out("op8_mixing")
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, words(t)) for d, t, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == by[s]
        assert r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sources:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK


def test_shards_are_drawn_as_multinomials_under_their_sums():
    every = np.array([60_000, 30_000, 9_000, 1_000]) * 4
    shards = np.array([n for *_, n in mixing.dealt(range(-(-int(every.sum()) // mixing.SLOTS)), every)])[:-1]
    p = every / every.sum()
    chi = ((shards - mixing.SLOTS * p) ** 2 / (mixing.SLOTS * p)).sum(axis=1)
    assert 2 < chi.mean() < 4  # 3 degrees of freedom
    assert abs(np.corrcoef(shards[:-1, 0], shards[1:, 0])[0, 1]) < 0.35


def test_op9(rows, out):
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out("op9_jaccard_join")) == brute_links(rows, 4, 85)


def test_op10(rows, out):
    got = out("op10_language_id")
    assert len(got) == len(rows)
    text, lang = {d: t for d, t, *_ in rows}, {d: x for d, _, x, *_ in rows}
    right = []
    for r in got:
        d = r["doc_id"]
        held = zlib.crc32(str(d).encode() if d is not None else b"") % 4 == 2
        assert r["held_out"] == held
        assert 0 <= r["score"] <= 1
        empty = text[d] is None or not any(c.isalpha() for c in text[d])
        assert r["lang_pred"] in ({"und"} if empty else {"en", "de"})
        if held and not empty and lang[d]:
            right.append(r["lang_pred"] == lang[d])
    assert len(right) > 10
    assert np.mean(right) > 0.9


# Words of two different 4,096-letter strings that polynomial hashes modulo 2^64 take for one.


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_words_are_not_told_by_a_weak_hash(spark):
    one = thue_morse(4096)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} same words here"), (2, f"{other} same words here")]
    assert {r["id"]: r["component_id"] for r in jaccard_join.linked(table(spark, rows)).collect()} == {1: 1, 2: 2}


def test_links_through_rows_without_an_id(spark):
    r = random.Random(3)
    words = prose(r, 130).split(" ")
    rows = [(1, " ".join(words[:101])), (None, " ".join(words[:115])), (2, " ".join(words)), (None, " ".join(words[:115])), (None, "alone here"), (None, "alone here"), (None, None)]
    got = jaccard_join.linked(table(spark, rows), words=4, percent=85).collect()
    assert Counter((x["id"], x["component_id"]) for x in got) == Counter({(1, 1): 1, (None, 1): 2, (2, 1): 1, (None, None): 3})
    kept = [(x["doc_id"], x["text"]) for x in jaccard_join.keep_one(table(spark, rows), words=4, percent=85).collect()]
    assert sorted(kept, key=str) == sorted([(1, rows[0][1]), (None, "alone here"), (None, None)], key=str)


def test_large_groups_are_searched_in_blocks(spark, corpus, monkeypatch):  # noqa: F811
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    got = jaccard_join.linked(table(spark, corpus), words=4, percent=85).collect()
    assert Counter((r["id"], r["n_shingles"], r["component_id"]) for r in got) == brute_links(corpus, 4, 85)


def test_bytes_are_checked_on_hits_of_earlier_runs(spark, tmp_path):
    """A digest by length alone: equal digests of other texts, in one run and over runs."""
    weak = lambda body: F.encode(F.length(body).cast("string"), "UTF-8")
    runs = [[(1, "aaa"), (2, "bb")], [(3, "zzz"), (4, "a a a"), (5, "bb")], [(6, "z zz"), (7, "yyy"), (8, "aaa"), (0, "zzz")]]
    where, seen = f"file://{tmp_path}/state", []
    for rows in runs:
        seen += rows
        groups = expected_dedup(seen)
        best = {k: (min(v)[2], len(v)) for k, v in groups.items()}
        got = exact_dedup.deduplicate(table(spark, rows), digest=weak, folder=where).collect()
        body = {d: re.sub(r"\s", "", t) for d, t in rows}
        assert {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(d, *best[b], d == best[b][0]) for d, b in body.items()}


# Columns of any name come back


ODD = "_id _text _found _digest _d _round _cuts _size _s _crc _bucket _place _row _map _spread _value id text2 size digest row i d round new cuts places node".split()
STAGES = {
    "accepted": language_id.accepted, "keep_first": exact_dedup.keep_first, "keep_one": jaccard_join.keep_one, "mixed": mixing.mixed,
    "checked": lambda d: sentencepieces.checked(d, sentencepieces.model_path()).drop("ids", "round_trip"),
    "encoded": lambda d: sentencepieces.encoded(d, sentencepieces.model_path()).drop("ids"),
    "with_media": lambda d: mpeg_audio.with_media(d, F.col("text")).drop("media"),
    **{f"pipeline {name}": lambda d, f=f: f(d.sparkSession, d, "") for name, f in corpus_pipeline.STAGES[:-1]},
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_odd_columns_come_back(spark, name):
    r = random.Random(8)
    docs = spark.createDataFrame([(k, prose(r, 40, ("en", "de")[k % 2]), ("en", "de")[k % 2], f"s{k % 2}", *[f"{c}{k}" for c in ODD]) for k in range(40)], ", ".join(["doc_id long, text string, lang string, source string", *[f"`{c}` string" for c in ODD]]))
    out = STAGES[name](docs)
    assert out.columns == docs.columns
    got = out.collect()
    if "mix" in name:  # takes of each source what its target is
        assert len({r["doc_id"] for r in got}) > 20
    else:
        assert {r["doc_id"] for r in got} == set(range(40))
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in ODD)


@pytest.mark.parametrize("run", [exact_dedup.deduplicate, lambda d: kd_sharding.shard(d, shards=3), lambda d: jaccard_join.linked(d), repeated_spans.repeats, lambda d: personal_data.annotated(d, personal_data.train(d)), lambda d: sentencepieces.token_digests(d, sentencepieces.model_path())])
def test_odd_columns_are_not_looked_at(spark, run):
    docs = spark.createDataFrame([(k, f"some text {k}", None, "s", *["x"] * len(ODD)) for k in range(5)], ", ".join(["doc_id long, text string, lang string, source string", *[f"`{c}` string" for c in ODD]]))
    assert run(docs).count() == 5


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_pipeline_stages_on_empty_tables_and_nulls(spark, stage):
    function = corpus_pipeline.STAGES[stage][1]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert function(spark, spark.createDataFrame([], schema), "").count() == 0
    nulls = [(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (1, "", None, None, 0), (None, "word " * 20, "en", None, 1)]
    out = function(spark, spark.createDataFrame(nulls, schema), "")
    assert out.count() <= len(nulls)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_common_prefixes_come_as_a_suffix_array_has_them():
    """The strings that extension finds in one interval, against all pairs of windows."""
    r = random.Random(5)
    base = "".join(r.choice(string.ascii_lowercase[:2]) for _ in range(400)).encode()
    before, after = [], []
    for _ in range(40):
        left, right = r.randrange(0, 200), r.randrange(100, 201)
        change = bytearray(base)
        change[r.randrange(len(base))] ^= 1
        before.append(bytes(change[200 - min(left, repeated_spans.LEFT) : 200])[::-1])
        after.append(bytes(change[200 : 200 + right]))
    w, j, k = repeated_spans.extended(np.zeros(40, np.int64), before, after)
    ours = {(int(a), x) for a, low, high in zip(w, j, k, strict=True) for x in range(low, high + 1)}
    whole = lambda i, x: (before[i][:x][::-1] + after[i])[: repeated_spans.LENGTH] if len(before[i]) >= x and len(after[i]) >= repeated_spans.LENGTH - x else None
    theirs = set()
    for x in range(repeated_spans.LEFT + 1):
        strings = defaultdict(list)
        for i in range(40):
            if (s := whole(i, x)) is not None:
                strings[s].append(i)
        theirs |= {(i, x) for own in strings.values() if len(own) > 1 for i in own}
    assert ours == theirs
