"""Vector codes, text quality and token alignment: each operator and its query against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import queries, text_quality, token_alignment, vector_codes

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def lloyd(rows, entries=256, rounds=4):
    """rows of (vec_id, vector, label), all of one length, by plain loops: (vec_id, code, error, label_error, sha)."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    wide = len(kept[0][1]) // 4
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    books = [[part(v, p) for _, v, _ in first] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(part(v, p), book)[1]].append(part(v, p))
            for k, xs in members.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [(i, [near(part(v, p), books[p]) for p in range(4)], l) for i, v, l in kept]
    errors = Counter()
    for _, n, l in found:
        errors[l] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in n), sum(d for d, _ in n), errors[l], sha) for i, n, l in found]


def vectors(n, dim, seed):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dim)], r.choice([0, 1, 2, None])) for i in range(n)]
    hot = [0.125] * dim
    rows += [(1000 + i, hot, 1) for i in range(n)]  # half of all rows are one vector
    rows += [(5, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (None, [0.5] * dim, 0), (None, [0.5] * dim, 0)]  # repeated and null ids
    rows += [(-1, None, 0), (-2, [], 1), (-3, [None] + [0.0] * (dim - 1), 1), (-4, [float("nan")] * dim, 0), (-5, [float("inf")] + [0.0] * (dim - 1), 0)]
    return rows


@pytest.mark.parametrize("members", [4096, 16])
def test_codes_equal_plain_lloyd(spark, members):
    rows = vectors(60, 8, 3)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], EMBEDDINGS + ", row string, pos int")
    codes, books = vector_codes.compress(df, entries=7, members=members)
    got = Counter((r.id, "".join(f"{c:02x}" for c in r.codes), r.error, vector_codes.digest(books)) for r in codes.collect())
    assert got == Counter((i, c, e, s) for i, c, e, _, s in lloyd(rows, 7))


def test_op11(spark, tmp_path):
    rows = vectors(330, 12, 4)
    spark.createDataFrame(rows, EMBEDDINGS).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_vector_codes"](spark, f"file://{tmp_path}").collect()
    assert Counter(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in got) == Counter(lloyd(rows))


def test_op11_without_rows(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None, None)])):
        spark.createDataFrame(rows, EMBEDDINGS).write.parquet(f"file://{tmp_path}/{k}/embeddings.parquet")
        out = queries.QUERIES["op11_vector_codes"](spark, f"file://{tmp_path}/{k}")
        assert out.collect() == [] and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_few_rows_odd_lengths_and_far_components(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30, 0.0, 0.5], 0), (2, [0.0] * 4, 0), (3, [0.0] * 8, 0), (4, [0.0] * 3, None)], EMBEDDINGS)
    codes, books = vector_codes.compress(df)
    assert sorted((r.id, r.error) for r in codes.collect()) == [(1, 0), (2, 0)]
    assert books[0].tolist() == [[vector_codes.REACH], [0]] and books[1].tolist() == [[-vector_codes.REACH], [0]]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(df.where("vec_id = 4"))


def test_nearest_is_exact_beyond_doubles():
    r = np.random.default_rng(1)
    x = r.integers(-vector_codes.REACH, vector_codes.REACH, (50, 16))
    e = np.concatenate([x[:5] + 1, x[:5] - 1])
    at, far = vector_codes.nearest(x, e)
    for k, row in enumerate(x.tolist()):
        assert (far[k], at[k]) == min((sum((a - b) ** 2 for a, b in zip(row, c)), j) for j, c in enumerate(e.tolist()))


def joined_ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain_groups(a, b):
    """Groups by the offsets that both have."""
    common, out, i, j = set(a) & set(b), [], 0, 0
    for end in sorted(common):
        p, q = a.index(end) + 1, b.index(end) + 1
        out.append((p - i, q - j))
        i, j = p, q
    return out


def test_alignment_equals_common_offsets():
    r = random.Random(5)
    for n in [1, 2, 3, 5, 8, 30, 200]:
        for share in (0.0, 0.05, 0.5, 1.0):
            for _ in range(30):
                ends = list(range(1, n + 1))
                cut = lambda: [e for e in ends if e == n or r.random() > share * r.random()]
                a, b = cut(), cut()
                in_a, in_b = token_alignment.aligned(a, b)
                assert list(zip(in_a.tolist(), in_b.tolist())) == plain_groups(a, b)


@pytest.mark.parametrize("longest", [1, 3, 300])
def test_alignment_of_arrays_of_long_tokens_and_long_stretches(longest):
    r = np.random.default_rng(longest)
    for n in [1, 7, 8, 9, 16, 24, 40, 700]:
        for share in (0.0, 0.01, 0.2):
            ends = np.cumsum(r.integers(1, longest + 1, n))
            keep_a, keep_b = (np.r_[r.random(n - 1) >= share, True] for _ in range(2))
            in_a, in_b = token_alignment.aligned(ends[keep_a], ends[keep_b])
            assert list(zip(in_a.tolist(), in_b.tolist())) == plain_groups(ends[keep_a].tolist(), ends[keep_b].tolist())


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_links_equal_all_pairs(monkeypatch, chunk):
    monkeypatch.setattr(token_alignment, "CHUNK", chunk)
    r = np.random.default_rng(2)
    for _ in range(20):
        in_a, in_b = r.integers(1, 6, 9), r.integers(1, 6, 9)
        a, b = r.integers(0, 5, in_a.sum()), r.integers(0, 5, in_b.sum())
        want, i, j = Counter(), 0, 0
        for p, q in zip(in_a, in_b):
            want.update((int(x) << 32) + int(y) for x in a[i : i + p] for y in b[j : j + q])
            i, j = i + p, j + q
        keys, counts = token_alignment.linked(a, b, in_a, in_b)
        assert keys.tolist() == sorted(want) and dict(zip(keys.tolist(), counts.tolist())) == want


def brute_alignment(rows):
    import sentencepiece

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
    bytes_a = lambda i: bytes(of[c] for c in first.id_to_token(i))

    def bytes_b(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    made, counts = [], Counter()
    for i, text in rows:
        groups = []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            ta, tb = [bytes_a(x) for x in a], [bytes_b(x) for x in b]
            if b"".join(ta) == b"".join(tb) == (" " + text).encode():
                ends_a, ends_b = joined_ends(ta), joined_ends(tb)
                where_a, where_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
                x = y = 0
                for e in ends_a:
                    if e in where_b:
                        groups.append((a[x : where_a[e] + 1], b[y : where_b[e] + 1]))
                        x, y = where_a[e] + 1, where_b[e] + 1
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        counts.update(set(links))
        made.append((i, groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    for i, groups, links in made:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), links.total(), sum(n for k, n in links.items() if counts[k] == top[k[0]]), sum(n * counts[k] for k, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else "")


def texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéßñ中あ😀 .,'!#12") for _ in range(r.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(80)]
    rows += [(100 + i, "the same text of many rows, é") for i in range(40)] + [(7, rows[7][1]), (None, "no id"), (None, None), (201, ""), (202, " "), (203, "a\n\n b\t  c  "), (204, "<|endoftext|> <s></s> <0x41> ▁x"), (205, "a" * 3000), (206, "\x00\x01    ")]
    rows.append((207, " ".join(word() for _ in range(220_000))))
    assert len(rows[-1][1].encode()) > 1 << 20
    return rows


@pytest.mark.parametrize("most", [token_alignment.SENT, 40, 0])
def test_op13(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_alignment.align, "__defaults__", ("doc_id", "text", most))
    rows = texts() if most == token_alignment.SENT else texts()[:-1]
    spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, id int, pair string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_token_alignment"](spark, f"file://{tmp_path}").collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(brute_alignment(rows))


def test_op13_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert queries.QUERIES["op13_token_alignment"](spark, f"file://{tmp_path}").collect() == []


def test_both_files_of_the_first_vocabulary_are_one():
    """The faster library, with the ranks, gives the ids of the other, for characters of each kind in each place."""
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    fast = token_alignment.byte_level(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 61 == 0)]
    said = [f"a{chr(c)}b1{chr(c)}2 {chr(c)}{chr(c)} !{chr(c)}? '{chr(c)}s  {chr(c)}\n{chr(c)}" for c in points]
    assert fast.encode(said) == [x.ids for x in slow.encode_batch_fast([" " + t for t in said], add_special_tokens=False)]


def quality_rows(n, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "the", "st", "ing", "ou"]) for _ in range(r.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [words[0]] * len(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad)))
    return rows, labels


def plain_features(text):
    """Features of a text, a word at a time."""
    out = Counter()
    words = text.split()
    hashes = [text_quality.word_features([w])[0] for w in words]
    for w in words:
        for _, f in text_quality.word_features([w])[1]:
            out.update(f.tolist())
    for x, y in zip(hashes, hashes[1:]):
        out[int(text_quality.pair_features(np.concatenate([x, y]))[0])] += 1
    return out


def test_features_do_not_depend_on_what_is_hashed_together():
    text = "one two two Three one!! é中😀 " + "x" * 300
    have, counts = text_quality.features(text)
    assert dict(zip(have.tolist(), counts.tolist())) == plain_features(text)
    w = "ab"
    n = sum(len(f) for _, f in text_quality.word_features([w])[1])
    assert n == 1 + 2 + 3 + 2 + 1  # the word; characters, pairs, triples and quadruples with its marks
    assert text_quality.pair_features(np.array([5, 5], np.uint64)) == text_quality.pair_features(np.array([9, 9], np.uint64)) == [0]


def test_scores_equal_brute_force_and_forgetting_changes_nothing(monkeypatch):
    rows, labels = quality_rows(200)
    model = text_quality.fitted([text_quality.features(t) for _, t in rows], np.array([l for _, l in labels]))
    said = [t for _, t in rows] + [None, "", " \n", "new words"]
    want = []
    for t in said:
        f = plain_features(t or "")
        mean = sum(n * model.weight[k] for k, n in f.items()) / max(1, f.total())
        want.append(1 / (1 + math.exp(-(model.bias + mean))))
    assert np.allclose(model.scores(said), want, atol=1e-9)
    monkeypatch.setattr(text_quality, "REMEMBERED", 3)
    assert [model.scores([t])[0] for t in said] == model.scores(said).tolist()


def test_training_lowers_the_loss():
    both = [(np.array([3, 9]), np.array([2, 1])), (np.array([4]), np.array([1]))]
    loss = lambda m: math.log(1 + math.exp(-(m.bias + (m.weight[[3, 9]] @ [2, 1]) / 3))) + math.log(1 + math.exp(m.bias + m.weight[4]))
    few, many = (text_quality.fitted(both, np.array([1, 0]), epochs=n) for n in (1, 30))
    assert loss(many) < loss(few) < 2 * math.log(2)


def test_op12(spark, tmp_path):
    rows, labels = quality_rows(1200)
    odd = [(None, "no id"), (None, None), (5000, ""), (5001, None), (5002, " ".join(["plain words of it"] * 80_000)), (7, rows[7][1]), (5003, rows[7][1])]
    assert len(odd[4][1]) > 1 << 20
    spark.createDataFrame([(*r, 0.5, 1) for r in rows + odd], "doc_id long, text string, score double, label int").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels if i % 3] + [(None, 1, 0), (1, None, 0), (1, 1, 0), (99999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = queries.QUERIES["op12_text_quality"](spark, f"file://{tmp_path}").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows + odd)
    truth, out = dict(labels), zlib.crc32
    for r in got:
        assert r.held_out == (out(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id in (7, 5003)}) == 1
    again = queries.QUERIES["op12_text_quality"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = quality_rows(400)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda flip: spark.createDataFrame([(i, 1 - q if flip and held(i) else q) for i, q in labels], "doc_id long, quality int")
    one, other = (text_quality.train(docs, told(flip)) for flip in (False, True))
    assert one.bias == other.bias and (one.weight == other.weight).all()


def test_the_sample_is_bounded_though_one_id_has_all_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)] * 5, "doc_id long, quality int")
    found = text_quality.sample(docs, labels, "doc_id", "text", "quality", 20).groupBy("label").agg(F.count("*").alias("n"))
    assert {r.label: r.n for r in found.collect()} == {0: 1, 1: 20}


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (3, 0)]])
def test_op12_without_labels_or_rows(spark, tmp_path, labels):
    for k, rows in enumerate(([], [(1, "a b"), (3, "c"), (4, None)])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"file://{tmp_path}/{k}/labels.parquet")
        got = queries.QUERIES["op12_text_quality"](spark, f"file://{tmp_path}/{k}").collect()
        assert len(got) == len(rows) and {round(r.score, 6) for r in got} <= {0.0, 0.5, 1.0}
