"""Language identification by interpolated Kneser-Ney models of characters, one for each language.

A text's words (runs of letters, lower case) are scored character by character, each given up to ORDER - 1 characters
before it in the word, the word's start among them, and the word's end is scored too. Spark counts the n-grams of a
bounded sample of labelled rows: of each language the DOCS_PER_LANG whole texts that come first by a hash of id and text,
CHARS_PER_LANG characters at most (a longer text only if it is the first); lower orders count the distinct characters before
an n-gram. The models lie side by side in sorted arrays of 64-bit n-gram hashes
with a column of log probabilities for each language, and in one of context hashes with log back-off weights.

The language of lowest cross-entropy per character is chosen. Further sampled rows calibrate the temperature of the
score and the cross-entropy above which a text is rejected as none of the languages. A few words may look odd by chance, so
there is a limit for each of LENGTHS characters, from pieces of that length of the calibrating rows: the highest
cross-entropy of a QUANTILE of them and MARGIN deviations more; limits of other lengths lie between these.

Defined results: a null text and a text without letters are `und` with score 0 and rejected, as is every text if no
row has a language, or the table no rows; null ids count as an empty one, and rows that agree in id and text are learned from
once; rows and ids may repeat, and are judged alike;
texts of any length are scored whole. Columns of other names, whatever they are, come back as they were.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, kept, sample_hash, texts_udf, workspace, written

ORDER = 5
#: Rows of a language that its model is learned from, at most; a tenth as many calibrate.
DOCS_PER_LANG, CHARS_PER_LANG = 400, 8_000_000
#: Languages whose numbers of rows are sent to every executor; a table with more values is joined.
SENT_LANGS = 10_000
#: Lengths with a limit of their own; pieces of each that are taken of a calibrating text.
LENGTHS, PIECES = (8, 16, 32, 64, 128, 256, 512, 1024, 2048), 8
QUANTILE, MARGIN = 0.999, 4.0
#: Characters a language is taken to have, for those never seen.
ALPHABET = 4096
REMEMBERED = 150_000
#: Characters whose words are looked up together, and new words that are scored together: some 100 bytes a character each.
CHARS_AT_ONCE, FRESH = 400_000, 16_000
START, END = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")


def mixed(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of the n-grams of this order that end at each code (those that begin before the array are junk)."""
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            shifted = np.zeros_like(codes)
            shifted[k:] = codes[: len(codes) - k]
            out = (out ^ shifted) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out * np.uint64(2 * order + 1)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class Models:
    langs: list[str]
    grams: list[np.ndarray]  # sorted hashes by order
    logs: list[np.ndarray]  # log probability, a column for each language
    contexts: np.ndarray
    backoffs: np.ndarray
    unseen: float
    key: str
    temperature: float = 20.0
    limits: np.ndarray = field(default_factory=lambda: np.full(len(LENGTHS), np.inf))
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """Summed log probability of each word, by language."""
        codes = codes_of("".join(f"{START}{w}{END}" for w in words))
        length = np.array([len(w) + 2 for w in words])
        first = np.cumsum(length) - length
        place = np.arange(len(codes)) - np.repeat(first, length)
        out = np.full((len(codes), len(self.langs)), self.unseen)
        open_, back = place >= 1, np.zeros((len(codes), len(self.langs)))
        out[~open_] = 0
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (place >= n - 1))
            if len(at):
                h = mixed(codes, n)[at]
                i = np.minimum(np.searchsorted(self.grams[n - 1], h), len(self.grams[n - 1]) - 1)
                hit = self.grams[n - 1][i] == h
                found = at[hit]
                out[found] = self.logs[n - 1][i[hit]] + back[found]
                open_[found] = False
                left = at[~hit]
                if n > 1 and len(left):
                    h = mixed(codes, n - 1)[left - 1]
                    i = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
                    hit = self.contexts[i] == h
                    back[left[hit]] += self.backoffs[i[hit]]
        out[open_] += back[open_]
        return np.add.reduceat(out, first, axis=0)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text, by language (nan without letters), and the characters scored."""
        out, scored = np.full((len(texts), len(self.langs)), np.nan), np.zeros(len(texts))
        chunk, size = [], 0
        for k, t in enumerate(texts):
            words = LETTERS.findall(t.lower()) if t else []
            if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
                words = []  # other numerals are word characters too
            chunk.append((k, words))
            size += len(t or "")
            if size >= CHARS_AT_ONCE or k + 1 == len(texts):
                self._chunk(chunk, out, scored)
                chunk, size = [], 0
        return out, scored

    def _chunk(self, chunk: list[tuple[int, list[str]]], out: np.ndarray, scored: np.ndarray) -> None:
        if self.table is None or len(self.known) > REMEMBERED:
            self.known, self.table = {}, np.zeros((0, len(self.langs)))
        known = self.known
        fresh = list({w for _, words in chunk for w in words if w not in known})
        for k in range(0, len(fresh), FRESH):
            part = fresh[k : k + FRESH]
            known.update(zip(part, range(len(known), len(known) + len(part)), strict=True))
            self.table = np.vstack([self.table, self.words(part)])
        for k, words in chunk:
            if words:
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                scored[k] = sum(map(len, words)) + len(words)
                out[k] = -self.table[at].sum(axis=0) / scored[k]

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        lang, score, rejected = [], [], []
        for h, n in zip(*self.entropies(texts), strict=True) if self.langs else [([np.nan], 0)] * len(texts):
            if np.isnan(h[0]):
                lang.append("und"), score.append(0.0), rejected.append(True)
                continue
            k = int(np.argmin(h))
            limit = np.interp(np.log2(n), np.log2(LENGTHS), self.limits)
            share = 1 / np.exp(-self.temperature * (h - h[k])).sum()
            lang.append(self.langs[k]), score.append(float(share * np.exp(min(0.0, limit - h[k])))), rejected.append(bool(h[k] > limit))
        return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, n, gram, count) for orders 1 to ORDER; counts of the highest order and of what starts a word are of
    occurrences, those of others of distinct characters before."""
    word = F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " "))
    words = sample.select("lang", word.alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("c"))
    words = written(words, f"{workspace(sample.sparkSession, 'language')}/words")
    marked = words.withColumn("w", F.concat(F.lit(START), "w", F.lit(END)))
    ends = marked.withColumn("e", F.explode(F.sequence(F.lit(2), F.length("w"))))
    every = ends.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(ORDER), "e"))))
    # All orders in one pass: a gram either counts its occurrences, or the characters before it, each once.
    occurs = (F.col("n") == ORDER) | (F.col("n") == F.col("e"))
    before = F.when(occurs, F.lit("")).otherwise(F.substr("w", F.col("e") - F.col("n"), F.lit(1)))
    grams = every.select("lang", "n", F.substr("w", F.col("e") - F.col("n") + 1, F.col("n")).alias("gram"), occurs.alias("occurs"), before.alias("before"), "c")
    once = grams.groupBy("lang", "n", "gram", "occurs", "before").agg(F.sum("c").alias("c"))
    return once.groupBy("lang", "n", "gram", "occurs").agg(F.sum(F.when(F.col("occurs"), F.col("c")).otherwise(1)).alias("count")).select("lang", "gram", "count", "n")


def matrix(grams: pd.Series, n: int) -> np.ndarray:
    """The code points of n-grams, a row for each."""
    return codes_of("".join(grams)).reshape(-1, n)


def tails(grams: np.ndarray, k: int) -> np.ndarray:
    """The hash of the last k code points of each row, as `mixed` has it."""
    out = np.zeros(len(grams), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ grams[:, grams.shape[1] - 1 - j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out * np.uint64(2 * k + 1)


def located(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted hash is among sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class Language:
    """One language's probabilities, from the shortest n-grams up, in sorted arrays."""

    def __init__(self, counts: pd.DataFrame):
        none = (np.zeros(0, np.uint64), np.zeros(0))
        self.grams, self.gammas, self.seen, self.least = [none] * (ORDER + 1), [none] * (ORDER + 1), {}, 1 / ALPHABET
        for n in range(1, ORDER + 1):
            own = counts[counts["n"] == n]
            if len(own):
                self.add(n, matrix(own["gram"], n), own["count"].to_numpy(float))

    def add(self, n: int, grams: np.ndarray, c: np.ndarray) -> None:
        ones, twos = (c == 1).sum(), (c == 2).sum()
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
        contexts, at = np.unique(tails(grams[:, :-1], n - 1), return_inverse=True)
        total = np.bincount(at, c)
        gamma = d * np.bincount(at) / total
        p = np.maximum(c - d, 0) / total[at]
        if n == 1:
            self.least *= gamma[0]
            p += self.least
        else:
            p += gamma[at] * self.probabilities(grams[:, 1:])
            self.gammas[n - 1] = (contexts, gamma)
        h = tails(grams, n)
        order = np.argsort(h)
        self.grams[n], self.seen[n] = (h[order], p[order]), grams

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of each row's last character after the ones before it."""
        weight, out = np.ones(len(grams)), np.full(len(grams), -1.0)
        for k in range(grams.shape[1], 0, -1):
            left = np.flatnonzero(out < 0)
            hit, at = located(self.grams[k][0], tails(grams[left], k))
            out[left[hit]] = weight[left[hit]] * self.grams[k][1][at[hit]]
            if k > 1:
                left = left[~hit]
                hit, at = located(self.gammas[k - 1][0], tails(grams[left][:, :-1], k - 1))
                weight[left[hit]] *= self.gammas[k - 1][1][at[hit]]
        return np.where(out < 0, weight * self.least, out)


def learned(counts: pd.DataFrame) -> Models:
    """The models, from the n-gram counts."""
    langs = sorted(counts["lang"].unique())
    each = [Language(counts[counts["lang"] == l]) for l in langs]
    grams, logs = [], []
    for n in range(1, ORDER + 1):
        every = [x.seen[n] for x in each if n in x.seen]
        every = np.concatenate(every) if every else np.zeros((1, n), np.uint64)
        h, first = np.unique(tails(every, n), return_index=True)
        grams.append(h)
        logs.append(np.column_stack([np.log(x.probabilities(every[first])) for x in each]) if each else np.zeros((len(h), 0)))
    contexts = np.unique(np.concatenate([np.zeros(1, np.uint64), *[x.gammas[k][0] for x in each for k in range(1, ORDER)]]))
    backs = np.zeros((len(contexts), len(langs)))
    for j, x in enumerate(each):
        for k in range(1, ORDER):
            backs[located(contexts, x.gammas[k][0])[1], j] = np.log(x.gammas[k][1])
    unseen = float(np.mean([np.log(x.least) for x in each])) if each else 0.0
    return Models(langs, grams, logs, contexts, backs, unseen, uuid.uuid4().hex)


def trainable(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) != 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> Models:
    """Learns from a sample of the rows that may be learned from; ids whose checksum modulo 4 is 2 never are."""
    picked = written(sample(docs.where(trainable(id_col)), id_col, text_col, lang_col, docs_per_lang), f"{workspace(docs.sparkSession, 'language')}/sample")
    models = learned(gram_counts(picked.where("learn")).toPandas())
    if models.langs:
        calibrate(models, picked.where("try").select("lang", calibrating(models)("text").alias("h")).toPandas())
    return models


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int, chars: int = CHARS_PER_LANG) -> DataFrame:
    """lang, text, learn, try: the rows of each language to learn from, and a tenth as many to calibrate by, which are the
    same if there are no others."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), sample_hash(id_col, text_col).alias("h"))
    number = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("all"))
    # A join by language would bring all texts of one to one task; so many rows are sent instead.
    number = F.broadcast(number) if number.count() <= SENT_LANGS else number
    most = int(1.1 * docs_per_lang)
    # Twice as many as are needed, by hash; of those the first by an exact rule. A language's window has no more rows than these.
    some = rows.join(number, "lang").where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < 2.0 * most / F.col("all")).dropDuplicates(["lang", "h"])
    by = Window.partitionBy("lang").orderBy(F.length("text") > chars // 8, "h")
    ranked = some.select("lang", "text", F.row_number().over(by).alias("n"), F.sum(F.length("text").cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    kept_rows = ranked.where((F.col("n") <= most) & ((F.col("upto") <= chars) | (F.col("n") == 1)))
    few = F.count(F.lit(1)).over(Window.partitionBy("lang")) < most
    return kept_rows.select("lang", "text", "n", few.alias("few")).select("lang", "text", (F.col("few") | (F.col("n") <= docs_per_lang)).alias("learn"), (F.col("few") | (F.col("n") > docs_per_lang)).alias("try"))


def pieces(text: str | None) -> list[str]:
    """The text, and at most PIECES pieces of it of each of LENGTHS characters, evenly spaced."""
    words = LETTERS.findall((text or "").lower())
    ends, out = np.cumsum([len(w) + 1 for w in words]), [text or ""]
    for n in LENGTHS:
        for start in np.unique(np.linspace(0, len(words), PIECES, endpoint=False).astype(int)):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + n)) + 1
            if stop <= len(words):
                out.append(" ".join(words[start:stop]))
    return out


def calibrate(models: Models, seen: pd.DataFrame) -> None:
    """Sets limits and temperature by rows of a language and, of its text and pieces, characters and cross-entropies."""
    rows = [(lang, k, *x) for lang, hs in zip(seen["lang"], seen["h"], strict=True) for k, x in enumerate(hs) if not np.isnan(x[1])]
    if not rows:
        return
    n, best = np.array([r[2] for r in rows]), np.array([min(r[3:]) for r in rows])
    near = np.abs(np.log2(n)[:, None] - np.log2(LENGTHS)).argmin(axis=1)
    limits = []
    for k in range(len(LENGTHS)):
        own = best[near == k]
        if len(own) < 4 * PIECES:  # too few to tell: as for the length before, or all there are
            limits.append(limits[-1] if limits else float(best.max()) + MARGIN)
            continue
        middle = np.median(own)
        limits.append(float(np.quantile(own, QUANTILE) + MARGIN * max(0.05, 1.4826 * np.median(np.abs(own - middle)))))
    models.limits = np.minimum.accumulate(limits)  # a longer text is no freer than a shorter one
    whole = [r for r in rows if r[1] == 0]
    if whole:
        h = np.array([r[3:] for r in whole])
        right = np.array([models.langs.index(r[0]) for r in whole])
        low = h.min(axis=1)
        fit = lambda t: np.mean(-t * h[np.arange(len(h)), right] - np.log(np.exp(-t * (h - low[:, None])).sum(axis=1)) + t * low)
        models.temperature = max((1.0, 2.0, 5.0, 10.0, 20.0, 50.0), key=fit)
    models.key = uuid.uuid4().hex  # workers remember models by key, and may hold these as they were before


def _shared(models: Models) -> Callable[[], Models]:
    """The models by broadcast; one copy serves all tasks of a worker process, with the words it has scored."""
    sent, key = SparkSession.active().sparkContext.broadcast(models), models.key
    return lambda: kept(key, lambda: sent.value)


def calibrating(models: Models):
    """A function of a text column: of the text and its pieces, the characters scored and the cross-entropies."""
    get = _shared(models)

    def run(texts: list[str | None]) -> pa.Array:
        own, out = get(), []
        for t in texts:
            h, n = own.entropies(pieces(t))
            out.append(np.column_stack([n, h]).tolist())
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return texts_udf(run, "array<array<double>>")


def predictor(models: Models):
    """A function of a text column: struct of lang, score, rejected."""
    get = _shared(models)

    def run(texts: list[str | None]) -> pa.Array:
        found = get().predict(texts)
        return pa.StructArray.from_arrays([pa.array(found[c], kind) for c, kind in (("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))], ["lang", "score", "rejected"])

    return texts_udf(run, "lang string, score double, rejected boolean")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are not rejected."""
    found = predictor(train(docs, id_col, text_col, lang_col))(F.col(text_col))
    return docs.where(~found["rejected"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predictor(train(docs))(F.col("text"))
    return docs.select("doc_id", (~trainable("doc_id")).alias("held_out"), found.alias("f")).select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))
