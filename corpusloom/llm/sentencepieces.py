"""SentencePiece BPE encoding and decoding by a table of last tokens.

For each prefix of a text there is one token with which its encoding ends. The table stores it: an automaton gives all
pieces that end at a place, and of these the one is right whose predecessor - the last token of the prefix before it -
may stand next to it, that is, whose concatenation encodes to just these two. The ids are then read backwards from the
table. Pair tests are remembered (by pair, of which a vocabulary has few that occur), so the work is linear in the text.
Pieces never have a blank mark after another character, so a text falls apart before blank marks; the ids of the parts
met first are remembered as bytes. Both memories are of bounded size and begin anew when what they hold no longer serves.

Characters that are no piece fall back to their UTF-8 bytes. Only the vocabulary (some 10^4 pieces) is sent to the
executors. Defined results: null text counts as empty and has no ids, and null ids decode to the empty text; texts of any
length are taken whole, a text at a time; ids and all other columns may be null or repeat, and no name clashes, for rows
are neither joined nor renamed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, kept, lists, map_texts, texts_udf, unused

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
#: Parts of a text that an encoder remembers (some 200 bytes each), the longest of them, and how many others it meets
#: before it begins anew.
REMEMBERED, LONGEST, STALE = 150_000, 48, 2_000_000
#: Pair tests that an encoder remembers.
PAIRS = 1_000_000


def vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id, of a BPE model with identity normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else BYTE if model.is_byte(i) else NORMAL
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Encoder:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.pieces = pieces
        self.rank = {p: (-s, i) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.fits: list[dict[int, bool]] = [{} for _ in pieces]  # by token, of the token before
        self.names = [str(i) for i in range(len(pieces))]
        # The characters of tokens; an ASCII byte is one by itself, whatever bytes stand beside it.
        self.plain = [p.replace(MARK, " ") if kind == NORMAL else None for p, _, kind in pieces]
        for b, i in self.bytes.items():
            self.plain[i] = chr(b) if b < 128 else None
        singles = {p: i for p, (_, i) in self.rank.items() if len(p) == 1}
        self.single = lambda c: singles.get(c, -1)
        self.parts: dict[str, bytes] = {}
        self.passed = self.tests = 0
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            if len(p) > 1 and self.merged(p) == [i]:  # a piece that merges don't reach is never a last token
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        inside = {c for p in self.rank for c in p[1:]}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            self.split = re.compile(r".+", re.S)
        else:
            alone = "" if "\n" in inside or any(p[0] == "\n" for p in self.rank) else "\n"
            self.split = re.compile(f"{alone}|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def merged(self, text: str) -> list[int]:
        """The ids of a short text by merging, best score first and of equal scores the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.rank[p][1] if p in self.rank else -1 for p in parts]

    def together(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if self.tests >= PAIRS:
            self.tests = 0
            for row in self.fits:
                row.clear()
        self.tests += 1
        found = self.fits[b][a] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return found

    def ids(self, part: str) -> list[int]:
        """The ids of a part, from the table of each prefix's last token."""
        n, fits = len(part), self.fits
        # A place where no longer piece fits has its character; -1 is one that is no piece, so nothing merges with it.
        last, size = [-1, *map(self.single, part)], [1] * (n + 1)
        for end, (token, length) in self.automaton.iter(part):
            end += 1
            if size[end] == 1:
                before = last[end - length]
                if before >= 0:
                    fit = fits[token].get(before)
                    if not fit and (fit is not None or not self.together(before, token)):
                        continue
                last[end] = token
                size[end] = length
        out: list[int] = []
        while n:
            if last[n] >= 0:
                out.append(last[n])
            else:
                raw = [self.bytes.get(b) for b in part[n - 1].encode("utf-8", "surrogatepass")]
                out.extend(reversed(raw) if None not in raw else [self.unknown])
            n -= size[n]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return self.codes(text).tolist()

    def codes(self, text: str) -> np.ndarray:
        known, own = self.parts, self.part
        return np.frombuffer(b"".join([known.get(p) or own(p) for p in self.split.findall(MARK + text.replace(" ", MARK))] if text else []), np.int32)

    def surface(self, ids: list[int]) -> str:
        """The characters of ids, blank marks as blanks, byte pieces as UTF-8."""
        try:
            return "".join(map(self.plain.__getitem__, ids))
        except TypeError:  # bytes that are characters only together
            pass
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.pieces[i][2] == BYTE:
                raw.append(int(self.pieces[i][0][3:5], 16))
                continue
            if raw:
                out.append(from_bytes(bytes(raw)))
                raw.clear()
            if i is not None and self.pieces[i][2] != CONTROL:
                out.append(" ⁇ " if self.pieces[i][2] == UNKNOWN else self.pieces[i][0])
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]][0][:1] == MARK else text

    def part(self, part: str) -> bytes:
        """The ids of a part as 32-bit numbers."""
        found = array("i", self.ids(part)).tobytes()
        if len(self.parts) < REMEMBERED and len(part) <= LONGEST:
            self.parts[part] = found
        elif (passed := self.passed + 1) < STALE:
            self.passed = passed
        else:
            self.passed = 0
            self.parts.clear()
        return found

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, sha256 of the ids joined by commas, sha256 of the decoded text."""
        ids = self.encode(text or "")
        joined = ",".join(map(self.names.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


def from_bytes(raw: bytes) -> str:
    """UTF-8, with U+FFFD for each byte that is not part of a character."""
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


def shared(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """One encoder for each vocabulary in a worker process, so what it remembers serves later tasks."""
    pieces = vocabulary(path)
    key, sent = hashlib.sha256(repr(pieces).encode()).hexdigest(), spark.sparkContext.broadcast(pieces)
    return lambda: kept(key, lambda: Encoder(sent.value))


def encoded(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids."""
    get = shared(docs.sparkSession, path)
    ids = texts_udf(lambda texts: lists([get().codes(t or "") for t in texts], pa.int32()), "array<int>")
    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def checked(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", same_col: str = "round_trip") -> DataFrame:
    """docs with a column of ids, and whether they decode to the text: both in one pass."""
    get = shared(docs.sparkSession, path)

    def run(texts: list[str | None]) -> pa.Array:
        own = get()
        ids = [own.codes(t or "") for t in texts]
        same = [own.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
        return pa.StructArray.from_arrays([lists(ids, pa.int32()), pa.array(same, pa.bool_())], ["ids", "same"])

    found = texts_udf(run, "ids array<int>, same boolean")(F.col(text_col).cast("string"))
    made = unused("_found", docs.columns)
    out = docs.withColumn(made, found)
    return out.withColumns({ids_col: out[made]["ids"], same_col: out[made]["same"]}).drop(made)


def decoded(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the text of a column of ids."""
    get = shared(docs.sparkSession, path)

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        own = get()
        return pa.array([own.decode(i.as_py() or []) for i in ids], pa.string())

    return docs.withColumn(text_col, text(F.col(ids_col)))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    get = shared(docs.sparkSession, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = pd.DataFrame([get().digests(t) for t in frame["text"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield made.assign(doc_id=frame["doc_id"].astype("Int64").array)

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, DIGESTS)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), model_path())
