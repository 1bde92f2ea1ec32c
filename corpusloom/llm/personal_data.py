"""Personal data: base patterns and a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. A conditional random field then labels the
tokens that could be such data (they hold a digit or an @, or repeat the name part of an address found): unary factors
by a token's shape, chain factors between neighbours, and skip factors between tokens of a document that repeat or
resemble each other however far apart. A token is linked to the one before it with the same key; one outside base spans
is linked to the nearest base span of each label that has its key instead of to others like it, so that each has the
base label's whole weight, however many there are. Tokens in base spans keep their label; loopy message passing over
all of a document carries it along the edges to the others, until the document's messages settle, and those that end up
as data are added as spans, neighbouring parts of one number as one span, if they repeat a base span or are whole
numbers or addresses by themselves. All other tokens have no chance of being data
in this model, so they need not be nodes.

The field is fitted to base labels. Spark counts shapes, neighbours and successive repeats over half of a bounded sample
(SAMPLE_DOCS rows by a hash of id and text), which gives each factor a table of logarithms; the other half gives the tables'
weights, by maximum pseudo-likelihood: each token's label given its shape, its neighbours' labels and those of its repeats.
What the patterns missed counts as `none` there, so a shape that is nearly always data where
patterns find it is data where they fail, as two numbers that one pattern takes for one that is too long. A number of a card's
length that fails the checksum, or an address with a part over 255, is never added.

Defined results: null text counts as empty and has no spans; texts of any length are one document; rows, ids and null ids
may repeat, and each row has its own result, which depends on its text only; an empty table gives no rows; columns of
other names are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import documents, map_texts, sample_hash, sampled

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SAMPLE_DOCS = 20_000
#: Added to each count of a shape's labels; what never was seen of a shape is this unlikely.
SMOOTH = 0.1
#: How strongly weights are held to 1, in cases; bound of the chain's logarithms.
PRIOR, CHAIN = 10.0, 4.0
#: Messages of a document have settled when none moves by CLOSE; loops that swing without end are left after ROUNDS.
ROUNDS, DAMPING, CLOSE = 1000, 0.3, 1e-3
#: Shortest key by which tokens count as repeats; digits by whose end numbers count as similar.
KEY, TAIL = 4, 7

HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BEFORE_AT = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits that fails from its first digit fails from each later one; possessive runs and the look-behind keep it linear.
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}()]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    if "@" in text:
        last = 0
        for m in HOST.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1].isascii() and not BEFORE_AT.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((0, start, m.end()))
                last = m.end()
    if DIGIT.search(text):
        for m in QUAD.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def shape(token: str) -> str:
    digits, dots = sum(c.isdigit() for c in token), token.count(".")
    bucket = next((k for k, n in enumerate((0, 1, 3, 6, 9, 12, 15, 19)) if digits <= n), 8)
    return f"{min(2, token.count('@'))}{bucket}{min(4, dots)}{min(3, token.count('-'))}{int(token[:1] == '+')}{int(any(c.isalpha() for c in token))}"


def keys(token: str) -> list[str]:
    """What a token shares with those that repeat or resemble it."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    digits = "".join(c for c in token if c.isdigit())
    out = ["=" + plain] if len(plain) >= KEY else []
    if len(digits) >= TAIL:
        out.append("#" + digits[-TAIL:])
    if "@" in token:
        out.append("~" + token.split("@")[0].lower())
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str], int]]:
    """(start, end, base label or -1, shape, keys, number of the token): the tokens that could be personal data."""
    names = {text[a:b].split("@")[0].lower() for k, a, b in base if k == 0}
    names = {n for n in names if len(n) > KEY}
    spans, out, k = sorted(base, key=lambda s: s[1]), [], 0
    for i, m in enumerate(TOKEN.finditer(text)):
        a, b = m.span()
        while b > a + 1 and text[b - 1] in ".-":
            b -= 1
        token = text[a:b]
        while k < len(spans) and spans[k][2] <= a:
            k += 1
        inside = next((s[0] + 1 for s in spans[k : k + 4] if s[1] < b and a < s[2]), -1)
        named = token.lower() in names
        if inside > 0 or named or "@" in token or DIGIT.search(token):
            out.append((a, b, inside, shape(token), keys(token) + (["~" + token.lower()] if named else []), i))
    return out


class Graph:
    """The nodes of many documents, their chain edges, skip edges to the next token with the same key, and to base spans."""

    def __init__(self):
        self.doc, self.spans, self.base, self.shapes = [], [], [], []
        self.chain, self.skip, self.star = [], [], []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        seen: dict[str, int] = {}
        places: dict[str, list[int]] = {}
        before, old = None, len(self.skip)
        for a, b, label, form, found, i in nodes(text, base):
            me = len(self.doc)
            self.doc.append(doc), self.spans.append((a, b)), self.base.append(label), self.shapes.append(form)
            if before is not None and before == i - 1:
                self.chain.append((me - 1, me))
            before = i
            for key in found:
                if key in seen and (not self.skip or self.skip[-1] != (seen[key], me)):
                    self.skip.append((seen[key], me))
                seen[key] = me
                places.setdefault(key, []).append(me)
        linked = set(self.skip[old:])
        held: dict[int, set[int]] = {}
        for mine in places.values():
            near = {self.base[x]: x for x in reversed(mine) if self.base[x] > 0}  # the first of each label, then the last one passed
            for me in mine if near else ():
                if self.base[me] > 0:
                    near[self.base[me]] = me
                    continue
                held.setdefault(me, set()).update(near)
                for x in near.values():
                    if (pair := (min(x, me), max(x, me))) not in linked:
                        linked.add(pair)
                        self.star.append(pair)
        # Repeats that are linked to a base span of one label need no link among each other: they would hold each other at none.
        self.skip[old:] = [(a, b) for a, b in self.skip[old:] if a not in held or held[a] != held.get(b)]


def counted(texts: list[str | None], held: list[bool] | None = None) -> Counter:
    """Counts of (shape, label), neighbouring labels, and agreement of repeats of one shape; of held texts, of whole cases:
    shape, labels before and after, labels of repeats, and the label."""
    out = Counter()
    for t, own in zip(texts, held or [False] * len(texts), strict=True):
        if not t:
            continue
        graph = Graph()
        graph.add(0, t, base_spans(t))
        label = [max(0, b) for b in graph.base]
        if not own:
            out.update(("shape", s, LABELS[y]) for s, y in zip(graph.shapes, label, strict=True))
            out.update(("chain", LABELS[label[a]], LABELS[label[b]]) for a, b in graph.chain)
            out.update(("skip", "same" if label[a] == label[b] else "other", "") for a, b in graph.skip + graph.star if label[a] + label[b] and graph.shapes[a] == graph.shapes[b])
            continue
        before, after, repeats = {b: label[a] for a, b in graph.chain}, {a: label[b] for a, b in graph.chain}, {}
        for a, b in graph.skip + graph.star:
            repeats.setdefault(a, [0] * len(LABELS))[label[b]] += 1
            repeats.setdefault(b, [0] * len(LABELS))[label[a]] += 1
        for i, (s, y) in enumerate(zip(graph.shapes, label, strict=True)):
            case = f"{s} {before.get(i, -1)} {after.get(i, -1)} {','.join(map(str, repeats[i])) if i in repeats else ''}"
            out[("case", case, LABELS[y])] += 1
    return out


class Field:
    """The factors, as logarithms."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        n = len(LABELS)
        by: dict[str, np.ndarray] = {}
        chain, cases = np.ones((n, n)), []
        same, other = 9.0, 1.0
        for (what, a, b), c in sorted(counts.items()):
            if what == "shape":
                by.setdefault(a, np.full(n, SMOOTH))[LABELS.index(b)] += c
            elif what == "chain":
                chain[LABELS.index(a), LABELS.index(b)] += c
            elif what == "case":
                cases.append((a, LABELS.index(b), c))
            elif a == "same":
                same += c
            else:
                other += c
        self.unary = {s: np.log(p / p.sum()) for s, p in by.items()}
        every = sum(by.values()) if by else np.ones(n)
        self.unknown = np.log((every + SMOOTH) / (every + SMOOTH).sum())
        p = chain / chain.sum()
        self.chain = np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -CHAIN, CHAIN)
        self.skip = np.eye(n) * np.log(same / other)
        self.weights = self.fitted(cases)
        a, b, c = self.weights
        self.unary, self.unknown, self.chain, self.skip = {s: a * u for s, u in self.unary.items()}, a * self.unknown, b * self.chain, c * self.skip

    def features(self, case: str) -> np.ndarray:
        """Of a case, what each of the three kinds of factor says of each label."""
        shape_, before, after, repeats = case.split(" ")
        chain = np.zeros(len(LABELS))
        if int(before) >= 0:
            chain += self.chain[int(before)]
        if int(after) >= 0:
            chain += self.chain[:, int(after)]
        skip = self.skip @ np.array(list(map(float, repeats.split(",")))) if repeats else np.zeros(len(LABELS))
        return np.array([self.unary.get(shape_, self.unknown), chain, skip])

    def fitted(self, cases: list[tuple[str, int, int]]) -> np.ndarray:
        """The weights of the three kinds of factor that make the cases' labels most likely, by Newton's method."""
        w = np.ones(3)
        if not cases:
            return w
        f = np.array([self.features(x) for x, _, _ in cases])
        y, n = np.array([y for _, y, _ in cases]), np.array([float(c) for _, _, c in cases])
        told = f[np.arange(len(y)), :, y]

        def value(w: np.ndarray) -> float:
            energy = np.einsum("k,ikl->il", w, f)
            return float(n @ (told @ w - np.logaddexp.reduce(energy, axis=1)) - PRIOR / 2 * ((w - 1) ** 2).sum())

        for _ in range(50):
            energy = np.einsum("k,ikl->il", w, f)
            p = np.exp(energy - np.logaddexp.reduce(energy, axis=1, keepdims=True))
            mean = np.einsum("il,ikl->ik", p, f)
            slope = n @ (told - mean) - PRIOR * (w - 1)
            bend = np.einsum("i,il,ikl,ijl->kj", n, p, f, f) - np.einsum("i,ik,ij->kj", n, mean, mean) + PRIOR * np.eye(3)
            step, size = np.linalg.solve(bend, slope), 1.0
            while size > 1e-6 and value(np.maximum(w + size * step, 0)) < value(w):
                size /= 2
            new = np.maximum(w + size * step, 0)  # a weight below nothing would turn a factor round
            if np.abs(new - w).max() < 1e-6:
                break
            w = new
        return w

    def labels(self, graph: Graph) -> np.ndarray:
        """Label of each node by loopy message passing: its most likely one if over one half, else none."""
        n, m = len(LABELS), len(graph.doc)
        unary = np.array([self.unary.get(s, self.unknown) for s in graph.shapes]).reshape(m, n)
        base = np.array(graph.base, dtype=np.int64)
        fixed = np.flatnonzero(base >= 0)
        unary[fixed] = -30.0
        unary[fixed, base[fixed]] = 0.0
        edges = np.array(graph.chain + graph.skip + graph.star, dtype=np.int64).reshape(-1, 2)
        e = len(edges)
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        back = np.r_[e : 2 * e, 0:e]
        skip = np.tile(np.arange(e) >= len(graph.chain), 2)
        pair = np.where(skip[:, None, None], self.skip, np.concatenate([np.broadcast_to(self.chain, (e, n, n)), np.broadcast_to(self.chain.T, (e, n, n))]) if e else np.zeros((0, n, n)))
        messages, belief = np.zeros((2 * e, n)), unary.copy()
        doc = np.array(graph.doc, dtype=np.int64)[source]
        live = np.flatnonzero(base[target] < 0) if e else target  # what has its label takes no messages, or many would turn it
        for _ in range(ROUNDS):
            if not len(live):
                break
            others = belief[source[live]] - messages[back[live]]
            new = np.logaddexp.reduce(others[:, :, None] + pair[live], axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            step = (1 - DAMPING) * (new - messages[live])
            messages[live] += step
            np.add.at(belief, target[live], step)
            moving = np.zeros(doc.max() + 1, bool)
            moving[doc[live][np.abs(step).max(axis=1) >= CLOSE]] = True
            live = live[moving[doc[live]]]
        share = np.exp(belief - np.logaddexp.reduce(belief, axis=1, keepdims=True))
        best = share.argmax(axis=1)
        return np.where(share.max(axis=1, initial=0) > 0.5, best, 0) if m else np.zeros(0, int)

    def find(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """(base spans, all spans) of each text."""
        base = [base_spans(t) if t else [] for t in texts]
        graph = Graph()
        for k, (t, b) in enumerate(zip(texts, base, strict=True)):
            if t and ("@" in t or DIGIT.search(t)):
                graph.add(k, t, b)
        more: dict[int, list] = {}
        labels = np.where(np.array(graph.base, dtype=np.int64) < 0, self.labels(graph), 0)
        follows, linked = {b: a for a, b in graph.chain}, {x for a, b in [*graph.skip, *graph.star] for x, y in ((a, b), (b, a)) if graph.base[y] > 0}
        for i, (k, span, y) in enumerate(zip(graph.doc, graph.spans, labels, strict=True)):
            if y:
                own = more.setdefault(k, [])
                text, before = texts[k], follows.get(i)
                if own and before is not None and labels[before] == y and own[-1][0] == y - 1 and part(text[slice(*span)]) and part(text[own[-1][1] : own[-1][2]]):
                    own[-1] = (int(y) - 1, own[-1][1], span[1], own[-1][3] or i in linked)
                else:
                    own.append((int(y) - 1, *span, i in linked))
        said = lambda k, s: texts[k][s[1] : s[2]]
        added = {k: [s[:3] for s in own if (s[3] or whole(s[0], said(k, s))) and not refuted(s[0], said(k, s))] for k, own in more.items()}
        return [(b, sorted({*b, *added.get(k, [])})) for k, b in enumerate(base)]


def whole(kind: int, span: str) -> bool:
    """Whether a span that repeats nothing has what its kind has: a part of a number alone is none."""
    digits = sum(c.isdigit() for c in span)
    return ("@" in span, span.count(".") == 3, 13 <= digits <= 19, 9 <= digits <= 15)[kind]


def refuted(kind: int, span: str) -> bool:
    """Whether a span is of a kind's form, but fails its test: such a number is none, whatever stands beside it."""
    digits = "".join(c for c in span if c in "0123456789")
    if KINDS[kind] == "card":
        return 13 <= len(digits) <= 19 and not luhn(digits)
    return KINDS[kind] == "ip" and any(int(x) > 255 for x in span.split(".") if x.isascii() and x.isdigit())


def part(token: str) -> bool:
    """Whether a token can be part of a number that goes on: it has too few digits to be one, and no letter or dot."""
    return sum(c.isdigit() for c in token) < 12 and not any(c.isalpha() or c in ".@" for c in token)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(*k, n) for k, n in counted(list(frame["text"]), list(frame["held"])).items()], columns=["what", "a", "b", "n"])

    held = F.pmod(F.xxhash64(F.lit("held"), sample_hash(id_col, text_col)), F.lit(2)) == 1
    found = sampled(docs, sample_docs, id_col, text_col).select(F.col(text_col).cast("string").alias("text"), held.alias("held"))
    found = map_texts(found, count, "what string, a string, b string, n long")
    return Field({(r[0], r[1], r[2]): r[3] for r in found.groupBy("what", "a", "b").agg(F.sum("n")).collect()})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def annotated(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and all spans (kind, start, end in code points) as arrays."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), 500):
                part = frame.iloc[k : k + 500]
                found = field.find(list(part["text"]))
                rows = [[[{"kind": KINDS[s[0]], "start": s[1], "end": s[2]} for s in spans] for spans in pair] for pair in found]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "base": [r[0] for r in rows], "spans": [r[1] for r in rows]})

    span = "array<struct<kind: string, start: int, end: int>>"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(texts, run, f"doc_id long, base {span}, spans {span}")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = annotated(docs, train(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = [(F.size("kinds") - F.size(F.array_remove("kinds", k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.withColumn("kinds", F.col("base.kind")).select("doc_id", *number, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
