"""The skip-chain field against exact inference by enumeration, its fit, and numbers that the patterns miss."""

import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import personal_data as pd_
from tests.llm.test_llm import table


def exact_labels(field, graph):
    """Each node's label by summing over all labellings."""
    n, m = len(pd_.LABELS), len(graph.doc)
    total = np.zeros((m, n))
    for ys in itertools.product(range(n), repeat=m):
        if any(b >= 0 and y != b for y, b in zip(ys, graph.base, strict=True)):
            continue
        e = sum(field.unary.get(s, field.unknown)[y] for s, y, b in zip(graph.shapes, ys, graph.base, strict=True) if b < 0)
        e += sum(field.chain[ys[a], ys[b]] for a, b in graph.chain)
        e += sum(field.skip[ys[a], ys[b]] for a, b in [*graph.skip, *graph.star])
        total[np.arange(m), list(ys)] += np.exp(e)
    share = total / total.sum(axis=1, keepdims=True)
    return np.where(share.max(axis=1) > 0.5, share.argmax(axis=1), 0), share


def counts(r):
    address = lambda i: f"write to name.{i}@mail.example.com or call +1 (555) 010-44{i % 90 + 10} by 12 and 3.0"
    cards = [f"pay {c} now" for c in ("4111 1111 1111 1111", "4111111111111111", "5500005555555559")]
    texts = [address(i) for i in range(300)] + cards * 60 + ["plain words, 7 of them"] * 900
    return pd_.counted(texts, [r.random() < 0.5 for _ in texts])


@pytest.fixture(scope="module")
def field():
    return pd_.Field(counts(random.Random(2)))


TEXTS = [
    "name.7 wrote, then name.7@mail.example.com said",
    "+1 (555) 010-4477 4111111111111111",  # one pattern takes both numbers for one that is too long
    "7 +1 (555) 010-4477 4111111111111111",
    "1111 of 3.0 and 12, 12",
    "name.7 name.7@mail.example.com name.7 name.7",
    "5550104477 12 +1 (555) 010-4477",
]


@pytest.mark.parametrize("text", TEXTS)
def test_message_passing_agrees_with_enumeration(field, text):
    graph = pd_.Graph()
    graph.add(0, text, pd_.base_spans(text))
    assert 0 < len(graph.doc) <= 7
    labels, share = exact_labels(field, graph)
    ours = field.labels(graph)
    sure = share.max(axis=1) > 0.6  # messages round a loop may count a factor twice, so near ties are left out
    assert (ours == labels)[sure].all()
    assert sure.any()


def test_numbers_that_one_pattern_takes_together_are_found(field):
    text = "call +1 (555) 010-4477 4111111111111111 today"
    ((base, every),) = field.find([text])
    assert base == []
    assert [(pd_.KINDS[k], text[a:b]) for k, a, b in every] == [("card", "4111111111111111"), ("phone", "+1 (555) 010-4477")]
    clean = "version 3.0 of 12 parts, 7 of them"
    assert field.find([clean]) == [([], [])]


def test_the_weights_are_where_the_pseudo_likelihood_is_highest():
    every = counts(random.Random(2))
    field = pd_.Field({k: v for k, v in every.items() if k[0] != "case"})
    assert (field.weights == 1).all()
    cases = [(a, pd_.LABELS.index(b), c) for (what, a, b), c in every.items() if what == "case"]
    best = field.fitted(cases)

    def value(w):
        out = -pd_.PRIOR / 2 * ((w - 1) ** 2).sum()
        for case, y, n in cases:
            e = w @ field.features(case)
            out += n * (e[y] - np.log(np.exp(e).sum()))
        return out

    for k in range(3):
        for d in (-0.05, 0.05):
            near = best.copy()
            near[k] = max(0, near[k] + d)
            assert value(near) <= value(best) + 1e-9


def test_rows_do_not_change_each_other_and_odd_input_is_defined(spark, field):
    rows = [(1, TEXTS[1]), (1, TEXTS[1]), (None, TEXTS[0]), (None, None), (2, ""), (3, "x " * 700_000 + TEXTS[1])]
    out = pd_.annotated(table(spark, rows), field).collect()
    assert len(out) == len(rows)
    spans = lambda r: [(s["kind"], s["end"] - s["start"]) for s in r["spans"]]
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(spans(r))
    assert by[1][0] == by[1][1] == by[3][0] == [("card", 16), ("phone", 17)]
    assert by[2] == [[]]
    assert sorted(map(len, by[None])) == [0, 2]
