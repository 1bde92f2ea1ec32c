"""Chat templates: functions from an array of (role, content) to text, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import column

TEMPLATES: dict[str, Callable[[Column, bool], Column]] = {}


def template(name: str):
    """Registers a template: a function of the messages and of whether a generation tail is wanted."""

    def register(f: Callable[[Column, bool], Column]):
        TEMPLATES[name] = f
        return f

    return register


def get(name: str) -> Callable[[Column, bool], Column]:
    if name not in TEMPLATES:
        raise KeyError(f"no chat template {name}; there are {', '.join(sorted(TEMPLATES))}")
    return TEMPLATES[name]


#: Patterns of model ids and the template of such models; the first that is found in an id counts.
FAMILIES: list[tuple[re.Pattern[str], str]] = []


def family(pattern: str, name: str) -> None:
    """Registers a template for models whose id the pattern, found anywhere and in any case, describes."""
    get(name)
    FAMILIES.insert(0, (re.compile(pattern, re.I), name))


def for_model(model_id: str) -> str:
    """The template of a model's family. There is none for an unknown model: a wrong prompt would go unnoticed."""
    found = next((name for pattern, name in FAMILIES if pattern.search(model_id)), None)
    if found is None:
        raise KeyError(f"no chat template for model {model_id}; name one of {', '.join(sorted(TEMPLATES))}, or a format with {{prompt}}, as model_prompt, or register its family")
    return found


def user_message(prompt: Column | str) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), column(prompt).alias("content")))


def render(name: str, messages: Column | str, is_text: bool = True, generation: bool = True) -> Column:
    """A prompt for a model; a text is one user message. A name with {prompt} in it is a format of its own."""
    messages = column(messages)
    if "{prompt}" in name:
        before, after = name.split("{prompt}", 1)
        return F.concat(F.lit(before), messages, F.lit(after))
    if name == "blank":
        return messages
    return get(name)(user_message(messages) if is_text else messages, generation)


@template("blank")
def blank(messages: Column, generation: bool) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), "\n")


@template("roles")
def roles(messages: Column, generation: bool) -> Column:
    """Lines tagged by role; an end-of-text mark after each assistant turn, and around pretraining text."""
    mark = lambda tag: F.lit(f"<|{tag}|>\n")

    def turn(m: Column, i: Column) -> Column:
        last = i == F.size(messages) - 1
        return (
            F.when(m["role"] == "pretraining", F.concat(F.lit("<|pretrain|>"), m["content"], F.lit("<|endoftext|><|/pretrain|>")))
            .when(m["role"].isin("system", "user"), F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
            .when(m["role"] == "assistant", F.concat(mark("assistant"), m["content"], F.lit("<|endoftext|>"), F.when(last, F.lit("")).otherwise(F.lit("\n"))))
            .otherwise(F.lit(""))
        )

    text = F.array_join(F.transform(messages, turn), "")
    return F.concat(text, mark("assistant")) if generation else text


@template("inst")
def inst(messages: Column, generation: bool) -> Column:
    """Instruction brackets; a leading system turn goes into the first user turn; turns must alternate."""
    system = F.element_at(messages, 1)["role"] == "system"
    turns = F.when(system, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    lead = F.when(system, F.concat(F.element_at(messages, 1)["content"], F.lit("\n\n"))).otherwise(F.lit(""))
    wrong = F.exists(F.transform(turns, lambda m, i: m["role"] != F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))), lambda x: x)
    text = F.transform(
        turns,
        lambda m, i: F.when(m["role"] == "user", F.concat(F.lit(" [INST] "), F.when(i == 0, lead).otherwise(F.lit("")), m["content"], F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), m["content"], F.lit("</s>"))),
    )
    return F.when(wrong, F.raise_error(F.lit("user and assistant turns must alternate"))).otherwise(F.concat(F.lit("<s>"), F.array_join(text, "")))


family(r"mistral|mixtral", "inst")
family(r"(^|[-_/])lab([-_/:]|$)", "roles")
