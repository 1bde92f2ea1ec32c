"""Prompt templates, compiled to Columns.

A subset of a well-known template language: {{ name }}, {{ name.field }}, {% if name is defined %}, {% if name %},
{% else %}, {% endif %}, {% for item in name %} ... {% endfor %} over arrays of structs or strings. What is defined is
known from the schema, so such branches are resolved when the template is compiled. Nulls render as empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import strip

TAG = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)


class TemplateError(ValueError):
    """A template that can't be compiled, or names a missing column."""


def _parse(text: str) -> list:
    """Nested lists of ("text", s), ("value", path), ("if", condition, then, else) and ("for", item, path, body)."""
    stack: list[tuple[list, tuple | None]] = [([], None)]
    at = 0
    for m in TAG.finditer(text):
        if m.start() > at:
            stack[-1][0].append(("text", text[at : m.start()]))
        at = m.end()
        value, word = m[1], (m[2] or "").split()
        if value is not None:
            stack[-1][0].append(("value", value))
        elif word[0] == "if":
            stack.append(([], ("if", word[1:])))
        elif word[0] == "for" and word[2] == "in":
            stack.append(([], ("for", word[1], word[3])))
        elif word[0] == "else":
            body, opened = stack.pop()
            if not opened or opened[0] != "if":
                raise TemplateError("else without if")
            stack.append(([], ("else", opened[1], body)))
        elif word[0] in ("endif", "endfor"):
            body, opened = stack.pop()
            if not opened:
                raise TemplateError(f"{word[0]} without a start")
            if opened[0] == "for":
                stack[-1][0].append(("for", opened[1], opened[2], body))
            else:
                stack[-1][0].append(("if", opened[1], *((body, []) if opened[0] == "if" else (opened[2], body))))
        else:
            raise TemplateError(f"unknown tag: {' '.join(word)}")
    if len(stack) > 1:
        raise TemplateError("a block isn't closed")
    stack[0][0].append(("text", text[at:]))
    return stack[0][0]


def _lookup(path: str, scope: dict, schema: T.StructType, missing: str) -> tuple[Column, T.DataType] | None:
    name, *fields = path.split(".")
    if name in scope:
        found, kind = scope[name]
    elif name in schema.names:
        found, kind = F.col(f"`{name}`"), schema[name].dataType
    elif missing == "empty":
        return None
    else:
        raise TemplateError(f"no column {name}")
    for f in fields:
        found, kind = found[f], kind[f].dataType
    return found, kind


def _render(body: list, scope: dict, schema: T.StructType, missing: str) -> Column:
    parts = []
    for node in body:
        if node[0] == "text":
            parts.append(F.lit(node[1]))
        elif node[0] == "value":
            found = _lookup(node[1], scope, schema, missing)
            parts.append(F.coalesce(found[0].cast("string"), F.lit("")) if found else F.lit(""))
        elif node[0] == "if":
            name, negated = node[1][0], "not" in node[1]
            if "is" in node[1]:
                there = (name in scope or name in schema.names) != negated
                parts.append(_render(node[2] if there else node[3], scope, schema, missing))
            else:
                found = _lookup(name, scope, schema, "empty")
                if not found:
                    parts.append(_render(node[3], scope, schema, missing))
                else:
                    value, kind = found
                    true = F.size(value) > 0 if isinstance(kind, T.ArrayType) else value.cast("string") != ""
                    parts.append(F.when(true, _render(node[2], scope, schema, missing)).otherwise(_render(node[3], scope, schema, missing)))
        else:
            found = _lookup(node[2], scope, schema, missing)
            if found:
                value, kind = found
                inner = lambda x, n=node, k=kind: _render(n[3], scope | {n[1]: (x, k.elementType)}, schema, missing)
                parts.append(F.coalesce(F.array_join(_each(value, inner), ""), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _each(value: Column, inner) -> Column:
    return F.transform(value, lambda x: inner(x))


def compiled(text: str, schema: T.StructType, missing: str = "error") -> Column:
    """The stripped rendering of a template over the rows of a schema. missing: "error" or "empty"."""
    return strip(_render(_parse(text), {}, schema, missing))


def variables(text: str) -> frozenset[str]:
    """The columns that a template names."""

    def of(body: list) -> set[str]:
        out: set[str] = set()
        for node in body:
            if node[0] == "value":
                out.add(node[1].split(".")[0])
            elif node[0] == "if":
                out |= {node[1][0].split(".")[0] if node[1][0] != "not" else node[1][1].split(".")[0]} | of(node[2]) | of(node[3])
            elif node[0] == "for":
                out |= {node[2].split(".")[0]} | (of(node[3]) - {node[1]})
        return out

    return frozenset(of(_parse(text)))


def prompt_text(config: dict | None) -> str:
    """The five sections of a prompt configuration in one template; nothing for no configuration."""
    if config is None:
        return ""
    sections = ("system", "introduction", "principles", "examples", "generation")
    absent = [s for s in sections if s not in config]
    if absent:
        raise TemplateError(f"prompt sections missing: {', '.join(absent)}")
    return "\n".join(str(config[s] or "") for s in sections)
