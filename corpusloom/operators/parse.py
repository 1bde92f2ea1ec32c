"""Completions into rows: tags or a pattern give arrays, arrays are zipped to the shortest, each entry is a row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import column as as_column
from corpusloom.functions.text import matched, tagged, without
from corpusloom.operators.columns import unused


@dataclass(frozen=True)
class Parser:
    """How a completion becomes output columns: by a pair of tags for each, or by the groups of one pattern."""

    columns: Sequence[str]
    start_tags: Sequence[str] = ()
    end_tags: Sequence[str] = ()
    pattern: str | None = None
    cleanup: Sequence[str] = field(default=())
    clean_all: bool = False

    def __post_init__(self):
        if not self.columns:
            raise ValueError("no output columns")
        if self.pattern is None and not (self.start_tags and self.end_tags):
            raise ValueError("neither tags nor a pattern to parse by")

    def arrays(self, text: Column | str) -> dict[str, Column]:
        text = as_column(text)
        if self.pattern is None:
            return {c: tagged(text, s or "", e or "") for s, e, c in zip(self.start_tags, self.end_tags, self.columns, strict=False)}
        groups = _groups(self.pattern)
        if groups < 2:
            found = {self.columns[0]: matched(text, self.pattern, groups)}
            clean = self.clean_all
        else:
            found = {c: matched(text, self.pattern, k + 1) for k, c in enumerate(self.columns[:groups])}
            clean = True
        return {c: F.transform(a, lambda x: without(x, self.cleanup)) if clean and self.cleanup else a for c, a in found.items()}


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def parse_rows(df: DataFrame, text: str, parser: Parser, keep: Sequence[str] | None = None, position: str | None = None) -> DataFrame:
    """A row for each parsed entry; a completion without one has none. Output columns replace columns of the same name."""
    arrays = parser.arrays(F.col(f"`{text}`"))
    rest = [c for c in (df.columns if keep is None else keep) if c not in arrays]
    # The arrays are columns of their own first: a pattern runs once a row, however many entries it finds.
    names = {c: unused(f"_array_{k}", df.columns) for k, c in enumerate(arrays)}
    found = df.select(*[F.col(f"`{c}`") for c in rest], *[a.alias(names[c]) for c, a in arrays.items()])
    shortest = F.least(*[F.size(n) for n in names.values()]) if len(names) > 1 else F.size(next(iter(names.values())))
    entries = F.slice(F.arrays_zip(*names.values()), F.lit(1), F.greatest(shortest, F.lit(0)))
    place, entry = unused("_position", rest), unused("_entry", rest)
    out = found.select(*[F.col(f"`{c}`") for c in rest], F.posexplode(entries).alias(place, entry))
    return out.select(*[F.col(f"`{c}`") for c in rest], *[F.col(entry)[n].alias(c) for c, n in names.items()], *([F.col(place).alias(position)] if position else []))
