"""Documents into seed rows: chunks, folded elements, few-shot examples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import filters, reshape
from corpusloom.plans.convert import fused

OVERLAP, RESERVE = 100, 1024
#: Chunks that are handed on together.
ROWS = 1000
SEPARATORS = ("\n#{1,6} ", "```\n", "\n\\*\\*\\*+\n", "\n---+\n", "\n___+\n", "\n\n", "\n", " ", "")


def budget(words: int, context: int) -> int:
    """Characters of a chunk of so many words, if a server with this context can take it."""
    tokens = tx.tokens_from_words(words)
    if tokens > context - RESERVE:
        raise ValueError(f"a chunk of {words} words is {tokens} tokens; the server takes {context - RESERVE}")
    size = tx.chars_from_tokens(tokens)
    if size < OVERLAP:
        raise ValueError(f"the overlap of {OVERLAP} characters is larger than the chunk size of {size}")
    return size


def split_text(text: str, size: int, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters where the separators allow it, coarse ones first, with an overlap between."""
    for k, separator in enumerate(separators):
        if separator == "" or re.search(separator, text):
            break
    rest = separators[k + 1 :]
    cuts = [0, *[m.start() for m in re.finditer(separator, text) if m.start()], len(text)] if separator else list(range(len(text) + 1))
    out: list[str] = []
    held: list[str] = []
    length = 0

    def flush() -> None:
        nonlocal length
        if whole := "".join(held).strip():
            out.append(whole)
        while held and length > overlap:
            length -= len(held.pop(0))

    for piece in (text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)):
        if len(piece) > size and rest:
            if held:
                flush()
                held.clear()
                length = 0
            out.extend(split_text(piece, size, overlap, rest))
            continue
        if length + len(piece) > size and held:
            flush()
            while held and length + len(piece) > size:
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if whole := "".join(held).strip():
        out.append(whole)
    return out


def chunk_texts(documents: str | Sequence[str], context: int, words: int) -> list[str]:
    """The chunks of documents on the driver: for seed files."""
    if isinstance(documents, str):
        documents = [documents]
    if not isinstance(documents, (list, tuple)):
        raise TypeError(f"documents are a string or a list of them, not {type(documents).__name__}")
    size = budget(words, context)
    return [c for d in documents for c in split_text(re.sub(r" {2,}\|", " |", re.sub(r"-{2,}\|", "-|", d)), size)]


def pieces_of(text: Column, separator: str) -> Column:
    """The text cut before each place of a separator, which stays in front of what follows it; characters for none."""
    found = F.split(text, "") if separator == "" else F.regexp_extract_all(text, F.lit(f"(?s)(?:{separator})?.*?(?={separator}|\\z)"), F.lit(0))
    return F.filter(found, lambda p: p != "")


def merged(sizes: Column, size: int, overlap: int, cuts_further: bool) -> Column:
    """Runs (start, stop, done) of pieces, from the pieces' lengths: as many as fit in size, a run beginning with as many of
    the last run's pieces as fit in the overlap. A piece that is too long by itself is a run that isn't done.

    A fold over the pieces with what is held (its first piece and its length) and the runs so far as its state.
    """
    run = lambda a, b, done: F.array(F.struct(a.alias("start"), b.alias("stop"), F.lit(done).alias("done")))
    none = F.array().cast("array<struct<start:int,stop:int,done:boolean>>")
    state = lambda start, length, runs: F.struct(start.cast("int").alias("start"), length.cast("int").alias("length"), runs.alias("runs"))

    def kept(start: Column, j: Column, limit: Column) -> Column:
        """(n, length) of the last pieces before j, from start on, whose length is within the limit: one step for each character of overlap at most."""
        begun = F.struct(F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit(True).alias("open"))
        return F.aggregate(
            F.sequence(F.lit(1), F.least(j - start, F.lit(max(1, overlap)))),
            begun,
            lambda t, i: F.when(t["open"] & (t["length"] + F.get(sizes, j - i) <= limit), F.struct((t["n"] + 1).alias("n"), (t["length"] + F.get(sizes, j - i)).alias("length"), F.lit(True).alias("open"))).otherwise(F.struct(t["n"].alias("n"), t["length"].alias("length"), F.lit(False).alias("open"))),
        )

    def add(s: Column, j: Column) -> Column:
        own, held = F.get(sizes, j), j > s["start"]
        further = F.lit(cuts_further) & (own > size)
        before = F.when(held, F.concat(s["runs"], run(s["start"], j, True))).otherwise(s["runs"])
        alone = state(j + 1, F.lit(0), F.concat(before, run(j, j + 1, False)))
        begun = F.transform(F.array(kept(s["start"], j, F.least(F.lit(overlap), size - own))), lambda t: state(j - t["n"], t["length"] + own, before))[0]
        return F.when(further, alone).when(held & (s["length"] + own > size), begun).otherwise(state(s["start"], s["length"] + own, s["runs"]))

    n = F.size(sizes)
    last = lambda s: F.when(s["start"] < n, F.concat(s["runs"], run(s["start"], n, True))).otherwise(s["runs"])
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), state(F.lit(0), F.lit(0), none), add, last)).otherwise(none)


def with_split(df: DataFrame, column: str, size: int, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """df with a text column as the array of its pieces, as `split_text` has them: none for null or blank text.

    Each separator is a projection, in which pieces that are still too long are cut there, all at once.
    """
    item = lambda t, done: F.struct(t.alias("text"), done.alias("done"))
    items = reshape.unused("_items", df.columns)

    def level(separator: str, further: bool) -> Column:
        whole = lambda ps, r: F.array_join(F.slice(ps, r["start"] + 1, r["stop"] - r["start"]), "")
        runs = lambda ps: tx.once(F.transform(ps, lambda p: F.length(p)), lambda n: merged(n, size, overlap, further))
        cut = lambda x: tx.once(pieces_of(x["text"], separator), lambda ps: F.transform(runs(ps), lambda r: item(whole(ps, r), r["done"])))
        there = lambda x: F.rlike(x["text"], F.lit(separator)) if separator else F.lit(True)
        return F.flatten(F.transform(items, lambda x: F.when(~x["done"] & there(x), cut(x)).otherwise(F.array(x))))

    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    out = df.withColumn(items, F.array(item(text, F.length(text) <= size)))
    for k, separator in enumerate(separators):
        out = out.withColumn(items, level(separator, k + 1 < len(separators)))
    return out.withColumn(column, F.filter(F.transform(items, lambda x: tx.strip(x["text"])), lambda t: t != "")).select(*df.columns)


def chunked(df: DataFrame, column: str, context: int, words: int, position: str | None = None) -> DataFrame:
    """A row for each chunk of a text column; none for null or blank text. All of it are expressions, no text leaves the JVM."""
    size = budget(words, context)
    return reshape.explode_list(with_split(df.withColumn(column, tx.compact_table(column)), column, size), column, position)


# Element types that are passed over, types that are taken, and what ends a document.
SKIPPED = {"page-footer", "page-header", "picture", "figure", "reference", "meta-data"}
TAKEN = {"subtitle-level-1", "title", "paragraph", "table", "equation"}
ENDS = ("## References", "## Acknowledgements")

WHOLE = re.compile(r"\s*[+-]?\d+\s*\Z")
DECIMAL = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\Z")


def table_column(cells: Sequence[str]) -> list[str]:
    """The cells of a column at one width: numbers to the right, points below each other; all else to the left."""
    if not all(map(DECIMAL.match, cells)):
        cells = [c.strip() for c in cells]
        width = max(map(len, cells))
        return [c.ljust(width) for c in cells]
    if not all(map(WHOLE.match, cells)):
        cells = [format(float(c), "g") for c in cells]
    after = [len(c) - 1 - c.rfind(".") if "." in c else -1 for c in map(str.strip, cells)]
    cells = [c.strip() + " " * (max(after) - n) for c, n in zip(cells, after, strict=True)]
    width = max(map(len, cells))
    return [c.rjust(width) for c in cells]


def table_text(table: dict | None) -> str:
    """A parsed table with a rule above its rows and its caption below; nothing for one row or column."""
    data = [[(cell or {}).get("text") or "" for cell in row] for row in (table or {}).get("data") or []]
    if len(data) <= 1 or len(data[0]) <= 1:
        return ""
    n = max(map(len, data))
    columns = [table_column([row[k] if k < len(row) else "" for row in data]) for k in range(n)]
    rule = "|" + "|".join("-" * (len(c[0]) + 2) for c in columns) + "|"
    body = ["| " + " | ".join(row) + " |" for row in zip(*columns, strict=True)]
    caption = f"\nCaption: {table['text']}\n" if table.get("text") else ""
    return "\n".join([rule, *body]) + caption


def bold_heading(text: str) -> str:
    first, *rest = text.split(".")
    return f"**{first}**" + ".".join(rest) if rest and len(first.split(" ")) < 3 else text


def page_of(elements: Sequence[dict], at: int) -> int | None:
    """A table's page: that of the nearest element before it, or from it on, with one; the latter where they differ."""
    page = lambda e: e["prov"][0]["page"] if e.get("prov") else None
    before = next((page(e) for e in reversed(elements[:at]) if page(e) is not None), None)
    after = next((page(e) for e in elements[at:] if page(e) is not None), None)
    return before if after is None else after


def fold_elements(elements: Sequence[dict], tables: Sequence[dict], max_tokens: int, count: Callable[[str], int] | None = None, by_page: bool = False, criteria: Callable[[str], bool] | None = None) -> list[str]:
    """The texts of a parsed document's elements in chunks: by a predicate of the next text, by page, or by a budget.

    The first subtitle is the document's title. With a budget, what is held is looked at before an element is added: if
    two elements or more have reached it, all but the last are a chunk, and the last begins the next one, or is a
    chunk of its own if it alone reaches the budget. Nothing from an element on whose text has one of ENDS is taken. A
    last chunk that was there before, and chunks without text, are left out; elements without a page keep the one before.
    """
    count = count or (lambda t: tx.tokens_from_words(len(t.split())))
    join, out, held = "\n\n".join, [], []
    page, titled = None, False
    for k, e in enumerate(elements):
        kind, text = e.get("type") or "", e.get("text") or ""
        if kind in SKIPPED:
            continue
        own = page_of(elements, k) if kind == "table" else e["prov"][0]["page"] if e.get("prov") else page
        if kind in TAKEN:
            if kind == "subtitle-level-1":
                text, titled = f"## **{text}**" if titled else f"# Title: **{text}**", True
            elif kind == "title":
                text = f"# **{text}**"
            if criteria is not None:
                if criteria(text):
                    out.append(join(held))
                    held = []
            elif by_page and page is not None and own != page:
                out.append(join(held))
                held = []
            elif len(held) > 1 and count(join(held)) >= max_tokens:
                out.append(join(held[:-1]))
                held = held[-1:]
                if count(held[0]) >= max_tokens:
                    out.append(held.pop())
            if kind == "paragraph":
                text = bold_heading(text)
            elif kind == "table":
                text = table_text(referred(e.get("$ref"), tables))
            if any(end in text for end in ENDS):
                break
            held.append(text)
        page = own
    last = join(held)
    return [c for c in out if c] + ([last] if last and last not in out else [])


def referred(reference: str | None, tables: Sequence[dict]) -> dict | None:
    parts = (reference or "").split("/")
    at = int(parts[2]) if len(parts) > 2 and parts[2].isdigit() else -1
    return tables[at] if 0 <= at < len(tables) else None


def plain(value):
    """Nested arrays as lists."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (np.ndarray, list, tuple)) else value


def folded(parsed: DataFrame, max_tokens: int = 500, by_page: bool = False, count: Callable[[str], int] | None = None, criteria: Callable[[str], bool] | None = None) -> DataFrame:
    """(file, place, text): a row for each chunk of each parsed document, one document to a row.

    By the words rule, and by pages or a budget, all of it are expressions; functions of texts are called in Python.
    """
    if count is None and criteria is None:
        found = folded_column(parsed.select("file", "elements", "tables"), max_tokens, by_page)
        return found.select("file", F.posexplode("chunks").alias("place", "text")).withColumn("place", F.col("place").cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str, int, str]] = []
            for file, elements, tables in zip(frame["file"], frame["elements"], frame["tables"], strict=True):
                out += [(file, k, t) for k, t in enumerate(fold_elements(plain(elements) or [], plain(tables) or [], max_tokens, count, by_page, criteria))]
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=["file", "place", "text"])
                    out = []
            yield pd.DataFrame(out, columns=["file", "place", "text"])

    return parsed.mapInPandas(run, "file string, place long, text string")


def g_text(number: Column) -> Column:
    """A number as format(x, "g") has it: six digits, no zeros at the end, an exponent below -4 and from 6 on."""
    said = F.format_string("%.5e", number)

    def of(s: Column) -> Column:
        sign, digits = F.when(s.startswith("-"), "-").otherwise(""), F.regexp_replace(F.substring_index(s, "e", 1), "[^0-9]", "")
        e = F.substring_index(s, "e", -1).cast("int")
        cut = lambda t: F.regexp_replace(t, r"\.?0+$", "")
        whole = cut(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2), F.lit("0")))
        small = cut(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        far = F.concat(cut(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        return F.concat(sign, F.when((e < -4) | (e > 5), far).when(e < 0, small).otherwise(whole))

    return F.when(F.abs(number) == float("inf"), F.when(number < 0, "-inf").otherwise("inf")).otherwise(tx.once(said, of))


def column_texts(cells: Column) -> Column:
    """`table_column` as a column: cells at one width, of digits in ASCII if they are numbers."""
    number, whole = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$", r"^\s*[+-]?[0-9]+\s*$"
    width = lambda c: F.array_max(F.transform(c, lambda x: F.length(x)))
    to_left = lambda c: tx.once(F.transform(c, tx.strip), lambda own: F.transform(own, lambda x: F.rpad(x, width(own), F.lit(" "))))
    after = lambda x: F.when(x.contains("."), F.length(F.substring_index(x, ".", -1))).otherwise(-1)
    pointed = lambda c: F.transform(c, lambda x: F.concat(x, F.repeat(F.lit(" "), F.array_max(F.transform(c, after)) - after(x))))
    to_right = lambda c: tx.once(tx.once(F.transform(c, tx.strip), pointed), lambda own: F.transform(own, lambda x: F.lpad(x, width(own), F.lit(" "))))
    numbers = lambda c: F.when(F.forall(c, lambda x: F.rlike(x, F.lit(whole))), c).otherwise(F.transform(c, lambda x: g_text(tx.strip(x).cast("double"))))
    return F.when(F.forall(cells, lambda x: F.rlike(x, F.lit(number))), to_right(numbers(cells))).otherwise(to_left(cells))


def folded_column(df: DataFrame, max_tokens: int, by_page: bool) -> DataFrame:
    """df of parsed documents (file, elements, tables) with `chunks`, as `fold_elements` has them by the words rule.

    Texts of tables and elements come first. The fold over the elements has a state of its own: chunks so far, what is held, the
    page, the last page of any element, and whether the end was met.
    """
    text = lambda x: F.coalesce(x, F.lit(""))
    # Tables: cells by row, then columns at one width, then lines.
    rows = F.transform(F.coalesce("tables", F.array().cast(df.schema["tables"].dataType)), lambda t: F.struct(F.transform(F.coalesce(t["data"], F.array().cast("array<array<struct<text:string>>>")), lambda r: F.transform(r, lambda c: text(c["text"]))).alias("rows"), t["text"].alias("caption")))
    cell = lambda t, k: F.transform(t["rows"], lambda r: text(F.get(r, k)))
    across = lambda t: F.sequence(F.lit(0), F.array_max(F.transform(t["rows"], lambda r: F.size(r))) - 1)
    real = lambda t: (F.size(t["rows"]) > 1) & (F.size(F.get(t["rows"], F.lit(0))) > 1)
    out = df.withColumn("_rows", rows)
    out = out.withColumn("_cells", F.transform("_rows", lambda t: F.struct(t["caption"].alias("caption"), F.when(real(t), F.transform(across(t), lambda k: cell(t, k))).otherwise(F.array().cast("array<array<string>>")).alias("columns"))))
    out = out.withColumn("_wide", F.transform("_cells", lambda t: F.struct(t["caption"].alias("caption"), F.transform(t["columns"], column_texts).alias("columns"))))

    def lines(t: Column) -> Column:
        rule = F.concat(F.lit("|"), F.array_join(F.transform(t["columns"], lambda c: F.repeat(F.lit("-"), F.length(c[0]) + 2)), "|"), F.lit("|"))
        line = lambda i: F.concat(F.lit("| "), F.array_join(F.transform(t["columns"], lambda c: F.get(c, i)), " | "), F.lit(" |"))
        body = F.transform(F.sequence(F.lit(0), F.size(t["columns"][0]) - 1), line)
        caption = F.when(text(t["caption"]) != "", F.concat(F.lit("\nCaption: "), t["caption"], F.lit("\n"))).otherwise("")
        return F.when(F.size(t["columns"]) > 0, F.concat(F.array_join(F.concat(F.array(rule), body), "\n"), caption)).otherwise("")

    out = out.withColumn("_tables", F.transform("_wide", lines))
    # Elements: kind, text, page, and the page of what comes after.
    page = lambda e: F.get(e["prov"], F.lit(0))["page"]
    subtitle = F.array_position(F.transform("elements", lambda e: e["type"]), "subtitle-level-1")

    def part(e: Column, k: Column) -> Column:
        kind, said = text(e["type"]), text(e["text"])
        number = F.get(F.split(e["$ref"], "/"), F.lit(2))
        first = F.substring_index(said, ".", 1)
        paragraph = F.when(said.contains(".") & (F.size(F.split(first, " ")) < 3), F.concat(F.lit("**"), first, F.lit("**"), F.substr(said, F.length(first) + 2))).otherwise(said)
        table = F.when(F.rlike(number, F.lit("^[0-9]+$")), F.get("_tables", number.try_cast("int")))
        head = F.when(k + 1 == F.col("_first"), F.concat(F.lit("# Title: **"), said, F.lit("**"))).otherwise(F.concat(F.lit("## **"), said, F.lit("**")))
        shown = F.when(kind == "subtitle-level-1", head).when(kind == "title", F.concat(F.lit("# **"), said, F.lit("**"))).when(kind == "paragraph", paragraph).when(kind == "table", text(table)).otherwise(said)
        later = F.filter(F.slice("elements", k + 1, F.size("elements")), lambda x: page(x).isNotNull())
        return F.struct(kind.alias("kind"), shown.alias("text"), tx.word_count(shown).cast("long").alias("words"), page(e).alias("page"), (F.size(e["prov"]) > 0).alias("told"), F.when(kind == "table", page(F.get(later, F.lit(0)))).alias("after"))

    out = out.withColumn("_first", subtitle).withColumn("_parts", F.transform(F.coalesce("elements", F.array().cast(df.schema["elements"].dataType)), part))
    joined = lambda held: F.array_join(held, "\n\n")
    none, no_words = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    number = F.lit(None).cast("long")
    tokens = tx.tokens_from_words  # words of texts that are joined add up
    state = lambda chunks, held, words, page, seen, ended: F.struct(chunks.alias("chunks"), held.alias("held"), words.alias("words"), page.cast("long").alias("page"), seen.cast("long").alias("seen"), ended.alias("ended"))

    def add(s: Column, e: Column) -> Column:
        held = s["held"]
        own = F.when(e["kind"] == "table", F.coalesce(e["after"], s["seen"])).otherwise(F.when(e["told"], e["page"]).otherwise(s["page"]))
        last = F.element_at(held, -1)
        turned = (s["page"].isNotNull() & ~own.eqNullSafe(s["page"])) if by_page else F.lit(False)
        words = s["words"]
        full = (F.size(held) > 1) & (tokens(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)) >= max_tokens)
        big = tokens(F.element_at(words, -1)) >= max_tokens
        chunks = F.when(turned, F.concat(s["chunks"], F.array(joined(held)))).when(full & big, F.concat(s["chunks"], F.array(joined(F.slice(held, F.lit(1), F.size(held) - 1)), last))).when(full, F.concat(s["chunks"], F.array(joined(F.slice(held, F.lit(1), F.size(held) - 1))))).otherwise(s["chunks"])
        kept = F.when(turned | (full & big), none).when(full, F.array(last)).otherwise(held)
        counts = F.when(turned | (full & big), no_words).when(full, F.array(F.element_at(words, -1))).otherwise(words)
        ends = F.lit(False)
        for end in ENDS:
            ends = ends | e["text"].contains(end)
        seen = F.coalesce(e["page"], s["seen"])
        taken = state(chunks, F.when(ends, kept).otherwise(F.concat(kept, F.array(e["text"]))), F.when(ends, counts).otherwise(F.concat(counts, F.array(e["words"]))), own, seen, ends)
        return F.when(s["ended"], s).when(e["kind"].isin(*SKIPPED), state(s["chunks"], held, words, s["page"], seen, F.lit(False))).when(e["kind"].isin(*TAKEN), taken).otherwise(state(s["chunks"], held, words, own, seen, F.lit(False)))

    out = out.withColumn("_state", F.aggregate("_parts", state(none, none, no_words, number, number, F.lit(False)), add))
    last = joined(F.col("_state.held"))
    rest = F.when((last != "") & ~F.array_contains("_state.chunks", last), F.array(last)).otherwise(none)
    return out.withColumn("chunks", F.concat(F.filter("_state.chunks", lambda c: c != ""), rest)).select(*df.columns, "chunks")


def seed_examples(config: dict) -> list[dict[str, str]]:
    """Few-shot columns of a document configuration: a context and three questions with answers for each example."""
    out = []
    for e in config["seed_examples"]:
        pairs = e["questions_and_answers"]
        if len(pairs) < 3:
            raise ValueError("an example needs three questions with answers")
        row = {"icl_document": e["context"]}
        for k, pair in enumerate(pairs[:3], 1):
            row |= {f"icl_query_{k}": pair["question"], f"icl_response_{k}": pair["answer"]}
        out.append(row)
    return out


def seeds_from_parsed(parsed: DataFrame, config: dict, max_tokens: int = 500, context: int = 4096, words: int = 1024, min_tokens: int = 100, split_over: int = 1024, count: Callable[[str], int] | None = None) -> DataFrame:
    """Seed rows of parsed documents: folded, short texts appended, with each example; texts of more than split_over
    tokens are chunked, and short ones dropped. count: a tokenizer's length, in place of the words rule."""
    spark = parsed.sparkSession
    texts = fused(folded(parsed, max_tokens, count=count), "file", "place", "text", 200).withColumnRenamed("text", "document")
    title = F.regexp_extract("file", r"^([^.]*)", 1)
    texts = texts.withColumns({"document_outline": F.lit(config["document_outline"]), "document_title": title, "domain": F.lit(config["domain"])})
    long = tx.token_count("document", count) > split_over
    whole = texts.where(~F.coalesce(long, F.lit(False))).withColumn("chunk", F.lit(0))
    texts = chunked(texts.where(long), "document", context, words, "chunk").unionByName(whole)
    kept = filters.min_tokens(texts, "document", min_tokens, count)
    return reshape.with_examples(kept, spark.createDataFrame(seed_examples(config)), "example")


def leaf_samples(leaves: DataFrame, context: int = 4096, words: int = 1024, pairs: int = 3) -> tuple[DataFrame, DataFrame]:
    """Knowledge rows (each chunk with each example) and skill rows of a taxonomy."""
    knowledge = leaves.where(F.col("document").isNotNull())
    icl = {c: F.get(F.col("questions_and_answers"), F.lit(k))[f].alias(c) for k in range(pairs) for c, f in ((f"icl_query_{k + 1}", "question"), (f"icl_response_{k + 1}", "answer"))}
    made = knowledge.withColumn("_text", F.explode("document"))
    rows = made.select("taxonomy_path", "ordinal", F.col("_text").alias("document"), "document_outline", "domain", F.col("context").alias("icl_document"), *icl.values())
    skills = leaves.where(F.col("document").isNull()).select("taxonomy_path", "ordinal", "task_description", F.col("context").alias("seed_context"), F.col("question").alias("seed_question"), F.col("answer").alias("seed_response"))
    return chunked(rows, "document", context, words, "chunk"), skills
