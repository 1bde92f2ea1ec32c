"""Readers and writers: JSON Lines, folders of checkpoints, parsed documents, taxonomies, YAML, reports."""

from __future__ import annotations

import hashlib
import json
import logging
import subprocess
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

log = logging.getLogger("corpusloom")


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """JSON Lines from a file, a folder or several. With a schema no pass over the data is made to infer one."""
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path if isinstance(path, str) else list(path))


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """All JSON Lines in a folder; None for an empty or a missing one."""
    try:
        df = read_jsonl(spark, path, schema)
        return df if df.columns and not df.isEmpty() else None
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


RESOLVERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def read_named(spark: SparkSession, name: str) -> DataFrame:
    """A JSON Lines path, or a name with a registered scheme (`hub:name`) for sets that live elsewhere."""
    scheme, _, rest = name.partition(":")
    return RESOLVERS[scheme](spark, rest) if scheme in RESOLVERS and rest else read_jsonl(spark, name)


def rows(spark: SparkSession, values: list[dict[str, Any]] | dict[str, list], schema: T.StructType | str | None = None) -> DataFrame:
    """A table from literal rows, or from columns."""
    if isinstance(values, dict):
        values = [dict(zip(values, row, strict=True)) for row in zip(*values.values(), strict=True)]
    return spark.createDataFrame(values, schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """JSON Lines with null fields kept; one file only if that is asked for."""
    (df.coalesce(files) if files else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_yaml(path: str | Path):
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def write_yaml(value, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(value, sort_keys=False, allow_unicode=True), encoding="utf-8")


def read_json(path: str | Path):
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_json(value, path: str | Path, mode: str = "w", indent: int = 4, default=str) -> None:
    """A dict or list as JSON, a string as it is."""
    if not isinstance(value, (dict, list, str)):
        raise ValueError(f"a {type(value).__name__} can't be written")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode, encoding="utf-8") as f:
        f.write(value if isinstance(value, str) else json.dumps(value, indent=indent, default=default))


def evaluation_task(name: str, data: str, path: str | Path) -> None:
    """The descriptor of a multiple-choice evaluation task."""
    write_yaml({"task": name, "dataset_kwargs": {"data_files": {"test": data}}, "include": "_default_mmlu_pr_template_yaml", "group": "mmlu_pr"}, path)


def paired(left: DataFrame, right: DataFrame, text: str, titles: tuple[str, str] = ("left", "right"), ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, report): a piece of Markdown for each pair of rows of two results with one ordinal."""
    both = left.select(ordinal, F.col(text).alias("_l")).join(right.select(ordinal, F.col(text).alias("_r")), ordinal)
    part = lambda title, c: F.concat(F.lit(f"### {title}\n\n"), F.coalesce(c, F.lit("")), F.lit("\n"))
    return both.select(ordinal, F.concat(F.lit("## "), F.col(ordinal).cast("string"), F.lit("\n\n"), part(titles[0], "_l"), F.lit("\n"), part(titles[1], "_r")).alias("report"))


def side_by_side(left: DataFrame, right: DataFrame, text: str, titles: tuple[str, str] = ("left", "right"), ordinal: str = "ordinal") -> str:
    """All pairs of two small results in one Markdown text; for large ones, write the rows of `paired`."""
    return "\n".join(r["report"] for r in paired(left, right, text, titles, ordinal).orderBy(ordinal).toLocalIterator())


def model_family(forced: str | None, path: str, families: Mapping[str, str], default: str) -> str:
    """The family of a model: what the first word of its file's name is mapped to."""
    import re

    if forced and forced.lower() not in families:
        raise ValueError(f"unknown model family {forced}")
    return families.get(re.match(r"\w*", Path(path).name)[0].lower(), families.get(default, default))


# Parsed documents

CELL = "array<array<struct<text: string>>>"
PARSED = f"`main-text` array<struct<type: string, text: string, `$ref`: string, prov: array<struct<page: int>>>>, tables array<struct<text: string, data: {CELL}>>"


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents: file, elements (in order) and tables."""
    df = spark.read.schema(PARSED).option("multiLine", True).json(path)
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("main-text").alias("elements"), "tables")


# Taxonomies

LEAF = "taxonomy_path string, ordinal long, task_description string, domain string, document array<string>, document_outline string, context string, question string, answer string, questions_and_answers array<struct<question: string, answer: string>>"
LEAF_COLUMNS = ("taxonomy_path", "ordinal", "task_description", "domain", "document", "document_outline", "context", "question", "answer", "questions_and_answers")
ROOTS = ("compositional_skills", "knowledge")


def changed_files(repo: str, base: str) -> list[str]:
    """YAML files of a taxonomy that are untracked, or changed since the merge base."""
    git = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, text=True).stdout.split("\n")
    found = git("ls-files", "--others", "--exclude-standard") + git("diff", "--name-only", "--diff-filter=d", f"{git('merge-base', base, 'HEAD')[0]}")
    return sorted({f for f in found if f.endswith((".yaml", ".yml")) and f.split("/")[0] in ROOTS})


def fetch_documents(source: dict[str, Any], folder: str) -> list[str]:
    """The Markdown files of a document source: a repository, a commit and patterns. A commit is fetched once."""
    place = Path(folder) / hashlib.sha256(f"{source['repo']} {source['commit']}".encode()).hexdigest()[:16]
    if not (place / ".git").exists():
        subprocess.run(["git", "clone", "--quiet", "--no-checkout", source["repo"], str(place)], check=True)
    subprocess.run(["git", "-C", str(place), "checkout", "--quiet", source["commit"]], check=True)
    found = sorted({p for pattern in source["patterns"] for p in place.glob(pattern) if p.is_file() and p.suffix.lower() == ".md"})
    if not found:
        raise ValueError(f"no documents in {source['repo']} match {source['patterns']}")
    return [p.read_text(encoding="utf-8") for p in found]


# Fixed values of the file format: what a knowledge or a skill file must have, and how many examples and questions.
REQUIRED = {"knowledge": ("version", "created_by", "domain", "document_outline", "document", "seed_examples"), "compositional_skills": ("version", "created_by", "task_description", "seed_examples")}
EXAMPLES, QUESTIONS = 5, 3


def check_schema(value: Any, path: str) -> list[str]:
    """What in a taxonomy file departs from the format of its kind, which the first folder of its path tells."""
    if not isinstance(value, dict):
        return ["not a mapping"]
    kind = Path(path).parts[0] if Path(path).parts[0] in REQUIRED else "knowledge" if "document" in value else "compositional_skills"
    out = [f"{f} is missing" for f in REQUIRED[kind] if value.get(f) in (None, "")]
    if "version" in value and not (isinstance(value["version"], int) and value["version"] >= 1):
        out.append("version is no number of a format")
    seeds = value.get("seed_examples") if isinstance(value.get("seed_examples"), list) else []
    if len(seeds) < EXAMPLES:
        out.append(f"seed_examples: {len(seeds)} of at least {EXAMPLES}")
    if kind == "knowledge":
        source = value.get("document") if isinstance(value.get("document"), dict) else {}
        out += [f"document.{f} is missing" for f in ("repo", "commit", "patterns") if not source.get(f)]
        for k, s in enumerate(seeds):
            if not s.get("context"):
                out.append(f"seed example {k}: context is missing")
            if len(s.get("questions_and_answers") or ()) < QUESTIONS:
                out.append(f"seed example {k}: fewer than {QUESTIONS} questions")
    return out


def check_leaf(value: Any) -> list[str]:
    """What is wrong with a taxonomy file."""
    if not isinstance(value, dict):
        return ["not a mapping"]
    out = []
    seeds = value.get("seed_examples")
    if not isinstance(seeds, list) or not seeds:
        return ["no seed_examples"]
    for k, s in enumerate(seeds):
        pairs = s.get("questions_and_answers")
        for pair in pairs if pairs is not None else [s]:
            if not pair.get("question") or not pair.get("answer"):
                out.append(f"seed example {k}: question or answer is missing")
    return out


def leaf_rows(path: str | Path, root: str | Path, documents: Callable[[dict], list[str]] | None = None, strict: bool = False) -> list[tuple]:
    """The seed rows of one taxonomy file, in the order of LEAF's columns. strict: the format's rules hold too."""
    value = read_yaml(path)
    relative = str(Path(path).resolve().relative_to(Path(root).resolve()))
    if wrong := check_leaf(value) + (check_schema(value, relative) if strict else []):
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    place = "->".join(Path(path).resolve().relative_to(Path(root).resolve()).parent.parts)
    source = value.get("document")
    docs = documents(source) if source and documents else None
    out = []
    for s in value["seed_examples"]:
        pairs = [(p["question"], p["answer"]) for p in s.get("questions_and_answers") or ()]
        out.append((place, len(out), value.get("task_description"), value.get("domain"), docs, value.get("document_outline"), s.get("context"), s.get("question"), s.get("answer"), pairs or None))
    return out


def taxonomy_files(path: str, base: str | None = None) -> tuple[list[str], str]:
    """One file, all files of a folder, or those changed against a base; and the folder."""
    root = Path(path)
    if root.is_file():
        return [str(root)], str(root.parent)
    found = [root / f for f in changed_files(path, base)] if base else sorted(p for r in ROOTS for p in (root / r).rglob("*.y*ml"))
    return [str(f) for f in found], path


def read_taxonomy(spark: SparkSession, path: str, base: str | None = None, documents: Callable[[dict], list[str]] | None = None, strict: bool = False) -> DataFrame:
    """The rows of one file, of all files of a folder, or of those changed against a base. Files are read in tasks; with strict,
    the format's rules are checked before."""
    if strict:
        names, root = taxonomy_files(path, base)
        for n in names:
            leaf_rows(n, root, strict=True)
    if documents is None:
        from corpusloom.sources import remote

        chosen = {"strict": str(strict)} | ({"base": base} if base else {})
        return remote.register(spark).read.format("taxonomy").options(**chosen).load(path)
    names, root = taxonomy_files(path, base)
    listed = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 64)), "name")
    kinds = to_arrow_schema(T.StructType.fromDDL(LEAF))
    pairs = LEAF_COLUMNS.index("questions_and_answers")
    named = lambda row: dict(zip(LEAF_COLUMNS, [*row[:pairs], [{"question": q, "answer": a} for q, a in row[pairs]] if row[pairs] else None], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["name"].to_pylist():
                found = leaf_rows(name, root, documents, strict)
                yield pa.RecordBatch.from_pylist([named(r) for r in found], kinds)

    return listed.mapInArrow(run, LEAF)
